"""Word and shingle kernels over whole Arrow text columns, in NumPy.

A word is a maximal run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` of the lower-cased text: ASCII letters and digits and every other
character outside ASCII. Words are 64-bit hashes; texts stay bytes. Nulls count as empty texts. Memory follows the longest text of
a chunk, not the batch.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20                      # bytes of text handled at once; one longer text is a chunk of its own
SHINGLE = 5                          # words to a shingle

_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
_IS_WORD[48:58] = True
_IS_WORD[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _u(x):
    return np.uint64(x)


def mix(h):
    """Finaliser that spreads every input bit (array of uint64)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _u(33))
        h = h * _u(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _u(33))
        h = h * _u(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _u(33))


_BASE = 0x5851F42D4C957F2D


def _powers(n):
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = _u(_BASE)
        np.multiply.accumulate(out, out=out)
    return out


_MULT = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | _u(1)


def chunks(column, limit=CHUNK, most=1 << 20):
    """Yield (first row, offsets, bytes) for runs of at most `most` rows of an Arrow string column; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n, a + most)
        yield a, off[a:b + 1] - off[a], data[off[a]:off[b]]
        a = b


_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def hash_spans(data, starts, ends):
    """64-bit hash of each byte span [start, end), eight bytes at a time."""
    lens = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lane = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = lens.astype(np.uint64) * _u(0x9E3779B97F4A7C15)
        out = (out ^ (lane[starts] & _MASK[np.minimum(lens, 8)])) * _u(_BASE)
        out ^= out >> _u(29)
        live, k = np.flatnonzero(lens > 8), 8
        while len(live):
            h = (out[live] ^ (lane[starts[live] + k] & _MASK[np.minimum(lens[live] - k, 8)])) * _u(_BASE)
            out[live] = h ^ (h >> _u(29))
            k += 8
            live = live[lens[live] > k]
    return mix(out)


def word_bounds(data, offsets):
    """Start and end bytes of the words of each text, and the index of each text's first word; lowers A-Z first."""
    data = _LOWER[data]
    is_word = _IS_WORD[data]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    first[inside] |= is_word[inside]
    last[inside - 1] |= is_word[inside - 1]
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def rows_of(offsets):
    """The text that each byte (or word) belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def words(column, unicode_lower=True, limit=CHUNK):
    """Yield (first row, index of each text's first word (one more than texts), word hashes, bytes, starts, ends)."""
    if unicode_lower:
        column = pc.utf8_lower(column.cast(pa.large_string()))
    for row, offsets, data in chunks(column, limit):
        data, starts, ends, begins = word_bounds(data, offsets)
        yield row, begins, hash_spans(data, starts, ends), data, starts, ends


def hash_words(text):
    """Word hashes of one text, as `words` gives them."""
    for _, _, h, _, _, _ in words(pa.array([text], pa.large_string())):
        return h
    return np.zeros(0, np.uint64)


def windows(h, k):
    """Hash of each window of k consecutive words, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * _MULT[0]
        for j in range(1, k):
            out += h[j:n + j] * _MULT[j]
    return mix(out)


def shingles(h, k=SHINGLE):
    """Shingle hashes of one text; a text of fewer than k words has one shingle of all its words, one of none has none."""
    if 0 < len(h) < k:
        return windows(h, len(h)) ^ _u(len(h))
    return windows(h, k)


def sequence_hash(h):
    """One hash of a whole sequence of words."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([(h * _powers(len(h))).sum() if len(h) else 0], np.uint64) + _u(len(h)))[0])


def signed(h):
    return h.view(np.int64)


def strings(column):
    """An Arrow column as a list of str with nulls as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


_PIECE = 1 << 12


def hash_counts(rows, hashes, bits):
    """How many hashes fall into each of 2^bits buckets; `hashes(batch)` gives arrays of a batch of `rows`. One table a task, added up by pieces."""
    def count(batches):
        table = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for h in hashes(batch):
                table += np.bincount((h >> _u(64 - bits)).astype(np.intp), minlength=len(table))
        for k in range(0, len(table), _PIECE):
            piece = table[k:k + _PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["piece", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(c, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["piece", "counts"])

    schema = "piece long, counts binary"
    table = np.zeros(1 << bits, np.int64)
    for r in rows.mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).collect():   # pieces of 32 KB
        table[r.piece:r.piece + _PIECE] = np.frombuffer(r.counts, np.int64)
    return table
