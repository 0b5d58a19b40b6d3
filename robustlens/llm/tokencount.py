"""Exact token counts of whole texts without moving a pre-token between tasks.

The piece model never joins across a blank's left edge or a line feed (`check_model` proves it on the vocabulary), so a text's count is the
sum over pre-tokens: blanks with what follows them, cut at line feeds. Two tiers stand between a pre-token and the encoder: a
broadcast table of the lengths of frequent pre-tokens, probed for a whole batch at once, then each worker's own cache; only what both miss
is encoded. Neither tier changes a count, so how the table is filled bears on speed alone.
"""
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import text as tx

TABLE_SIZE = 1 << 16      # frequent pre-tokens in the broadcast table, of 12 bytes each
TABLE_DOCS = 4000         # documents whose pre-tokens fill the table; speed only
CACHE_SIZE = 1 << 20      # pre-tokens a worker remembers before it starts anew
LIMIT = 4096
_BLANK, _FEED = 32, 10
_MARK = "▁".encode()


def check_model(processor):
    """Raise unless a piece holds a blank only at its left edge and no line feed, on which the split into pre-tokens rests."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if re.search("[^▁]▁", piece) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token")


def load(path):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def pretokens(column):
    """Yield (first row, index of each text's first pre-token, hashes, bytes, starts, ends, line feeds of each text).

    A text gets the blank that the model puts before it, and its own mark characters count as blanks; a null or empty text has no pre-token.
    """
    for row, off, data in tx.chunks(column):
        n = len(off) - 1
        full = np.flatnonzero(off[1:] > off[:-1])
        if _MARK in (raw := data.tobytes()):
            parts = [raw[off[i]:off[i + 1]].replace(_MARK, b" ") for i in range(n)]
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            data = np.frombuffer(b"".join(parts), np.uint8)
        data = np.insert(data, off[:-1][full], _BLANK)
        off = off + np.concatenate([[0], np.cumsum(np.isin(np.arange(n), full))])
        blank, feed = data == _BLANK, data == _FEED
        begin = ~feed
        begin[1:] &= feed[:-1] | (blank[1:] & ~blank[:-1])
        inner = off[(off > 0) & (off < len(data))]
        begin[inner] |= ~feed[inner]
        starts = np.flatnonzero(begin)
        stop = begin | feed
        stop[inner] = True
        stops = np.append(np.flatnonzero(stop), len(data))
        ends = stops[np.searchsorted(stops, starts, "right")]
        feeds = np.add.reduceat(np.append(feed, False), off[:-1]) * (off[1:] > off[:-1]) if n else np.zeros(0, int)
        yield row, np.searchsorted(starts, off), tx.hash_spans(data, starts, ends), data, starts, ends, feeds


class Counter:
    """Pre-token lengths: broadcast table first, then the worker's cache, then the encoder."""

    def __init__(self, path, table):
        self.path, (self.keys, self.lengths) = path, table
        self.cache, self.processor = {}, None

    def encode(self, spans):
        if self.processor is None:
            self.processor = load(self.path)
        # After a line feed the model adds no blank of its own: its two tokens stand before those of the span.
        return [len(x) - 2 for x in self.processor.encode(["\n" + s.decode() for s in spans], num_threads=1)]

    def __call__(self, hashes, data, starts, ends):
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        out = np.zeros(len(hashes), np.int64)
        out[hit] = self.lengths[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            keys, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            known = [self.cache.get(k, -1) for k in keys.tolist()]
            new = [i for i, k in enumerate(known) if k < 0]
            if new:
                if len(self.cache) + len(new) > CACHE_SIZE:
                    self.cache.clear()
                spans = [data[starts[j]:ends[j]].tobytes() for j in miss[first[new]]]
                for i, length in zip(new, self.encode(spans)):
                    known[i] = self.cache[int(keys[i])] = length
            out[miss] = np.array(known, np.int64)[back]
        return out


def frequent_table(docs, path, text="text", size=TABLE_SIZE, docs_read=TABLE_DOCS):
    """Sorted hashes and lengths of the pre-tokens seen most often in a few documents; at most `size` of them."""
    def local(batches):
        total = {}
        for batch in batches:
            for _, _, hashes, data, starts, ends, _ in pretokens(batch.column(0)):
                keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                for k, j, c in zip(keys.tolist(), first.tolist(), n.tolist()):
                    old = total.get(k)
                    total[k] = (old[0] + c, old[1]) if old else (c, data[starts[j]:ends[j]].tobytes())
        top = sorted(total.items(), key=lambda x: (-x[1][0], x[0]))[:size]
        yield pa.RecordBatch.from_arrays([pa.array([v[1] for _, v in top], pa.binary()), pa.array([v[0] for _, v in top], pa.int64())], ["span", "n"])

    n = docs.count()
    part = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(max(1, n // max(1, docs_read)))) == 0)
    rows = (part.mapInArrow(local, "span binary, n long").groupBy("span").agg(F.sum("n").alias("n")).where("n > 1")
            .orderBy(F.desc("n"), "span").limit(size).collect())
    spans = [bytes(r.span) for r in rows]
    lengths = np.array(Counter(path, (np.zeros(0, np.uint64), np.zeros(0, np.int32))).encode(spans) if spans else [], np.int32)
    ends = np.cumsum([len(s) for s in spans]).astype(np.int64)
    keys = tx.hash_spans(np.frombuffer(b"".join(spans), np.uint8), np.concatenate([[0], ends])[:-1].astype(np.int64), ends) if spans else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    return keys[order], lengths[order]


def count_tokens(docs, path, text="text", limit=LIMIT):
    """Add n_bytes, n_tokens and over_limit to every row of `docs`; all other columns but those three stay.

    A null or empty text counts 0 and 0. Texts of any length are encoded whole; repeated rows each get their row; an empty table
    gives an empty result. `path` is the piece model's file, which every worker must be able to read.
    """
    check_model(load(path))
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, text))
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    kept = [c for c in keep if c != text]

    def run(batches):
        counter = Counter(path, table.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n_bytes = np.array([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], np.int64)
            tokens = np.zeros(batch.num_rows, np.int64)
            for row, begins, hashes, data, starts, ends, feeds in pretokens(column):
                sums = np.concatenate([[0], np.cumsum(counter(hashes, data, starts, ends))])
                tokens[row:row + len(feeds)] = sums[begins[1:]] - sums[begins[:-1]] + feeds
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)],
                                             [*kept, "n_bytes", "n_tokens", "over_limit"])

    from pyspark.sql.types import BooleanType, LongType, StructField, StructType
    schema = StructType([docs.schema[c] for c in kept] + [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()),
                                                          StructField("over_limit", BooleanType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text")).mapInArrow(run, schema)
