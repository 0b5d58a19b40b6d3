"""Ranked lexical search over bit-sliced Bloom signatures.

Every document gets a Bloom bitmap of its terms, entered once for each power of two that their count reaches. Searching turns the bitmaps of
documents of one width into slices, one bit row over the documents to each bit position. ANDing a term's slices says which documents may hold it and at
most how often, never too little; the terms' weights summed over the slices bound the score from above. The documents of the highest bounds are
scored exactly, which gives each item a score that its last place has to reach; then every document whose bound is not below it is scored exactly
from its text. So the result is that of scoring all documents.

Terms are maximal runs of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]` with A-Z lower-cased, known by 64-bit hashes. Items are held in blocks of
bounded size, each of which takes its own passes over the index; all that is gathered or broadcast is bounded by a block.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import text as tx

BEST = 50
HASHES = 4
BITS_EACH = 10                       # bits to an entry at least; the width is the next power of two
LEAST_BITS, MOST_BITS = 8, 26        # as powers of two
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 15
CELLS = 1 << 23                      # bits turned, and (term, document) cells held, at once
_KEYS = tx.mix(np.arange(1301, 1301 + HASHES, dtype=np.uint64)) | np.uint64(1)
_LAST = np.iinfo(np.int64).max       # stands for a null id, which ranks last among equals


def positions(h, level, width):
    """Bit positions (entries x HASHES) of terms at a level in signatures of 2 ** width bits; width is a number or one for each entry."""
    with np.errstate(over="ignore"):
        x = tx.mix(h + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return ((x[:, None] * _KEYS) >> (np.uint64(64) - np.asarray(width, np.uint64).reshape(-1, 1))).astype(np.int64)


def counted(begins, h):
    """(text, term, times) of the distinct terms of each text."""
    row = tx.rows_of(begins)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def signatures(begins, h):
    """Packed bitmaps of the texts of a chunk, one after another, and where each ends."""
    row, term, times = counted(begins, h)
    levels = np.frexp(times.astype(np.float64))[1]           # a term of count c is entered at the levels 0 .. log2 c
    entries = np.bincount(row, levels, len(begins) - 1).astype(np.int64)
    width = np.clip(np.ceil(np.log2(np.maximum(entries, 1) * BITS_EACH)), LEAST_BITS, MOST_BITS).astype(np.int64)
    ends = np.cumsum(1 << width)
    begin = ends - (1 << width)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    row, term = np.repeat(row, levels), np.repeat(term, levels)
    bits = np.zeros(ends[-1] if len(ends) else 0, bool)
    bits[(positions(term, level, width[row]) + begin[row][:, None]).ravel()] = True
    return np.packbits(bits, bitorder="little"), ends // 8


def sign(docs, text="text"):
    """(doc_id, n, bits, text) of the documents with at least one term; n counts terms with repeats."""
    def run(batches):
        for batch in batches:
            for row, begins, h, *_ in tx.words(batch.column(1), unicode_lower=False):
                packed, ends = signatures(begins, h)
                n = np.diff(begins)
                part = batch.slice(row, len(n))
                bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), bits, part.column(1)], schema.names).filter(pa.array(n > 0))

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("text", T.StringType())])
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


class Items:
    """A block of items: their distinct terms, and which terms each one has. After `weigh` also the terms' weights and the corpus's sizes."""

    def __init__(self, texts):
        terms = [np.unique(tx_terms(t)) for t in texts]
        self.terms = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        self.of = [np.searchsorted(self.terms, t) for t in terms]
        pair_item = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        pair_term = np.concatenate(self.of) if terms else np.zeros(0, np.int64)
        order = np.argsort(pair_term, kind="stable")
        self.items = pair_item[order]                                     # items of each term, term by term
        self.begin = np.searchsorted(pair_term[order], np.arange(len(self.terms) + 1))

    def weigh(self, df, n_docs, n_terms):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.where(df > 0, np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))), 0).astype(np.int64)
        return self

    def lookup(self, h):
        """Index of each hash among the terms, or -1."""
        at = np.minimum(np.searchsorted(self.terms, h), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == h, at, -1) if len(self.terms) else np.full(len(h), -1)

    def damping(self, n):
        return 100 - 50 + (50 * n * self.n_docs) // self.n_terms

    def bounds(self, n, signatures):
        """Upper bounds (items x documents) of the scores of documents of one signature width."""
        raw = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
        width = int(raw.shape[1] * 8).bit_length() - 1
        slices = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)     # one row of documents to each bit position
        m = self.damping(n)
        most = int(n.max()).bit_length()
        times = (1 << np.arange(most + 1, dtype=np.int64)) - 1                            # a term met at k levels occurs 2 ** k - 1 times at most
        factor = (10 ** 9 * times[:, None]) // np.maximum(1000 * times[:, None] + 20 * m, 1)
        out, step = np.zeros((len(self.of), len(n)), np.int64), max(1, CELLS // max(len(n), 1))
        for a in range(0, len(self.terms), step):
            h = self.terms[a:a + step]
            levels = np.zeros((len(h), len(n)), np.int8)
            live, held = np.arange(len(h)), None
            for level in range(most):
                now = np.bitwise_and.reduce(slices[positions(h[live], level, width)], axis=1)
                if held is not None:
                    now &= held
                some = now.any(1)
                live, held = live[some], now[some]
                if not len(live):
                    break
                levels[live] += np.unpackbits(held, axis=1, count=len(n)).view(np.int8)
            gain = factor[levels, np.arange(len(n))] * self.weight[a:a + step, None]
            for i, of in enumerate(self.of):
                own = of[(of >= a) & (of < a + step)] - a
                if len(own):
                    out[i] += gain[own].sum(0)
        return out

    def scores(self, n, column):
        """Exact scores (documents x items) of whole texts."""
        out = np.zeros((len(n), len(self.of)), np.int64)
        m = self.damping(n)
        for row, begins, h, *_ in tx.words(column, unicode_lower=False):
            at = self.lookup(h)
            key, times = np.unique(tx.rows_of(begins)[at >= 0] * len(self.terms) + at[at >= 0], return_counts=True)
            if len(key):
                doc, term = key // len(self.terms) + row, key % len(self.terms)
                gain = self.weight[term] * ((10 ** 9 * times) // (1000 * times + 20 * m[doc]))
                many = self.begin[term + 1] - self.begin[term]
                place = np.repeat(self.begin[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                np.add.at(out, (np.repeat(doc, many), self.items[place]), np.repeat(gain, many))
        return out


def tx_terms(text):
    for _, _, h, *_ in tx.words(pa.array([text], pa.large_string()), unicode_lower=False):
        return h
    return np.zeros(0, np.uint64)


class Best:
    """The documents of highest value of each item seen so far: value, then smaller id."""

    def __init__(self, n_items, size, floor):
        self.values, self.ids = np.zeros((n_items, size), np.int64), np.full((n_items, size), _LAST)
        self.size, self.floor = size, np.maximum(floor, 1)

    def add(self, values, ids):
        """values: items x documents; those below the floor take no part. The floor rises to the last of a full list."""
        some = np.flatnonzero((values >= self.floor[:, None]).any(1))
        if not len(some):
            return
        v = np.where(values[some] >= self.floor[some, None], values[some], 0)
        v, d = np.concatenate([self.values[some], v], 1), np.concatenate([self.ids[some], np.broadcast_to(ids, v.shape)], 1)
        order = np.lexsort((d, -v), axis=-1)[:, :self.size]
        self.values[some], self.ids[some] = np.take_along_axis(v, order, 1), np.take_along_axis(d, order, 1)
        self.floor[some] = np.maximum(self.floor[some], self.values[some, -1])

    def batch(self, names):
        item, place = np.nonzero(self.values)
        ids = self.ids[item, place]
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == _LAST), pa.array(self.values[item, place])], names)


def _widths(batch):
    """Rows of a batch (doc_id, n, bits, ..) by signature width, as many at once as the turned bits allow: (rows, ids, n, signatures)."""
    import pyarrow.compute as pc
    ids = pc.fill_null(batch.column(0).cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)
    n = batch.column(1).to_numpy(zero_copy_only=False)
    size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        step = int(max(8, min(1024, CELLS // (s * 8))))
        for a in range(0, len(rows), step):
            part = rows[a:a + step]
            yield part, ids[part], n[part], [batch.column(2)[int(i)].as_buffer() for i in part]


_TOP = "item int, doc_id long, score long"
_NAMES = ["item", "doc_id", "score"]


def highest_bounds(signed, block, best=BEST):
    """(item, doc_id, score) of the documents of highest upper bound of each item; score is the bound."""
    shared = signed.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        items = shared.value
        top = Best(len(items.of), best, np.ones(len(items.of), np.int64))
        for batch in batches:
            for _, ids, n, bits in _widths(batch):
                top.add(items.bounds(n, bits), ids)
        yield top.batch(_NAMES)

    return _first(signed.select("doc_id", "n", "bits").mapInArrow(run, _TOP), best)


def exact_best(signed, block, floor, best=BEST):
    """(item, doc_id, score, rank) of the documents of highest exact score of each item, among those whose bound reaches `floor`."""
    shared = signed.sparkSession.sparkContext.broadcast((block, floor))

    def run(batches):
        items, least = shared.value
        top = Best(len(items.of), best, least.copy())
        for batch in batches:
            for rows, ids, n, bits in _widths(batch):
                bound = items.bounds(n, bits)
                open_ = np.flatnonzero((bound >= top.floor[:, None]).any(0))
                if len(open_):
                    top.add(items.scores(n[open_], batch.column(3).take(pa.array(rows[open_]))).T, ids[open_])
        yield top.batch(_NAMES)

    return _first(signed.select("doc_id", "n", "bits", "text").mapInArrow(run, _TOP), best)


def _first(rows, best):
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def frequencies(signed, block):
    """Number of documents that hold each term of the block: counts of each task, summed."""
    shared = signed.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        items = shared.value
        total = np.zeros(len(items.terms), np.int64)
        for batch in batches:
            for _, begins, h, *_ in tx.words(batch.column(0), unicode_lower=False):
                at = items.lookup(h)
                key = np.unique(tx.rows_of(begins)[at >= 0] * max(len(total), 1) + at[at >= 0])
                total += np.bincount(key % max(len(total), 1), minlength=len(total))
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], ["term", "df"])

    df = np.zeros(len(block.terms), np.int64)
    for r in signed.select("text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():     # one row a term of the block
        df[r.term] = r.df
    return df


def item_blocks(items, most_items, most_terms):
    """Lists of (id, text) of at most so many items and terms (one longer item is a block of its own)."""
    block, held = [], 0
    for r in items.toLocalIterator():
        n = len(np.unique(tx_terms(r[1] or "")))
        if block and (len(block) >= most_items or held + n > most_terms):
            yield block
            block, held = [], 0
        block.append((r[0], r[1] or ""))
        held += n
    if block:
        yield block


def search(docs, items, best=BEST, text="text", item_text="text", block_items=BLOCK_ITEMS, block_terms=BLOCK_TERMS):
    """(item_id, rank, doc_id, score): the `best` documents of score above 0 of every row of `items`, equal scores by ascending doc_id.

    doc_id is an integer column; a null id ranks last among equal scores. Rows that repeat an id are documents of their own, items that repeat an
    id each get their ranking. Null and empty texts have no terms: such a document counts nowhere, such an item gets no row. Empty tables give an
    empty result. Texts are read whole. Extra columns are left out, so clashing names do no harm. Items are read by the driver, block by block
    (a benchmark is small beside the documents); a block costs four passes over the index.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    out_schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    result = spark.createDataFrame([], out_schema)
    signed = materialize(spark, sign(docs, text), "signed")
    size = signed.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    if not size.n:
        return result
    for block in item_blocks(items.select("item_id", item_text), block_items, block_terms):
        own = Items([t for _, t in block])
        own.weigh(frequencies(signed, own), size.n, size.terms)
        seeds = materialize(spark, highest_bounds(signed, own, best), "seeds").select("doc_id").distinct()     # at most `best` an item of the block
        some = signed.join(F.broadcast(seeds), "doc_id", "left_semi")
        first = exact_best(some, own, np.ones(len(block), np.int64), best).where(F.col("rank") == best).select("item", "score").collect()
        floor = np.ones(len(block), np.int64)
        for r in first:
            floor[r.item] = r.score
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)]))
        found = exact_best(signed, own, floor, best).join(F.broadcast(ids), "item")
        result = result.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return result
