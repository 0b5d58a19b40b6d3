"""Benchmark decontamination by spaced seeds.

Each fixed mask keeps 8 of 12 consecutive words; a window's hash over the kept words meets that of a benchmark window even where ignored words
were replaced. Every hit names a diagonal (text position minus item position), along which words are compared one by one. With `whole`, as op2 and
the pipeline run it, every stretch of which at least 80% of the words agree counts as an overlap; without, the best-scoring stretch alone. Benchmarks are held in blocks of bounded size, one map-only pass for each.
"""
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

# Which of 12 consecutive words a seed keeps.
MASKS = ("110110110101", "101101011011", "111001011101")
SPAN = 12
MIN_WORDS = 5           # an item of fewer words can not be told from common phrases and takes no part
MIN_MATCHED = 13        # equal words of an overlap, or all words of a shorter item
MIN_SHARE = 0.8         # equal words among those of an overlap
BLOCK_WORDS = 1 << 21   # benchmark words held by a worker at once
_FILTER_BITS = 23


def seed_hashes(h, kept):
    """Hash of the kept words of every window of a word sequence."""
    n = len(h) - max(kept)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(kept) * 131 + max(kept), np.uint64)
    with np.errstate(over="ignore"):
        for k, j in enumerate(kept):
            out += h[j:j + n] * tx._MULT[k + 7]
    return tx.mix(out)


_KEPT = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]


class Block:
    """Seeds of some benchmark items, sorted, with the items' words."""

    def __init__(self, items, whole=False):
        self.whole = whole
        self.ids, self.words = [i for i, _ in items], [h for _, h in items]
        short = [(n, kept) for n in sorted({len(h) for h in self.words if len(h) < SPAN}) for kept in combinations(range(n), least_equal(n) if whole else n)]
        self.kept, self.tables = _KEPT + [kept for _, kept in short], []
        for n, kept in [(SPAN, kept) for kept in _KEPT] + short:
            owners = [k for k, h in enumerate(self.words) if min(len(h), SPAN) == n]
            seeds = [seed_hashes(self.words[k], kept) for k in owners]
            s = np.concatenate([np.zeros(0, np.uint64), *seeds])
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in seeds]])
            item = np.repeat(np.array(owners, np.int64), [len(x) for x in seeds]) if owners else np.zeros(0, np.int64)
            order = np.argsort(s, kind="stable")
            may = np.zeros(1 << _FILTER_BITS, bool)
            may[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((s[order], item[order], at[order], may))

    def overlaps(self, h, begins):
        """(text number, item number, first word, end word, item's first word, equal words) of a run of texts."""
        found = set()
        for kept, (seeds, item, at, may) in zip(self.kept, self.tables):
            s = seed_hashes(h, kept)
            if not len(s) or not len(seeds):
                continue
            pos = np.flatnonzero(may[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(seeds, s[pos], "left"), np.searchsorted(seeds, s[pos], "right")
            pos, lo, n = pos[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if len(pos):
                which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                pos = np.repeat(pos, n)
                row = np.searchsorted(begins, pos, "right") - 1
                inside = pos + max(kept) < begins[row + 1]
                found |= set(zip(row[inside].tolist(), item[which][inside].tolist(), (pos - at[which])[inside].tolist()))
        out = []
        for row, item, diagonal in sorted(found):
            if self.whole:
                out += [(row, item, *x) for x in align_all(h, begins[row], begins[row + 1], self.words[item], diagonal)]
            elif x := align(h, begins[row], begins[row + 1], self.words[item], diagonal):
                out.append((row, item, *x))
        return out


def align(h, begin, end, item, diagonal):
    """Best-scoring stretch (+1 equal, -3 not) of an item laid at `diagonal`: (first word, end word, item's first word, equal words) or None."""
    a, b = max(begin, diagonal), min(end, diagonal + len(item))
    equal = h[a:b] == item[a - diagonal:b - diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    low = np.minimum.accumulate(total)
    stop = int(np.argmax(total - low))
    start = int(np.argmin(total[:stop + 1]))
    matched = int(equal[start:stop].sum())
    if matched < min(MIN_MATCHED, len(item)) or matched < MIN_SHARE * (stop - start):
        return None
    return int(a + start - begin), int(a + stop - begin), int(a + start - diagonal), matched


def least_equal(n):
    """Equal words that an overlap with an item of n words needs: MIN_SHARE of a short item's."""
    return min(MIN_MATCHED, -(-n * 4 // 5))


def align_all(h, begin, end, item, diagonal):
    """As `align`, all disjoint stretches that begin and end on equal words, MIN_SHARE or more of them equal: the one of most equal words first,
    then those before and after it."""
    a, b = max(begin, diagonal), min(end, diagonal + len(item))
    equal = h[a:b] == item[a - diagonal:b - diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])    # not below its value at the start: at least 4 of 5 equal
    count, need = np.concatenate([[0], np.cumsum(equal)]), least_equal(len(item))
    out, todo = [], [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        if count[hi] - count[lo] < need:
            continue
        starts = lo + np.flatnonzero(equal[lo:hi])
        lowest = np.minimum.accumulate(total[starts])
        first = np.concatenate([[True], lowest[1:] < lowest[:-1]])
        begins, ends = starts[first], starts + 1
        begins = begins[np.searchsorted(-lowest[first], -total[ends])]      # the earliest start that is no higher than the end
        best = int(np.argmax(count[ends] - count[begins]))
        start, stop = int(begins[best]), int(ends[best])
        if count[stop] - count[start] >= need:
            out.append((int(a + start - begin), int(a + stop - begin), int(a + start - diagonal), int(count[stop] - count[start])))
            todo += [(lo, start), (stop, hi)]
    return sorted(out)


def blocks(benchmark, item="item_id", text="text", block_words=BLOCK_WORDS, whole=False):
    """Blocks of benchmark items of at most `block_words` words each (one longer item is a block of its own), read part by part."""
    out, size = [], 0
    for r in benchmark.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        h = tx.hash_words(r[1])
        if len(h) < MIN_WORDS:
            continue
        if out and size + len(h) > block_words:
            yield Block(out, whole)
            out, size = [], 0
        out.append((r[0], h))
        size += len(h)
    if out:
        yield Block(out, whole)


def find_overlaps(docs, benchmark, doc="doc_id", text="text", whole=False):
    """One row per (text, item, stretch) that overlaps: doc_id, item_id, first_word, end_word, item_word, n_matched.

    Only overlapping texts appear. Null and empty texts or items overlap nothing; an item of fewer than 5 words takes no part. With `whole` all
    stretches of at least 80% equal words and 13 equal words, or 80% of a shorter item's, are given; without it the best-scoring one of a
    diagonal, of 13 equal words or all of a shorter item's, and an item of fewer than 12 words has to stand whole and unchanged. Repeated rows each give their rows; ids may be null.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("first_word", "end_word", "item_word", "n_matched")])

    def step(shared):
        def run(batches):
            block = shared.value
            for batch in batches:
                for row, begins, h, *_ in tx.words(batch.column(1)):
                    got = block.overlaps(h, begins)
                    if got:
                        ids = batch.column(0).take(pa.array([row + g[0] for g in got]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([block.ids[g[1]] for g in got], _arrow(schema[1].dataType)),
                                                          *[pa.array([g[k] for g in got], pa.int64()) for k in range(2, 6)]], schema.names)
        return run

    parts = [docs.select(F.col(doc).alias("doc_id"), text).mapInArrow(step(spark.sparkContext.broadcast(b)), schema) for b in blocks(benchmark, **{"whole": True} if whole else {})]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def decontaminate(docs, benchmark, text="text", whole=False):
    """`docs` without the rows that overlap a benchmark item; every pass only filters, so nothing is shuffled. Columns stay as they are."""
    def step(shared):
        def run(batches):
            block = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, begins, h, *_ in tx.words(batch.column("__text")):
                    keep[[row + g[0] for g in block.overlaps(h, begins)]] = False
                yield batch.filter(pa.array(keep)).select(names)
        return run

    names = docs.columns
    for b in blocks(benchmark, **{"whole": True} if whole else {}):
        docs = docs.withColumn("__text", F.col(text)).mapInArrow(step(docs.sparkSession.sparkContext.broadcast(b)), docs.schema)
    return docs
