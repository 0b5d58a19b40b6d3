"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. A task turns its rows into postings (for each component, the rows and their weights); every
component of a block of queries adds its weighted postings to dense score arrays, from which the k best of the task are selected by
partition. Windows merge the tasks' selections. Queries come in blocks of bounded size, one pass over the vectors for each.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

SCALE = 1024
_LONG = 1 << 63
QUERY_BLOCK = 4096       # queries that a worker holds at once
_AT_ONCE = 128           # queries whose score arrays are dense at once


def integer_rows(vectors, key="vec_id", vector="embedding", scale=SCALE):
    """(id, weights): floor(scale * component) in double precision; rows with a null vector or a null or non-finite component are left out. A weight
    that does not fit into a long fails the job."""
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    weight = lambda x: F.when(F.abs(scaled(x)) < F.lit(float(_LONG)), F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a weight does not fit into a long")).cast("long"))
    return vectors.where(finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, weight).cast("array<long>").alias("w"))


def postings(offsets, weights):
    """For each component that some row uses: its number, the rows (ascending) and their weights."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(weights)) - np.repeat(offsets[:-1] - offsets[0], size)
    used = np.flatnonzero(weights)
    order = used[np.argsort(term[used], kind="stable")]
    cut = np.flatnonzero(np.diff(term[order])) + 1
    return [(int(term[g[0]]), row[g], weights[g]) for g in np.split(order, cut) if len(g)]


class Queries:
    """A block of query rows by component."""

    def __init__(self, rows):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.dims = max([len(w) for _, w in rows], default=0)
        self.weights = np.zeros((len(rows), self.dims), np.int64)
        for k, (_, w) in enumerate(rows):
            self.weights[k, :len(w)] = w

    def best(self, ids, offsets, weights, k):
        """(query number, row, score) of the k best rows of each query, the query's own id left out; ties go to the smaller id.

        Where sums might leave 64 bits they are taken in whole numbers of any length; a score that does not fit into a long then raises.
        """
        most = np.zeros(self.dims)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        sorted_ids = ids[order]
        lists = [(t, rank[r], w) for t, r, w in postings(offsets, weights) if t < self.dims]
        for t, _, w in lists:
            most[t] = np.abs(w.astype(float)).max()
        for a in range(0, len(self.ids), _AT_ONCE):
            q = self.weights[a:a + _AT_ONCE]
            wide = len(q) and (np.abs(q.astype(float)) @ most).max() >= _LONG / 4
            kind = object if wide else np.int64
            q = q.astype(kind)
            score = np.zeros((len(q), len(ids)), kind)
            for t, r, w in lists:
                w = w.astype(kind)
                some = np.flatnonzero(q[:, t])
                if len(some) == len(q) and len(r) == len(ids):
                    dense = np.empty(len(ids), kind)
                    dense[r] = w
                    score += q[:, t, None] * dense
                elif len(some):
                    score[some[:, None], r[None, :]] += q[some, t, None] * w
            lo, hi = (np.searchsorted(sorted_ids, self.ids[a:a + len(q)], side) for side in ("left", "right"))
            if wide:
                for i in range(len(q)):
                    score[i, lo[i]:hi[i]] = 0      # no candidates
                if score.size and max(abs(score.max()), abs(score.min())) >= _LONG:
                    raise OverflowError("a score does not fit into a long")
                score = score.astype(np.int64)
            for i in range(len(q)):
                own = np.iinfo(np.int64).min
                score[i, lo[i]:hi[i]] = own
                cut = np.partition(score[i], len(ids) - k)[len(ids) - k] if len(ids) > k else own
                near = np.flatnonzero(score[i] >= cut)
                near = near[np.lexsort((near, -score[i, near]))][:k]
                near = near[score[i, near] != own]
                yield a + i, order[near], score[i, near]


def search(queries, vectors, k=10, query_block=QUERY_BLOCK):
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over `vectors` (both from `integer_rows`).

    Rows under the query's own id are no candidates; fewer candidates than k are all returned; a component that one side lacks counts 0.
    Queries that repeat an id are answered once, by the smallest vector; repeated vector rows are candidates each. Empty tables give none.
    """
    spark = vectors.sparkSession

    def blocks():
        rows = []
        for r in queries.groupBy("id").agg(F.min("w").alias("w")).toLocalIterator():
            rows.append((r.id, np.array(r.w, np.int64)))
            if len(rows) == query_block:
                yield Queries(rows)
                rows = []
        if rows:
            yield Queries(rows)

    def step(shared):
        def run(batches):
            block = shared.value
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                offsets = lists.offsets.to_numpy()
                weights = lists.values.to_numpy()[offsets[0]:offsets[-1]]
                for q, rows, score in block.best(ids, offsets - offsets[0], weights, k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block.ids[q])), pa.array(ids[rows]), pa.array(score)], ["query_id", "vec_id", "score"])
        return run

    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for b in blocks():
        out = out.unionByName(vectors.mapInArrow(step(spark.sparkContext.broadcast(b)), "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
