"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A text is the set of its five-word shingles, weighted by count times inverse document frequency; frequencies come from all documents, in a
table of fixed size addressed by shingle hash. Consistent samples agree between two texts with the chance of their weighted Jaccard similarity;
bands of three samples make buckets. A bucket's texts are compared with its heads, then with those of other classes that share enough of their rarest
shingles (`graph.banded_links`). Links are verified weighted Jaccard
similarities; classes are their components. Equal texts are one node throughout.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import materialize
from . import text as tx
from .graph import banded_links, components

SIMILARITY = 0.8
BANDS, WIDTH = 9, 3
DF_BITS = 18                 # buckets of the frequency table: 2 MB whatever the corpus
_SLOTS = 1 << 16


def _uniform(seed):
    return (tx.mix(np.arange(1, _SLOTS + 1, dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 + 2.0 ** -54


_R = (-np.log(_uniform(1) * _uniform(2))).astype(np.float32)              # gamma(2, 1)
_LOG_C = np.log(-np.log(_uniform(3) * _uniform(4))).astype(np.float32)     # log of gamma(2, 1)
_BETA = _uniform(5).astype(np.float32)
_KEYS = tx.mix(np.arange(101, 101 + BANDS * WIDTH, dtype=np.uint64)) | np.uint64(1)


def samples(shingles, weights):
    """One consistent weighted sample for each key: a hash of the chosen shingle and its weight's level."""
    log_w = np.log(weights).astype(np.float32)
    best, out = np.full(len(_KEYS), np.inf, np.float32), np.zeros(len(_KEYS), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 4096):
            h = shingles[a:a + 4096]
            mixed = h * _KEYS[:, None]
            one, two = (mixed >> np.uint64(48)).astype(np.intp), ((mixed >> np.uint64(30)) & np.uint64(_SLOTS - 1)).astype(np.intp)
            r, beta = _R[one], _BETA[one]
            level = np.floor(log_w[a:a + 4096] / r + beta)
            cost = _LOG_C[two] - r * (level - beta + 1)
            at = cost.argmin(1)
            rows = np.arange(len(_KEYS))
            better = cost[rows, at] < best
            chosen = tx.mix(h[at] + level[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            best, out = np.where(better, cost[rows, at], best), np.where(better, chosen, out)
    return out


def band_keys(sample):
    """A hash of each band's samples."""
    with np.errstate(over="ignore"):
        s = sample.reshape(BANDS, WIDTH) * tx._MULT[:WIDTH]
        return tx.mix(s.sum(1) + np.arange(BANDS, dtype=np.uint64))


def counted(h):
    """Distinct shingles of a text's words, ascending, and their counts."""
    return np.unique(tx.shingles(h), return_counts=True)


class Frequencies:
    """Inverse document frequencies from the shared table."""

    def __init__(self, table, n):
        self.idf = 1 + np.log((n + 1) / (np.minimum(table, n) + 1))

    def weights(self, shingles, counts):
        return counts * self.idf[(shingles >> np.uint64(64 - DF_BITS)).astype(np.intp)]


def document_frequencies(docs, text="text"):
    """Number of documents' distinct shingles in each hash bucket, over all documents."""
    def hashes(batch):
        for _, begins, h, *_ in tx.words(batch.column(0)):
            yield np.concatenate([np.unique(tx.shingles(h[a:b])) for a, b in zip(begins, begins[1:])])

    return Frequencies(tx.hash_counts(docs.select(text), hashes, DF_BITS), docs.count())


def signatures(docs, frequencies, text="text"):
    """(doc_id, node, bands): node is the hash of the text, bands is null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches):
        f = shared.value
        for batch in batches:
            bands = []
            for _, begins, h, *_ in tx.words(batch.column(2)):
                for a, b in zip(begins, begins[1:]):
                    s, n = counted(h[a:b])
                    bands.append(tx.signed(band_keys(samples(s, f.weights(s, n)))) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType
    schema = StructType([docs.schema["doc_id"], StructField("node", LongType()), StructField("bands", ArrayType(LongType()))])
    return docs.select("doc_id", F.xxhash64(text).alias("node"), text).mapInArrow(run, schema)


def similarities(pairs, texts, frequencies):
    """(a, b, similarity): weighted Jaccard similarity of each pair (a, b) of nodes; `texts` has (node, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches):
        f, last = shared.value, (None, None)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            ids = batch.column(0).to_pylist()
            for row, begins, h, *_ in tx.words(batch.column(3)):
                for i in range(len(begins) - 1):
                    if ids[row + i] != last[0]:
                        s, n = counted(tx.hash_words(batch.column(2)[row + i].as_py() or ""))
                        last = ids[row + i], (s, f.weights(s, n))
                    s, n = counted(h[begins[i]:begins[i + 1]])
                    w, (s0, w0) = f.weights(s, n), last[1]
                    _, x, y = np.intersect1d(s, s0, assume_unique=True, return_indices=True)
                    common = np.minimum(w[x], w0[y]).sum()
                    out[row + i] = common / (w.sum() + w0.sum() - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similarity"])

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def weighted_shingles(texts, frequencies):
    """(node, text) and how a batch of it is read as (node, shingles, weights)."""
    shared = texts.sparkSession.sparkContext.broadcast(frequencies)

    def read(batch):
        for row, begins, h, *_ in tx.words(batch.column(1)):
            for i in range(len(begins) - 1):
                s, n = counted(h[begins[i]:begins[i + 1]])
                yield batch.column(0)[row + i].as_py(), s, shared.value.weights(s, n)

    return texts.select("node", "text"), read


def near_duplicates(docs, similarity=SIMILARITY, text="text"):
    """(doc_id, node, class_id, class_size) for every row of `docs`: class_id is the least doc_id of the row's class.

    Texts are lower-cased; one of fewer than five words has one shingle of all its words. Null, empty and wordless texts are each a class of
    their own. Equal texts are always together, whatever their ids; a null id never names a class that has another.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(text).alias("text"))
    f = document_frequencies(docs)
    signed = materialize(spark, signatures(docs, f), "signatures")

    texts = {}

    def prepare(nodes):
        holder = signed.where("bands IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node")
        node = docs.withColumn("node", F.xxhash64("text"))
        held = holder.select(F.col("node").alias("n"), F.col("doc_id").alias("d"))
        found = node.join(held, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("node", "text")
        texts["table"] = materialize(spark, found.dropDuplicates(["node"]), "texts")

    bands = signed.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "key")).distinct()
    roots = components(banded_links(bands, prepare, lambda pairs: similarities(pairs, texts["table"], f), similarity,
                                    lambda nodes: weighted_shingles(texts["table"].join(nodes, "node"), f)))
    rows = signed.join(roots, "node", "left").select("doc_id", "node", F.when(F.col("bands").isNotNull(), F.coalesce("root", "node")).alias("root"))
    rows = materialize(spark, rows, "rooted")
    # Written before it is joined: a side that aggregates by the join key keeps adaptive execution from splitting a hot class.
    classes = materialize(spark, rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    together = rows.where("root IS NOT NULL").join(classes, "root").select("doc_id", "node", "class_id", "class_size")
    return together.union(rows.where("root IS NULL").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long")))


def drop_near_duplicates(docs, similarity=SIMILARITY, text="text"):
    """`docs` with one row of each class: that of the class's least doc_id. Columns stay as they are; wordless texts all stay."""
    spark = docs.sparkSession
    classes = materialize(spark, near_duplicates(docs, similarity, text), "classes").where("class_size > 1")
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("of")).agg(F.min("node").alias("kept"), F.count(F.lit(1)).alias("times"))
    kept = materialize(spark, kept, "kept")
    marked = classes.join(kept, F.col("class_id").eqNullSafe(F.col("of")))
    gone = marked.where(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept")))).select(F.col("doc_id").alias("__d"), F.col("node").alias("__n")).distinct()
    node = F.xxhash64(F.col(text))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (node == F.col("__n")), "left_anti")
    if kept.where("times > 1").isEmpty():
        return out
    # Rows that repeat an id and its text: one of them stays.
    again = kept.where("times > 1").select(F.col("of").alias("__d"), F.col("kept").alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (node == F.col("__n"))
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", text]))
