"""Repeated passages: paragraph MinHash with banding, exact Jaccard and components.

Paragraphs are the lines of a text of at least 20 words, and, as a passage may be pasted into the middle of a line, stretches of 24 words that start
at anchors: positions whose pair of words hashes least among 24 in a row. Any run of 48 words that two texts share holds the same stretch. A
paragraph's content is one node whatever its copies. Lines are banded by MinHash of their five-word shingles; a bucket's lines are compared with
its heads by exact Jaccard similarity on shingles, then with those of other classes that share enough of their rarest shingles (`graph.banded_links`). Stretches are alike only if equal, which their content hash says. Components of links are classes; of a class's places the
first (by doc_id, then position) stays.
"""
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import text as tx
from .graph import banded_links, components

SIMILARITY = 0.8
LINE_WORDS = 20
STRETCH = 24             # words of a stretch, and positions among which an anchor is least
BANDS, WIDTH = 7, 3      # a pair of similarity 0.8 meets in some band with chance 0.993
_KEYS = tx.mix(np.arange(701, 701 + BANDS * WIDTH, dtype=np.uint64)) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def sequences(h, starts, ends):
    """Hash of each word span [start, end)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(h) + 1
    up, down = np.full(n, np.uint64(_STEP)), np.full(n, np.uint64(_BACK))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1])])
        return tx.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lines(data, starts, begins, least=LINE_WORDS):
    """Word spans of the lines of at least `least` words."""
    cuts = np.unique(np.concatenate([begins, np.searchsorted(starts, np.flatnonzero(data == 10))]))
    keep = np.diff(cuts) >= least
    return cuts[:-1][keep], cuts[1:][keep]


def stretches(h, begins):
    """Word spans of anchored stretches. In a run of one repeated word only every 24th anchor is taken, as all its stretches are equal."""
    if len(h) <= STRETCH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = tx.rows_of(begins)
    pair = tx.windows(h, 2)
    inside = row[:len(pair) - STRETCH + 1] == row[STRETCH:]
    at = np.unique((sliding_window_view(pair, STRETCH).argmin(1) + np.arange(len(pair) - STRETCH + 1))[inside])
    at = at[at + STRETCH <= len(h)]
    at = at[row[at] == row[at + STRETCH - 1]]
    at = at[(at % STRETCH == 0) | (pair[at] != pair[np.maximum(at - 1, 0)]) | (at == 0)]
    return at, at + STRETCH


def line_bands(h, starts, ends):
    """Band keys of each line: a row of BANDS hashes."""
    if not len(starts):
        return np.zeros((0, BANDS), np.uint64)
    shingle = tx.windows(h, tx.SHINGLE)
    edges = np.stack([starts, ends - tx.SHINGLE + 1], 1).ravel()
    edges[-1] = min(edges[-1], len(shingle) - 1) if edges[-1] >= len(shingle) else edges[-1]
    last = int(ends[-1]) - tx.SHINGLE + 1 >= len(shingle)
    least = []
    with np.errstate(over="ignore"):
        for k in _KEYS:
            x = shingle * k
            x ^= x >> np.uint64(32)
            got = np.minimum.reduceat(x, edges)[::2]
            if last:
                got[-1] = x[starts[-1]:].min()
            least.append(got)
        s = np.stack(least, 1).reshape(len(starts), BANDS, WIDTH) * tx._MULT[:WIDTH]
        return tx.mix(s.sum(2) + np.arange(BANDS, dtype=np.uint64))


def paragraphs(docs, text="text"):
    """(doc_id, node, first_word, end_word, content, bands) of every paragraph; node is the text's hash, bands is null for stretches."""
    def run(batches):
        for batch in batches:
            for row, begins, h, data, starts, _ in tx.words(batch.column(2)):
                a, b = lines(data, starts, begins)
                c, d = stretches(h, begins)
                first, end = np.concatenate([a, c]), np.concatenate([b, d])
                owner = np.searchsorted(begins, first, "right") - 1
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([np.arange(len(a) + 1) * BANDS, np.full(len(c), len(a) * BANDS)]).astype(np.int32)),
                                                 pa.array(tx.signed(line_bands(h, a, b).ravel())))
                take = pa.array(row + owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((first - begins[owner]).astype(np.int32)),
                                                  pa.array((end - begins[owner]).astype(np.int32)), pa.array(tx.signed(sequences(h, first, end))), bands], schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("node", T.LongType()), T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
                           T.StructField("content", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", F.xxhash64(text).alias("node"), text).mapInArrow(run, schema)


def line_shingles(docs, wanted, text="text"):
    """(content, shingles) of each wanted line (content, node, doc_id, first_word, end_word), read from one text that holds it."""
    def run(batches):
        for batch in batches:
            out = []
            wants = batch.column(0).to_pylist()
            for row, begins, h, *_ in tx.words(batch.column(1)):
                for i in range(len(begins) - 1):
                    own = h[begins[i]:begins[i + 1]]
                    out += [(w["content"], tx.signed(np.unique(tx.shingles(own[w["first_word"]:w["end_word"]])))) for w in wants[row + i]]
            for k in range(0, len(out), 1000):
                part = out[k:k + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.int64()), pa.array([s for _, s in part], pa.list_(pa.int64()))], ["content", "shingles"])

    per = wanted.groupBy("doc_id", "node").agg(F.collect_list(F.struct("content", "first_word", "end_word")).alias("wants"))
    per = per.withColumnRenamed("doc_id", "d").withColumnRenamed("node", "n")
    held = docs.select("doc_id", F.xxhash64(text).alias("node"), text).join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("n")))
    return held.select("wants", text).mapInArrow(run, "content long, shingles array<long>").dropDuplicates(["content"])


def line_links(parts, docs, similarity=SIMILARITY):
    """(a, b) of different line contents that are alike."""
    spark, known = docs.sparkSession, {}
    rows = parts.where("bands IS NOT NULL")

    def prepare(nodes):
        first = rows.groupBy("content").agg(F.min(F.struct("node", "doc_id", "first_word", "end_word")).alias("p"))
        places = first.join(nodes.withColumnRenamed("node", "content"), "content").select("content", "p.*")
        known["shingles"] = materialize(spark, line_shingles(docs, places), "shingles")

    def compare(pairs):
        a, b = (known["shingles"].select(F.col("content").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
        return both.select("a", "b", (F.col("common") / (F.col("sizes") - F.col("common"))).alias("similarity"))

    def items(nodes):
        def read(batch):
            for node, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield node, s.values.to_numpy().view(np.uint64), np.ones(len(s))

        return known["shingles"].withColumnRenamed("content", "node").join(nodes, "node").select("node", "shingles"), read

    return banded_links(rows.select(F.col("content").alias("node"), F.posexplode("bands").alias("band", "key")).distinct(), prepare, compare, similarity, items)


def repeated_passages(docs, similarity=SIMILARITY, text="text"):
    """(doc_id, node, first_word, end_word, class_id, first_doc_id, removed) of every paragraph whose class has more than one place.

    removed is false at the class's first place only. Paragraphs overlap: a repeated line and the stretches in it are listed each. Null, empty and
    short texts have no paragraphs; rows of equal id and text are one document; null ids come last in the order of places.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(text).alias("text"))
    parts = materialize(spark, paragraphs(docs), "paragraphs")
    roots = components(line_links(parts, docs, similarity))
    often = parts.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content")
    roots = roots.select(F.col("node").alias("content"), "root")
    classes = materialize(spark, often.join(roots, "content", "full").select("content", F.coalesce("root", "content").alias("class_id")), "classes")
    places = parts.drop("bands").join(classes, "content").drop("content")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "first_word", "end_word")
    places = materialize(spark, places.withColumn("place", order), "places")
    first = places.groupBy("class_id").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
    first = materialize(spark, first, "first")     # so that adaptive execution can split a hot class in the join
    return places.join(first, "class_id").select("doc_id", "node", "first_word", "end_word", "class_id", F.col("first.doc_id").alias("first_doc_id"),
                                                 (~F.col("place").eqNullSafe(F.col("first"))).alias("removed"))


def drop_repeats(docs, similarity=SIMILARITY, text="text", length="n_chars"):
    """`docs` without the words of removed paragraphs; a text of which no word is left goes. `length`, if it is a column, is counted anew."""
    own = lambda c: c + "_" * (1 + max(len(x) for x in docs.columns))  # noqa: E731  a name that no column has
    held = own("gone")
    gone = repeated_passages(docs, similarity, text).where("removed")
    gone = gone.groupBy("doc_id", "node").agg(F.collect_set(F.struct("first_word", "end_word")).alias(held)).withColumnRenamed("doc_id", own("d")).withColumnRenamed("node", own("n"))
    gone = materialize(docs.sparkSession, gone, "gone")
    names = docs.columns

    def run(batches):
        for batch in batches:
            spans, old = batch.column(held).to_pylist(), batch.column(text)
            new, keep = [], np.ones(batch.num_rows, bool)
            for i, s in enumerate(spans):
                t = old[i].as_py()
                if s:
                    t = cut(t, [(x["first_word"], x["end_word"]) for x in s])
                    keep[i] = t is not None
                new.append(t)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).filter(pa.array(keep)).select(names)

    marked = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own("d"))) & (F.xxhash64(text) == F.col(own("n"))), "left").drop(own("d"), own("n"))
    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)).select(*names) if length in names else out


def cut(text, spans):
    """A text without the given word spans, and None if no word is left. What follows a removed word up to the next kept one goes with it;
    if a line feed was in there, one stays between kept words."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, starts, _, _ = tx.word_bounds(data, np.array([0, len(data)]))
    step = np.zeros(len(starts) + 1, np.int64)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    gone = np.cumsum(step)[:-1] > 0
    if gone.all():
        return None
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = b"", 0
    for a, b in turns.reshape(-1, 2):
        out += raw[at:starts[a]]
        at = starts[b] if b < len(starts) else len(raw)
        if b == len(starts):
            out = out.rstrip(b" \n")
        elif out and not out.endswith(b"\n") and b"\n" in raw[starts[a]:at]:
            out = out.rstrip(b" ") + b"\n"
    return (out + raw[at:]).decode()
