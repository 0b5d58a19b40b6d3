"""Links from bucket collisions, by heads first and then by the pairs of different components that can be alike, and connected components by contraction."""
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import text as tx

HEADS = 3                   # how often each node is compared with a head before all pairs of different components are
PAIRS_A_TASK = 1_000_000    # pairs of one bucket that a task makes
FEW = 16                    # nodes beside the largest component of a bucket whose pairs are all made
COUNT_BITS = 18             # hash buckets in which items are counted: 2 MB whatever the corpus
SLACK = 1 - 1e-9            # sums of weights are rounded


class Rounds:
    """Tables of the rounds of one computation in the shared folder, deleted when a later round has taken their place."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df, name):
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables):
        for t in tables:
            if (held := self.paths.pop(id(t), None)) is not None:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(held[1])
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def end(self):
        self.drop(*[t for t, _ in list(self.paths.values())])


def components(links):
    """(node, root) for every id of `links` (a, b): root is the least id of its component.

    Every round points each id at its least neighbour, follows that pointer on once and keeps only links between different pointers, so what is
    left shrinks at least by half; rounds are written tables, cut from their lineage, and only the last one stays.
    """
    spark = links.sparkSession
    rounds = Rounds(spark)
    edges = rounds.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
        least = rounds.write(least, "pointers")
        up = least.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = rounds.write(least.join(up, "root").select("node", F.col("up").alias("root")), "pointers")
        rounds.drop(least)
        if found is None:
            found = step
        else:
            joined = rounds.write(found.join(step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "components")
            rounds.drop(found)
            found = joined
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
        left = rounds.write(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        rounds.drop(edges, *([step] if step is not found else []))
        edges = left
        if edges.isEmpty():
            rounds.drop(edges)
            return found


def mixed(rounds, held, roots):
    """(bucket, node, n, root) of the buckets of `held` whose nodes are not yet all of one component; `roots` has (node, root) of linked nodes.

    Tables that are aggregated by bucket are written before they are joined, so that adaptive execution can split a hot bucket.
    """
    rooted = held.withColumn("root", F.col("node")) if roots is None else held.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = rounds.write(rooted, "rooted")
    open_ = rounds.write(rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket"), "open")
    live = rounds.write(rooted.join(open_, "bucket"), "live")
    rounds.drop(rooted, open_)
    return live


def with_heads(rounds, live, led, told):
    """(a, b): each node with one head of another component, that of its largest bucket; and `led` with the heads added.

    A bucket's head is a node that has not led it, with the largest buckets in all, which an original shares with most of its edited copies; ties go to the
    least id. Pairs in `told` are not asked again.
    """
    weight = live.groupBy("node").agg(F.sum("n").alias("weight"))
    own = live.join(weight, "node").join(led.withColumn("led", F.lit(1)), ["bucket", "node"], "left")
    own = own.groupBy("bucket").agg(F.min(F.struct(F.coalesce("led", F.lit(0)).alias("led"), -F.col("weight"), "node", "root")).alias("c"))
    own = rounds.write(own.select("bucket", F.col("c.node").alias("head"), F.col("c.root").alias("head_root")), "heads")
    asked = live.join(own, "bucket").where("root <> head_root").select("node", "head", "bucket", "n", F.least("node", "head").alias("lo"), F.greatest("node", "head").alias("hi"))
    picked = asked.join(told, ["lo", "hi"], "left_anti").groupBy("node").agg(F.min(F.struct(-F.col("n"), "bucket", "head")).alias("c"))
    return picked.select(F.col("c.head").alias("a"), F.col("node").alias("b")), led.union(own.select("bucket", F.col("head").alias("node")))


def main_parts(live):
    """(bucket, main, k, nodes): each bucket's largest component, its nodes and those of the bucket."""
    sizes = live.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("c"), F.sum("k").alias("nodes")).select("bucket", F.col("c.root").alias("main"), F.col("c.k").alias("k"), "nodes")


def across(rounds, live, parts, similarity=None):
    """(lo, hi): every pair of nodes of different components that share a bucket.

    The nodes of a bucket's largest component are not paired with each other, only with the others; a bucket of many pairs is dealt over tasks by its
    nodes' hashes. With `similarity`, `live` is that of `prefixes` and pairs that can not reach it are not made.
    """
    deals = (F.lit(1) + F.floor(F.col("nodes") * (F.col("nodes") - F.col("k")) / PAIRS_A_TASK)).cast("int")
    parts = rounds.write(parts.where("nodes > k").select("bucket", "main", deals.alias("deals")), "parts")
    own = [] if similarity is None else ["weight", "after", "total"]
    rows = live.join(parts, "bucket").select("bucket", "node", "root", (F.col("root") == F.col("main")).alias("is_main"), "deals", *own)
    few = rows.where("NOT is_main").select("bucket", F.col("node").alias("a"), F.col("root").alias("ra"), F.pmod(F.xxhash64("node"), "deals").cast("int").alias("deal"), *[F.col(c).alias(f"{c}_a") for c in own])
    many = rows.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"), "is_main", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), *[F.col(c).alias(f"{c}_b") for c in own])
    on = [few[c] == many[c] for c in ("bucket", "deal")] + [F.expr("ra <> rb AND (is_main OR a < b)")]
    if similarity is not None:
        most = F.least("weight_a", "weight_b") + F.least("after_a", "after_b")
        on.append(most >= similarity / (1 + similarity) * SLACK * (F.col("total_a") + F.col("total_b")))
    return few.join(many, on).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def prefixes(rounds, sets, read, similarity):
    """(bucket, node, weight, after, total): the rarest items of each node's weighted set, as buckets. `read(batch)` gives (node, items, weights) of the rows of `sets`.

    Items are ordered by how often their hash bucket is held, then by hash; `after` is the weight of a node's later items. Of two nodes alike, the items
    before their first common one are not common, so what they have in common weighs no more than that item and what follows it in either: both hold it among
    the items kept here. Items that surely are of one node are not kept.
    """
    sets = rounds.write(sets, "sets")
    shared = sets.sparkSession.sparkContext.broadcast(tx.hash_counts(sets, lambda batch: (items for _, items, _ in read(batch)), COUNT_BITS))

    def run(batches):
        often = shared.value
        for batch in batches:
            for node, items, weights in read(batch):
                n = often[(items >> np.uint64(64 - COUNT_BITS)).astype(np.intp)]
                order = np.lexsort((items, n))
                w = weights[order]
                upto = np.cumsum(w)
                keep = (upto[-1] - upto + w >= similarity * SLACK * upto[-1]) & (n[order] > 1)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(items[order][keep])), pa.array(np.full(keep.sum(), node, np.int64)), pa.array(w[keep]),
                                                  pa.array((upto[-1] - upto)[keep]), pa.array(np.full(keep.sum(), upto[-1]))], ["bucket", "node", "weight", "after", "total"])

    return sets.mapInArrow(run, "bucket long, node long, weight double, after double, total double")


def able(rounds, live, items, similarity):
    """(lo, hi): pairs of nodes of different components that can be alike, among them every alike pair that shares a bucket of `live`.

    Of a bucket of few nodes, or where `items` is None, all pairs are taken; the nodes of the others are paired where their rarest items meet.
    """
    parts = rounds.write(main_parts(live), "mains")
    if items is None:
        return across(rounds, live, parts)
    many = rounds.write(live.join(parts.where(F.col("nodes") - F.col("k") > FEW).select("bucket"), "bucket").select("node", "root").distinct(), "many")
    pairs = across(rounds, live, parts.where(F.col("nodes") - F.col("k") <= FEW))
    if many.isEmpty():
        return pairs
    rare = rounds.write(prefixes(rounds, *items(many.select("node")), similarity), "prefixes")
    rare = rounds.write(rare.join(many, "node"), "rare")
    return pairs.union(across(rounds, rare, main_parts(rare), similarity)).distinct()


def banded_links(bands, prepare, compare, similarity, items=None):
    """(a, b) of alike nodes among those that share a band; `bands` has distinct (node, band, key).

    Their components join all alike pairs that share a band. First, HEADS times, each node is compared with one head of a bucket that holds other
    components as well; that joins most of a large group of copies by as many pairs as it has nodes. Then the pairs of nodes of different components that share a
    bucket are compared; of a bucket of many nodes only those that can be alike. So pairs that are left out are within a component that stands already
    or not alike. `prepare(nodes)` is called once with the candidates, `compare(pairs)` gives (a, b, similarity) of every (a, b). `items(nodes)` gives the
    weighted sets whose Jaccard similarity it is, as `prefixes` takes them; without it, all pairs are compared, and in a bucket of many nodes that are
    not alike they grow with their square.
    """
    spark = bands.sparkSession
    rounds = Rounds(spark)
    entries = rounds.write(bands.select("node", F.xxhash64("band", "key").alias("bucket")).distinct(), "entries")
    sizes = rounds.write(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    held = rounds.write(entries.join(sizes, "bucket").select("bucket", "node", "n"), "held")
    rounds.drop(entries, sizes)
    prepared, found, roots = False, [], None
    led, told = spark.createDataFrame([], "bucket long, node long"), spark.createDataFrame([], "lo long, hi long")
    turn = 0
    while turn <= HEADS:
        live = mixed(rounds, held, roots)
        if live.isEmpty():
            break
        if turn < HEADS:
            pairs, led = with_heads(rounds, live, led, told)
        else:
            pairs = able(rounds, live, items, similarity).join(told, ["lo", "hi"], "left_anti").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        pairs = rounds.write(pairs, "pairs")
        if pairs.isEmpty():
            turn = HEADS if turn < HEADS else HEADS + 1      # no head has anything new: what is left are pairs of others
            continue
        if not prepared:
            prepare(held.select("node").distinct())
            prepared = True
        done = materialize(spark, compare(pairs).select("a", "b", "similarity"), "compared")
        found.append(done.where(F.col("similarity") >= similarity).select("a", "b"))
        told = told.union(done.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
        turn += 1
        if turn <= HEADS:
            roots = components(reduce(DataFrame.union, found))
        held = live.drop("root")
    rounds.end()
    if not found:
        return spark.createDataFrame([], "a long, b long")
    return reduce(DataFrame.union, found)
