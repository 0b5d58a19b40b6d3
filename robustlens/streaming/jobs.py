"""Incremental forms of the batch operators. Every sink is replayable: a batch writes its own folder, named by its id,
so a re-run of the batch overwrites the same rows. State lives in checkpoints in the shared folder."""
from pyspark.sql import functions as F

from ..functions.arrays import band_overlap, band_quadratic_overlap, overlap, quadratic_overlap
from ..operators.aggregates import group_tasks
from ..operators.joins import with_filters
from ..operators.topk import balanced_sample, salted_row_number
from ..operators.trials import with_outcomes
from ..session import shuffles_dropped


def json_stream(spark, path, schema, files_per_batch=None):
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.json(path)


def ingest(stream, out, checkpoint):
    """Append-only ingestion of arriving records to Parquet."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_partials(stream, partial, out, checkpoint):
    """Per micro-batch partial sums, one folder per batch id (exactly once under replay)."""
    def save(df, batch_id):
        with shuffles_dropped(df.sparkSession):
            partial(df).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


GROUP_KEYS = ("item_id", "level_no", "family")


PAIR_COLUMNS = (*GROUP_KEYS, "clean_correct", "pert_correct", "loglik_drift", "csem", "cprompt", "hopt", "is_binary", "d")     # what pair_partials reads
PAIR_MEASURES = ("predicted", "predicted_quadratic", "csem", "cprompt", "hopt", "is_binary", "accuracy_drop", "loglik_drift", "volatility", "erosion",
                 "recovery", "clean_correct", "pert_correct")


def pair_partials(filters, average, bands=None, tasks=0):
    """Stream-static join with the filter table, the level average where an item has no filter of its own, and partial sums of every
    measure, with the number of its missing values (mostly 0, which packs to nothing), per (item, level, family) (X02). `bands` is the length of all arrays, if it is known. With `tasks` the rows of a batch move once, by item to
    so many tasks."""
    linear, quadratic = (band_overlap("w", "d", bands), band_quadratic_overlap("w", "d", bands)) if bands else (overlap("w", "d"), quadratic_overlap("w", "d"))

    def partial(df):
        rows = df.repartition(tasks, "item_id") if tasks else df
        j = with_filters(with_outcomes(rows), filters, average, by_item=bool(tasks)).withColumn("predicted", linear).withColumn("predicted_quadratic", quadratic)
        right, wrong = (F.col("clean_correct") == 1) & (F.col("pert_correct") == 0), (F.col("clean_correct") == 0) & (F.col("pert_correct") == 1)
        return j.groupBy(*GROUP_KEYS).agg(*[F.sum(m).cast("double").alias(m) for m in PAIR_MEASURES], *[F.count_if(F.col(m).isNull()).alias(f"no_{m}") for m in PAIR_MEASURES], F.count_if(right).alias("ci_count"), F.count_if(wrong).alias("ic_count"), F.count("*").alias("n"))
    return partial


def merge_pairs(partials, rows=0):
    """Group means, counts and net change from the batches' partial sums, which hold a group once a batch, so they move as they are. `rows`, their number
    at most, sets how many tasks share them where Spark's own number would give one task too many."""
    g = partials.repartition(group_tasks(partials.sparkSession, rows), *GROUP_KEYS).groupBy(*GROUP_KEYS).agg(*[F.try_divide(F.sum(m), F.sum(F.col("n") - F.col(f"no_{m}"))).alias(m) for m in PAIR_MEASURES], *[F.sum(c).alias(c) for c in ("ci_count", "ic_count", "n")])
    net = (F.col("ci_count") - F.col("ic_count")) / F.col("n")
    return (g.withColumnsRenamed({"clean_correct": "clean_accuracy", "pert_correct": "perturbed_accuracy"}).withColumn("net_drop", net)
            .withColumn("relative_drop", F.when(F.col("clean_accuracy") > 1e-8, F.try_divide("net_drop", "clean_accuracy"))))


def running_transitions(stream):
    """Running flip and transition counters per perturbation."""
    c, p = F.col("clean_correct") == 1, F.col("pert_correct") == 1
    return stream.groupBy("perturbation").agg(
        F.count("*").alias("instances"), F.count_if(c != p).alias("changed"), F.count_if(c & ~p).alias("r2w"), F.count_if(~c & p).alias("w2r"))


def latest_table(aggregated, out, checkpoint):
    """Complete-mode counters: every batch writes the whole small table under its id."""
    def save(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return aggregated.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_batch(spark, out):
    d = spark.read.parquet(f"{out}/*")
    return d.where(F.col("batch_id") == d.agg(F.max("batch_id").alias("b")).select("b").scalar()).drop("batch_id")


class ItemStates:
    """The items of a stream of variants, as `append_parquet` writes them; made by `item_states`."""

    SUMS = ("n", "flips", "sum_flip", "sum_keep")

    def __init__(self, stream, wait_ms, late):
        self.stream, self.wait_ms, self.late = stream, wait_ms, late

    def fold(self, variants, before=None):
        """One row per item from variants and from the rows of `before`, by one map-side combined aggregate."""
        hit = F.coalesce("changed", F.lit(False))
        margin = F.when(~F.isnan("margin"), F.col("margin"))
        rows = variants.select("item_id", F.lit(1).cast("long").alias("n"), hit.cast("long").alias("flips"), F.when(hit, margin).alias("sum_flip"), F.when(~hit, margin).alias("sum_keep"),
                               F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.when(hit & F.col("family").isNotNull(), F.array("family")).alias("types"), F.unix_micros("at").alias("last"))
        if before is not None:
            rows = rows.unionByName(before.select(*rows.columns))
        return rows.groupBy("item_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.SUMS], F.max("expected").alias("expected"),
                                           F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.max("last").alias("last"))

    def start(self, out, checkpoint):
        """A batch writes the items that leave to `out` and its state under the checkpoint, each in a folder of the batch's id."""
        spark = self.stream.sparkSession

        def folder(batch_id):
            return f"{checkpoint}/items/{batch_id}"

        def save(df, batch_id):
            mark, before = None, None
            if batch_id:
                mark = spark.read.parquet(f"{folder(batch_id - 1)}/watermark").first()["at"]
                before = spark.read.parquet(f"{folder(batch_id - 1)}/state").where("NOT leaves")
            seen = df.agg(F.max(F.unix_micros(F.col("at") - F.expr(f"INTERVAL {self.late}")))).first()[0]
            now = max((x for x in (mark, seen) if x is not None), default=None)
            here = folder(batch_id)
            spark.createDataFrame([(now,)], "at long").coalesce(1).write.mode("overwrite").parquet(f"{here}/watermark")
            if mark is not None:
                df = df.where(F.col("at").isNull() | (F.unix_micros("at") > mark))
            late = F.coalesce(F.col("last") + int(self.wait_ms * 1000) < F.lit(now).cast("long"), F.lit(False))
            state = self.fold(df, before).withColumn("complete", F.col("n") >= F.col("expected"))
            state.withColumn("leaves", F.col("complete") | late).write.mode("overwrite").parquet(f"{here}/state")
            gone = spark.read.parquet(f"{here}/state").where("leaves")
            gone.select("item_id", "n", "flips", F.when(F.col("flips") > 0, F.col("sum_flip") / F.col("flips")).alias("flip_margin"),
                        F.when(F.col("n") > F.col("flips"), F.col("sum_keep") / (F.col("n") - F.col("flips"))).alias("keep_margin"), (F.col("flips") > 0).alias("any_flip"),
                        F.col("types").alias("flipped_types"), "complete").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            old = spark._jvm.org.apache.hadoop.fs.Path(folder(batch_id - 2))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def item_states(stream, wait_ms, late="1 hour"):
    """Items of a stream of variants (item_id, changed, margin, family, expected, at), each as it is finished (X04); `append_parquet` runs it.

    State per item: counts, margin sums, the perturbation types that flipped it and the time of its last variant. Every micro-batch folds its variants and
    the open items of the batch before in one aggregate, and writes the state under its id, so a replayed batch writes the same. An item leaves in the
    micro-batch that brings its last expected variant (complete), or, where some never come, at the end of the batch whose watermark on `at` has passed its last
    variant by `wait_ms` (incomplete). A variant that comes after its item has left opens the item anew, with its own wait; so an item's
    rows add up to its variants. The watermark follows the greatest `at` by `late`; a variant that is not after the watermark of the batch before is dropped, as in
    every windowed stream. A restart from the checkpoint goes on with the same state. Memory follows one item's types, not its variants.
    """
    return ItemStates(stream, wait_ms, late)


def append_parquet(stream, out, checkpoint):
    if isinstance(stream, ItemStates):
        return stream.start(out, checkpoint)
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_baseline(stream, baseline, tau):
    """Perturbed records against the cached baseline of their item, with the conditional success flag."""
    j = stream.join(baseline.select("item_id", "base_value"), "item_id", "left")
    return j.withColumn("base_ok", F.coalesce(F.col("base_value") >= tau, F.lit(False))).withColumn(
        "conditional", F.when(F.col("base_ok"), (F.col("value") >= tau).cast("double")))


class _Enough(Exception):
    pass


def until_balanced(spark, stream, target, out, checkpoint, seed=3, id_col="item_id"):
    """Consume (item, pattern) batches until the balanced capacity reaches the target, and keep a sample of that size.

    Every batch folds its rows into a bottom-k sketch: of each pattern the half target's worth of rows of lowest hash, and their running
    counts, written under the batch's id from the folder before; a replayed batch writes the same. Once the capacity is reached every further batch is
    refused before its rows are read, so what is consumed depends on the files' order alone, also after a restart. Returns (capacity, items):
    the items are `topk.balanced_sample` over all rows consumed.
    """
    k, state = (target + 1) // 2, {"capacity": 0, "batch": None}

    def capacity(counts):
        other = counts.select(F.translate("pattern", "01", "10").alias("pattern"), F.col("k").alias("o"))
        return int(counts.join(other, "pattern").agg(F.coalesce(F.sum(F.least("k", "o")), F.lit(0)).alias("c")).first()["c"])

    def save(df, batch_id):
        before = f"{out}/batch={batch_id - 1}"
        if batch_id and state["batch"] is None:        # a restart: what the checkpoint's last batch left
            state.update(batch=batch_id - 1, capacity=capacity(spark.read.parquet(f"{before}/counts")))
        if state["capacity"] >= target:
            raise _Enough
        counts, items = df.groupBy("pattern").agg(F.count("*").alias("k")), df.select(id_col, "pattern")
        if batch_id:
            counts = counts.unionByName(spark.read.parquet(f"{before}/counts")).groupBy("pattern").agg(F.sum("k").alias("k"))
            items = items.unionByName(spark.read.parquet(f"{before}/items"))
        here = f"{out}/batch={batch_id}"
        salted_row_number(items, ["pattern"], seed, id_col).where(F.col("rn") <= k).drop("rn").write.mode("overwrite").parquet(f"{here}/items")
        counts.write.mode("overwrite").parquet(f"{here}/counts")
        state.update(batch=batch_id, capacity=capacity(spark.read.parquet(f"{here}/counts")))

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception:
        if state["capacity"] < target:
            raise
    if state["batch"] is None:                         # nothing new to read: what an earlier run left, if there was one
        folder = spark._jvm.org.apache.hadoop.fs.Path(out)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder)] if fs.exists(folder) else []
        if not done:
            return 0, spark.createDataFrame([], stream.select(id_col, "pattern").schema)
        state.update(batch=max(done), capacity=capacity(spark.read.parquet(f"{out}/batch={max(done)}/counts")))
    items = spark.read.parquet(f"{out}/batch={state['batch']}/items")
    return state["capacity"], balanced_sample(items, target, seed, id_col)
