"""X: the streaming jobs, fed with JSON files that Spark writes from the given tables and run until all is consumed."""
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators.aggregates import group_tasks
from ..session import discard, scratch_path, shuffles_dropped
from ..sources import sinks
from ..streaming import jobs
from . import bindings as b
from .q_aggregates import _GM, _GP, outcomes, rounded
from .registry import query
from .sqlkit import H, R

BATCHES = 4                  # micro-batches per stream
FILE_ROWS = 2_000_000        # rows of an input file at most, about 300 MB of JSON


def feed(spark, df, schema, rows, closing=None):
    """JSON folder and a stream over it in BATCHES batches. `rows` is the number of rows: the files grow in number, not in size, so no task
    writes more than FILE_ROWS. `closing` is the time `at` of a last row without a key, which moves the watermark on so that open items leave."""
    path = scratch_path(spark, "feed")
    files = -(-max(rows, 1) // (BATCHES * FILE_ROWS))        # of one batch
    sinks.write_jsonl(df.repartition(BATCHES * files), path)
    if closing:
        spark.sql(f"SELECT CAST('{closing}' AS TIMESTAMP) AS at, CAST(1 AS BIGINT) AS expected, false AS changed").coalesce(1).write.mode("append").json(path)
    return jobs.json_stream(spark, path, schema, files)


def packed_feed(spark, rows_of, rows, path):
    """`feed` by gzip into the folder `path`. `rows_of` gives the rows dealt to a number of tasks or more; a file holds about half of what one task may
    read whole, so uneven dealing cuts none in two. The files of a batch follow from those that were written."""
    df = rows_of(BATCHES * -(-max(rows, 1) // (BATCHES * (sinks.PACKED_ROWS // 2))))
    with shuffles_dropped(spark):
        sinks.write_jsonl(df, path, packed=True)
    return jobs.json_stream(spark, path, df.schema, -(-len(sinks.part_files(spark, path)) // BATCHES))


def paths(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-cp")


@query("x01_incremental_ingest", f"SELECT event_type, CAST(count(*) AS BIGINT) AS n, {R('sum(value)')} AS total FROM events GROUP BY event_type")
def x01(spark, sf):
    out, cp = paths(spark, "ingest")
    e = b.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    s = feed(spark, e, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING", e.count())
    jobs.ingest(s, out, cp).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


_X02 = (*_GM, "recovery", "clean_accuracy", "perturbed_accuracy", "net_drop", "relative_drop")


@query("x02_running_pairs", f"{_GP}, h AS (SELECT item_id, level_no, family, avg(recovery) AS recovery FROM pairs GROUP BY 1, 2, 3), q AS (SELECT g.*, recovery, CASE WHEN clean_accuracy > 1e-8 THEN net_drop / clean_accuracy END AS relative_drop FROM g JOIN h USING (item_id, level_no, family)) SELECT item_id, level_no, family, "
       + ", ".join(f"{R(c)} AS {c}" for c in _X02) + ", ci_count, ic_count, n FROM q")
def x02(spark, sf):
    out, cp = paths(spark, "pairs")

    def rows_of(tasks):
        return b.trials(spark, sf, "d", dealt=lambda raw: raw.repartition(tasks, "l_orderkey", "l_linenumber")).select(*jobs.PAIR_COLUMNS)
    arrivals = scratch_path(spark, "feed")
    rows = b.table(spark, sf, "lineitem").count()
    partial = jobs.pair_partials(*b.filter_tables(spark, sf), b.BANDS, group_tasks(spark, rows // BATCHES))
    jobs.write_partials(packed_feed(spark, rows_of, rows, arrivals), partial, out, cp).awaitTermination()
    discard(spark, arrivals)     # all of it is in the partial sums
    return rounded(jobs.merge_pairs(spark.read.parquet(f"{out}/*"), rows), *_X02)


@query("x03_running_transitions", f"""{b.T()} SELECT perturbation, CAST(count(*) AS BIGINT) AS instances, CAST(sum(changed::INT) AS BIGINT) AS changed, CAST(count(*) FILTER (WHERE clean_correct = 1 AND pert_correct = 0) AS BIGINT) AS r2w, CAST(count(*) FILTER (WHERE clean_correct = 0 AND pert_correct = 1) AS BIGINT) AS w2r FROM tr GROUP BY perturbation""")
def x03(spark, sf):
    out, cp = paths(spark, "counters")
    t = b.trials(spark, sf).select("perturbation", "clean_correct", "pert_correct")
    s = feed(spark, t, "perturbation STRING, clean_correct INT, pert_correct INT", t.count())
    jobs.latest_table(jobs.running_transitions(s), out, cp).awaitTermination()
    return jobs.last_batch(spark, out)


@query("x04_item_state", f"""{b.T('order_id')}
SELECT order_id AS item_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(changed::INT) AS BIGINT) AS flips, {R('avg(loglik_drift) FILTER (WHERE changed)')} AS flip_margin, {R('avg(loglik_drift) FILTER (WHERE NOT changed)')} AS keep_margin,
  bool_or(changed) AS any_flip, coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER (WHERE changed)), ','), '') AS flipped_types, order_id % 10 <> 3 AS complete FROM tr GROUP BY order_id""")
def x04(spark, sf):
    out, cp = paths(spark, "items")
    t = outcomes(spark, sf, "order_id").select(F.col("order_id").alias("item_id"), "changed", F.col("loglik_drift").alias("margin"), "family")
    # one item in ten waits for one variant more than will come
    expected = t.groupBy("item_id").agg(F.count("*").alias("k")).select("item_id", (F.col("k") + (F.col("item_id") % 10 == 3).cast("long")).alias("expected"))
    rows = t.join(expected, "item_id").withColumn("at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    s = feed(spark, rows, "item_id BIGINT, changed BOOLEAN, margin DOUBLE, family STRING, expected BIGINT, at TIMESTAMP", t.count(), closing="2020-01-02 00:00:00")
    jobs.append_parquet(jobs.item_states(s, 3_600_000), out, cp).awaitTermination()
    items = spark.read.parquet(out).where("item_id IS NOT NULL").drop("batch").withColumn("flipped_types", F.array_join("flipped_types", ","))
    return rounded(items, "flip_margin", "keep_margin")


@query("x05_baseline_then_perturbed", """WITH o AS (SELECT o_orderkey, o_custkey AS item_id, o_orderpriority AS perturb, (o_totalprice % 1000) / 1000 AS v FROM orders), base AS (SELECT item_id, max(v) AS bv FROM o WHERE perturb = '1-URGENT' GROUP BY 1)
SELECT perturb, coalesce(bv >= 0.5, false) AS base_ok, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN bv >= 0.5 THEN (v >= 0.5)::INT END), 6) + 0e0 AS conditional_rate FROM o LEFT JOIN base USING (item_id) WHERE perturb <> '1-URGENT' GROUP BY 1, 2""")
def x05(spark, sf):
    out, cp = paths(spark, "conditional")
    o = b.table(spark, sf, "orders").selectExpr("o_custkey AS item_id", "o_orderpriority AS perturb", "(o_totalprice % 1000) / 1000 AS value")
    base = o.where("perturb = '1-URGENT'").groupBy("item_id").agg(F.max("value").alias("base_value"))
    later = o.where("perturb <> '1-URGENT'")
    s = feed(spark, later, "item_id BIGINT, perturb STRING, value DOUBLE", later.count())
    jobs.append_parquet(jobs.with_baseline(s, base, 0.5), out, cp).awaitTermination()
    return spark.read.parquet(out).groupBy("perturb", "base_ok").agg(F.count("*").alias("n"), r6(F.avg("conditional")).alias("conditional_rate"))


_PATTERN = "concat(o_custkey % 2, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END)"
_PARTS, _TARGET = 8, 400     # files of the feed, each with the orders of one remainder, and items wanted


@query("x06_early_stop", f"""WITH ap AS (SELECT o_orderkey AS item_id, {_PATTERN} AS pattern, o_orderkey % {_PARTS} AS part FROM orders),
ac AS (SELECT f, pattern, count(*) AS k FROM ap JOIN (SELECT unnest(range({_PARTS})) AS f) r ON part <= f GROUP BY f, pattern),
st AS (SELECT coalesce(min(f), {_PARTS - 1}) AS f FROM (SELECT a.f, sum(least(a.k, o.k)) AS capacity FROM ac a JOIN ac o ON a.f = o.f AND o.pattern = translate(a.pattern, '01', '10') GROUP BY a.f) WHERE capacity >= {_TARGET}),
pt AS (SELECT item_id, pattern FROM ap WHERE part <= (SELECT f FROM st)), ct AS (SELECT pattern, count(*) AS k FROM pt GROUP BY 1),
cp AS (SELECT a.pattern, least(a.k, o.k) AS capacity FROM ct a JOIN ct o ON o.pattern = translate(a.pattern, '01', '10')),
hd AS (SELECT *, sum(capacity) OVER (ORDER BY {H(3, 'pattern')}, pattern) - capacity AS before, floor(least({_TARGET}, 2 * sum(capacity) OVER ()) / 2) AS room FROM cp WHERE pattern < translate(pattern, '01', '10')),
q AS (SELECT pattern, greatest(least(capacity, room - before), 0) AS quota FROM hd), q2 AS (SELECT * FROM q UNION ALL SELECT translate(pattern, '01', '10'), quota FROM q),
rn AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY {H(3, 'item_id')}, item_id) AS rn FROM pt)
SELECT item_id, pattern, (SELECT CAST(sum(capacity) AS BIGINT) FROM cp) AS capacity FROM rn JOIN q2 USING (pattern) WHERE rn <= quota""")
def x06(spark, sf):
    out, cp = paths(spark, "balanced")
    rows = b.table(spark, sf, "orders").selectExpr("o_orderkey AS item_id", f"{_PATTERN} AS pattern")
    feeds = scratch_path(spark, "feed")
    for part in range(_PARTS):      # files are read in the order of their times
        rows.where(F.col("item_id") % _PARTS == part).coalesce(1).write.mode("append").json(feeds)
    capacity, items = jobs.until_balanced(spark, jobs.json_stream(spark, feeds, "item_id BIGINT, pattern STRING", 1), _TARGET, out, cp)
    return items.withColumn("capacity", F.lit(capacity).cast("long"))
