"""Mixing sources to target weights by proportionate-fair scheduling, in DataFrame operations only.

A source's documents, in hashed order, form blocks. With integer weights b and a period of sum(b) slots, block i (from 0) of a source is
released at floor(i * period / b) and due by ceil((i + 1) * period / b); earliest deadline first fills every slot, so after any number of slots
each source is less than one block away from its share. A phase is a number of equal periods. It ends before a source would run short; one
period with what is left of that source follows, then a phase without it. So there are at most two phases for each source, the schedule's size
does not follow the data, and every document gets its place.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_DOCS = 16
RESOLUTION = 1000        # slots of a full period, about
MAX_SOURCES = 256        # bounds the schedule: at most 2 * 256 phases of about RESOLUTION slots
_BUCKET_ROWS = 500       # of a source's rows numbered together, or the root of their count if that is more


def source_plan(docs, source="source", weights=None, block_docs=BLOCK_DOCS, resolution=RESOLUTION):
    """(source, n, blocks, a): row count, block count and integer weight of each source; a null source is a source.

    `weights` has (source, weight); a source it lacks, or one of weight 0 or less, gets the least weight. Without it weights are the roots of the counts.
    """
    plan = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        plan = plan.withColumn("s", F.floor(1000 * F.sqrt("n")))
    else:
        given = weights.groupBy(F.col("source").alias("__s")).agg(F.max("weight").alias("weight"))
        plan = plan.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("s", F.floor(1000 * F.greatest(F.lit(0), F.coalesce("weight", F.lit(0)))))
    plan = materialize(docs.sparkSession, plan.select("source", "n", "s"), "sources")
    if plan.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = plan.agg(F.sum("s")).first()[0] or 0
    return plan.select(
        "source", "n", F.expr(f"(n + {block_docs - 1}) div {block_docs}").alias("blocks"),
        F.expr(f"greatest(1L, (s * {resolution}L) div {max(total, 1)}L)").alias("a"))


_STEP = """
aggregate(sequence(1, 2 * size(a)),
  named_struct('rest', blocks, 'base', transform(a, x -> 0L), 'slot', 0L,
               'phases', cast(array() AS array<struct<b: array<bigint>, base: array<bigint>, times: bigint, period: bigint, slot: bigint>>)),
  (acc, i) -> transform(array(named_struct(
      'b', zip_with(acc.rest, a, (r, x) -> least(r, x)),
      'times', greatest(1L, coalesce(array_min(zip_with(acc.rest, a, (r, x) -> if(r > 0, r div x, NULL))), 1L)),
      'period', aggregate(zip_with(acc.rest, a, (r, x) -> least(r, x)), 0L, (p, x) -> p + x))),
    f -> named_struct(
      'rest', zip_with(acc.rest, f.b, (r, x) -> r - f.times * x),
      'base', zip_with(acc.base, f.b, (r, x) -> r + f.times * x),
      'slot', acc.slot + f.times * f.period,
      'phases', if(f.period > 0, concat(acc.phases, array(named_struct('b', f.b, 'base', acc.base, 'times', f.times, 'period', f.period, 'slot', acc.slot))), acc.phases)))[0]
).phases"""

_EARLIEST = """
aggregate(sequence(0L, period - 1),
  named_struct('done', transform(b, x -> 0L), 'order', cast(array() AS array<int>)),
  (acc, t) -> transform(array(array_min(transform(
      filter(sequence(0, size(b) - 1), s -> acc.done[s] < b[s] AND (acc.done[s] * period) div b[s] <= t),
      s -> named_struct('due', ((acc.done[s] + 1) * period + b[s] - 1) div b[s], 's', s))).s),
    pick -> named_struct('done', transform(acc.done, (d, j) -> if(j = pick, d + 1, d)), 'order', array_append(acc.order, pick)))[0]
).order"""


def schedule(plan):
    """(source, base, b, times, period, slot, slots): for each source and phase the first block, blocks a period, number of periods,
    slots of a period, the phase's first slot, and the source's slots inside a period. At most 2 * MAX_SOURCES phases."""
    one = plan.agg(F.array_sort(F.collect_list(F.struct("source", "blocks", "a"))).alias("all"))   # at most MAX_SOURCES elements
    one = one.select(F.col("all.source").alias("names"), F.col("all.blocks").alias("blocks"), F.col("all.a").alias("a"))
    phases = materialize(plan.sparkSession, one.where("size(a) > 0").select("names", F.posexplode(F.expr(_STEP))).select("names", F.col("pos").alias("phase"), "col.*"), "phases")
    order = phases.repartition("phase").withColumn("order", F.expr(_EARLIEST))
    rows = order.select("phase", "period", "slot", "times", "order", F.posexplode(F.arrays_zip("names", "b", "base"))).select(
        F.col("col.names").alias("source"), F.col("col.base").alias("base"), F.col("col.b").alias("b"), "times", "period", "slot",
        F.expr("filter(transform(order, (s, t) -> if(s = pos, t, NULL)), t -> t IS NOT NULL)").alias("slots"))
    return materialize(plan.sparkSession, rows.where("b > 0"), "schedule")


def _hashable(docs, name):
    """A column as what can be hashed: maps, alone or inside, by their JSON text."""
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if "map<" in docs.schema[name].dataType.simpleString() else column


def mix(docs, source="source", key="doc_id", weights=None, block_docs=BLOCK_DOCS, resolution=RESOLUTION):
    """Every row of `docs` with mix_block (its block in its source), mix_slot (the block's place in the mix) and mix_pos (place in the block).

    Reading by (mix_slot, mix_pos) gives the mixture. Rows of equal id are ordered by their other columns; equal rows are interchangeable. Null ids
    sort with empty text, a null source is a source, an empty table stays empty; columns of the three names are replaced.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_pos")
    columns = docs.columns
    plan = source_plan(docs, source, weights, block_docs, resolution)
    if plan.isEmpty():
        return docs.select("*", *[F.lit(None).cast("long").alias(c) for c in ("mix_block", "mix_slot", "mix_pos")])
    spread = F.broadcast(plan.select(F.col("source").alias("__source"), F.expr(f"ceil(n / greatest({_BUCKET_ROWS}, floor(sqrt(n))))").alias("__buckets")))
    same = F.col(source).eqNullSafe(F.col("__source"))
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.withColumn("__order", order).join(spread, same).withColumn(
        "__bucket", F.expr("(conv(substr(__order, 1, 8), 16, 10) * __buckets) div 4294967296L").cast("long")).drop("__buckets", "__source")
    counts = keyed.groupBy(F.col(source).alias("__source"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__first", F.coalesce(F.sum("__n").over(Window.partitionBy("__source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(F.col(source), "__bucket").orderBy("__order", F.xxhash64(*[_hashable(docs, c) for c in columns]))
    numbered = keyed.withColumn("__row", F.row_number().over(inside)).join(
        before.drop("__n"), same & (F.col("__bucket") == F.col("__b"))).withColumn("__row", F.col("__row") - 1 + F.col("__first")).drop("__first", "__b", "__bucket", "__source")
    block = F.expr(f"__row div {block_docs}")
    slots = F.broadcast(schedule(plan).withColumnRenamed("source", "__source"))
    placed = numbered.withColumn("mix_block", block).join(slots, same & (F.col("mix_block") >= F.col("base")) & (F.col("mix_block") < F.col("base") + F.col("b") * F.col("times")))
    return placed.select(*[F.col(f"`{c}`") for c in columns], "mix_block",
                         F.expr("slot + ((mix_block - base) div b) * period + slots[CAST((mix_block - base) % b AS INT)]").alias("mix_slot"),
                         F.expr(f"__row % {block_docs}").alias("mix_pos"))
