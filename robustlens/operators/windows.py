"""Ordered computations. Rows are folded to their ordering key first, so a window partition is never
longer than the number of distinct cutoffs, bands or frames; global ranks go through value counts."""
from pyspark.sql import Window
from pyspark.sql import functions as F


_COARSE, _FINE = 16, 16      # a group's buckets: their product, or its distinct values if these are fewer


def flip_threshold(trials, keys, cutoff="cutoff"):
    """First cutoff at which the prediction differs from the base (null if it never does)."""
    return trials.groupBy(*keys).agg(F.min(F.when(F.col("changed"), F.col(cutoff))).alias("threshold"))


def ordered_counts(df, value, keys=(), weight=None):
    """Distinct values per group with their count `k` and the 0-based position `first` of their first copy.

    Nulls and NaN have no place in an order and are left out. Values are counted first (map-side combined). Each group is then cut into order-preserving buckets at
    its own approximate quantiles, up to 256 of them and no more than it has values; the bucket counts give the offsets and
    a window runs inside one bucket only: neither a hot value nor a hot group ends up in a single task. `weight` counts rows folded before.
    """
    keys = list(keys)
    by = keys or ["_all"]
    df = df if keys else df.withColumn("_all", F.lit(0))
    counts = _in_order(df, value).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("k"))
    run = _running(counts, value, keys, ["k"])
    return run.select(*keys, value, "k", F.col("_first_k").alias("first"), F.col("_total_k").alias("total"))


def _in_order(df, value):
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def _running(counts, value, keys, ks):
    """`counts` (a row per value, grouped by `keys`, by `_all` without them) with, for each of the counts `ks`, their sum over smaller values and over all."""
    by = keys or ["_all"]
    buckets = _COARSE * _FINE
    cuts = F.array_distinct(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets))
    coarse = F.filter("_cuts", lambda q, i: (i + 1) % _FINE == 0).alias("_coarse")     # once a group, not once a value
    if keys:
        c = counts.join(counts.groupBy(*by).agg(cuts.alias("_cuts")).select(*by, "_cuts", coarse), by)
    else:
        own = counts.agg(cuts.alias("_cuts")).select(F.struct("_cuts", coarse)).scalar()
        c = counts.withColumn("_own", own).select("*", "_own.*").drop("_own")
    # A value's bucket in two steps: the coarse cuts below it, then the cuts of that stretch.
    c = c.withColumn("_at", F.size(F.filter("_coarse", lambda q: q < F.col(value))) * _FINE)
    c = c.withColumn("bkt", F.col("_at") + F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, F.lit(_FINE)), lambda q: q < F.col(value)))).drop("_cuts", "_coarse", "_at")
    sizes = c.groupBy(*by, "bkt").agg(*[F.sum(k).alias(f"_n_{k}") for k in ks])
    w = Window.partitionBy(*by)
    offs = sizes.select(*by, "bkt", *[(F.sum(f"_n_{k}").over(w.orderBy("bkt")) - F.col(f"_n_{k}")).alias(f"_off_{k}") for k in ks],
                        *[F.sum(f"_n_{k}").over(w).alias(f"_total_{k}") for k in ks])
    inside = Window.partitionBy(*by, "bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = c.withColumns({f"_upto_{k}": F.sum(k).over(inside) for k in ks}).join(offs, by + ["bkt"])
    return run.withColumns({f"_first_{k}": F.col(f"_off_{k}") + F.col(f"_upto_{k}") - F.col(k) for k in ks})


def average_ranks(df, value, group=None, weight=None):
    """Average rank (ties share their mean) of every distinct value per group: (group.., value, k, rank)."""
    o = ordered_counts(df, value, group or [], weight)
    return o.select(*(group or []), value, "k", (F.col("first") + (F.col("k") + 1) / F.lit(2.0)).alias("rank"))


def rung_ranks(cells, value, keys, level, weight, halves):
    """Average ranks of every (rung, value) of a ladder among three sets: its half, the whole ladder and its rung, as (keys.., level, value, half, pooled, rung).

    `halves` lists the rungs of each half. Values are put in order once, with a running count for every rung; all three ranks are sums of those.
    """
    rungs = [r for half in halves for r in half]
    count = {r: f"_k{r}" for r in rungs}
    wide = _in_order(cells, value).groupBy(*keys, value).agg(*[F.coalesce(F.sum(F.when(F.col(level) == r, F.col(weight))), F.lit(0)).alias(c) for r, c in count.items()])
    run = _running(wide, value, list(keys), list(count.values()))

    def rank(among):
        return sum((F.col(f"_first_{count[r]}") for r in among), F.lit(0)) + (sum((F.col(count[r]) for r in among), F.lit(0)) + 1) / F.lit(2.0)
    run = run.select(*keys, value, *count.values(), *[F.col(f"_first_{c}") for c in count.values()], rank(rungs).alias("pooled"), *[rank(h).alias(f"_half{i}") for i, h in enumerate(halves)])
    own = F.array(*[F.when(F.col(count[r]) > 0, F.struct(F.lit(r).alias(level), F.col(f"_half{i}").alias("half"), rank([r]).alias("rung"))) for i, h in enumerate(halves) for r in h])
    return run.select(*keys, value, "pooled", F.explode(F.array_compact(own)).alias("_r")).select(*keys, F.col(f"_r.{level}").cast(cells.schema[level].dataType).alias(level), value, "_r.half", "pooled", "_r.rung")


def exact_quantiles(df, value, probs, keys=()):
    """Exact linearly interpolated quantiles per group: (keys.., q0, q1, ..). Scales with `ordered_counts`."""
    o = ordered_counts(df, value, keys)
    v = F.col(value).cast("double")
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, frac = F.floor(pos), pos - F.floor(pos)

        def at(idx):
            return F.max(F.when((idx >= F.col("first")) & (idx < F.col("first") + F.col("k")), v))
        aggs += [at(lo).alias(f"_l{i}"), at(F.ceil(pos)).alias(f"_h{i}"), F.max(frac).alias(f"_f{i}")]
    g = o.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"_l{i}") + F.col(f"_f{i}") * (F.col(f"_h{i}") - F.col(f"_l{i}"))).alias(f"q{i}")
                             for i in range(len(probs))])


def critical_cutoff(curve, keys, threshold, direction="auto", cutoff="cutoff", acc="acc"):
    """First crossing of the threshold along the cutoffs, linearly interpolated.

    `curve` has one row per (keys, cutoff). `direction` is increasing (accuracy rises with the cutoff),
    decreasing, or auto (from the end points). A curve beyond the threshold at its first point gives the
    first cutoff; one that never crosses gives the last.
    """
    w = Window.partitionBy(*keys).orderBy(cutoff)
    pt = F.struct(F.col(cutoff).alias("i"), F.col(acc).alias("a"))
    whole = Window.partitionBy(*keys)
    c = (curve.withColumn("nx", F.lead(acc).over(w)).withColumn("nc", F.lead(cutoff).over(w))
         .withColumn("fst", F.min(pt).over(whole)).withColumn("lst", F.max(pt).over(whole)))
    rising = {"increasing": F.lit(True), "decreasing": F.lit(False)}.get(direction, F.col("lst.a") >= F.col("fst.a"))
    c = c.withColumn("up", rising)
    a0, a1 = F.col(acc), F.col("nx")
    cross = F.when(F.col("up"), (a0 < threshold) & (a1 >= threshold)).otherwise((a0 >= threshold) & (a1 < threshold))
    frac = F.coalesce(F.try_divide(F.lit(float(threshold)) - a0, a1 - a0), F.lit(0.5))
    at = F.col(cutoff) + frac * (F.col("nc") - F.col(cutoff))
    g = c.groupBy(*keys).agg(
        F.min(F.when(cross, F.struct(F.col(cutoff).alias("i"), at.alias("v")))).alias("hit"),
        F.min("fst").alias("fst"), F.max("lst").alias("lst"), F.bool_or("up").alias("up"))
    done = F.when(F.col("up"), F.col("fst.a") >= threshold).otherwise(F.col("fst.a") < threshold)
    return g.select(*keys, F.when(done, F.col("fst.i")).otherwise(F.coalesce("hit.v", "lst.i")).alias("critical_cutoff"),
                    (~done & F.col("hit").isNotNull()).alias("crossed"))


def curve_diagnostic(curve, keys, threshold, cutoff="cutoff", acc="acc"):
    """Lowest accuracy and where, loss, and whether the first / last point is already beyond the threshold."""
    g = curve.groupBy(*keys).agg(
        F.min(F.struct(F.col(acc).alias("a"), F.col(cutoff).alias("i"))).alias("lo"),
        F.min(F.struct(F.col(cutoff).alias("i"), F.col(acc).alias("a"))).alias("first"),
        F.max(F.struct(F.col(cutoff).alias("i"), F.col(acc).alias("a"))).alias("last"))
    return g.select(*keys, F.col("lo.a").alias("min_accuracy"), F.col("lo.i").alias("min_cutoff"),
                    (1 - F.col("lo.a")).alias("max_loss"), (F.col("lo.a") < threshold).alias("crossed"),
                    (F.col("first.a") < threshold).alias("below_at_first"), (F.col("last.a") < threshold).alias("below_at_last"))


def demean(df, unit, *cols):
    """x minus its unit mean: an aggregate joined back, so a hot unit is split by the skew join."""
    means = df.groupBy(*unit).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], F.count("*").alias("unit_n"))
    out = df.join(means, list(unit))
    return out.withColumns({f"{c}_dm": F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def monotone(points, keys, order, value):
    """Whether the values never fall / never rise along the order (one row per key and order value)."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = points.withColumn("prev", F.lag(value).over(w))
    return p.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("prev") <= F.col(value)), F.lit(True)).alias("non_decreasing"),
                                F.coalesce(F.bool_and(F.col("prev") >= F.col(value)), F.lit(True)).alias("non_increasing"))


def layer_groups(df, layer="layer", n_layers="n_layers"):
    """Early / mid / late thirds of the layer stack, each at least one layer where the depth allows it."""
    n = F.col(n_layers)
    first = F.greatest(F.lit(1), F.floor(n / 3))
    second = F.least(F.greatest(first + 1, F.floor(2 * n / 3)), n)
    return df.withColumn("layer_group", F.when(F.col(layer) < first, "early").when(F.col(layer) < second, "mid").otherwise("late"))


def top_margin(scores):
    """Best minus second-best score; a single score is its own margin; null if there is none."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(s) > 1, F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2))).otherwise(F.try_element_at(s, F.lit(1)))


def cumulative_mass(profiles, keys, bin_col="bin", mass="mass"):
    """Running mass along the bins of one profile (a window of as many rows as there are bins)."""
    w = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return profiles.withColumn("cdf", F.sum(mass).over(w))
