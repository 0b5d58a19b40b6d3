"""Statistics from mergeable sums: correlations, group tests, ladder tests, bootstrap, residuals and densities.

Facts are reduced to moments by one aggregation; tests then run on the few summary rows.
"""
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..functions.numeric import hash_int, safe_corr, safe_slope
from ..session import materialize
from .windows import average_ranks, rung_ranks

PRIME = (1 << 61) - 1   # a Mersenne prime: residues of products need no division


def pearson(df, keys, x, y, min_n=3, default=0.0, weight=None):
    """Correlation per key. With `weight` a row stands for that many equal ones; values are then taken about their mean over the rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    if weight is None:
        return df.groupBy(*keys).agg(F.count(F.when(both, 1)).alias("n"), safe_corr(x, y, min_n, default).alias("r"))
    d = df.where(both)
    k = F.col(weight)
    mean = d.groupBy(*keys).agg(F.sum(weight).alias("n"), (F.sum(k * F.col(x)) / F.sum(k)).alias("_mx"), (F.sum(k * F.col(y)) / F.sum(k)).alias("_my"))
    d = d.join(mean, list(keys)) if keys else with_scalars(d, mean).select("*", "_st.*")
    a, b = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    g = d.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(k * a * b).alias("ab"), F.sum(k * a * a).alias("aa"), F.sum(k * b * b).alias("bb"),
                             (F.min(x) < F.max(x)).alias("vx"), (F.min(y) < F.max(y)).alias("vy"))
    r = F.when((F.col("n") >= min_n) & F.col("vx") & F.col("vy"), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(F.lit(default).cast("double"))
    return g.select(*keys, "n", r.alias("r"))


def spearman(df, keys, x, y, min_n=3, default=0.0, weight=None):
    """Rank correlation with average ranks, from (x, y) counts: rows are folded and written once, and both ranks start from that table.

    Ranks are centred at their known mean (n+1)/2, so the sums stay well conditioned.
    """
    keys = list(keys)
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg((F.sum(weight) if weight else F.count("*")).alias("k"))
    cells = materialize(df.sparkSession, cells, "cells")
    rx = average_ranks(cells, x, keys, "k").select(*keys, x, F.col("rank").alias("rx"))
    ry = average_ranks(cells, y, keys, "k").select(*keys, y, F.col("rank").alias("ry"))
    j = cells.join(rx, keys + [x]).join(ry, keys + [y])
    a, b, k = F.col("rx"), F.col("ry"), F.col("k")
    n = cells.groupBy(*keys).agg(F.sum("k").alias("n"))
    if keys:
        j = j.join(n, keys)
    else:
        j = j.withColumn("n", n.scalar())
    a, b = a - (F.col("n") + 1) / 2, b - (F.col("n") + 1) / 2
    g = j.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(k * a * b).alias("sab"), F.sum(k * a * a).alias("saa"), F.sum(k * b * b).alias("sbb"))
    rho = F.when((F.col("n") >= min_n) & (F.col("saa") > 0) & (F.col("sbb") > 0),
                 F.col("sab") / F.sqrt(F.col("saa") * F.col("sbb"))).otherwise(F.lit(default).cast("double"))
    return g.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), rho.alias("rho"))


def view_correlations(cells, keys, x, y, level, weight, halves, min_n=3, default=0.0):
    """`pearson` and `spearman` of every view of a ladder: (keys.., view, n, r, rho) for its halves, the whole (`pooled`) and each rung (`level_<rung>`).

    `cells` has (keys.., level, x, y) with a count, `halves` the rungs of each half by name. Cells are not copied for their views: sums are taken once a rung,
    about its means and about the mean rank in each of its three views, and added up over the rungs (a row a key and rung is broadcast).
    """
    keys = list(keys)
    at = keys + [level]
    cells = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(level).isin([r for h in halves.values() for r in h]))
    half = F.lit(None).cast("string")
    for name, rungs in halves.items():
        half = F.when(F.col(level).isin(list(rungs)), F.lit(name)).otherwise(half)
    k, a, b = F.col(weight), F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    means = cells.groupBy(*at).agg(F.sum(weight).alias("n"), (F.sum(k * F.col(x)) / F.sum(k)).alias("_mx"), (F.sum(k * F.col(y)) / F.sum(k)).alias("_my"))
    whole = Window.partitionBy(*keys)
    means = materialize(cells.sparkSession, means.withColumn("_half", half).withColumns({"_n_pooled": F.sum("n").over(whole), "_n_half": F.sum("n").over(Window.partitionBy(*keys, "_half"))}), "means")
    sums = cells.join(F.broadcast(means), at).groupBy(*at).agg(F.sum(k * a * b).alias("ab"), F.sum(k * a * a).alias("aa"), F.sum(k * b * b).alias("bb"),
                                                            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    rx, ry = (rung_ranks(cells, v, keys, level, weight, list(halves.values())).withColumnsRenamed({c: f"{c}_{p}" for c in ("half", "pooled", "rung")}) for v, p in ((x, "x"), (y, "y")))
    ranked = cells.join(rx, at + [x]).join(ry, at + [y]).join(F.broadcast(means.select(*at, "n", "_n_pooled", "_n_half")), at)
    parts = []
    for view, n in (("half", "_n_half"), ("pooled", "_n_pooled"), ("rung", "n")):
        ra, rb = (F.col(f"{view}_{p}") - (F.col(n) + 1) / 2 for p in ("x", "y"))
        parts += [F.sum(k * ra * rb).alias(f"{view}_ab"), F.sum(k * ra * ra).alias(f"{view}_aa"), F.sum(k * rb * rb).alias(f"{view}_bb")]
    both = means.join(sums, at).join(ranked.groupBy(*at).agg(*parts), at, "left")
    named = {"half": F.col("_half"), "pooled": F.lit("pooled"), "rung": F.concat(F.lit("level_"), F.col(level).cast("string"))}
    views = both.withColumn("_v", F.explode(F.array(*[F.struct(name.alias("view"), *[F.col(f"{v}_{s}").alias(f"s{s}") for s in ("ab", "aa", "bb")]) for v, name in named.items()])))
    views = views.select(*keys, "n", "_mx", "_my", "ab", "aa", "bb", "x0", "x1", "y0", "y1", "_v.*")
    own = Window.partitionBy(*keys, "view")
    views = views.withColumns({"_dx": F.col("_mx") - F.sum(F.col("n") * F.col("_mx")).over(own) / F.sum("n").over(own), "_dy": F.col("_my") - F.sum(F.col("n") * F.col("_my")).over(own) / F.sum("n").over(own)})
    n, dx, dy = F.col("n"), F.col("_dx"), F.col("_dy")
    g = views.groupBy(*keys, "view").agg(F.sum("n").alias("n"), F.sum(F.col("ab") + n * dx * dy).alias("ab"), F.sum(F.col("aa") + n * dx * dx).alias("aa"), F.sum(F.col("bb") + n * dy * dy).alias("bb"),
                                         (F.min("x0") < F.max("x1")).alias("vx"), (F.min("y0") < F.max("y1")).alias("vy"), *[F.sum(c).alias(c) for c in ("sab", "saa", "sbb")])
    none = F.lit(default).cast("double")
    r = F.when((n >= min_n) & F.col("vx") & F.col("vy"), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(none)
    rho = F.when((n >= min_n) & (F.col("saa") > 0) & (F.col("sbb") > 0), F.col("sab") / F.sqrt(F.col("saa") * F.col("sbb"))).otherwise(none)
    return g.select(*keys, "view", "n", r.alias("r"), rho.alias("rho"))


def ladder(points, keys, order, *values):
    """The level means of one key as an array sorted by rung. A ladder has at most eight rungs."""
    s = F.struct(F.col(order).alias("ord"), *[F.col(v).cast("double").alias(v) for v in values])
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(s)).alias("pts"))


def kendall_tau(pts, x, y):
    """Tau-b over a short array of structs; 1 below three points, 0 when a side is constant."""
    def total(f):
        per = F.transform(pts, lambda a, i: F.aggregate(F.slice(pts, i + 2, F.size(pts)), F.lit(0.0), lambda s, b: s + f(a, b)))
        return F.aggregate(per, F.lit(0.0), lambda s, v: s + v)

    def sg(a, b, c):
        return F.signum(b[c].cast("double") - a[c].cast("double"))
    s = total(lambda a, b: sg(a, b, x) * sg(a, b, y))
    tx, ty = total(lambda a, b: F.abs(sg(a, b, x))), total(lambda a, b: F.abs(sg(a, b, y)))
    return F.when(F.size(pts) < 3, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(s, F.sqrt(tx * ty)), F.lit(0.0)))


def ladder_spearman(pts, x, y):
    """Spearman over a short array of structs: ranks by counting within the array; 0 below three points."""
    def rank(c):
        def one(a):
            lower = F.size(F.filter(pts, lambda b: b[c] < a[c]))
            same = F.size(F.filter(pts, lambda b: b[c] == a[c]))
            return lower + (same + 1) / F.lit(2.0) - (F.size(pts) + 1) / F.lit(2.0)
        return F.transform(pts, one)

    def fold(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rho = let(rank(x), lambda a: let(rank(y), lambda b: F.try_divide(fold(a, b), F.sqrt(fold(a, a) * fold(b, b)))))
    return F.when(F.size(pts) >= 3, F.coalesce(rho, F.lit(0.0))).otherwise(0.0)


def anova(groups, keys, n="n", s="s", q="q"):
    """One-way ANOVA from group counts, sums and sums of squares; F = 0 below two groups."""
    g = groups.groupBy(*keys).agg(F.sum(n).alias("N"), F.sum(s).alias("S"), F.sum(q).alias("Q"),
                                  F.sum(F.col(s) * F.col(s) / F.col(n)).alias("B"), F.count("*").alias("k"))
    ssb = F.col("B") - F.col("S") * F.col("S") / F.col("N")
    ssw = F.col("Q") - F.col("B")
    d1, d2 = F.col("k") - 1, F.col("N") - F.col("k")
    f = F.try_divide(ssb / d1, ssw / d2)
    return g.select(*keys, F.when(F.col("k") >= 2, f).otherwise(0.0).alias("f_stat"), d1.cast("double").alias("df1"), d2.cast("double").alias("df2"))


def paired_columns(x, y):
    """Aggregate columns of a paired test of x - y: n, means, effect, t, dz and degrees of freedom."""
    d = F.col(x) - F.col(y)
    sd = F.coalesce(F.stddev_samp(d), F.lit(0.0))
    n = F.count(d)
    effect = F.coalesce(F.avg(d), F.lit(0.0))
    return [n.alias("n_pairs"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean_x"), F.coalesce(F.avg(y), F.lit(0.0)).alias("mean_y"),
            effect.alias("effect"), F.when(n > 1, sd / F.sqrt(n.cast("double"))).otherwise(0.0).alias("sem"),
            F.when((n > 1) & (sd > 0), effect / (sd / F.sqrt(n.cast("double")))).otherwise(0.0).alias("t_stat"),
            F.when((n > 1) & (sd > 0), effect / sd).otherwise(0.0).alias("dz"), (n - 1).cast("double").alias("dof")]


def mirror_ttests(cells, outcomes):
    """Paired mirror tests per (outcome, rung) and overall, in one grouping-sets pass (rung null = overall)."""
    long = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"base_{o}").alias("base"), F.col(f"wordy_{o}").alias("wordy")) for o in outcomes]))
    rows = cells.select("rung", long.alias("o")).select("rung", "o.*").where("base IS NOT NULL AND wordy IS NOT NULL")
    return rows.groupingSets([["outcome", "rung"], ["outcome"]], "outcome", "rung").agg(*paired_columns("base", "wordy"))


def two_sample(df, keys, flag, value):
    """Pooled-variance t-test and effect size of `value` where flag is true against false."""
    aggs = []
    for lab, cond in (("a", F.col(flag)), ("b", ~F.col(flag))):
        v = F.when(cond, F.col(value))
        aggs += [F.count(v).alias(f"n_{lab}"), F.avg(v).alias(f"m_{lab}"), F.var_samp(v).alias(f"v_{lab}")]
    g = df.groupBy(*keys).agg(*aggs)
    dof = F.col("n_a") + F.col("n_b") - 2
    sp2 = F.try_divide((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"), dof)
    diff = F.col("m_a") - F.col("m_b")
    return g.select(*keys, "n_a", "n_b", "m_a", "m_b", diff.alias("difference"),
                    F.try_divide(diff, F.sqrt(sp2 * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("t_stat"),
                    F.coalesce(F.try_divide(diff, F.sqrt(sp2)), F.lit(0.0)).alias("cohens_d"), dof.cast("double").alias("dof"))


def fisher_ci(r, n):
    """95% interval of a correlation by the Fisher transform; r itself for n <= 3."""
    z = F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))
    se = F.try_divide(F.lit(1.0), F.sqrt((n - 3).cast("double")))
    lo, hi = F.tanh(z - 1.96 * se), F.tanh(z + 1.96 * se)
    return F.when(n <= 3, r).otherwise(lo), F.when(n <= 3, r).otherwise(hi)


def linear_trend(df, keys, x, y):
    """Slope, intercept, Pearson r and ranges; zeros below three points or two distinct x."""
    ok = (F.count(x) >= 3) & (F.min(x) < F.max(x))
    slope = F.when(ok, safe_slope(x, y)).otherwise(0.0)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        F.when(ok, safe_corr(x, y)).otherwise(0.0).alias("pearson_r"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def linear_residual(df, target, control, fit_on=None, min_slope=None):
    """Residual of target on control: fitted where `fit_on` holds (everywhere if it never does), applied to all.

    The fit is a one-row scalar subquery. Returns (rows with `residual`, fit row).
    """
    valid = F.col(control).isNotNull() & F.col(target).isNotNull()
    flag = valid & (fit_on if fit_on is not None else F.lit(True))
    use = df.where(valid).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("any")).select("any").scalar()
    fitted = df.withColumn("_any", use).withColumn("_in", F.when(F.col("_any"), flag).otherwise(valid))
    x, y = F.when(F.col("_in"), F.col(control)), F.when(F.col("_in"), F.col(target))
    slope = safe_slope(x, y)
    if min_slope is not None:
        slope = F.greatest(slope, F.lit(float(min_slope)))
    intercept = F.avg(y) - slope * F.avg(x)
    m = fitted.agg(slope.alias("slope"), intercept.alias("intercept"), F.count(x).alias("fit_n"),
                   F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    rss = F.col("vy") - 2 * F.col("slope") * F.col("cxy") + F.col("slope") * F.col("slope") * F.col("vx")
    fit = m.select("slope", "intercept", "fit_n", F.when(F.col("vy") > 0, 1 - rss / F.col("vy")).otherwise(0.0).alias("r_squared"))
    line = fit.select(F.struct("slope", "intercept").alias("f")).scalar()
    out = df.withColumn("_f", line).withColumn("residual", F.when(
        valid, F.col(target) - F.col("_f.intercept") - F.col("_f.slope") * F.col(control))).drop("_f")
    return out, fit


def group_slopes(df, group, x, y):
    """OLS slope, intercept and r within every group with two or more distinct x."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), safe_slope(x, y).alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.min(x) < F.max(x)).alias("ok"), F.when((F.count("*") >= 3) & (F.min(y) < F.max(y)), safe_corr(x, y)).alias("r"))
    return g.where("ok").select(group, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r")


def slope_summary(slopes):
    n = F.count("*")
    sd = F.stddev_samp("slope")
    return slopes.agg(n.alias("n_groups"), F.avg("n").alias("mean_points"), F.avg("slope").alias("mean_slope"),
                      F.stddev_pop("slope").alias("std_slope"), F.avg("intercept").alias("mean_intercept"),
                      F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean_within_r"),
                      F.coalesce(F.try_divide(F.avg("slope"), sd / F.sqrt(n.cast("double"))), F.lit(0.0)).alias("t_stat"))


# --- bootstrap -------------------------------------------------------------------------------------
def _poisson_cdf():
    """Cumulative probabilities of a Poisson(1) count until what is left is under 2^-53, the step of a double below 1."""
    out, total, p, k = [], 0.0, math.exp(-1), 0
    while 1 - (total := total + p) > 2.0 ** -53:
        out.append(total)
        k += 1
        p /= k
    return tuple(out)


POISSON_CDF = _poisson_cdf()


def draw_coefficients(n_boot, seed):
    """Multiplier and offset of every draw's hash, from md5 of (seed, draw)."""
    def h(tag, i):
        return int(hashlib.md5(f"{tag}{seed}|{i}".encode()).hexdigest()[:15], 16)
    return [(1 + h("a", i) % (PRIME - 1), h("c", i) % PRIME) for i in range(n_boot)]


def hash_residues(x, a, c):
    """(x * a + c) modulo the Mersenne prime, for uint64 arrays below it, in 32-bit halves."""
    m, half, low = np.uint64(PRIME), np.uint64(32), np.uint64(0xFFFFFFFF)
    ah, al, xh, xl = a >> half, a & low, x >> half, x & low
    mid = ah * xl + al * xh
    bottom = al * xl
    total = (ah * xh << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << half)
    total = (total & m) + (total >> np.uint64(61)) + (bottom & m) + (bottom >> np.uint64(61)) + c
    return total % m


def bootstrap_sums(units, keys, unit_cols, sums, n_boot=1000, seed=42):
    """Poisson-bootstrap totals: one row per (keys, draw) with the weighted sum of every `sums` column.

    `units` are pre-aggregated resampling units (items, clusters). An Arrow batch forms its units x draws weight matrix and multiplies it with
    the sums, so a task hands on n_boot rows per key and nothing is fanned out; weights are a hash of (unit, draw), the same on every retry.
    """
    keys = list(keys)
    a, c = (np.array(v, np.uint64) for v in zip(*draw_coefficients(n_boot, seed)))
    cdf, at_once, held = np.array(POISSON_CDF), 1024, 256

    def run(batches):
        totals = {}

        def rows():
            for key, t in totals.items():
                out = pd.DataFrame(t, columns=sums)
                for k, v in zip(keys, key):
                    out[k] = pd.Series([v] * len(out), dtype=object)
                out["draw"] = np.arange(n_boot, dtype=np.int32)
                yield out[[*keys, "draw", *sums]]
            totals.clear()
        for pdf in batches:
            x, values = pdf["_x"].to_numpy(np.uint64), pdf[sums].to_numpy(float)
            groups = pdf.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(len(pdf))}
            for key, rows_of in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                for i in range(0, len(rows_of), at_once):
                    r = rows_of[i:i + at_once]
                    u = hash_residues(x[r, None], a, c).astype(float) / float(PRIME)
                    part = np.searchsorted(cdf, u, "right").astype(float).T @ values[r]
                    totals[key] = totals[key] + part if key in totals else part
            if len(totals) > held:
                yield from rows()
        yield from rows()

    fields = [units.schema[k] for k in keys] + [T.StructField("draw", T.IntegerType())] + [T.StructField(s, T.DoubleType()) for s in sums]
    d = units.select(*keys, *[F.col(s).cast("double").alias(s) for s in sums], hash_int("unit", *unit_cols).alias("_x"))
    return d.mapInPandas(run, T.StructType(fields)).groupBy(*keys, "draw").agg(*[F.sum(s).alias(s) for s in sums])


# weighted statistics the bootstrap can resample, from unit sums
STATISTICS = {
    "mean": (("s", "n"), lambda: F.try_divide("s", "n")),
    "slope": (("sxy", "sxx"), lambda: F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx"))),
    "fe_corr": (("sxy", "sxx", "syy"), lambda: F.when((F.col("sxx") > 1e-12) & (F.col("syy") > 1e-12),
                                                      F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))),
    "corr": (("n", "sx", "sy", "qxx", "qyy", "qxy"), lambda: F.try_divide(
        F.col("qxy") - F.col("sx") * F.col("sy") / F.col("n"),
        F.sqrt((F.col("qxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("qyy") - F.col("sy") * F.col("sy") / F.col("n"))))),
}


def bootstrap_ci(units, keys, unit_cols, statistic, n_boot=1000, ci=0.95, seed=42):
    """Point estimate and percentile interval of a registered statistic (the percentile sees n_boot values per key)."""
    keys = list(keys)
    sums, stat = STATISTICS[statistic]
    d = bootstrap_sums(units, keys, unit_cols, list(sums), n_boot, seed).withColumn("stat", stat())
    lo = (1 - ci) / 2
    g = d.groupBy(*keys).agg(F.percentile("stat", F.array(F.lit(lo), F.lit(1 - lo))).alias("q"))
    g = g.select(*keys, F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))
    own = units.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]).select(*keys, stat().alias("estimate"))
    return g.join(own, keys) if keys else g.withColumn("estimate", own.scalar())


def slope_trend(df, group, x, y, n_boot=1000, ci=0.95, seed=42):
    """`slope_summary` with the bootstrap interval of the mean slope, the groups being the resampled units; a single group's interval is its slope."""
    slopes = materialize(df.sparkSession, group_slopes(df, group, x, y), "slopes")
    units = slopes.select(group, F.col("slope").alias("s"), F.lit(1).alias("n"))
    bounds = bootstrap_ci(units, [], [group], "mean", n_boot, ci, seed).select(F.struct("ci_lower", "ci_upper")).scalar()
    out = slope_summary(slopes).withColumn("_ci", bounds)
    for c in ("ci_lower", "ci_upper"):
        out = out.withColumn(f"slope_{c}", F.when(F.col("n_groups") > 1, F.col(f"_ci.{c}")).otherwise(F.col("mean_slope")))
    return out.drop("_ci")


def marginal_relationships(df, predictors, y, level="level_no"):
    """Every predictor against `y` on its own: Pearson r with its Fisher interval, Spearman rho and Kendall's tau of the level means."""
    z = F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).alias("x")) for p in predictors]))
    p = df.select(F.col(level).alias("level_no"), F.col(y).alias("y"), z.alias("z")).select("level_no", "y", "z.*")
    c = pearson(p, ["predictor"], "x", "y")
    lo, hi = fisher_ci(F.col("r"), F.col("n"))
    sp = spearman(p, ["predictor"], "x", "y").select("predictor", F.col("rho").alias("spearman_rho"))
    m = p.groupBy("predictor", "level_no").agg(F.round(F.avg("x"), 9).alias("mx"), F.round(F.avg("y"), 9).alias("my"))
    pts = F.col("pts")
    taus = ladder(m, ["predictor"], "level_no", "mx", "my").select(
        "predictor", kendall_tau(pts, "ord", "my").alias("tau_level_target"), kendall_tau(pts, "ord", "mx").alias("tau_level_predictor"),
        kendall_tau(pts, "mx", "my").alias("tau_predictor_target"))
    return c.select("predictor", "n", F.col("r").alias("pearson_r"), lo.alias("ci_lower"), hi.alias("ci_upper")).join(sp, "predictor").join(taus, "predictor")


# --- matched fixed effects ---------------------------------------------------------------------------
def unit_sums(df, unit, x, y, min_levels=2, level="level_no", extra=()):
    """Centred sums of squares of every matched unit with enough distinct levels (at most eight exist)."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*extra, *unit).agg(
        F.count("*").alias("n"), F.size(F.collect_set(level)).alias("levels"), (F.var_pop(x) * F.count("*")).alias("sxx"),
        (F.var_pop(y) * F.count("*")).alias("syy"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"),
        safe_corr(x, y, 3, None).alias("r"))
    return g.where((F.col("levels") >= min_levels) & (F.col("n") >= 2))


def fixed_effects_summary(units, keys=()):
    """Demeaned correlation and slopes from unit sums, and the mean and positive share of within-unit r."""
    sxx, syy, sxy = F.sum("sxx"), F.sum("syy"), F.sum("sxy")
    r = F.when((sxx > 1e-12) & (syy > 1e-12), sxy / F.sqrt(sxx * syy))
    return units.groupBy(*keys).agg(
        F.count("*").alias("n_units"), F.sum("n").alias("n_rows"), r.alias("fe_r"), F.when(sxx > 1e-12, sxy / sxx).alias("fe_slope"),
        r.alias("fe_std_beta"), F.count("r").alias("within_n"), F.avg("r").alias("within_mean"),
        F.avg((F.col("r") > 0).cast("double")).alias("within_positive_rate"))


# --- bridge, calibration, densities ---------------------------------------------------------------------
def with_scalars(df, row, name="_st"):
    """Attach a one-row aggregate as a struct column (scalar subquery, no join)."""
    return df.withColumn(name, row.select(F.struct(*row.columns).alias("z")).scalar())


def z(c, m, s):
    return F.when(s > 1e-8, (c - m) / s).otherwise(c - m)


def log_prediction(predicted):
    return F.log1p(F.greatest(F.col(predicted), F.lit(0.0)))


def standardized_bridge(df, predicted="predicted", actual="actual"):
    """z(log1p(max(pred,0))) and z(actual) on every row."""
    d = df.withColumn("pred_log", log_prediction(predicted))
    st = d.agg(F.avg("pred_log").alias("pm"), F.stddev_pop("pred_log").alias("ps"), F.avg(actual).alias("am"), F.stddev_pop(actual).alias("as"))
    d = with_scalars(d, st)
    return d.withColumn("pred_z", z(F.col("pred_log"), F.col("_st.pm"), F.col("_st.ps"))).withColumn(
        "actual_z", z(F.col(actual), F.col("_st.am"), F.col("_st.as"))).drop("_st")


def prediction_error(df, predicted="predicted", actual="actual"):
    """Calibrated prediction, residual and absolute error on every row."""
    slope = safe_slope(predicted, actual)
    fit = df.agg(slope.alias("b"), (F.avg(actual) - slope * F.avg(predicted)).alias("a"))
    d = with_scalars(df, fit)
    cal = F.col("_st.a") + F.col("_st.b") * F.col(predicted)
    return d.withColumn("calibrated", cal).withColumn("residual", F.col(actual) - F.col("calibrated")).withColumn(
        "abs_error", F.abs("residual")).drop("_st")


def kde(df, keys, value, points=200):
    """Gaussian density on an even grid between the extremes, bandwidth 1.06*sd*n^(-1/5); needs two values.

    Equal values are counted first; a task adds its values up on the grid, so it hands on one row per key and grid point.
    """
    keys = list(keys)
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))
    st = df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    st = st.where("n >= 2 AND sd > 0").withColumn("bw", 1.06 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).drop("sd")
    held, at_once = 1024, 4096

    def run(batches):
        total = {}

        def rows():
            for key, (x, d) in total.items():
                out = pd.DataFrame({"i": np.arange(points, dtype=np.int32), "x": x, "density": d})
                for k, v in zip(keys, key):
                    out[k] = pd.Series([v] * points, dtype=object)
                yield out[[*keys, "i", "x", "density"]]
            total.clear()
        for pdf in batches:
            for key, at in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                first = pdf.iloc[at[0]]
                x = first["lo"] + (first["hi"] - first["lo"]) * np.arange(points) / (points - 1)
                d = total[key][1] if key in total else np.zeros(points)
                for i in range(0, len(at), at_once):
                    part = pdf.iloc[at[i:i + at_once]]
                    z = (x - part["v"].to_numpy()[:, None]) / first["bw"]
                    d = d + part["k"].to_numpy() @ np.exp(-0.5 * z * z) / (first["bw"] * math.sqrt(2 * math.pi) * first["n"])
                total[key] = x, d
            if len(total) > held:
                yield from rows()
        yield from rows()

    fields = [df.schema[k] for k in keys] + [T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("density", T.DoubleType())]
    return c.join(st, keys).mapInPandas(run, T.StructType(fields)).groupBy(*keys, "i").agg(F.max("x").alias("x"), F.sum("density").alias("density"))


def histogram(df, keys, value):
    """Counts per bin with clamp(floor(sqrt n), 10, 50) equal bins; the last bin is closed."""
    st = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    st = st.withColumn("bins", F.greatest(F.lit(10), F.least(F.lit(50), F.floor(F.sqrt("n")))))
    d = df.where(F.col(value).isNotNull()).join(st, list(keys))
    pos = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * F.col("bins")
    b = F.least(F.floor(pos), F.col("bins") - 1)
    return d.groupBy(*keys, "bins", b.cast("int").alias("bin")).agg(F.count("*").alias("k"))


def gates(tests, thresholds):
    """Pass flag of every (test, value) row against its threshold row (direction min or max); missing fails."""
    j = tests.join(thresholds, "test", "left")
    ok = F.when(F.col("direction") == "min", F.col("value") > F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return j.withColumn("passed", F.coalesce(ok, F.lit(False)))


def verdict(gated, *keys):
    return gated.groupBy(*keys).agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_total"), F.bool_and("passed").alias("supported"))
