"""OLS with classical and cluster-robust (CR1) errors from cross-product sums.

One aggregation folds the facts to one small row per (key, cluster), written once. Solving works on k x k matrices in Arrow
batches of the key rows; grand means, totals and cluster scores all come from the folded table, so the facts are read once
and never gathered. Many regressions (per view, perturbation, family) are one job with the key as a column.
Fixed effects of a categorical are partialled out by demeaning within its levels, which gives the same
coefficients and scores as K-1 dummy columns.
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pvalues import t_sf2
from ..session import materialize
from .stats import log_prediction, marginal_relationships
from .trials import complete_cases, is_complete, level_views


def _pairs(k):
    return [(i, j) for i in range(k) for j in range(i, k)]


def fold(df, cols, by, also=None):
    """One pass over the facts: count, means m<i> and centred cross products c<i>_<j> of `cols` per cell of `by`, written once.

    `also` are aggregates over all rows of a cell, complete or not; with them, cells without a complete row are written too.
    """
    if also:
        ok = is_complete(cols, by)
        rows = df.withColumns({"_ok": ok, **{f"_v{i}": F.when(ok, F.col(c).cast("double")) for i, c in enumerate(cols)}})
        v, n = [F.col(f"_v{i}") for i in range(len(cols))], F.count_if("_ok")
    else:
        rows = complete_cases(df, cols, by)
        v, n = [F.col(c).cast("double") for c in cols], F.count("*")
    cells = rows.groupBy(*by).agg(n.alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)],
                                  *[(F.covar_pop(v[i], v[j]) * n).alias(f"c{i}_{j}") for i, j in _pairs(len(v))], *(also or []))
    return materialize(df.sparkSession, cells, "cells")


def cluster_sums(cells, cols, keys, cluster, centred=False, single=False):
    """Counts, sums s<i> and cross products q<i>_<j> per (keys, cluster) from folded cells, about the grand mean, which is kept as `shift`.

    The grand mean comes from the folded cells; `centred` cells are already about the means of their level and stay where they are. `single` says that
    (keys, cluster) has one cell each, so nothing is left to add up and no row moves; otherwise the sums are written once.
    """
    if centred:
        shift = F.struct(*[F.lit(0.0).alias(c) for c in cols])
    else:
        shift = cells.agg(*[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(c) for i, c in enumerate(cols)]).select(F.struct(*cols).alias("z")).scalar()
    d = cells.withColumn("shift", shift)
    dev = [F.col(f"m{i}") - F.col(f"shift.{c}") for i, c in enumerate(cols)]
    d = d.select(*keys, cluster, "n", "shift", *[f"c{i}_{j}" for i, j in _pairs(len(cols))], *[x.alias(f"d{i}") for i, x in enumerate(dev)])
    if single:
        return d.select(*keys, cluster, "n", "shift", *[(F.col("n") * F.col(f"d{i}")).alias(f"s{i}") for i in range(len(cols))],
                        *[(F.col(f"c{i}_{j}") + F.col("n") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"q{i}_{j}") for i, j in _pairs(len(cols))])
    sums = d.groupBy(*keys, cluster).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"d{i}")).alias(f"s{i}") for i in range(len(cols))],
        *[F.sum(F.col(f"c{i}_{j}") + F.col("n") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"q{i}_{j}") for i, j in _pairs(len(cols))])
    # the shift is put back behind the aggregate: a struct among its values would make it sort its rows
    return materialize(cells.sparkSession, sums.withColumn("shift", shift), "sums")


def _few(df, keyed):
    """An unkeyed fit has exactly one key row, so that side may be broadcast; that of a keyed fit is written, and broadcast where its bytes are few,
    before the cells would be shuffled by a handful of keys."""
    return materialize(df.sparkSession, df, "keys") if keyed else F.broadcast(df)


def _center(g, k, within, keys, keyed):
    """Cross products about the key means (pooled) or about the cluster's own means (within)."""
    m = k + 1
    if within:
        g = g.where("n >= 2")
        mean = [F.try_divide(F.col(f"s{i}"), F.col("n")) for i in range(m)]
        dev = [F.lit(0.0)] * m
        cross = {(i, j): F.col(f"q{i}_{j}") - F.col(f"s{i}") * mean[j] for i, j in _pairs(m)}
        mu = [F.lit(0.0)] * m
    else:
        tot = g.groupBy(*keys).agg(F.sum("n").alias("key_n"), *[F.sum(f"s{i}").alias(f"key_s{i}") for i in range(m)])
        g = g.join(_few(tot, keyed), list(keys))
        mu = [F.col(f"key_s{i}") / F.col("key_n") for i in range(m)]
        dev = [F.col(f"s{i}") - F.col("n") * mu[i] for i in range(m)]
        cross = {(i, j): F.col(f"q{i}_{j}") - F.col(f"s{i}") * mu[j] - mu[i] * F.col(f"s{j}") + F.col("n") * mu[i] * mu[j]
                 for i, j in _pairs(m)}
    return g.select(*keys, "n", "shift", *[d.alias(f"d{i}") for i, d in enumerate(dev)], *[c.alias(f"c{i}_{j}") for (i, j), c in cross.items()],
                    *[u.alias(f"m{i}") for i, u in enumerate(mu)])


def fit(df, xs, y, cluster, keys=(), within=False):
    """Coefficient table: one row per key and predictor (and the intercept of a pooled fit). `within` demeans by cluster and drops clusters of one row."""
    own = list(keys) or ["_one"]
    df = df if keys else df.withColumn("_one", F.lit("all"))
    return fit_cells(fold(df, [*xs, y], [*own, cluster]), xs, y, cluster, keys, within, single=True)


def fit_cells(cells, xs, y, cluster, keys=(), within=False, absorb=None, spread=None, single=False):
    """`fit` from folded cells; `single` if (keys, cluster) has one cell each. `absorb` is the number of categorical levels already demeaned out of them (None for a plain fit); `spread`
    then holds the variances w<i> of the undemeaned columns for R2 and scaling."""
    own = list(keys) or ["_one"]
    k, m = len(xs), len(xs) + 1
    df = cells
    g = cluster_sums(cells, [*xs, y], own, cluster, absorb is not None, single)
    c = _center(g, k, within, own, bool(keys))
    total = c.groupBy(*own).agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), *[F.first(F.col("shift")[x]).alias(f"h{i}") for i, x in enumerate([*xs, y])],
        *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in _pairs(m)], *[F.first(f"m{i}").alias(f"m{i}") for i in range(m)])
    total = total.withColumn("shift", F.struct(*[F.col(f"h{i}").alias(x) for i, x in enumerate([*xs, y])])).drop(*[f"h{i}" for i in range(m)])
    total = materialize(df.sparkSession, total, "totals")

    key_fields = [df.schema[c_] if c_ in df.columns else T.StructField(c_, T.StringType()) for c_ in own]
    solved_schema = T.StructType(key_fields + [T.StructField("beta", T.ArrayType(T.DoubleType()))])

    def cxx(row):
        a = np.zeros((m, m))
        for i, j in _pairs(m):
            a[i, j] = a[j, i] = row[f"c{i}_{j}"]
        return a

    def scaled_pinv(a):
        s = np.sqrt(np.maximum(np.diag(a), 0.0))
        s[s == 0] = 1.0
        b = a / np.outer(s, s)
        return np.linalg.pinv(b, rcond=1e-10, hermitian=True) / np.outer(s, s), int(np.linalg.matrix_rank(b, tol=1e-8, hermitian=True))

    intercept = not within and absorb is None

    def full_pinv(row, a):
        """Moore-Penrose inverse of the raw cross products, intercept column last (rank-deficient designs)."""
        if not intercept:
            return np.linalg.pinv(a[:k, :k], rcond=1e-10, hermitian=True)
        n = float(row["n"])
        xb = np.array([row[f"m{i}"] + row["shift"][x] for i, x in enumerate(xs)], dtype=float)
        gfull = np.zeros((k + 1, k + 1))
        gfull[:k, :k] = a[:k, :k] + n * np.outer(xb, xb)
        gfull[:k, k] = gfull[k, :k] = n * xb
        gfull[k, k] = n
        return np.linalg.pinv(gfull, rcond=1e-10, hermitian=True)

    def estimate(row, a):
        """Coefficients of xs; the least-norm ones where the design lacks full rank."""
        inv, rk = scaled_pinv(a[:k, :k])
        if rk == k:
            return inv @ a[:k, k]
        p = full_pinv(row, a)
        if not intercept:
            return p @ a[:k, k]
        n = float(row["n"])
        xb = np.array([row[f"m{i}"] + row["shift"][x] for i, x in enumerate(xs)], dtype=float)
        yb = float(row[f"m{k}"] + row["shift"][y])
        return (p @ np.append(a[:k, k] + n * xb * yb, n * yb))[:k]

    def solve(batches):
        for pdf in batches:
            out = pdf[own].copy()
            betas = []
            for _, row in pdf.iterrows():
                a = cxx(row)
                betas.append(list(estimate(row, a)))
            out["beta"] = betas
            yield out
    beta = _few(total.mapInPandas(solve, solved_schema), keys)

    s = c.join(beta, own)
    b = [F.col("beta")[i] for i in range(k)]

    def cr(i, j):
        return F.col(f"c{min(i, j)}_{max(i, j)}")
    score = [cr(i, k) - sum((b[j] * cr(i, j) for j in range(1, k)), b[0] * cr(i, 0)) for i in range(k)]
    score.append(F.col(f"d{k}") - sum((b[j] * F.col(f"d{j}") for j in range(1, k)), b[0] * F.col("d0")))
    u = s.select(*own, *[e.alias(f"u{i}") for i, e in enumerate(score)])
    meat = u.groupBy(*own).agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"b{i}_{j}") for i, j in _pairs(m)])
    final = total.join(beta, own).join(_few(meat, keys), own)
    if spread is not None:
        final = final.join(_few(spread, keys), own)

    fields = [("predictor", "string"), ("beta", "double"), ("standardized_beta", "double"), ("stderr", "double"), ("t_stat", "double"),
              ("p_value", "double"), ("classical_stderr", "double"), ("classical_t", "double"), ("classical_p", "double"),
              ("design_effect", "double"), ("n", "long"), ("n_clusters", "long"), ("rank", "int"), ("dof", "long"),
              ("r_squared", "double"), ("adjusted_r_squared", "double")]
    out_schema = T.StructType(key_fields + [T.StructField(a, {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(),
                                                                "int": T.IntegerType()}[t]) for a, t in fields])
    extra = 1 if intercept else (absorb or 0)

    scaled = spread is not None

    def finish(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                a = cxx(r)
                inv, rk = scaled_pinv(a[:k, :k])
                bt = np.asarray(r["beta"], dtype=float)
                n, gc = int(r["n"]), int(r["g"])
                if n < max(4, k + 1):
                    continue
                rss = max(a[k, k] - bt @ a[:k, k], 0.0)
                tss = float(r[f"w{k}"]) * n if scaled else a[k, k]
                r2 = 1 - rss / tss if tss > 0 else 0.0
                rank = rk + extra
                dof = max(0, n - rank)
                adj = 1 - (1 - r2) * (n - 1) / dof if not within and dof > 0 else r2
                meat_m = np.zeros((m, m))
                for i, j in _pairs(m):
                    meat_m[i, j] = meat_m[j, i] = r[f"b{i}_{j}"]
                p_all = k + extra
                corr = (gc / (gc - 1)) * ((n - 1) / (n - p_all)) if gc > 1 and n > p_all else 1.0
                cov = corr * inv @ meat_m[:k, :k] @ inv
                sigma2 = rss / dof if dof > 0 else 0.0
                sd = [np.sqrt(float(r[f"w{i}"])) if scaled else np.sqrt(a[i, i] / n) for i in range(m)]
                names, est = list(xs), list(bt)
                ses, cse = list(np.sqrt(np.maximum(np.diag(cov), 0))), list(np.sqrt(np.maximum(sigma2 * np.diag(inv), 0)))
                std = [e * sd[i] / sd[k] if sd[k] > 0 and sd[i] > 0 else 0.0 for i, e in enumerate(bt)]
                if intercept:
                    xbar = np.array([r[f"m{i}"] + r["shift"][x] for i, x in enumerate(xs)], dtype=float)
                    w = np.append(-inv @ xbar, 1.0 / n)
                    names.append("intercept")
                    est.append(float(r[f"m{k}"] + r["shift"][y] - xbar @ bt))
                    ses.append(float(np.sqrt(max(corr * w @ meat_m @ w, 0))))
                    cse.append(float(np.sqrt(max(sigma2 * (1.0 / n + xbar @ inv @ xbar), 0))))
                    std.append(0.0)
                if rk < k:
                    p = full_pinv(r, a)
                    lift = np.eye(len(p), m)
                    if intercept:
                        lift[:k, k] = xbar
                    robust = corr * p @ (lift @ meat_m @ lift.T) @ p
                    ses = list(np.sqrt(np.maximum(np.diag(robust), 0)))
                    cse = list(np.sqrt(np.maximum(sigma2 * np.diag(p), 0)))
                cd = max(1, gc - 1)
                for nm, e, se, cs, sb in zip(names, est, ses, cse, std):
                    t, ct = (e / se if se > 0 else 0.0), (e / cs if cs > 0 else 0.0)
                    rows.append([*[r[o] for o in own], nm, e, sb, se, t, float(t_sf2(t, cd)), cs, ct,
                                 float(t_sf2(ct, dof)) if dof > 0 else 1.0, (se / cs) ** 2 if cs > 0 else None,
                                 n, gc, rank, cd, r2, adj])
            yield pd.DataFrame(rows, columns=[f.name for f in out_schema])
    res = final.mapInPandas(finish, out_schema)
    return res if keys else res.drop("_one")


def long_format_fit(df, xs, y, cluster, by, models=("no_fe", "fe")):
    """Regression with and without the fixed effects of `by` (T20), as one table with a `model` column. The facts are folded once to
    (level, cluster); demeaning within a level moves only the cells' means. A model that is not asked for is not worked out."""
    cols = [*xs, y]
    m = len(cols)
    cells = fold(df.withColumn("_one", F.lit("all")), cols, ["_one", by, cluster])
    fits = []
    if "no_fe" in models:
        fits.append(fit_cells(cells, xs, y, cluster).withColumn("model", F.lit("no_fe")))
    if "fe" in models:
        level = cells.groupBy(F.col(by).alias("_by")).agg(*[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"l{i}") for i in range(m)])
        level = materialize(df.sparkSession, level, "levels")
        moved = cells.join(level, F.col(by) == F.col("_by")).withColumns({f"m{i}": F.col(f"m{i}") - F.col(f"l{i}") for i in range(m)}).drop("_by", *[f"l{i}" for i in range(m)])
        fits.append(fit_cells(moved, xs, y, cluster, absorb=level.count(), spread=_spread(cells, m)).withColumn("model", F.lit("fe")))
    return fits[0] if len(fits) == 1 else fits[0].unionByName(fits[1])


def _spread(cells, m):
    """Variances w<i> of the columns over all rows, straight from the cells about their grand mean; no row moves by cluster."""
    mean = cells.agg(*[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"g{i}") for i in range(m)]).select(F.struct(*[f"g{i}" for i in range(m)]).alias("z")).scalar()
    d = cells.withColumn("_g", mean)
    dev = [F.col(f"m{i}") - F.col(f"_g.g{i}") for i in range(m)]
    return d.groupBy("_one").agg(*[(F.sum(F.col(f"c{i}_{i}") + F.col("n") * x * x) / F.sum("n")).alias(f"w{i}") for i, x in enumerate(dev)])


def fit_by_key(df, xs, y, cluster, key, min_rows):
    """One fit per key with enough rows; the others are reported as skipped (T21, T22). Row counts come from the folded cells."""
    cells = fold(df, [*xs, y], [key, cluster])
    counts = _few(cells.groupBy(key).agg(F.sum("n").alias("n_rows")), True)
    good = counts.where(F.col("n_rows") >= max(min_rows, len(xs) + 2))
    res = fit_cells(cells.join(good.select(key), key, "left_semi"), xs, y, cluster, [key], single=True)
    return counts.join(res, key, "left").withColumn("skipped", F.col("predictor").isNull())


def prediction_fit(df, predicted, xs, y, cluster):
    """Fit per level view on overlap_z, `stats.standardized_bridge` of the prediction, `xs`, and `is_binary` and `prediction_entropy` where they vary / exist.

    z is affine, so the facts are folded once with its logarithm, beside what its mean and deviation and the choice of predictors are taken from; the
    cells then move to z. Only a predictor that drops out is a second fold. Facts dealt by `cluster` do not move for the fold.
    """
    spark = df.sparkSession
    v = level_views(df.withColumn("_log", log_prediction(predicted)))
    more = [c for c in ("is_binary", "prediction_entropy") if c in df.columns]
    cells = fold(v, ["_log", *xs, *more, y], ["view", cluster], [
        F.count("_log").alias("_n"), F.avg("_log").alias("_m"), (F.var_pop("_log") * F.count("_log")).alias("_q"),
        *[e for c in more for e in (F.count(c).alias(f"_{c}_n"), F.min(c).alias(f"_{c}_lo"), F.max(c).alias(f"_{c}_hi"))]])
    every = cells.where("view = 'pooled'")     # each row once
    s = every.agg(F.try_divide(F.sum(F.col("_n") * F.col("_m")), F.sum("_n")).alias("m"), *[e for c in more for e in (
        F.sum(f"_{c}_n").alias(f"{c}_n"), F.min(f"_{c}_lo").alias(f"{c}_lo"), F.max(f"_{c}_hi").alias(f"{c}_hi"))]).first()
    mean = s["m"] if s["m"] is not None else float("nan")
    var = every.agg(F.try_divide(F.sum(F.col("_q") + F.col("_n") * (F.col("_m") - mean) * (F.col("_m") - mean)), F.sum("_n"))).first()[0]
    sd = np.sqrt(var) if var is not None else float("nan")
    kept = [c for c in more if (s["is_binary_lo"] == 0 and s["is_binary_hi"] == 1 if c == "is_binary" else s[f"{c}_n"] > 0)]
    if kept != more:
        cells = fold(v, ["_log", *xs, *kept, y], ["view", cluster])
    names = ["overlap_z", *xs, *kept]
    scale = 1.0 / sd if sd > 1e-8 else 1.0
    cells = cells.where(F.col("n") > 0).where(F.lit(bool(np.isfinite(mean) and np.isfinite(sd))))   # without a finite z no row is complete
    to_z = {"m0": (F.col("m0") - mean) * scale, "c0_0": F.col("c0_0") * scale * scale, **{f"c0_{j}": F.col(f"c0_{j}") * scale for j in range(1, len(names) + 1)}}
    return fit_cells(cells.withColumns(to_z), names, y, cluster, ["view"], single=True)


def sign_stability(fits):
    """Share of positive and negative coefficients per predictor over the keys, and their spread."""
    f = fits.where("predictor IS NOT NULL AND predictor <> 'intercept'")
    return f.groupBy("predictor").agg(
        F.count("*").alias("n_fits"), F.avg((F.col("beta") > 0).cast("double")).alias("fraction_positive"),
        F.avg((F.col("beta") < 0).cast("double")).alias("fraction_negative"), F.avg("beta").alias("mean_beta"),
        F.percentile("beta", F.lit(0.5)).alias("median_beta"), F.stddev_pop("beta").alias("std_beta"))  # one value per key


def vif(df, keys, xs):
    """Variance inflation of every predictor from the inverse correlation matrix (k x k per key)."""
    rows = complete_cases(df, xs, keys)
    k = len(xs)
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i, j in _pairs(k)])
    schema = T.StructType([df.schema[c] for c in keys] + [T.StructField("predictor", T.StringType()), T.StructField("n", T.LongType()),
                                                           T.StructField("vif", T.DoubleType()), T.StructField("first_pair_r", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                a = np.zeros((k, k))
                for i, j in _pairs(k):
                    a[i, j] = a[j, i] = r[f"c{i}_{j}"]
                s = np.sqrt(np.diag(a))
                for i in range(k):
                    o = [j for j in range(k) if j != i]
                    tss = a[i, i]
                    r2 = (a[i, o] @ np.linalg.pinv(a[np.ix_(o, o)], hermitian=True) @ a[o, i]) / tss if tss > 0 else 0.0
                    pair = a[0, 1] / (s[0] * s[1]) if s[0] > 0 and s[1] > 0 else 0.0
                    out.append([*[r[c] for c in keys], xs[i], int(r["n"]), 1 / max(1e-12, 1 - r2) if r["n"] >= 3 else 1.0, pair])
            yield pd.DataFrame(out, columns=[f.name for f in schema])
    return g.mapInPandas(run, schema)


def horse_race_view(df, view, predictors, y, cluster):
    """What a view of the horse race reports: the marginal relationships for `primary`, else (fit, coefficients) of the pooled and the within-cluster fit."""
    rows = level_views(df).where(F.col("view") == view)
    if view == "primary":
        return marginal_relationships(rows, predictors, y)
    pooled = fit(rows, predictors, y, cluster).withColumn("fit", F.lit("pooled"))
    return pooled.unionByName(fit(rows, predictors, y, cluster, within=True).withColumn("fit", F.lit("within_item")))
