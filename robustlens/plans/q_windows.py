"""W: ordered computations, and the sweep and filter aggregates built on them."""
from pyspark.sql import functions as F

from ..functions.arrays import asum, bandwidth, centroid_norm, normalize, tail_mass, top_k_mass
from ..functions.numeric import div0, r6, sd0, sdp0
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import windows as wn
from . import bindings as b
from .q_aggregates import outcomes, rounded
from .q_joins import _COS, _L2
from .registry import query
from .sqlkit import DIV0, R


@query("w01_average_ranks", f"""{b.T()}, v AS (SELECT family, loglik_drift, rank() OVER (PARTITION BY family ORDER BY loglik_drift) AS rk, count(*) OVER (PARTITION BY family, loglik_drift) AS k FROM tr)
SELECT DISTINCT family, {R('loglik_drift')} AS loglik_drift, CAST(k AS BIGINT) AS k, {R('rk + (k - 1) / 2.0')} AS rank FROM v""")
def w01(spark, sf):
    return rounded(wn.average_ranks(outcomes(spark, sf), "loglik_drift", ["family"]), "loglik_drift", "rank")


_CURVE = "cv AS (SELECT item_id, mode, level_no, cutoff, avg(pert_correct) AS acc FROM tr GROUP BY 1, 2, 3, 4)"


def curve(spark, sf):
    t = outcomes(spark, sf, "mode", "cutoff")
    return t.groupBy("item_id", "mode", "level_no", "cutoff").agg(F.avg("pert_correct").alias("acc"))


_CRIT = f"""{_CURVE}, o AS (SELECT *, lead(acc) OVER w AS nx, lead(cutoff) OVER w AS nc, first_value(acc) OVER (PARTITION BY item_id, mode, level_no ORDER BY cutoff) AS fa,
  first_value(acc) OVER (PARTITION BY item_id, mode, level_no ORDER BY cutoff DESC) AS la FROM cv WINDOW w AS (PARTITION BY item_id, mode, level_no ORDER BY cutoff)),
x AS (SELECT *, CASE WHEN la >= fa THEN acc < 0.5 AND nx >= 0.5 ELSE acc >= 0.5 AND nx < 0.5 END AS hit FROM o),
crit AS (SELECT item_id, mode, level_no, CASE WHEN max(la) >= max(fa) THEN max(fa) >= 0.5 ELSE max(fa) < 0.5 END AS done,
  arg_min(cutoff + (0.5 - acc) / (nx - acc) * (nc - cutoff), cutoff) FILTER (WHERE hit) AS hv, min(cutoff) AS fc, max(cutoff) AS lc FROM x GROUP BY 1, 2, 3),
cc AS (SELECT item_id, mode, level_no, CASE WHEN done THEN fc ELSE coalesce(hv, lc) END AS critical_cutoff, NOT done AND hv IS NOT NULL AS crossed FROM crit)"""


@query("w03_critical_cutoff", f"{b.T('mode', 'cutoff')}, {_CRIT} SELECT item_id, mode, level_no, {R('critical_cutoff')} AS critical_cutoff, crossed FROM cc")
def w03(spark, sf):
    return rounded(wn.critical_cutoff(curve(spark, sf), ["item_id", "mode", "level_no"], 0.5), "critical_cutoff")


@query("w04_curve_diagnostic", f"""{b.T('mode', 'cutoff')}, {_CURVE}, m AS MATERIALIZED (SELECT mode, level_no, cutoff, avg(acc) AS acc FROM cv GROUP BY 1, 2, 3)
SELECT mode, level_no, {R('min(acc)')} AS min_accuracy, {R('min(cutoff) FILTER (WHERE acc = mn)')} AS min_cutoff, {R('1 - min(acc)')} AS max_loss, min(acc) < 0.6 AS crossed,
  arg_min(acc, cutoff) < 0.6 AS below_at_first, arg_max(acc, cutoff) < 0.6 AS below_at_last FROM (SELECT *, min(acc) OVER (PARTITION BY mode, level_no) AS mn FROM m) GROUP BY 1, 2""")
def w04(spark, sf):
    m = curve(spark, sf).groupBy("mode", "level_no", "cutoff").agg(F.avg("acc").alias("acc"))
    return rounded(wn.curve_diagnostic(m, ["mode", "level_no"], 0.6), "min_accuracy", "min_cutoff", "max_loss")


@query("w05_flip_threshold", f"{b.T('mode', 'cutoff', 'order_id')} SELECT order_id, mode, {R('min(cutoff) FILTER (WHERE changed)')} AS threshold FROM tr GROUP BY 1, 2")
def w05(spark, sf):
    return rounded(wn.flip_threshold(outcomes(spark, sf, "mode", "cutoff", "order_id"), ["order_id", "mode"]), "threshold")


@query("w06_demean", f"{b.T()} SELECT item_id, level_no, perturbation, {R('loglik_drift - avg(loglik_drift) OVER (PARTITION BY item_id)')} AS loglik_drift_dm, CAST(count(*) OVER (PARTITION BY item_id) AS BIGINT) AS unit_n FROM tr")
def w06(spark, sf):
    d = wn.demean(outcomes(spark, sf), ["item_id"], "loglik_drift")
    return d.select("item_id", "level_no", "perturbation", r6("loglik_drift_dm").alias("loglik_drift_dm"), "unit_n")


@query("w07_monotone", f"""{b.T()}, m AS (SELECT family, level_no, round(avg(volatility), 9) AS v FROM tr GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY family ORDER BY level_no) AS p FROM m)
SELECT family, coalesce(bool_and(p <= v), true) AS non_decreasing, coalesce(bool_and(p >= v), true) AS non_increasing FROM l GROUP BY family""")
def w07(spark, sf):
    m = outcomes(spark, sf).groupBy("family", "level_no").agg(F.round(F.avg("volatility"), 9).alias("v"))
    return wn.monotone(m, ["family"], "level_no", "v")


_LAY = """ly AS (SELECT vec_id, embedding, CAST(vec_id % 28 AS INT) AS layer, 28 AS n_layers, CAST(label % 8 + 1 AS INT) AS level_no FROM embeddings),
lg AS (SELECT *, CASE WHEN layer < greatest(1, n_layers // 3) THEN 'early' WHEN layer < least(greatest(greatest(1, n_layers // 3) + 1, 2 * n_layers // 3), n_layers) THEN 'mid' ELSE 'late' END AS layer_group FROM ly)"""


def layered_filters(spark, sf):
    f = b.filters(spark, sf).withColumn("layer", (F.col("item_id") % 28).cast("int")).withColumn("n_layers", F.lit(28))
    return wn.layer_groups(f)


@query("w08_layer_groups", f"WITH {_LAY} SELECT layer_group, layer, CAST(count(*) AS BIGINT) AS n, layer >= n_layers - 4 AS last_4 FROM lg GROUP BY layer_group, layer, n_layers")
def w08(spark, sf):
    return layered_filters(spark, sf).groupBy("layer_group", "layer", (F.col("layer") >= F.col("n_layers") - 4).alias("last_4")).agg(F.count("*").alias("n"))


@query("w09_top_margin", f"WITH {b.SCORES_SQL}, s AS (SELECT *, list_sort([sA, sB, sC, sD], 'DESC') AS v FROM cs) SELECT item_id, level_no, {R('v[1] - v[2]')} AS margin FROM s")
def w09(spark, sf):
    return b.clean_scores(spark, sf).select("item_id", "level_no", r6(wn.top_margin(F.map_values("scores"))).alias("margin"))


@query("w10_radial_cdf", f"""WITH {b.FILTERS_SQL}, x AS (SELECT item_id, level_no, b, sum(w[b]) OVER (PARTITION BY item_id ORDER BY b) AS cdf FROM filters, range(1, 9) t(b))
SELECT level_no, CAST(b AS INT) AS bin, {R('avg(cdf)')} AS mean_cdf, {R('coalesce(stddev_samp(cdf), 0) / sqrt(count(*))')} AS sem FROM x GROUP BY 1, 2""")
def w10(spark, sf):
    p = b.filters(spark, sf).select("item_id", "level_no", F.posexplode("w").alias("bin", "mass")).withColumn("bin", F.col("bin") + 1)
    c = wn.cumulative_mass(p, ["item_id", "level_no"])
    return c.groupBy("level_no", "bin").agg(r6(F.avg("cdf")).alias("mean_cdf"), r6(sd0("cdf") / F.sqrt(F.count("*"))).alias("sem"))


@query("w02_id_stability", """WITH m AS (SELECT vec_id // 10 AS video, vec_id, CAST(i AS INT) AS cell FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE x > 0),
f AS (SELECT vec_id // 10 AS video, vec_id, lag(vec_id) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS prev FROM embeddings),
s AS (SELECT vec_id, count(*) AS k FROM m GROUP BY 1), i AS (SELECT f.video, f.vec_id, (SELECT count(*) FROM m a JOIN m b ON a.cell = b.cell WHERE a.vec_id = f.vec_id AND b.vec_id = f.prev) AS c, s.k AS ka, p.k AS kb FROM f JOIN s ON s.vec_id = f.vec_id JOIN s p ON p.vec_id = f.prev)
SELECT video, round(avg(c / (ka + kb - c)), 6) + 0e0 AS id_stability FROM i GROUP BY video""")
def w02(spark, sf):
    from ..operators.masks import id_stability, masks
    m = masks(b.table(spark, sf, "embeddings")).withColumn("video", F.floor(F.col("vec_id") / 10))
    return rounded(id_stability(m, "video", "vec_id"), "id_stability")


@query("a21_level_filters", f"""WITH {b.FILTERS_SQL}, bw AS (SELECT level_no, CASE WHEN list_sum(radial) = 0 THEN 1 ELSE 1 / list_dot_product(w, w) END AS g FROM filters)
SELECT a.level_no, CAST(b AS INT) AS band, {R('any_value(a.w[b])')} AS w, {R('avg(g)')} AS mean_bw, {R('stddev_pop(g)')} AS std_bw, {R('quantile_cont(g, 0.5)')} AS median_bw
FROM avgf a, range(1, 9) t(b), bw WHERE bw.level_no = a.level_no GROUP BY a.level_no, b""")
def a21(spark, sf):
    f = b.filters(spark, sf)
    avg = ag.mean_vector(f, "radial", "level_no").select("level_no", F.posexplode(normalize("mean_vec")).alias("band", "w"))
    g = f.select("level_no", bandwidth("radial").alias("g"))
    bw = g.groupBy("level_no").agg(r6(F.avg("g")).alias("mean_bw"), r6(sdp0("g")).alias("std_bw"))
    med = wn.exact_quantiles(g, "g", [0.5], ["level_no"]).select("level_no", r6("q0").alias("median_bw"))
    bw = bw.join(med, "level_no")
    return avg.join(bw, "level_no").select("level_no", (F.col("band") + 1).alias("band"), r6("w").alias("w"), "mean_bw", "std_bw", "median_bw")


_BW = "1 / list_dot_product(w, w)"
_FL = f"WITH {b.FILTERS_SQL}, {_LAY}, fl AS (SELECT f.*, lg.layer, lg.layer_group, {_BW} AS bw FROM filters f JOIN lg ON lg.vec_id = f.item_id)"


@query("a22_bandwidth_by_layer", f"{_FL} SELECT level_no, layer, {R('avg(bw)')} AS mean_bw, {R('stddev_pop(bw)')} AS std_bw, CAST(count(*) AS BIGINT) AS n FROM fl GROUP BY 1, 2")
def a22(spark, sf):
    return layered_filters(spark, sf).withColumn("bw", bandwidth("radial")).groupBy("level_no", "layer").agg(
        r6(F.avg("bw")).alias("mean_bw"), r6(sdp0("bw")).alias("std_bw"), F.count("*").alias("n"))


@query("a23_bandwidth_curve", f"""{_FL}, m AS (SELECT level_no, layer_group, avg(bw) AS b FROM fl GROUP BY 1, 2)
SELECT v.view, layer_group, {R('avg(b)')} AS mean_bw, CAST(count(*) AS BIGINT) AS levels FROM m JOIN (VALUES ('primary', 1, 4), ('wordy', 5, 8), ('pooled', 1, 8)) v(view, lo, hi) ON level_no BETWEEN lo AND hi GROUP BY 1, 2""")
def a23(spark, sf):
    from ..operators.trials import level_views
    m = layered_filters(spark, sf).groupBy("level_no", "layer_group").agg(F.avg(bandwidth("radial")).alias("b"))
    return level_views(m).groupBy("view", "layer_group").agg(r6(F.avg("b")).alias("mean_bw"), F.count("*").alias("levels"))


@query("a24_control_statistics", f"""{_FL}, c AS (SELECT f.level_no, f.layer_group, g.control, {_L2('f.w', 'g.w')} AS l2, {_COS('f.w', 'g.w')} AS cs, g.bw - f.bw AS d
  FROM fl f JOIN (SELECT item_id - k AS item_id, w, bw, CASE k WHEN 1 THEN 'empty_language' ELSE 'random_language' END AS control FROM fl, (VALUES (1), (2)) t(k)) g USING (item_id))
SELECT control, level_no, layer_group, CAST(count(*) AS BIGINT) AS n, {R('avg(l2)')} AS l2_mean, {R('stddev_pop(l2)')} AS l2_std, {R('avg(cs)')} AS cos_mean, {R('avg(d)')} AS bw_delta_mean, {R('stddev_pop(d)')} AS bw_delta_std FROM c GROUP BY 1, 2, 3""")
def a24(spark, sf):
    from ..functions.arrays import cosine, l2_distance
    f = layered_filters(spark, sf).withColumn("bw", bandwidth("radial")).select("item_id", "level_no", "layer_group", "w", "bw")
    k = F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("empty_language").alias("control")),
                          F.struct(F.lit(2).alias("k"), F.lit("random_language").alias("control"))))
    g = f.select("item_id", F.col("w").alias("gw"), F.col("bw").alias("gb"), k.alias("c")).select(
        (F.col("item_id") - F.col("c.k")).alias("item_id"), "gw", "gb", "c.control")
    j = f.join(g, "item_id").withColumn("l2", l2_distance("w", "gw")).withColumn("cs", cosine("w", "gw")).withColumn("d", F.col("gb") - F.col("bw"))
    return j.groupBy("control", "level_no", "layer_group").agg(
        F.count("*").alias("n"), r6(F.avg("l2")).alias("l2_mean"), r6(sdp0("l2")).alias("l2_std"), r6(F.avg("cs")).alias("cos_mean"),
        r6(F.avg("d")).alias("bw_delta_mean"), r6(sdp0("d")).alias("bw_delta_std"))


@query("a25_accuracy_curve", f"{b.T('mode', 'cutoff')} SELECT mode, level_no, {R('cutoff')} AS cutoff, {R('avg(pert_correct)')} AS accuracy, {R('1 - avg(pert_correct)')} AS loss FROM tr GROUP BY mode, level_no, cutoff")
def a25(spark, sf):
    t = outcomes(spark, sf, "mode", "cutoff").groupBy("mode", "level_no", "cutoff").agg(F.avg("pert_correct").alias("accuracy"))
    return rounded(t.withColumn("loss", 1 - F.col("accuracy")), "cutoff", "accuracy", "loss")


@query("a26_cutoff_rollup", f"""{b.T('mode', 'cutoff')}, {_CRIT}, m AS (SELECT level_no, mode, avg(critical_cutoff) AS c FROM cc GROUP BY 1, 2)
SELECT level_no, {R('avg(c)')} AS mean_cutoff, CAST(count(*) AS BIGINT) AS modes FROM m GROUP BY level_no""")
def a26(spark, sf):
    c = wn.critical_cutoff(curve(spark, sf), ["item_id", "mode", "level_no"], 0.5)
    return c.groupBy("level_no", "mode").agg(F.avg("critical_cutoff").alias("c")).groupBy("level_no").agg(
        r6(F.avg("c")).alias("mean_cutoff"), F.count("*").alias("modes"))


@query("a27_template_summary", f"""{b.T()}, c AS (SELECT family, item_id, level_no, max(clean_correct) AS cc, avg(csem) AS cs FROM tr GROUP BY 1, 2, 3),
cl AS (SELECT family, avg(cc) AS clean_accuracy, avg(cs) AS mean_csem, count(*) AS cells FROM c GROUP BY family)
SELECT family, {R('any_value(clean_accuracy)')} AS clean_accuracy, {R('any_value(mean_csem)')} AS mean_csem, CAST(any_value(cells) AS BIGINT) AS cells, CAST(count(*) AS BIGINT) AS rows, {R('avg(volatility)')} AS mean_volatility, {R('avg(accuracy_drop)')} AS mean_drop
FROM tr JOIN cl USING (family) GROUP BY family""")
def a27(spark, sf):
    cell = outcomes(spark, sf).groupBy("family", "item_id", "level_no").agg(
        F.max("clean_correct").alias("cc"), F.avg("csem").alias("cs"), F.count("*").alias("n"), F.sum("volatility").alias("v"), F.sum("accuracy_drop").alias("d"))
    return cell.groupBy("family").agg(
        r6(F.avg("cc")).alias("clean_accuracy"), r6(F.avg("cs")).alias("mean_csem"), F.count("*").alias("cells"), F.sum("n").alias("rows"),
        r6(F.sum("v") / F.sum("n")).alias("mean_volatility"), r6(F.sum("d") / F.sum("n")).alias("mean_drop"))


_DX = ", ".join(f"({i + 1}, {e})" for i, e in enumerate(b.DELTA_ELEMENTS))


@query("a30_band_variation", f"""WITH x AS (SELECT concat(l_returnflag, l_linestatus) AS op, t.b, t.x FROM lineitem, LATERAL (VALUES {_DX}) t(b, x) WHERE (l_orderkey + l_linenumber) % 8 = 0),
m AS (SELECT op, b, avg(x) AS mu, stddev_pop(x) AS sd, count(*) AS n FROM x GROUP BY 1, 2)
SELECT op, {R('100 * avg(sd / mu) FILTER (WHERE mu > 1e-10)')} AS band_cv_pct, CAST(max(n) AS BIGINT) AS n FROM m GROUP BY op""")
def a30(spark, sf):
    t = b.trials(spark, sf, "d").where("level_no = 1").select(F.col("family").alias("op"), F.posexplode("d").alias("band", "x"))
    m = t.groupBy("op", "band").agg(F.avg("x").alias("mu"), sdp0("x").alias("sd"), F.count("*").alias("n"))
    return m.groupBy("op").agg(r6(100 * F.avg(F.when(F.col("mu") > 1e-10, F.col("sd") / F.col("mu")))).alias("band_cv_pct"), F.max("n").alias("n"))


@query("a31_bandwidth_cv", f"""{_FL} SELECT level_no, {R('avg(bw)')} AS mean_bw, {R('stddev_pop(bw)')} AS std_bw, {R('CASE WHEN avg(bw) > 0 THEN 100 * stddev_pop(bw) / avg(bw) END')} AS cv_pct
FROM fl WHERE layer = (SELECT max(layer) - 1 FROM fl) GROUP BY level_no""")
def a31(spark, sf):
    f = layered_filters(spark, sf).withColumn("bw", bandwidth("radial"))
    last2 = f.agg((F.max("layer") - 1).alias("l")).select("l").scalar()
    g = f.where(F.col("layer") == last2).groupBy("level_no").agg(F.avg("bw").alias("mean_bw"), sdp0("bw").alias("std_bw"))
    return rounded(g.withColumn("cv_pct", F.when(F.col("mean_bw") > 0, 100 * F.col("std_bw") / F.col("mean_bw"))), "mean_bw", "std_bw", "cv_pct")


@query("a47_band_mass", f"""WITH {b.FILTERS_SQL} SELECT level_no, CAST(b AS INT) AS band, {R('avg(w[b])')} AS mass, b = 8 AS highest FROM filters, range(1, 9) t(b) GROUP BY 1, b""")
def a47(spark, sf):
    f = b.filters(spark, sf).select("level_no", F.posexplode("w").alias("band", "m"))
    return f.groupBy("level_no", (F.col("band") + 1).alias("band"), (F.col("band") == 7).alias("highest")).agg(r6(F.avg("m")).alias("mass"))


@query("a54_radial_profiles", f"""WITH {b.FILTERS_SQL}, p AS (SELECT level_no, b, avg(w[b]) AS m, coalesce(stddev_samp(w[b]), 0) / sqrt(count(*)) AS sem FROM filters, range(1, 9) t(b) GROUP BY 1, 2),
s AS (SELECT level_no, sum((b - 0.5) / 8 * m) / sum(m) AS cen, -sum(m * ln(m)) FILTER (WHERE m > 1e-12) / ln(8) AS ent FROM p GROUP BY 1)
SELECT level_no, CAST(b AS INT) AS bin, {R('m')} AS mean_mass, {R('sem')} AS sem, {R('cen')} AS centroid, {R('ent')} AS entropy FROM p JOIN s USING (level_no)""")
def a54(spark, sf):
    f = b.filters(spark, sf).select("level_no", F.posexplode("w").alias("bin", "m")).withColumn("bin", F.col("bin") + 1)
    p = f.groupBy("level_no", "bin").agg(F.avg("m").alias("mean_mass"), (sd0("m") / F.sqrt(F.count("*"))).alias("sem"))
    m = F.col("mean_mass")
    s = p.groupBy("level_no").agg((F.sum((F.col("bin") - 0.5) / 8 * m) / F.sum(m)).alias("centroid"),
                                  (-F.sum(F.when(m > 1e-12, m * F.log(m))) / F.log(F.lit(8.0))).alias("entropy"))
    return rounded(p.join(s, "level_no"), "mean_mass", "sem", "centroid", "entropy")


_M2 = """g2 AS (SELECT v.vec_id, v.perturbation, CAST(v.channel % 8 + 1 AS INT) AS level_no, list_transform(v.clean, lambda x: x * x) AS w,
  list_transform(range(1, 65), lambda i: abs(v.pert[i] - v.clean[i])) AS d FROM variants v),
o2 AS (SELECT *, list_dot_product(w, d) AS first_order, list_dot_product(w, list_transform(d, lambda x: x * x)) AS linear,
  list_dot_product(list_transform(w, lambda x: x * x), list_transform(d, lambda x: x * x)) AS quadratic FROM g2)"""


def overlap_2d_rows(spark, sf):
    """Overlap variants of a squared-activation filter grid and a magnitude delta grid."""
    from ..functions.arrays import cosine, dot, quadratic_overlap
    v = b.variants(spark, sf).select("vec_id", "perturbation", (F.col("channel") % 8 + 1).cast("int").alias("level_no"),
                                     F.transform("clean", lambda x: x.cast("double") * x.cast("double")).alias("w"),
                                     F.zip_with("pert", "clean", lambda p, c: F.abs(p.cast("double") - c.cast("double"))).alias("d"))
    return v.withColumns({"first_order": dot("w", "d"), "linear": dot("w", F.transform("d", lambda x: x * x)),
                          "quadratic": quadratic_overlap("w", "d"), "cos": cosine("w", "d")})


@query("m06b_overlap_2d", f"WITH {b.VARIANTS_SQL}, {_M2} SELECT vec_id, {R('first_order')} AS first_order, {R('linear')} AS linear, {R('quadratic')} AS quadratic, {R(_COS('w', 'd'))} AS cos FROM o2")
def m06b(spark, sf):
    return rounded(overlap_2d_rows(spark, sf).select("vec_id", "first_order", "linear", "quadratic", "cos"), "first_order", "linear", "quadratic", "cos")


@query("a53_grouped_overlap_2d", f"WITH {b.VARIANTS_SQL}, {_M2} SELECT level_no, perturbation, CAST(count(*) AS BIGINT) AS n, {R('avg(first_order)')} AS first_order, {R('avg(linear)')} AS linear, {R('avg(quadratic)')} AS quadratic, {R('avg(' + _COS('w', 'd') + ')')} AS cos FROM o2 GROUP BY 1, 2")
def a53(spark, sf):
    return overlap_2d_rows(spark, sf).groupBy("level_no", "perturbation").agg(
        F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("first_order", "linear", "quadratic", "cos")])
