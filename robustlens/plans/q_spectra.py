"""M: filter, overlap, score-entropy and mask expressions over array columns."""
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import div0, r6
from ..operators import masks as mk
from . import bindings as b
from .q_aggregates import rounded
from .q_joins import _COS, _J01, _L2
from .registry import query
from .sqlkit import R


@query("m01_prediction_entropy", f"""WITH {b.SCORES_SQL}, v AS (SELECT item_id, perturbation, list_filter([sA, sB, sC, sD], lambda x: x IS NOT NULL) AS v FROM ps),
e AS (SELECT *, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v) SELECT item_id, perturbation, {R('-list_sum(list_transform(e, lambda x: x / list_sum(e) * ln(greatest(x / list_sum(e), 1e-12))))')} AS entropy FROM e""")
def m01(spark, sf):
    return b.pert_scores(spark, sf).select("item_id", "perturbation", r6(ar.softmax_entropy(F.map_values("scores"))).alias("entropy"))


@query("m02_score_entropy", f"""WITH v AS (SELECT l_orderkey, l_linenumber, list_transform([l_discount, l_tax, l_quantity - 25, l_discount - 0.05], lambda x: greatest(x, 0)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, {R('CASE WHEN list_sum(v) > 0 THEN -list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN x / list_sum(v) * ln(x / list_sum(v) + 1e-12) ELSE 0 END)) ELSE 0 END')} AS entropy FROM v""")
def m02(spark, sf):
    li = b.table(spark, sf, "lineitem")
    v = F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") - 25, F.col("l_discount") - 0.05)
    return li.select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", r6(ar.mass_entropy(F.col("v"))).alias("entropy"))


@query("m04_effective_bandwidth", f"WITH {b.FILTERS_SQL} SELECT item_id, {R('1 / list_dot_product(w, w)')} AS bandwidth FROM filters")
def m04(spark, sf):
    return b.filters(spark, sf).select("item_id", r6(ar.bandwidth("radial")).alias("bandwidth"))


@query("m05_filter_normalization", f"""WITH {b.FILTERS_SQL}, z AS (SELECT item_id, CASE WHEN item_id % 20 = 0 THEN list_transform(radial, lambda x: 0e0) ELSE radial END AS r FROM filters)
SELECT item_id, CAST(b AS INT) AS band, {R('CASE WHEN list_sum(r) = 0 THEN 1 / 8e0 ELSE r[b] / list_sum(r) END')} AS w_l1, {R('CASE WHEN list_sum(r) = 0 THEN 1 / sqrt(8) ELSE r[b] / sqrt(list_dot_product(r, r)) END')} AS w_l2 FROM z, range(1, 9) t(b)""")
def m05(spark, sf):
    z = b.filters(spark, sf).select("item_id", F.expr("CASE WHEN item_id % 20 = 0 THEN transform(radial, x -> 0e0) ELSE radial END").alias("r"))
    z = z.select("item_id", F.arrays_zip(ar.normalize("r").alias("a"), ar.normalize("r", "l2").alias("b")).alias("z"))
    return z.select("item_id", F.posexplode("z").alias("band", "v")).select("item_id", (F.col("band") + 1).alias("band"), r6(F.col("v.a")).alias("w_l1"), r6(F.col("v.b")).alias("w_l2"))


@query("m06_overlap", f"{b.PAIRS()} SELECT item_id, level_no, perturbation, {R('predicted')} AS first_order, {R('predicted_quadratic')} AS quadratic FROM pairs")
def m06(spark, sf):
    return b.pairs(spark, sf).select("item_id", "level_no", "perturbation", r6("predicted").alias("first_order"), r6("predicted_quadratic").alias("quadratic"))


_MODES = ("none", "filter_centered", "delta_centered", "both_centered")


@query("m07_centred_overlap", f"""{b.PAIRS()}, c AS (SELECT level_no, list_transform(w, lambda x: x - list_avg(w)) AS wc, list_transform(d, lambda x: x - list_avg(d)) AS dc, w, d FROM pairs)
SELECT level_no, {R('avg(list_dot_product(w, d))')} AS "none", {R('avg(list_dot_product(wc, d))')} AS filter_centered, {R('avg(list_dot_product(w, dc))')} AS delta_centered, {R('avg(list_dot_product(wc, dc))')} AS both_centered FROM c GROUP BY level_no""")
def m07(spark, sf):
    return b.pairs(spark, sf).groupBy("level_no").agg(*[r6(F.avg(ar.centred_overlap("w", "d", m))).alias(m) for m in _MODES])


@query("m08_filter_shape", f"""WITH {b.FILTERS_SQL} SELECT item_id, {R('list_sum(w[5:8])')} AS tail_mass, {R('list_sum(list_transform(range(1, 9), lambda i: (i - 1) * w[i]))')} AS centroid,
  {R('list_sum(list_transform(range(1, 9), lambda i: (i - 1) * w[i])) / 7')} AS centroid_normalised FROM filters""")
def m08(spark, sf):
    return b.filters(spark, sf).select("item_id", r6(ar.tail_mass("w")).alias("tail_mass"), r6(ar.centroid("w")).alias("centroid"), r6(ar.centroid_norm("w")).alias("centroid_normalised"))


@query("m10_spectral_features", f"""WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a FROM embeddings), p AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p FROM x),
f AS (SELECT vec_id, list_sum(p[1:22]) AS lo, list_sum(p[23:43]) AS mi, list_sum(p[44:64]) AS hi, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(64) AS ent, list_sum(list_transform(range(1, 65), lambda i: (i - 1) * p[i])) AS cen FROM p)
SELECT vec_id, CASE WHEN ent >= 0.86 AND greatest(lo, mi, hi) - (lo + mi + hi - greatest(lo, mi, hi) - least(lo, mi, hi)) < 0.12 THEN 'broadband' WHEN lo = greatest(lo, mi, hi) THEN 'low' WHEN mi = greatest(lo, mi, hi) THEN 'mid' ELSE 'high' END AS signature,
  {R('lo')} AS low_mass, {R('mi')} AS mid_mass, {R('hi')} AS high_mass, {R('ent')} AS entropy, {R('cen')} AS centroid FROM f""")
def m10(spark, sf):
    e = b.table(spark, sf, "embeddings").select("vec_id", ar.doubles("embedding").alias("a"))
    f = e.select("vec_id", ar.spectral_features("a").alias("f")).select("vec_id", "f.*")
    return rounded(f, "low_mass", "mid_mass", "high_mass", "entropy", "centroid")


_JS = """0.5 * list_sum(list_transform(range(1, 65), lambda i: p[i] * ln(p[i] / (0.5 * (p[i] + q[i]))) + q[i] * ln(q[i] / (0.5 * (p[i] + q[i])))))"""


@query("m11_js_divergence", f"""WITH {b.VARIANTS_SQL}, a AS (SELECT vec_id, list_transform(clean, lambda x: x * x) AS c, list_transform(pert, lambda x: x * x) AS d FROM variants),
k AS (SELECT vec_id, list_transform(c, lambda x: greatest(x / list_sum(c), 1e-8)) AS c, list_transform(d, lambda x: greatest(x / list_sum(d), 1e-8)) AS d FROM a),
n AS (SELECT vec_id, list_transform(c, lambda x: x / list_sum(c)) AS p, list_transform(d, lambda x: x / list_sum(d)) AS q FROM k) SELECT vec_id, {R(_JS)} AS js FROM n""")
def m11(spark, sf):
    def sq(c):
        return F.transform(c, lambda x: x.cast("double") * x.cast("double"))
    v = b.variants(spark, sf).select("vec_id", sq("clean").alias("c"), sq("pert").alias("d"))
    return v.select("vec_id", r6(ar.js_divergence("c", "d")).alias("js"))


@query("m12_filter_distances", f"WITH {b.FILTERS_SQL} SELECT f.item_id, {R(_L2('f.w', 'a.w'))} AS l2_distance, {R(_COS('f.w', 'a.w'))} AS cosine_similarity FROM filters f JOIN avgf a USING (level_no)")
def m12(spark, sf):
    from ..operators.aggregates import mean_vector
    f = b.filters(spark, sf)
    a = mean_vector(f, "radial", "level_no").select("level_no", ar.normalize("mean_vec").alias("a"))
    return f.join(F.broadcast(a), "level_no").select("item_id", r6(ar.l2_distance("w", "a")).alias("l2_distance"), r6(ar.cosine("w", "a")).alias("cosine_similarity"))


@query("m13_band_count_rule", f"""WITH g AS (SELECT o_orderstatus AS run, 8 + o_custkey % 20 AS h, 8 + o_orderkey % 24 AS w FROM orders),
s AS (SELECT run, quantile_cont(CAST(h * w AS DOUBLE), 0.5) AS tokens, min(h) AS mh, min(w) AS mw FROM g GROUP BY run)
SELECT run, {R('tokens')} AS tokens, CAST(least(least(greatest(ceil(0.6 * sqrt(tokens)), 8), 20), greatest(1, ceil(sqrt((mh // 2) ** 2 + (mw // 2) ** 2)))) AS BIGINT) AS num_bands FROM s""")
def m13(spark, sf):
    from ..operators.grids import band_count
    g = b.table(spark, sf, "orders").selectExpr("o_orderstatus AS run", "8 + o_custkey % 20 AS h", "8 + o_orderkey % 24 AS w")
    return rounded(band_count(g, "run"), "tokens")


@query("m22_token_fft_drift", f"""WITH {b.VARIANTS_SQL}, x AS (SELECT vec_id, list_transform(range(1, 65), lambda i: pert[i] - clean[i]) AS x FROM variants),
f AS (SELECT vec_id, k, list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(2 * pi() * k * i / 64))) AS re, list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(2 * pi() * k * i / 64))) AS im FROM x, range(0, 33) g(k)),
m AS (SELECT vec_id, avg(sqrt(re * re + im * im)) FILTER (WHERE k < 8) AS low, avg(sqrt(re * re + im * im)) FILTER (WHERE k >= 25) AS high FROM f GROUP BY 1)
SELECT vec_id, {R('low')} AS low, {R('high')} AS high, {R('high / (low + 1e-8)')} AS ratio FROM m""")
def m22(spark, sf):
    from ..operators.grids import token_fft_drift
    return rounded(token_fft_drift(b.variants(spark, sf)), "low", "high", "ratio")


@query("m23_alignment_gain", f"""WITH {b.VARIANTS_SQL}, m AS (SELECT perturbation, i, avg(clean[i]) AS c, avg(pert[i]) AS p, avg(clean[65 - i]) AS t FROM variants, range(1, 65) r(i) GROUP BY 1, 2)
SELECT perturbation, {R('sum(c * t) / sqrt(sum(c * c) * sum(t * t))')} AS pre, {R('sum(p * t) / sqrt(sum(p * p) * sum(t * t))')} AS post, {R('sum(p * t) / sqrt(sum(p * p) * sum(t * t)) - sum(c * t) / sqrt(sum(c * c) * sum(t * t))')} AS gain FROM m GROUP BY perturbation""")
def m23(spark, sf):
    v = b.variants(spark, sf).select("perturbation", F.posexplode(F.arrays_zip("clean", "pert", F.reverse("clean").alias("txt"))).alias("i", "z"))
    m = v.groupBy("perturbation", "i").agg(F.avg(F.col("z.clean").cast("double")).alias("c"), F.avg(F.col("z.pert").cast("double")).alias("p"), F.avg(F.col("z.txt").cast("double")).alias("t"))
    pre = F.sum(F.col("c") * F.col("t")) / F.sqrt(F.sum(F.col("c") * F.col("c")) * F.sum(F.col("t") * F.col("t")))
    post = F.sum(F.col("p") * F.col("t")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("t") * F.col("t")))
    return m.groupBy("perturbation").agg(r6(pre).alias("pre"), r6(post).alias("post"), r6(post - pre).alias("gain"))


@query("m26_filter_invariants", f"""WITH {b.FILTERS_SQL} SELECT level_no, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE abs(list_sum(w) - 1) <= 1e-5) AS BIGINT) AS sum_ok,
  CAST(count(*) FILTER (WHERE list_min(w) >= 0) AS BIGINT) AS non_negative, CAST(count(*) FILTER (WHERE 1 / list_dot_product(w, w) BETWEEN 1 - 1e-6 AND 8 + 1e-6) AS BIGINT) AS ipr_ok FROM filters GROUP BY level_no""")
def m26(spark, sf):
    f = b.filters(spark, sf).withColumn("ipr", ar.bandwidth("w"))
    return f.groupBy("level_no").agg(
        F.count("*").alias("n"), F.count_if(F.abs(ar.asum("w") - 1) <= 1e-5).alias("sum_ok"),
        F.count_if(F.forall("w", lambda x: (x >= 0) & ~F.isnan(x))).alias("non_negative"),
        F.count_if((F.col("ipr") >= 1 - 1e-6) & (F.col("ipr") <= 8 + 1e-6)).alias("ipr_ok"))


@query("m27_mask_iou", f"WITH {b.VARIANTS_SQL} SELECT vec_id, " + R("list_sum(list_transform(range(1, 65), lambda i: CASE WHEN clean[i] > 0 AND pert[i] > 0 THEN 1 ELSE 0 END)) / list_sum(list_transform(range(1, 65), lambda i: CASE WHEN clean[i] > 0 OR pert[i] > 0 THEN 1 ELSE 0 END))") + " AS iou FROM variants")
def m27(spark, sf):
    v = mk.masks(mk.masks(b.variants(spark, sf), "clean", "gt"), "pert", "pred")
    return v.select("vec_id", r6(mk.mask_iou("pred", "gt")).alias("iou"))


@query("m28_box_diagnostics", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS x0, l_suppkey % 40 AS y0, l_partkey % 40 + l_quantity AS x1, l_suppkey % 40 + l_quantity AS y1,
  l_partkey % 40 + 5e0 AS gx0, l_suppkey % 40 + 3e0 AS gy0, l_partkey % 40 + 5e0 + 20 AS gx1, l_suppkey % 40 + 3e0 + 20 AS gy1 FROM lineitem),
i AS (SELECT *, greatest(least(x1, gx1) - greatest(x0, gx0), 0) * greatest(least(y1, gy1) - greatest(y0, gy0), 0) AS i FROM x)
SELECT l_orderkey, l_linenumber, {R('i / ((x1 - x0) * (y1 - y0) + 400 - i)')} AS iou, {R('sqrt(((x0 + x1) / 2 - (gx0 + gx1) / 2) ** 2 + ((y0 + y1) / 2 - (gy0 + gy1) / 2) ** 2) / sqrt(100 ** 2 + 80 ** 2)')} AS center_shift FROM i""")
def m28(spark, sf):
    x = b.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "named_struct('x0', CAST(l_partkey % 40 AS DOUBLE), 'y0', CAST(l_suppkey % 40 AS DOUBLE), 'x1', l_partkey % 40 + l_quantity, 'y1', l_suppkey % 40 + l_quantity) AS p",
        "named_struct('x0', l_partkey % 40 + 5e0, 'y0', l_suppkey % 40 + 3e0, 'x1', l_partkey % 40 + 25e0, 'y1', l_suppkey % 40 + 23e0) AS g")
    return x.select("l_orderkey", "l_linenumber", r6(mk.box_iou(F.col("p"), F.col("g"))).alias("iou"), r6(mk.center_shift(F.col("p"), F.col("g"), 100, 80)).alias("center_shift"))


_NEAR = "abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1"


@query("m29_boundary_f", f"""WITH {b.CELLS_SQL}, pos AS (SELECT vec_id, r, c FROM cells WHERE x > 0),
rim AS MATERIALIZED (SELECT p.vec_id, p.r, p.c FROM pos p JOIN pos q ON q.vec_id = p.vec_id AND {_NEAR} GROUP BY ALL HAVING count(*) < 9),
v AS (SELECT a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT vec_id, count(*) AS n FROM rim GROUP BY 1),
ha AS (SELECT p.vec_id - 1 AS vec_id, count(*) AS h FROM rim p WHERE EXISTS (SELECT 1 FROM rim q WHERE q.vec_id = p.vec_id - 1 AND {_NEAR}) GROUP BY 1),
hb AS (SELECT p.vec_id, count(*) AS h FROM rim p WHERE EXISTS (SELECT 1 FROM rim q WHERE q.vec_id = p.vec_id + 1 AND {_NEAR}) GROUP BY 1),
z AS (SELECT v.vec_id, coalesce(na.n, 0) AS na, coalesce(nb.n, 0) AS nb, coalesce(ha.h, 0) AS ha, coalesce(hb.h, 0) AS hb FROM v LEFT JOIN n na ON na.vec_id = v.vec_id + 1 LEFT JOIN n nb ON nb.vec_id = v.vec_id LEFT JOIN ha ON ha.vec_id = v.vec_id LEFT JOIN hb ON hb.vec_id = v.vec_id)
SELECT vec_id, {R('CASE WHEN na + nb = 0 THEN 1 WHEN ha * nb + hb * na = 0 THEN 0 ELSE 2.0 * ha * hb / (ha * nb + hb * na) END')} AS boundary_f FROM z""")
def m29(spark, sf):
    v = mk.masks(mk.masks(b.variants(spark, sf), "clean", "gt"), "pert", "pred")
    return v.select("vec_id", r6(mk.boundary_f_udf(8, 8, 1)("pred", "gt")).alias("boundary_f"))


@query("m30_fragmentation", f"""WITH RECURSIVE {b.CELLS_SQL}, m AS (SELECT vec_id, r, c FROM cells WHERE x > 0),
walk AS (SELECT vec_id, r, c, r * 8 + c AS root FROM m UNION SELECT m.vec_id, m.r, m.c, w.root FROM walk w JOIN m ON m.vec_id = w.vec_id AND abs(m.r - w.r) + abs(m.c - w.c) = 1),
lab AS (SELECT vec_id, r, c, min(root) AS lab FROM walk GROUP BY 1, 2, 3) SELECT vec_id, CAST(count(DISTINCT lab) AS INT) AS components FROM lab GROUP BY vec_id""")
def m30(spark, sf):
    v = mk.masks(b.table(spark, sf, "embeddings"))
    return v.select("vec_id", mk.fragmentation_udf(8, 8)("mask").alias("components"))


@query("m31_grounding", f"""WITH {b.CELLS_SQL}, m AS (SELECT vec_id, vec_id // 6 AS frame, vec_id % 6 AS k, label, list(r * 8 + c ORDER BY r, c) FILTER (WHERE x > 0) AS mask FROM cells GROUP BY vec_id, label),
g AS (SELECT frame, k AS g, mask, (frame % 4) <> 0 AS present FROM m WHERE k < 3), p AS (SELECT frame, k, label AS score, mask FROM m WHERE k >= 3 AND frame % 5 <> 0),
i AS (SELECT p.frame, p.k, p.score, max(len(list_intersect(p.mask, g.mask)) / (len(p.mask) + len(g.mask) - len(list_intersect(p.mask, g.mask)))) AS iou FROM p JOIN g USING (frame) GROUP BY 1, 2, 3),
a AS (SELECT frame, arg_max(iou, score * 10 - k) AS best, count(*) AS n, avg((iou < 0.36)::INT) AS fp FROM i GROUP BY frame),
f AS (SELECT DISTINCT frame, present FROM g)
SELECT f.frame, CASE WHEN present AND best >= 0.36 THEN 1e0 ELSE 0e0 END AS concept_recall, {R('CASE WHEN n IS NULL THEN 0 WHEN present THEN fp ELSE 1 END')} AS false_positive,
  CASE WHEN present AND n > 0 AND best < 0.36 THEN 1e0 ELSE 0e0 END AS wrong_instance_rate, CASE WHEN n > 0 THEN 0e0 ELSE 1e0 END AS no_prediction_rate,
  CASE WHEN present THEN CASE WHEN best >= 0.36 THEN 0e0 ELSE 1e0 END WHEN n > 0 THEN 1e0 ELSE 0e0 END AS presence_error FROM f LEFT JOIN a USING (frame)""")
def m31(spark, sf):
    m = mk.masks(b.table(spark, sf, "embeddings")).select(F.floor(F.col("vec_id") / 6).alias("frame"), (F.col("vec_id") % 6).alias("k"), "label", "mask")
    gts = m.where("k < 3").select("frame", "mask", (F.col("frame") % 4 != 0).alias("present"))
    preds = m.where("k >= 3 AND frame % 5 <> 0").select("frame", "k", F.col("label").alias("score"), "mask")
    return rounded(mk.grounding(preds, gts, "frame", 0.36), "false_positive")


@query("m32_mask_boxes", f"""WITH {b.CELLS_SQL}, m AS (SELECT * FROM cells WHERE x > 0) SELECT vec_id, CAST(min(c) AS DOUBLE) AS x0, CAST(min(r) AS DOUBLE) AS y0, CAST(max(c) AS DOUBLE) AS x1, CAST(max(r) AS DOUBLE) AS y1,
  {R('avg(c)')} AS cx, {R('avg(r)')} AS cy FROM m GROUP BY vec_id""")
def m32(spark, sf):
    m = mk.masks(b.table(spark, sf, "embeddings")).where(F.size("mask") > 0)
    return m.select("vec_id", mk.box_of("mask", 8).alias("b"), mk.center_of("mask", 8).alias("p")).select(
        "vec_id", "b.*", r6("p.x").alias("cx"), r6("p.y").alias("cy"))


def _clip(e, n):
    return f"greatest(least({e}, {n}e0), 0e0)"


@query("m33_box_transforms", f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 50 AS DOUBLE) AS y0, l_partkey % 60 + l_quantity AS x1, l_suppkey % 50 + l_quantity AS y1 FROM lineitem),
k AS (SELECT *, cos(radians(15)) AS c, sin(radians(15)) AS s FROM x),
rt AS (SELECT *, [(x0-50)*c-(y0-40)*s+50, (x0-50)*c-(y1-40)*s+50, (x1-50)*c-(y0-40)*s+50, (x1-50)*c-(y1-40)*s+50] AS rx, [(x0-50)*s+(y0-40)*c+40, (x0-50)*s+(y1-40)*c+40, (x1-50)*s+(y0-40)*c+40, (x1-50)*s+(y1-40)*c+40] AS ry FROM k)
SELECT l_orderkey, l_linenumber, {R(_clip('(x0 - 50) * 1.1 + 50 + 8', 100))} AS sx0, {R(_clip('(y0 - 40) * 1.1 + 40 - 4', 80))} AS sy0, {R(_clip('(x1 - 50) * 1.1 + 50 + 8', 100))} AS sx1, {R(_clip('(y1 - 40) * 1.1 + 40 - 4', 80))} AS sy1,
  {R('list_min(rx)')} AS rx0, {R('list_min(ry)')} AS ry0, {R('list_max(rx)')} AS rx1, {R('list_max(ry)')} AS ry1 FROM rt""")
def m33(spark, sf):
    x = b.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "array(named_struct('x0', CAST(l_partkey % 60 AS DOUBLE), 'y0', CAST(l_suppkey % 50 AS DOUBLE), 'x1', l_partkey % 60 + l_quantity, 'y1', l_suppkey % 50 + l_quantity)) AS boxes")
    s = mk.move_boxes(F.col("boxes"), dx=8.0, dy=-4.0, scale=1.1, w=100, h=80)
    r = mk.rotate_boxes(F.col("boxes"), 15.0, 100, 80)
    y = x.select("l_orderkey", "l_linenumber", F.element_at(s, 1).alias("s"), F.element_at(r, 1).alias("r"))
    return y.select("l_orderkey", "l_linenumber", *[r6(f"{k}.{c}").alias(k + c) for k in ("s", "r") for c in ("x0", "y0", "x1", "y1")])


@query("m35_ring_profile", f"""WITH {b.CELLS_SQL}, g AS (SELECT vec_id, CAST(floor(sqrt((r - 4) ** 2 + (c - 4) ** 2)) AS INT) AS ring, x FROM cells)
SELECT vec_id, ring, {R('avg(abs(x))')} AS mean_magnitude, {R('sum(x * x)')} AS energy, CAST(count(*) AS BIGINT) AS n, ring <= 4 AS inside FROM g GROUP BY 1, 2""")
def m35(spark, sf):
    g = b.grid_cells(spark, sf).withColumn("ring", F.floor(F.sqrt(F.pow(F.col("r") - 4, F.lit(2)) + F.pow(F.col("c") - 4, F.lit(2)))).cast("int"))
    return g.groupBy("vec_id", "ring").agg(r6(F.avg(F.abs("x"))).alias("mean_magnitude"), r6(F.sum(F.col("x") * F.col("x"))).alias("energy"),
                                           F.count("*").alias("n")).withColumn("inside", F.col("ring") <= 4)


_BAND = "CASE WHEN dist >= {m} - 1e-12 THEN 7 ELSE least(7, CAST(floor(dist / {m} * 8) AS INT)) END"


@query("m15_radial_bands", f"""WITH {b.CELLS_SQL}, p AS (SELECT vec_id, sqrt((r - 4) ** 2 + (c - 4) ** 2) AS dist, CASE WHEN r = 4 AND c = 4 THEN 0 ELSE x * x END AS p FROM cells)
SELECT vec_id, CAST({_BAND.format(m='sqrt(32e0)')} AS INT) AS band, {R('sum(p)')} AS power FROM p GROUP BY 1, 2""")
def m15(spark, sf):
    from ..operators.grids import radial_bands
    cells = b.grid_cells(spark, sf).withColumn("power", F.col("x") * F.col("x"))
    return rounded(radial_bands(cells, "vec_id", 8, 8, 8, suppress_dc=True), "power")


# 2-D DFT of an 8x8 grid by its basis, for checking the FFT jobs: power at shifted position (u, v)
_DFT = """uv AS (SELECT CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM range(0, 8) a(u), range(0, 8) b(v)),
ft AS (SELECT id, (u + 4) % 8 AS su, (v + 4) % 8 AS sv, sum(x * cos(2 * pi() * (u * r + v * c) / 8)) AS re, -sum(x * sin(2 * pi() * (u * r + v * c) / 8)) AS im FROM gx, uv GROUP BY id, u, v),
pw AS (SELECT id, su, sv, re * re + im * im AS p, sqrt((su - 4) ** 2 + (sv - 4) ** 2) AS dist FROM ft)"""


def _PB(m="sqrt(32e0)"):
    return f"CAST({_BAND.format(m=m)} AS INT)"


@query("m14_windowed_energy", f"""WITH {b.CELLS_SQL} SELECT vec_id, {R('sum((x * (0.5 - 0.5 * cos(2 * pi() * r / 7)) * (0.5 - 0.5 * cos(2 * pi() * c / 7))) ** 2)')} AS hann_energy,
  {R('sum((x * (0.54 - 0.46 * cos(2 * pi() * r / 7)) * (0.54 - 0.46 * cos(2 * pi() * c / 7))) ** 2)')} AS hamming_energy FROM cells GROUP BY vec_id""")
def m14(spark, sf):
    from ..operators.grids import window_weight
    c = b.grid_cells(spark, sf)

    def energy(kind):
        w = window_weight("r", 8, kind) * window_weight("c", 8, kind)
        return F.sum(F.pow(F.col("x") * w, F.lit(2)))
    return c.groupBy("vec_id").agg(r6(energy("hann")).alias("hann_energy"), r6(energy("hamming")).alias("hamming_energy"))


@query("m16_fft_bands", f"""WITH {b.CELLS_SQL}, gx AS (SELECT vec_id AS id, r, c, x * (0.5 - 0.5 * cos(2 * pi() * r / 7)) * (0.5 - 0.5 * cos(2 * pi() * c / 7)) AS x FROM cells), {_DFT}
SELECT id AS vec_id, {_PB()} AS band, {R('sum(CASE WHEN su = 4 AND sv = 4 THEN 0 ELSE p END)')} AS power FROM pw GROUP BY 1, 2""")
def m16(spark, sf):
    from ..operators.grids import fft_bands, long_bands
    e = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return rounded(long_bands(fft_bands(e, "embedding", 8, 8, 8, window="hann", suppress_dc=True), "vec_id"), "power")


_DELTA = f"""WITH {b.CELLS_SQL}, gx AS (SELECT c.vec_id AS id, c.r, c.c, p.x - c.x AS x FROM cells c JOIN cells p ON p.vec_id = c.vec_id + 1 AND p.r = c.r AND p.c = c.c), {_DFT},
en AS (SELECT vec_id AS id, 64 * sum(x * x) AS e FROM cells GROUP BY 1), bd AS (SELECT id, {_PB()} AS band, sum(CASE WHEN su = 4 AND sv = 4 THEN 0 ELSE p END) AS d FROM pw GROUP BY 1, 2)"""


@query("m17_delta_spectrum", f"{_DELTA} SELECT id AS vec_id, band, {R('d')} AS delta, {R('d / e')} AS relative, {R('sqrt(sum(d * d) OVER (PARTITION BY id))')} AS norm, first_value(band) OVER (PARTITION BY id ORDER BY d DESC) AS peak_band FROM bd JOIN en USING (id)")
def m17(spark, sf):
    from ..operators.grids import delta_spectrum
    d = delta_spectrum(b.variants(spark, sf), 8, 8, 8)
    d = d.withColumn("norm", ar.norm("delta")).withColumn("peak_band", (F.array_position("delta", F.array_max("delta")) - 1).cast("int"))
    z = d.select("vec_id", r6("norm").alias("norm"), "peak_band", F.posexplode(F.arrays_zip("delta", "relative")).alias("band", "z"))
    return z.select("vec_id", "band", r6("z.delta").alias("delta"), r6("z.relative").alias("relative"), "norm", "peak_band")


@query("m18_three_band_power", f"""WITH {b.CELLS_SQL}, gx AS (SELECT vec_id AS id, r, c, x FROM cells), {_DFT},
e AS (SELECT 'equal' AS scheme, sqrt(32e0) / 3 AS a, 2 * sqrt(32e0) / 3 AS b UNION ALL SELECT 'log', (sqrt(32e0) + 1) ** (1 / 3e0) - 1, (sqrt(32e0) + 1) ** (2 / 3e0) - 1
  UNION ALL SELECT 'percentile', quantile_cont(dist, 0.333), quantile_cont(dist, 0.666) FROM pw WHERE id = (SELECT min(id) FROM pw))
SELECT id AS vec_id, scheme, {R('avg(p)')} AS total, {R('avg(p) FILTER (WHERE dist < a)')} AS low, {R('avg(p) FILTER (WHERE dist >= a AND dist < b)')} AS mid, {R('avg(p) FILTER (WHERE dist >= b)')} AS high FROM pw, e GROUP BY id, scheme""")
def m18(spark, sf):
    from ..operators.grids import INNER_EDGES, three_band_power
    e = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    parts = [three_band_power(e, "embedding", 8, 8, s).withColumn("scheme", F.lit(s)) for s in INNER_EDGES]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "total", "low", "mid", "high")


@query("m20_dirichlet_energy", f"""WITH {b.CELLS_SQL}, e AS (SELECT a.vec_id, (b.x - a.x) ** 2 AS q FROM cells a JOIN cells b ON b.vec_id = a.vec_id AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)))
SELECT vec_id, {R('sum(q) / 112')} AS energy FROM e GROUP BY vec_id""")
def m20(spark, sf):
    from ..operators.grids import dirichlet_energy
    return b.table(spark, sf, "embeddings").select("vec_id", r6(dirichlet_energy("embedding", 8, 8)).alias("energy"))


@query("m21_token_drift", f"""WITH {b.VARIANTS_SQL}, t AS (SELECT vec_id, k, clean[8*k+1:8*k+8] AS c, pert[8*k+1:8*k+8] AS p FROM variants, range(0, 8) r(k))
SELECT vec_id, {R('avg(list_distance(c, p))')} AS mean_token_l2, {R('avg(1 - ' + _COS('c', 'p') + ')')} AS mean_token_cosine FROM t GROUP BY vec_id""")
def m21(spark, sf):
    from ..operators.grids import token_drift
    return rounded(token_drift(b.variants(spark, sf), 8, 8), "mean_token_l2", "mean_token_cosine")


@query("m24_grid_alignment", f"""WITH {b.CELLS_SQL}, t AS (SELECT CAST(i AS INT) AS i, CAST(round_even(i * 7 / 4.0, 0) AS INT) AS s FROM range(0, 5) r(i))
SELECT vec_id, a.i AS r, b.i AS c, {R('x')} AS x FROM cells JOIN t a ON a.s = cells.r JOIN t b ON b.s = cells.c""")
def m24(spark, sf):
    from ..operators.grids import nearest_resize
    g = b.table(spark, sf, "embeddings").select("vec_id", nearest_resize(ar.doubles("embedding"), 8, 8, 5, 5).alias("g"))
    z = g.select("vec_id", F.posexplode("g").alias("pos", "x"))
    return z.select("vec_id", F.floor(F.col("pos") / 5).cast("int").alias("r"), (F.col("pos") % 5).alias("c"), r6("x").alias("x"))


@query("m24b_linear_resize", f"""WITH {b.CELLS_SQL}, p AS (SELECT vec_id, r, c, x * x AS x FROM cells), t AS (SELECT CAST(i AS INT) AS i, CAST(least(floor(i * 7 / 4.0), 6) AS INT) AS s, i * 7 / 4.0 - least(floor(i * 7 / 4.0), 6) AS f FROM range(0, 5) r(i)),
h AS (SELECT a.vec_id, a.r, t.i AS c, a.x * (1 - t.f) + b.x * t.f AS x FROM t JOIN p a ON a.c = t.s JOIN p b ON b.vec_id = a.vec_id AND b.r = a.r AND b.c = t.s + 1),
v AS (SELECT a.vec_id, t.i AS r, a.c, a.x * (1 - t.f) + b.x * t.f AS x FROM t JOIN h a ON a.r = t.s JOIN h b ON b.vec_id = a.vec_id AND b.c = a.c AND b.r = t.s + 1)
SELECT vec_id, r, c, {R('x / sum(x) OVER (PARTITION BY vec_id)')} AS x FROM v""")
def m24b(spark, sf):
    from ..operators.grids import linear_resize
    p = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("p"))
    z = linear_resize(p, "p", 8, 8, 5, 5).select("vec_id", F.posexplode("resized").alias("pos", "x"))
    return z.select("vec_id", F.floor(F.col("pos") / 5).cast("int").alias("r"), (F.col("pos") % 5).alias("c"), r6("x").alias("x"))


@query("m25_radial_centroid", f"""WITH {b.CELLS_SQL}, g AS (SELECT vec_id, x * x AS p, sqrt((r - 3.5) ** 2 + (c - 3.5) ** 2) / sqrt(24.5) AS rad FROM cells),
k AS (SELECT vec_id, least(3, CAST(floor(rad * 4) AS INT)) AS bin, sum(p) AS m FROM g GROUP BY 1, 2), ce AS (SELECT vec_id, sum(p * rad) / sum(p) AS cen, sum(p) AS tot FROM g GROUP BY 1)
SELECT vec_id, CAST(bin AS INT) AS bin, {R('m / tot')} AS mass, {R('cen')} AS centroid FROM k JOIN ce USING (vec_id)""")
def m25(spark, sf):
    from ..operators.grids import half_pixel_profile
    c = b.grid_cells(spark, sf).withColumn("power", F.col("x") * F.col("x"))
    return rounded(half_pixel_profile(c, "vec_id", 8, 8, 4), "mass", "centroid")


@query("m34_grid_perturbations", None)
def m34(spark, sf):
    from ..operators.grids import perturb_grids
    specs = [{"kind": k, "strength": float(s)} for k, ss in (
        ("shift", (1, 2)), ("pad_crop", (1,)), ("motion_blur", (3,)), ("occlusion", (0.08, 0.2)), ("brightness", (0.1,)), ("contrast", (0.5,)),
        ("gaussian_noise", (0.05,)), ("lowpass", (0.35,)), ("highpass", (0.35,)), ("band_noise", (0.1,))) for s in ss]
    e = b.table(spark, sf, "embeddings").select("vec_id", ar.doubles("embedding").alias("grid"))
    p = perturb_grids(e, specs, 8, 8, seed=13)
    return p.select("vec_id", "kind", "strength", r6(ar.asum("perturbed")).alias("total"), r6(ar.sq_norm("perturbed")).alias("energy"))
