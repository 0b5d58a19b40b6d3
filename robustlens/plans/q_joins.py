"""J: clean/perturbed, filter, mirror, scene and control joins."""
from pyspark.sql import functions as F

from ..functions.arrays import bandwidth, cosine, doubles, js_divergence, l2_distance, normalize
from ..functions.numeric import cohens_d, r6, safe_corr, sd0
from ..operators import joins as jn
from ..operators import scenes as sc
from . import bindings as b
from .q_aggregates import _DIR_SQL, _DROP, _MS, dirichlet_rows, metric_means, outcomes, rounded
from .registry import query
from .sqlkit import CORR, HI, R

_J01 = f"""WITH {b.SCORES_SQL}, j AS (SELECT ps.*, cs.answer_label, {b.ARGMAX_SQL('cs.')} AS clean_pred,
  CASE cs.answer_label WHEN 'A' THEN cs.sA WHEN 'B' THEN cs.sB WHEN 'C' THEN cs.sC ELSE cs.sD END AS gold,
  CASE cs.answer_label WHEN 'A' THEN ps.sA WHEN 'B' THEN ps.sB WHEN 'C' THEN ps.sC ELSE ps.sD END AS pgold,
  {b.ARGMAX_SQL('ps.')} AS pert_pred FROM ps JOIN cs USING (item_id, level_no))"""


@query("j01_clean_vs_perturbed", f"""{_J01} SELECT item_id, level_no, perturbation, severity, answer_label, clean_pred, pert_pred,
  clean_pred = answer_label AS clean_correct, pert_pred = answer_label AS pert_correct,
  CASE WHEN clean_pred = answer_label AND pert_pred <> answer_label THEN 1e0 ELSE 0e0 END AS accuracy_drop,
  {R('gold - coalesce(pgold, gold)')} AS loglik_drift FROM j""")
def j01(spark, sf):
    j = jn.clean_vs_perturbed(b.clean_scores(spark, sf), b.pert_scores(spark, sf))
    return rounded(j.drop("scores", "option_labels"), "loglik_drift")


@query("j02_filter_with_fallback", f"""{b.PAIRS()} SELECT level_no, own, CAST(count(*) AS BIGINT) AS n, {R('avg(predicted)')} AS mean_predicted FROM pairs GROUP BY 1, 2""")
def j02(spark, sf):
    f = b.filters(spark, sf).select("item_id", "level_no", F.lit(True).alias("own"))
    p = b.pairs(spark, sf).join(f, ["item_id", "level_no"], "left")
    return p.groupBy("level_no", F.coalesce("own", F.lit(False)).alias("own")).agg(
        F.count("*").alias("n"), r6(F.avg("predicted")).alias("mean_predicted"))


@query("j03_grid_filter_join", f"""WITH {b.VARIANTS_SQL}, f AS (SELECT vec_id, label % 3 AS grp, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x) AS w FROM embeddings)
SELECT v.vec_id, f.grp, {R('list_dot_product(f.w, list_transform(range(1, 65), lambda i: abs(v.pert[i] - v.clean[i])))')} AS overlap_2d FROM f JOIN variants v USING (vec_id)""")
def j03(spark, sf):
    from ..functions.arrays import dot
    f = b.table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("grp"),
                                                F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("w"))
    v = b.variants(spark, sf).select("vec_id", F.zip_with("pert", "clean", lambda p, c: F.abs(p.cast("double") - c.cast("double"))).alias("d"))
    return f.join(v, "vec_id").select("vec_id", "grp", r6(dot("w", "d")).alias("overlap_2d"))


_CELL = """cell AS (SELECT item_id, level_no, avg(volatility) AS v, avg(accuracy_drop) AS d FROM tr GROUP BY 1, 2),
mir AS (SELECT x.item_id, x.level_no AS rung, x.v AS base_volatility, y.v AS wordy_volatility, x.d AS base_accuracy_drop, y.d AS wordy_accuracy_drop
  FROM cell x JOIN cell y ON x.item_id = y.item_id AND y.level_no = x.level_no + 4 WHERE x.level_no <= 4)"""


@query("j04_mirror_join", f"{b.T()}, {_CELL} SELECT item_id, rung, {R('base_volatility')} AS base_volatility, {R('wordy_volatility')} AS wordy_volatility FROM mir")
def j04(spark, sf):
    return rounded(jn.mirror_cells(outcomes(spark, sf), ["volatility"]), "base_volatility", "wordy_volatility")


@query("j05_mirror_cells", f"""{b.T()}, {_CELL} SELECT rung, CAST(count(*) AS BIGINT) AS n, {R('avg(base_volatility)')} AS base_volatility, {R('avg(wordy_volatility)')} AS wordy_volatility,
  {R('avg(base_accuracy_drop)')} AS base_accuracy_drop, {R('avg(wordy_accuracy_drop)')} AS wordy_accuracy_drop FROM mir GROUP BY rung""")
def j05(spark, sf):
    m = jn.mirror_cells(outcomes(spark, sf), ["volatility", "accuracy_drop"])
    cols = ("base_volatility", "wordy_volatility", "base_accuracy_drop", "wordy_accuracy_drop")
    return m.groupBy("rung").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in cols])


@query("j06_category_lookup", """SELECT o_orderkey % 1000 AS image_id, coalesce(n.n_name, 'unknown') AS category, CAST(count(*) AS BIGINT) AS n
FROM orders LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON n.n_nationkey = o_custkey % 30 GROUP BY 1, 2""")
def j06(spark, sf):
    cats = b.table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("category_id"), "n_name")
    ann = b.table(spark, sf, "orders").select((F.col("o_orderkey") % 1000).alias("image_id"), (F.col("o_custkey") % 30).alias("category_id"))
    return ann.join(cats, "category_id", "left").groupBy("image_id", F.coalesce("n_name", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("j07_relation_lookup", f"""WITH {b.SCENE_SQL} SELECT s.name AS subject_name, rel.relation, t.name AS target_name, CAST(count(*) AS BIGINT) AS n
FROM rel JOIN so s ON s.scene = rel.scene AND s.oid = rel.subject JOIN so t ON t.scene = rel.scene AND t.oid = rel.target GROUP BY 1, 2, 3""")
def j07(spark, sf):
    so = b.scene_objects(spark, sf)
    return sc.named_relations(so, b.scene_relations(so)).groupBy("subject_name", "relation", "target_name").agg(F.count("*").alias("n"))


@query("j08_named_pair_count", f"""WITH {b.SCENE_SQL} SELECT rel.scene, s.name AS subject_name, t.name AS target_name,
  (SELECT CAST(count(*) AS BIGINT) FROM so x JOIN so y ON x.scene = y.scene AND x.oid <> y.oid WHERE x.scene = rel.scene AND x.name = s.name AND y.name = t.name) AS n_pairs
FROM rel JOIN so s ON s.scene = rel.scene AND s.oid = rel.subject JOIN so t ON t.scene = rel.scene AND t.oid = rel.target""")
def j08(spark, sf):
    so = b.scene_objects(spark, sf)
    named = sc.named_relations(so, b.scene_relations(so)).select("scene", "subject_name", "target_name")
    return sc.named_pair_counts(so, named)


@query("j09_model_key_join", f"""{_MS} SELECT x.metric, x.perturb, x.severity, {R('x.mean')} AS mean_f, {R('y.mean')} AS mean_o
FROM ms x JOIN ms y ON x.metric = y.metric AND x.perturb = y.perturb AND x.severity = y.severity WHERE x.model = 'F' AND y.model = 'O'""")
def j09(spark, sf):
    ms = metric_means(spark, sf)
    x = ms.where("model = 'F'").select("metric", "perturb", "severity", r6("mean").alias("mean_f"))
    y = ms.where("model = 'O'").select("metric", "perturb", "severity", r6("mean").alias("mean_o"))
    return jn.shared_keys(x, y, ("metric", "perturb", "severity"))


@query("j10_relative_to_base", f"{_DROP} SELECT model, metric, perturb, severity, {R('d')} AS drop, CAST(n AS BIGINT) AS count FROM dr")
def j10(spark, sf):
    return rounded(jn.relative_to_base(metric_means(spark, sf)).drop("mean"), "drop")


@query("j11_pipeline_difference", f"""{_MS} SELECT x.model, x.perturb, x.severity, {R('x.mean - y.mean')} AS delta
FROM ms x JOIN ms y ON x.model = y.model AND x.perturb = y.perturb AND x.severity = y.severity WHERE x.metric = 'iou' AND y.metric = 'dice'""")
def j11(spark, sf):
    ms = metric_means(spark, sf)
    keys = ["model", "perturb", "severity"]
    x = ms.where("metric = 'iou'").select(*keys, F.col("mean").alias("a"))
    y = ms.where("metric = 'dice'").select(*keys, F.col("mean").alias("b"))
    return jn.shared_keys(x, y, keys).select(*keys, r6(F.col("a") - F.col("b")).alias("delta"))


_CTRL = f"""ix AS (SELECT vec_id, row_number() OVER (ORDER BY {HI('index', 'vec_id')} % 4096, {HI('index', 'vec_id')}, vec_id) - 1 AS pos FROM embeddings),
nn AS (SELECT count(*) AS n FROM embeddings),
dj AS (SELECT vec_id, pos, n, j, (n - 1) * j // 3 AS lo, (n - 1) * (j + 1) // 3 - (n - 1) * j // 3 AS width FROM ix, nn, range(0, 3) t(j)),
ctrl AS (SELECT dj.vec_id, CAST(dj.j AS INT) AS draw, o.vec_id AS other FROM dj JOIN ix o ON o.pos = (dj.pos + 1 + lo + {HI(7, 'dj.vec_id', 'j')} % width) % n)"""


@query("j12_control_draws", f"WITH {_CTRL} SELECT * FROM ctrl")
def j12(spark, sf):
    return jn.control_draws(b.table(spark, sf, "embeddings").select("vec_id"), "vec_id")


def _COS(x, y):
    n = f"(sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y})))"
    return f"(CASE WHEN {n} > 1e-8 THEN list_dot_product({x}, {y}) / {n} ELSE 0 END)"


def _L2(x, y):
    return f"list_distance({x}, {y})"


@query("j18_embedding_distance", f"WITH {b.VARIANTS_SQL} SELECT vec_id, channel, perturbation, {R(_COS('clean', 'pert'))} AS cosine, {R(_L2('clean', 'pert'))} AS l2 FROM variants")
def j18(spark, sf):
    v = b.variants(spark, sf).withColumn("clean", doubles("clean")).withColumn("pert", doubles("pert"))
    return v.select("vec_id", "channel", "perturbation", r6(cosine("clean", "pert")).alias("cosine"), r6(l2_distance("clean", "pert")).alias("l2"))


_SIM = f"WITH {b.VARIANTS_SQL}, s AS (SELECT channel, perturbation, {_COS('clean', 'pert')} AS cs, {_L2('clean', 'pert')} AS l2 FROM variants)"


@query("a12_mean_similarity", f"""{_SIM} SELECT channel, coalesce(CAST(perturbation AS VARCHAR), 'Any') AS perturbation, {R('avg(cs)')} AS mean_cos, {R('avg(l2)')} AS mean_l2, CAST(count(*) AS BIGINT) AS n
FROM s GROUP BY GROUPING SETS ((channel, perturbation), (channel))""")
def a12(spark, sf):
    v = b.variants(spark, sf).withColumn("clean", doubles("clean")).withColumn("pert", doubles("pert"))
    v = v.select("channel", "perturbation", cosine("clean", "pert").alias("cs"), l2_distance("clean", "pert").alias("l2"))
    return v.groupingSets([["channel", "perturbation"], ["channel"]], "channel", "perturbation").agg(
        r6(F.avg("cs")).alias("mean_cos"), r6(F.avg("l2")).alias("mean_l2"), F.count("*").alias("n")).withColumn(
        "perturbation", F.coalesce(F.col("perturbation").cast("string"), F.lit("Any")))


@query("a13_drift_vs_control", f"""WITH {b.VARIANTS_SQL}, {_CTRL}, em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pd AS (SELECT vec_id, channel, perturbation, avg(1 - {_COS('clean', 'pert')}) AS c, avg({_L2('clean', 'pert')}) AS l FROM variants GROUP BY 1, 2, 3),
cd AS (SELECT c.vec_id, avg(1 - {_COS('a.v', 'o.v')}) AS cc, avg({_L2('a.v', 'o.v')}) AS cl FROM ctrl c JOIN em a ON a.vec_id = c.vec_id JOIN em o ON o.vec_id = c.other GROUP BY 1),
m AS (SELECT channel % 3 AS channel, perturbation, count(*) AS n, avg(c) AS pm, coalesce(stddev_samp(c), 0) AS ps, avg(cc) AS cm, coalesce(stddev_samp(cc), 0) AS cs, var_samp(c) AS pv, var_samp(cc) AS cv, avg(l) AS pl, avg(cl) AS cl FROM pd JOIN cd USING (vec_id) GROUP BY 1, 2)
SELECT channel, perturbation, CAST(n AS BIGINT) AS n, {R('pm')} AS pert_mean, {R('ps')} AS pert_std, {R('cm')} AS ctrl_mean, {R('cs')} AS ctrl_std, {R('pl')} AS pert_l2, {R('cl')} AS ctrl_l2,
  {R('CASE WHEN n >= 2 AND pv + cv > 0 THEN (pm - cm) / sqrt((pv + cv) / 2) ELSE 0 END')} AS cohen_d FROM m""")
def a13(spark, sf):
    v = b.variants(spark, sf).withColumn("clean", doubles("clean")).withColumn("pert", doubles("pert"))
    pd = v.groupBy("vec_id", "channel", "perturbation").agg(F.avg(1 - cosine("clean", "pert")).alias("c"), F.avg(l2_distance("clean", "pert")).alias("l"))
    em = b.table(spark, sf, "embeddings").select("vec_id", doubles("embedding").alias("v"))
    ctrl = jn.control_draws(em.select("vec_id"), "vec_id").join(em, "vec_id").join(em.select(F.col("vec_id").alias("other"), F.col("v").alias("o")), "other")
    cd = ctrl.groupBy("vec_id").agg(F.avg(1 - cosine("v", "o")).alias("cc"), F.avg(l2_distance("v", "o")).alias("cl"))
    g = pd.join(cd, "vec_id").groupBy((F.col("channel") % 3).alias("channel"), "perturbation").agg(
        F.count("*").alias("n"), F.avg("c").alias("pert_mean"), sd0("c").alias("pert_std"), F.avg("cc").alias("ctrl_mean"), sd0("cc").alias("ctrl_std"),
        F.avg("l").alias("pert_l2"), F.avg("cl").alias("ctrl_l2"), F.var_samp("c").alias("pv"), F.var_samp("cc").alias("cv"))
    g = g.withColumn("cohen_d", cohens_d("n", "pert_mean", "pv", "n", "ctrl_mean", "cv")).drop("pv", "cv")
    return rounded(g, "pert_mean", "pert_std", "ctrl_mean", "ctrl_std", "pert_l2", "ctrl_l2", "cohen_d")


@query("j13_best_iou_match", """WITH f AS (SELECT l_orderkey AS frame, l_linenumber AS k, l_partkey % 50 AS x, l_suppkey % 50 AS y, l_quantity AS s, row_number() OVER () AS rid FROM lineitem),
p AS (SELECT * FROM f WHERE k % 2 = 0), g AS (SELECT * FROM f WHERE k % 2 = 1),
m AS (SELECT p.rid, p.frame, p.k, p.x, p.y, p.s, g.k AS gk, greatest(0, least(p.x + p.s, g.x + g.s) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.s, g.y + g.s) - greatest(p.y, g.y)) AS i, g.s AS gs FROM p LEFT JOIN g ON p.frame = g.frame),
u AS (SELECT *, CASE WHEN gk IS NULL OR s * s + gs * gs - i <= 0 THEN 0 ELSE i / (s * s + gs * gs - i) END AS iou FROM m)
SELECT frame, k, x, y, s, round(max(iou), 6) + 0e0 AS best_iou, CASE WHEN max(iou) > 0 THEN arg_min(gk, gk) FILTER (WHERE iou = mx) END AS matched
FROM (SELECT *, max(iou) OVER (PARTITION BY rid) AS mx FROM u) GROUP BY rid, frame, k, x, y, s""")
def j13(spark, sf):
    f = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS frame", "l_linenumber AS k", "l_partkey % 50 AS x", "l_suppkey % 50 AS y", "l_quantity AS s")
    return rounded(sc.best_box_match(f.where("k % 2 = 0"), f.where("k % 2 = 1")), "best_iou")


@query("j14_filter_comparison", f"""WITH {b.FILTERS_SQL}, c AS (SELECT f.item_id, f.level_no, f.w, g.w AS cw FROM filters f JOIN filters g ON g.item_id = f.item_id + 1),
q AS (SELECT *, list_transform(w, lambda x: greatest(x, 1e-8)) AS p0, list_transform(cw, lambda x: greatest(x, 1e-8)) AS q0 FROM c),
n AS (SELECT *, list_transform(p0, lambda x: x / list_sum(p0)) AS p, list_transform(q0, lambda x: x / list_sum(q0)) AS qq FROM q)
SELECT item_id, level_no, {R(_L2('w', 'cw'))} AS l2_distance, {R(_COS('w', 'cw'))} AS cosine_similarity,
  {R('0.5 * list_sum(list_transform(range(1, 9), lambda i: p[i] * ln(p[i] / (0.5 * (p[i] + qq[i]))) + qq[i] * ln(qq[i] / (0.5 * (p[i] + qq[i])))))')} AS js_divergence,
  {R('1 / list_dot_product(cw, cw) - 1 / list_dot_product(w, w)')} AS bandwidth_delta FROM n""")
def j14(spark, sf):
    f = b.filters(spark, sf).select("item_id", "level_no", "w")
    ctrl = f.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("cw"))
    return f.join(ctrl, "item_id").select(
        "item_id", "level_no", r6(l2_distance("w", "cw")).alias("l2_distance"), r6(cosine("w", "cw")).alias("cosine_similarity"),
        r6(js_divergence("w", "cw")).alias("js_divergence"), r6(bandwidth("cw") - bandwidth("w")).alias("bandwidth_delta"))


@query("j15_negative_names", f"""WITH {b.SCENE_SQL}, v AS (SELECT full_name AS name, row_number() OVER (ORDER BY full_name) - 1 AS rk FROM (SELECT DISTINCT full_name FROM so)),
scenes AS (SELECT DISTINCT scene FROM so), miss AS (SELECT s.scene, v.name, row_number() OVER (PARTITION BY s.scene ORDER BY v.rk) - 1 AS i, count(*) OVER (PARTITION BY s.scene) AS n
  FROM scenes s, v WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.scene = s.scene AND so.full_name = v.name))
SELECT scene, name AS negative FROM miss WHERE i = {HI(5, 'scene')} % n""")
def j15(spark, sf):
    so = b.scene_objects(spark, sf)
    return sc.negative_names(so.select("scene", F.col("full_name").alias("name")), seed=5)


_SPECS = [{"kind": k, "sev": s, "strength": round(s * v, 2), "sign": g} for k, v in (("shift", 4.0), ("contrast", 0.15), ("noise", 0.05)) for s in (1, 2, 3) for g in (1, -1)]


@query("j16_perturbation_fan_out", "SELECT p_partkey AS item_id, kind, CAST(sev AS INT) AS sev, CAST(strength AS DOUBLE) AS strength, CAST(sign AS INT) AS sign FROM part, (VALUES " + ", ".join(
    f"('{s['kind']}', {s['sev']}, {s['strength']}, {s['sign']})" for s in _SPECS) + ") v(kind, sev, strength, sign)")
def j16(spark, sf):
    return jn.fan_out(b.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")), _SPECS)


@query("j19_band_dirichlet_lookup", f"{_DIR_SQL} SELECT vec_id, perturbation, {R('delta_energy')} AS delta_energy, {R('d_low')} AS delta_low, {R('d_high')} AS delta_high, {R('CASE WHEN abs(d_low) > 1e-5 THEN ratio END')} AS delta_ratio FROM dl")
def j19(spark, sf):
    d = dirichlet_rows(spark, sf)
    bands = d.select("vec_id", "perturbation", "d_low", "d_high", "ratio")
    j = d.select("vec_id", "perturbation", "delta_energy").join(bands, ["vec_id", "perturbation"], "left")
    return j.select("vec_id", "perturbation", r6("delta_energy").alias("delta_energy"), r6("d_low").alias("delta_low"),
                    r6("d_high").alias("delta_high"), r6(F.when(F.abs("d_low") > 1e-5, F.col("ratio"))).alias("delta_ratio"))


@query("j20_prior_success", """WITH t AS (SELECT o_custkey AS frame, o_orderkey, o_orderpriority AS perturb, (o_totalprice % 1000) / 1000 AS iou FROM orders),
ok AS (SELECT DISTINCT frame FROM t WHERE perturb = '1-URGENT' AND iou >= 0.5)
SELECT perturb, CAST(count(c) AS BIGINT) AS n, round(avg(c), 6) + 0e0 AS conditional_mean FROM (
  SELECT perturb, CASE WHEN ok.frame IS NOT NULL THEN CASE WHEN iou >= 0.5 THEN iou ELSE 0 END END AS c FROM t LEFT JOIN ok USING (frame) WHERE perturb <> '1-URGENT') GROUP BY perturb""")
def j20(spark, sf):
    t = b.table(spark, sf, "orders").selectExpr("o_custkey AS frame", "o_orderpriority AS perturb", "(o_totalprice % 1000) / 1000 AS metric_value")
    t = t.withColumn("passed", F.col("metric_value") >= 0.5)
    c = jn.prior_success(t.where("perturb <> '1-URGENT'"), t.where("perturb = '1-URGENT' AND passed"), "frame")
    return c.groupBy("perturb").agg(F.count("conditional").alias("n"), r6(F.avg("conditional")).alias("conditional_mean"))


@query("j21_alignment_vs_drop", f"""{_DROP}, al AS (SELECT model, perturb, severity, mean FROM ms WHERE metric = 'dice' AND severity > 0), pf AS (SELECT model, perturb, severity, d FROM dr WHERE metric = 'iou')
SELECT model, CAST(count(*) AS BIGINT) AS n, {R(CORR('mean', 'd'))} AS r FROM al JOIN pf USING (model, perturb, severity) GROUP BY model""")
def j21(spark, sf):
    ms = metric_means(spark, sf)
    keys = ["model", "perturb", "severity"]
    al = ms.where("metric = 'dice' AND severity > 0").select(*keys, "mean")
    pf = jn.relative_to_base(ms).where("metric = 'iou'").select(*keys, F.col("drop").alias("d"))
    return al.join(pf, keys).groupBy("model").agg(F.count("*").alias("n"), r6(safe_corr("mean", "d")).alias("r"))


@query("j22_missing_images", "SELECT o_orderkey AS image FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j22(spark, sf):
    wanted = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"))
    return jn.missing_keys(wanted, b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image")), "image")


@query("j17_option_hardness", f"""WITH {b.SCENE_SQL}, {{items}} SELECT scene, oid, CAST(same_category AS BIGINT) AS same_category, CAST(scene_present AS BIGINT) AS scene_present, same_category + 0.5e0 * scene_present AS hardness FROM hard""".replace("{items}", sc.HARDNESS_SQL))
def j17(spark, sf):
    so = b.scene_objects(spark, sf)
    return sc.option_hardness(so)


@query("u2_key_intersection", f"{_MS} SELECT perturb, severity FROM ms WHERE model = 'F' INTERSECT SELECT perturb, severity FROM ms WHERE model = 'P'")
def u2(spark, sf):
    ms = metric_means(spark, sf)
    return ms.where("model = 'F'").select("perturb", "severity").intersect(ms.where("model = 'P'").select("perturb", "severity"))


@query("u3_name_difference", f"""WITH {b.SCENE_SQL} SELECT v.name, CAST(count(*) AS BIGINT) AS absent_scenes FROM (SELECT DISTINCT name FROM so) v, (SELECT DISTINCT scene FROM so) s
WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.scene = s.scene AND so.name = v.name) GROUP BY v.name""")
def u3(spark, sf):
    # how many scenes lack each name: all scenes minus the scenes that hold it, without forming the grid
    so = b.scene_objects(spark, sf).select("scene", "name").distinct()
    total = so.select("scene").distinct().agg(F.count("*").alias("t")).select("t").scalar()
    return so.groupBy("name").agg(F.count("*").alias("k")).select("name", (total - F.col("k")).alias("absent_scenes")).where("absent_scenes > 0")


@query("u4_distinct_levels", f"{b.T()} SELECT DISTINCT family, level_no FROM tr")
def u4(spark, sf):
    return b.trials(spark, sf).select("family", "level_no").distinct()
