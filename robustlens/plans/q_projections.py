"""P: flattening, views, filters and outcome selection."""
from pyspark.sql import functions as F

from ..functions.arrays import delta_family
from ..functions.numeric import optional_double, r6
from ..operators import trials as tr
from . import bindings as b
from .registry import query
from .sqlkit import R


@query("p01_complexity_points", f"""WITH {b.RECORDS_SQL}
SELECT rec_id, rec_no, item_id, level_no, csem, cprompt, any_value(clean_correct) AS clean_correct,
  {R('avg(accuracy_drop)')} AS mean_drop, {R('avg(coalesce(loglik_drift, 0))')} AS mean_drift
FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, rec_no, item_id, level_no, severity ORDER BY l_discount, l_returnflag) AS copy
      FROM rp)
GROUP BY rec_id, rec_no, item_id, level_no, csem, cprompt, l_discount, l_returnflag, copy""")
def p01(spark, sf):
    out = tr.complexity_points(b.records(spark, sf))
    return out.withColumns({"mean_drop": r6("mean_drop"), "mean_drift": r6("mean_drift")})


@query("p02_long_table", f"""WITH {b.RECORDS_SQL}
SELECT rec_id, rec_no, item_id, level_no, csem, cprompt, clean_correct, perturbation, family, severity,
  accuracy_drop, {R('loglik_drift')} AS loglik_drift FROM rp WHERE loglik_drift IS NOT NULL""")
def p02(spark, sf):
    return tr.flatten_records(b.records(spark, sf)).withColumn("loglik_drift", r6("loglik_drift"))


@query("p03_per_perturbation_points", f"""WITH {b.RECORDS_SQL}
SELECT perturbation, CAST(count(*) AS BIGINT) AS n, {R('avg(accuracy_drop)')} AS mean_drop,
  {R('avg(coalesce(loglik_drift, 0))')} AS mean_drift FROM rp GROUP BY perturbation""")
def p03(spark, sf):
    rows = tr.flatten_records(b.records(spark, sf), drop_null_drift=False)
    return rows.groupBy("perturbation").agg(F.count("*").alias("n"), r6(F.avg("accuracy_drop")).alias("mean_drop"),
                                            r6(F.avg("loglik_drift")).alias("mean_drift"))


@query("p04_level_views", f"""{b.T()}
SELECT v.view, CAST(count(*) AS BIGINT) AS n, {R('avg(volatility)')} AS mean_volatility
FROM tr JOIN (VALUES ('primary', 1, 4), ('wordy', 5, 8), ('pooled', 1, 8)) v(view, lo, hi)
  ON level_no BETWEEN lo AND hi GROUP BY v.view""")
def p04(spark, sf):
    v = tr.level_views(tr.with_outcomes(b.trials(spark, sf)))
    return v.groupBy("view").agg(F.count("*").alias("n"), r6(F.avg("volatility")).alias("mean_volatility"))


@query("p05_clean_correct_gate", f"""{b.T()}
SELECT level_no, CAST(count(*) AS BIGINT) AS n, {R('avg(accuracy_drop)')} AS mean_drop
FROM tr WHERE clean_correct = 1 GROUP BY level_no""")
def p05(spark, sf):
    rows = tr.clean_correct_only(tr.with_outcomes(b.trials(spark, sf)))
    return rows.groupBy("level_no").agg(F.count("*").alias("n"), r6(F.avg("accuracy_drop")).alias("mean_drop"))


@query("p06_complete_cases", """SELECT user_id % 7 AS grp, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) + 0e0 AS mean_value
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN CAST('nan' AS DOUBLE)
      WHEN event_id % 5 = 2 THEN CAST('inf' AS DOUBLE) ELSE value END AS x FROM events)
WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AND value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id % 7""")
def p06(spark, sf):
    ev = b.table(spark, sf, "events").withColumn("x", F.expr(
        "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN CAST('NaN' AS DOUBLE) "
        "WHEN event_id % 5 = 2 THEN CAST('Infinity' AS DOUBLE) ELSE value END"))
    rows = tr.complete_cases(ev, ["x", "value"], ["user_id"])
    return rows.groupBy((F.col("user_id") % 7).alias("grp")).agg(
        F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("p07_numeric_coercion", """SELECT event_type, CAST(count(x) AS BIGINT) AS n_ok, CAST(count(*) - count(x) AS BIGINT) AS n_null,
  round(sum(x), 6) + 0e0 AS total FROM (SELECT event_type, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL
  ELSE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS x FROM events) GROUP BY event_type""")
def p07(spark, sf):
    raw = F.expr("CASE WHEN event_id % 4 = 0 THEN concat(event_type, '?') WHEN event_id % 4 = 1 THEN 'NaN' "
                 "ELSE regexp_extract(props, '([0-9]+)', 1) END")
    ev = b.table(spark, sf, "events").select("event_type", optional_double(raw).alias("x"))
    return ev.groupBy("event_type").agg(F.count("x").alias("n_ok"), (F.count("*") - F.count("x")).alias("n_null"),
                                        r6(F.sum("x")).alias("total"))


@query("p08_allow_kinds", f"""{b.T()} SELECT family, CAST(count(*) AS BIGINT) AS n FROM tr
WHERE lower(family) IN ('af', 'no') GROUP BY family""")
def p08(spark, sf):
    return tr.allow_kinds(b.trials(spark, sf), ["AF", "no"]).groupBy("family").agg(F.count("*").alias("n"))


@query("p09_mcq_validity", """SELECT page_id, len(opts) AS n_options, len(imgs) AS n_images FROM (
  SELECT page_id, list_filter(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)), lambda x: trim(x) <> '') AS opts,
         regexp_extract_all(html, '<h1>') AS imgs FROM pages) WHERE len(opts) >= 2 AND len(imgs) > 0""")
def p09(spark, sf):
    items = b.table(spark, sf, "pages").select(
        "page_id", F.filter(F.array_distinct(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")),
                            lambda x: F.trim(x) != "").alias("opts"),
        F.expr("regexp_extract_all(html, '<h1>', 0)").alias("imgs"))
    return items.where((F.size("opts") >= 2) & (F.size("imgs") > 0)).select(
        "page_id", F.size("opts").cast("long").alias("n_options"), F.size("imgs").cast("long").alias("n_images"))


@query("p10_complete_ladder", f"""{b.T()}, full_items AS (SELECT item_id FROM tr WHERE level_no <= 4
  GROUP BY item_id HAVING count(DISTINCT level_no) = 4)
SELECT item_id, CAST(count(*) AS BIGINT) AS n FROM tr WHERE item_id IN (SELECT item_id FROM full_items) GROUP BY item_id""")
def p10(spark, sf):
    return tr.complete_ladder(b.trials(spark, sf), tr.PRIMARY_LEVELS).groupBy("item_id").agg(F.count("*").alias("n"))


@query("p11_flipped_items_only", f"""{b.T('order_id')}
SELECT order_id, CAST(count(*) AS BIGINT) AS n, {R('sum(loglik_drift)')} AS total_drift FROM tr
WHERE order_id IN (SELECT order_id FROM tr WHERE changed) GROUP BY order_id""")
def p11(spark, sf):
    t = tr.with_outcomes(b.trials(spark, sf, "order_id"))
    return tr.keep_flipped_items(t, t, "order_id").groupBy("order_id").agg(
        F.count("*").alias("n"), r6(F.sum("loglik_drift")).alias("total_drift"))


@query("p12_spectrum_sources", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings),
s AS (SELECT vec_id, 'image' AS space, CASE WHEN vec_id % 3 = 0 THEN 'raw' ELSE 'relative' END AS normalization,
        CASE WHEN vec_id % 3 = 0 THEN d ELSE list_transform(d, lambda x: x * 2) END AS delta FROM e
      UNION ALL SELECT vec_id, 'vision', CASE WHEN vec_id % 5 = 0 THEN 'relative' ELSE 'raw' END,
        CASE WHEN vec_id % 5 = 0 THEN list_transform(d, lambda x: x * 8) ELSE list_transform(d, lambda x: x * 4) END FROM e WHERE NOT (vec_id % 7 = 0 AND vec_id % 5 <> 0))
SELECT space, normalization, CAST(count(*) AS BIGINT) AS n, {R('sum(list_sum(delta))')} AS total FROM s GROUP BY space, normalization""")
def p12(spark, sf):
    e = b.table(spark, sf, "embeddings").selectExpr(
        "vec_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS d").selectExpr(
        "vec_id", "d AS image_raw", "CASE WHEN vec_id % 3 = 0 THEN slice(d, 1, 0) ELSE transform(d, x -> x * 2) END AS image_relative",
        "CASE WHEN vec_id % 7 = 0 THEN NULL ELSE transform(d, x -> x * 4) END AS vision_raw",
        "CASE WHEN vec_id % 5 = 0 THEN transform(d, x -> x * 8) END AS vision_relative")
    s = tr.spectrum_sources(e)
    total = F.aggregate("delta", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return s.groupBy("space", "normalization").agg(F.count("*").alias("n"), r6(F.sum(total)).alias("total"))


_TARGETS = ("loglik_drift", "erosion", "recovery", "volatility", "accuracy_drop", "net_change")


@query("p13_outcome_selection", f"""{b.T()}, n AS (SELECT *, CASE WHEN clean_correct = 1 AND pert_correct = 0 THEN 1e0
  WHEN clean_correct = 0 AND pert_correct = 1 THEN -1e0 ELSE 0e0 END AS net_change FROM tr)
""" + " UNION ALL ".join(f"SELECT '{t}' AS target, CAST(count(*) AS BIGINT) AS n, {R(f'sum({t})')} AS total, {R(f'min({t})')} AS lo FROM n"
                         for t in _TARGETS))
def p13(spark, sf):
    t = tr.with_outcomes(b.trials(spark, sf)).withColumn(
        "net_change", (F.col("clean_correct") - F.col("pert_correct")).cast("double"))
    return tr.unpivot_targets(t.select("item_id", *_TARGETS), list(_TARGETS)).groupBy("target").agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("total"), r6(F.min("value")).alias("lo"))


@query("p14_target_pairs", f"""WITH {b.RECORDS_SQL}
SELECT 'accuracy_drop' AS target, item_id, CAST(count(*) AS BIGINT) AS n, {R('sum(accuracy_drop)')} AS total FROM rp GROUP BY item_id
UNION ALL SELECT 'loglik_drift', item_id, CAST(count(*) AS BIGINT), {R('sum(loglik_drift)')} FROM rp WHERE loglik_drift IS NOT NULL GROUP BY item_id""")
def p14(spark, sf):
    lv = b.records(spark, sf).select("item_id", F.explode("levels").alias("k", "lv"))
    rows = lv.select("item_id", F.explode("lv.perturbations").alias("p")).select("item_id", "p.accuracy_drop", "p.loglik_drift")
    return tr.unpivot_targets(rows, ["accuracy_drop", "loglik_drift"]).groupBy("target", "item_id").agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("p15_grid_guard", """SELECT label, CAST(count(*) FILTER (WHERE h * w = len(embedding)) AS BIGINT) AS kept,
  CAST(count(*) FILTER (WHERE h * w <> len(embedding)) AS BIGINT) AS dropped
FROM (SELECT *, 8 AS h, CASE WHEN vec_id % 6 = 0 THEN 7 ELSE 8 END AS w FROM embeddings) GROUP BY label""")
def p15(spark, sf):
    g = b.table(spark, sf, "embeddings").selectExpr("*", "8 AS h", "CASE WHEN vec_id % 6 = 0 THEN 7 ELSE 8 END AS w")
    ok = F.col("h") * F.col("w") == F.size("embedding")
    return g.groupBy("label").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


_Q16 = """SELECT p_partkey AS item_id, level_no,
  CASE WHEN level_no > 4 THEN concat('Look closely. ', p_name, '?') ELSE concat(p_name, '?') END AS question,
  CASE WHEN level_no = 7 AND p_partkey % 3 = 0 THEN 'B' ELSE 'A' END AS answer_label, p_brand AS options,
  CAST(p_size AS DOUBLE) AS csem, CAST(CASE WHEN level_no > 4 THEN 9 ELSE 3 END AS DOUBLE) AS cprompt FROM part"""


@query("p16_valid_mirror_pairs", f"""WITH q AS ({_Q16}, range(1, 9) g(level_no)),
pairs AS (SELECT b.item_id, CAST(b.level_no AS INT) AS base_level, b.answer_label = w.answer_label AND b.options = w.options
    AND b.csem = w.csem AND w.cprompt > b.cprompt AND contains(w.question, b.question) AS valid
  FROM q b JOIN q w ON b.item_id = w.item_id AND w.level_no = b.level_no + 4 WHERE b.level_no <= 4)
SELECT base_level, item_id, valid, (SELECT {R('avg(CAST(x.valid AS INT))')} FROM pairs x WHERE x.base_level = pairs.base_level) AS valid_rate
FROM pairs WHERE base_level IN (SELECT base_level FROM pairs GROUP BY base_level HAVING avg(CAST(valid AS INT)) >= 0.99)""")
def p16(spark, sf):
    q = b.table(spark, sf, "part").withColumn("level_no", F.explode(F.sequence(F.lit(1), F.lit(8)))).selectExpr(
        "p_partkey AS item_id", "level_no",
        "CASE WHEN level_no > 4 THEN concat('Look closely. ', p_name, '?') ELSE concat(p_name, '?') END AS question",
        "CASE WHEN level_no = 7 AND p_partkey % 3 = 0 THEN 'B' ELSE 'A' END AS answer_label", "p_brand AS options",
        "CAST(p_size AS DOUBLE) AS csem", "CAST(CASE WHEN level_no > 4 THEN 9 ELSE 3 END AS DOUBLE) AS cprompt")
    return tr.valid_mirror_pairs(q).withColumn("valid_rate", r6("valid_rate"))


@query("p17_predictor_list", f"""{b.T()} SELECT level_no, CAST(count(*) AS BIGINT) AS n,
  concat('csem,cprompt,hopt', CASE WHEN min(is_binary) = 0 AND max(is_binary) = 1 THEN ',is_binary' ELSE '' END, CASE WHEN count(entropy) > 0 THEN ',prediction_entropy' ELSE '' END) AS predictors
FROM (SELECT level_no % 3 AS level_no, is_binary, CASE WHEN level_no = 3 THEN abs(loglik_drift) END AS entropy FROM tr) GROUP BY level_no""")
def p17(spark, sf):
    t = b.trials(spark, sf).selectExpr("level_no % 3 AS level_no", "is_binary", "CASE WHEN level_no = 3 THEN abs(loglik_drift) END AS prediction_entropy")
    return t.groupBy("level_no").agg(F.count("*").alias("n"), F.concat_ws(",", tr.predictor_names(t.columns)).alias("predictors"))


@query("p18_skip_null_base", """SELECT o_orderstatus AS model, CAST(count(*) AS BIGINT) AS n FROM orders
WHERE o_custkey % 9 <> 0 GROUP BY o_orderstatus""")
def p18(spark, sf):
    o = b.table(spark, sf, "orders").selectExpr("o_orderstatus AS model", "CASE WHEN o_custkey % 9 <> 0 THEN 'Yes' END AS base_label")
    return o.where(F.col("base_label").isNotNull()).groupBy("model").agg(F.count("*").alias("n"))


@query("p19_drop_marked_columns", f"""SELECT vec_id, {R('list_sum(CAST(embedding AS DOUBLE[]))')} AS w_t FROM embeddings""")
def p19(spark, sf):
    e = b.table(spark, sf, "embeddings").select(
        "vec_id", r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("w_t"),
        F.col("embedding").alias("w_t_l2"), F.lit(1).alias("l2_norm"))
    return tr.drop_marked_columns(e, "_l2", "l2_")


@query("p20_trial_export", f"""WITH {b.RECORDS_SQL}
SELECT r.item_id, r.rec_id, r.rec_no, r.level_no, r.perturbation, CAST(r.severity - 1 AS INT) AS pos, r.clean_correct, r.accuracy_drop,
  {R('r.loglik_drift')} AS loglik_drift, e.example_file
FROM rp r LEFT JOIN (SELECT DISTINCT concat(l_returnflag, '(', 2, ')|sev', 2) AS perturbation, concat('ex_', l_returnflag, '.png') AS example_file FROM lineitem) e
USING (perturbation)""")
def p20(spark, sf):
    li = b.table(spark, sf, "lineitem")
    examples = li.select("l_returnflag").distinct().selectExpr(
        "concat(l_returnflag, '(', 2, ')|sev', 2) AS perturbation", "concat('ex_', l_returnflag, '.png') AS example_file")
    lv = b.records(spark, sf).select("item_id", "rec_id", "rec_no", F.explode("levels").alias("level_no", "lv"))
    rows = lv.select("item_id", "rec_id", "rec_no", "level_no", "lv.clean_correct", F.posexplode("lv.perturbations").alias("pos", "p"))
    rows = rows.select("item_id", "rec_id", "rec_no", "level_no", "pos", "clean_correct", F.col("p.name").alias("perturbation"),
                       "p.accuracy_drop", r6("p.loglik_drift").alias("loglik_drift"))
    return tr.export_trials(rows, F.broadcast(examples), ("perturbation",))    # one row per return flag; the rows would go to a task per name


@query("m03_signed_drift_split", f"""{b.T()} SELECT family, {R('sum(erosion)')} AS erosion, {R('sum(recovery)')} AS recovery,
  {R('sum(volatility)')} AS volatility FROM tr GROUP BY family""")
def m03(spark, sf):
    return tr.with_outcomes(b.trials(spark, sf)).groupBy("family").agg(
        *[r6(F.sum(c)).alias(c) for c in ("erosion", "recovery", "volatility")])


@query("m09_delta_family", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS d0 FROM embeddings),
d AS (SELECT vec_id, list_transform(d0, lambda x: CASE WHEN vec_id % 10 = 0 THEN 0e0 ELSE abs(x) END) AS d FROM e),
x AS (SELECT vec_id, list_sum(d) AS tot, CASE WHEN list_sum(d) > 0 THEN list_sum(list_transform(range(0, 64), lambda i: i * d[i + 1])) / list_sum(d) END AS c FROM d)
SELECT CASE WHEN tot <= 1e-6 THEN 'zero' WHEN c < 64 / 3e0 THEN 'low_freq' WHEN c > 128 / 3e0 THEN 'high_freq' ELSE 'broadband' END AS delta_family,
  CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1""")
def m09(spark, sf):
    e = b.table(spark, sf, "embeddings").selectExpr(
        "transform(embedding, x -> CASE WHEN vec_id % 10 = 0 THEN 0e0 ELSE CAST(x AS DOUBLE) END) AS d")
    return e.groupBy(delta_family("d").alias("delta_family")).agg(F.count("*").alias("n"))
