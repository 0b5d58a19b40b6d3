"""A: group aggregates over trials, metric observations and derived tables."""
from pyspark.sql import functions as F

from ..functions.numeric import cohens_d, div0, mean0, r6, safe_corr, sd0, sdp0
from ..operators import aggregates as ag
from ..operators import trials as tr
from ..session import materialize
from . import bindings as b
from .registry import query
from .sqlkit import CORR, DIV0, R


def outcomes(spark, sf, *extra):
    return tr.with_outcomes(b.trials(spark, sf, *extra))


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


_FLIP = f"""SELECT {{key}} AS perturbation, CAST(sum(changed::INT) AS BIGINT) AS changed, CAST(count(*) AS BIGINT) AS instances,
  CAST(count(DISTINCT CASE WHEN changed THEN item_id END) AS BIGINT) AS items_affected, {R('avg(changed::INT)')} AS avg_rate,
  {R('count(DISTINCT CASE WHEN changed THEN item_id END)::DOUBLE / (SELECT count(DISTINCT item_id) FROM tr)')} AS ve_rate FROM tr"""


@query("a01_flip_rates", f"{b.T()} " + _FLIP.format(key="perturbation") + " GROUP BY perturbation UNION ALL " + _FLIP.format(key="'Any'"))
def a01(spark, sf):
    return rounded(ag.flip_rates(outcomes(spark, sf)), "avg_rate", "ve_rate")


@query("a02_any_row", f"{b.T()} " + _FLIP.format(key="family") + " GROUP BY family UNION ALL " + _FLIP.format(key="'Any'"))
def a02(spark, sf):
    return rounded(ag.flip_rates(outcomes(spark, sf), "family"), "avg_rate", "ve_rate").withColumnRenamed("family", "perturbation")


_TRANS = """CAST(count(*) FILTER (WHERE clean_correct = 1 AND pert_correct = 0) AS BIGINT) AS r2w,
  CAST(count(*) FILTER (WHERE clean_correct = 0 AND pert_correct = 1) AS BIGINT) AS w2r,
  CAST(count(*) FILTER (WHERE clean_correct = 1 AND pert_correct = 1) AS BIGINT) AS r2r,
  CAST(count(*) FILTER (WHERE clean_correct = 0 AND pert_correct = 0) AS BIGINT) AS w2w"""


@query("a03_transition_confusion", f"{b.T()} SELECT perturbation, {_TRANS} FROM tr GROUP BY perturbation")
def a03(spark, sf):
    return ag.transitions(outcomes(spark, sf), "perturbation")


_CELL = "concat(CASE WHEN clean_correct = 1 THEN 'Y' ELSE 'N' END, CASE WHEN rung % 2 = 0 THEN 'Y' ELSE 'N' END)"


@query("a04_transition_by_base_cell", f"{b.T()} SELECT {_CELL} AS base_cell, family, {_TRANS} FROM tr GROUP BY 1, family")
def a04(spark, sf):
    return ag.transitions(outcomes(spark, sf).withColumn("base_cell", F.expr(_CELL)), "base_cell", "family")


@query("a05_binary_metrics", f"""WITH x AS (SELECT source, n_chars > 1000 AS p, quality = 1 AS t FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp,
  count(*) FILTER (WHERE NOT p AND NOT t) AS tn, count(*) FILTER (WHERE NOT p AND t) AS fn FROM x GROUP BY source),
m AS (SELECT *, {DIV0('tp', 'tp + fp')} AS pr, {DIV0('tp', 'tp + fn')} AS rc FROM c)
SELECT source, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  {R(DIV0('tp + tn', 'tp + fp + tn + fn'))} AS accuracy, {R('pr')} AS precision, {R('rc')} AS recall,
  {R(DIV0('2 * pr * rc', 'pr + rc'))} AS f1, {R(DIV0('fp', 'fp + tn'))} AS fpr, {R(DIV0('tp + fp', 'tp + fp + tn + fn'))} AS yes_rate FROM m""")
def a05(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(b.table(spark, sf, "labels"), "doc_id")
    d = d.select("source", (F.col("n_chars") > 1000).alias("p"), (F.col("quality") == 1).alias("t"))
    return rounded(ag.binary_metrics(d, "p", "t", "source"), "accuracy", "precision", "recall", "f1", "fpr", "yes_rate")


@query("a06_base_accuracy", f"""SELECT lang, CAST(count(quality) AS BIGINT) AS n_gt, {R('avg(((n_chars > 1000)::INT = quality)::INT)')} AS base_accuracy
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a06(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(b.table(spark, sf, "labels"), "doc_id", "left")
    hit = ((F.col("n_chars") > 1000).cast("int") == F.col("quality")).cast("double")
    return d.groupBy("lang").agg(F.count("quality").alias("n_gt"), r6(F.avg(hit)).alias("base_accuracy"))


@query("a07_margin_by_flip", f"""{b.T()} SELECT item_id, {R('avg(loglik_drift) FILTER (WHERE changed)')} AS flip_margin,
  {R('avg(loglik_drift) FILTER (WHERE NOT changed)')} AS keep_margin FROM tr GROUP BY item_id""")
def a07(spark, sf):
    m = F.col("loglik_drift")
    return outcomes(spark, sf).groupBy("item_id").agg(r6(F.avg(F.when(F.col("changed"), m))).alias("flip_margin"),
                                                      r6(F.avg(F.when(~F.col("changed"), m))).alias("keep_margin"))


@query("a08_answer_entropy", f"""WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2),
p AS (SELECT user_id, k / sum(k) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, {R('-sum(p * ln(p + 1e-12))')} AS entropy FROM p GROUP BY user_id""")
def a08(spark, sf):
    ev = b.table(spark, sf, "events").withColumn("answer", F.expr("CASE WHEN event_id % 10 <> 0 THEN event_type END"))
    return rounded(ag.answer_entropy(ev, "user_id", "answer"), "entropy")


@query("a09_mean_std", f"""SELECT o_custkey, {R('coalesce(avg(o_totalprice), 0)')} AS mean, {R('coalesce(stddev_samp(o_totalprice), 0)')} AS std
FROM orders GROUP BY o_custkey""")
def a09(spark, sf):
    return rounded(ag.mean_std(b.table(spark, sf, "orders"), "o_totalprice", "o_custkey"), "mean", "std")


_BANDS = ("low", "mid", "high")


_THIRDS = ((1, 22), (23, 21), (44, 21))   # first value and size of each third of 64 values


def _band(i):
    a, n = _THIRDS[i]
    return f"list_sum(list_transform(({{v}})[{a}:{a + n - 1}], lambda x: x * x)) / {n}"


_BAND_SQL = "WITH " + b.VARIANTS_SQL + ", bd AS (SELECT *, (vec_id + perturbation) % 2 = 0 AS is_flip, " + ", ".join(
    f"{_band(i).format(v='pert')} - {_band(i).format(v='clean')} AS d_{n}, "
    f"({_band(i).format(v='pert')} - {_band(i).format(v='clean')}) / (abs({_band(i).format(v='clean')}) + 1e-8) AS rel_{n}"
    for i, n in enumerate(_BANDS)) + " FROM variants)"


def band_deltas(spark, sf):
    """Three-band energy deltas, absolute and relative to the base energy."""
    from ..functions.arrays import asum
    v = b.variants(spark, sf)

    def energy(c, i):
        a, n = _THIRDS[i]
        return asum(F.transform(F.slice(c, a, n), lambda x: x.cast("double") * x.cast("double"))) / n
    cols = {}
    for i, n in enumerate(_BANDS):
        d = energy("pert", i) - energy("clean", i)
        cols[f"d_{n}"] = d
        cols[f"rel_{n}"] = d / (F.abs(energy("clean", i)) + 1e-8)
    cols["is_flip"] = (F.col("vec_id") + F.col("perturbation")) % 2 == 0
    return v.withColumns(cols)


@query("m19_band_deltas", f"{_BAND_SQL} SELECT vec_id, perturbation, " + ", ".join(
    f"{R(f'd_{n}')} AS d_{n}, {R(f'rel_{n}')} AS rel_{n}" for n in _BANDS) + " FROM bd")
def m19(spark, sf):
    return band_deltas(spark, sf).select("vec_id", "perturbation", *[r6(f"{k}_{n}").alias(f"{k}_{n}") for n in _BANDS for k in ("d", "rel")])


@query("a10_band_summary", f"{_BAND_SQL} SELECT perturbation, " + ", ".join(
    f"{R(f'avg({k}_{n})')} AS {k}_{n}_mean, {R(f'coalesce(stddev_samp({k}_{n}), 0)')} AS {k}_{n}_std, "
    f"{R(f'coalesce(avg({k}_{n}) FILTER (WHERE is_flip), 0)')} AS {k}_{n}_flip_mean" for n in _BANDS for k in ("d", "rel"))
    + " FROM bd GROUP BY perturbation")
def a10(spark, sf):
    aggs = []
    for n in _BANDS:
        for k in ("d", "rel"):
            c = f"{k}_{n}"
            aggs += [r6(mean0(c)).alias(f"{c}_mean"), r6(sd0(c)).alias(f"{c}_std"),
                     r6(mean0(F.when(F.col("is_flip"), F.col(c)))).alias(f"{c}_flip_mean")]
    return band_deltas(spark, sf).groupBy("perturbation").agg(*aggs)


_DIR_SQL = _BAND_SQL + """, dl AS (SELECT *, list_sum(list_transform(range(1, 64), lambda i: (pert[i+1] - pert[i]) ** 2 - (clean[i+1] - clean[i]) ** 2)) AS delta_energy,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (pert[i] - clean[i]) ** 2))) AS drift, d_high / (d_low + 1e-8) AS ratio FROM bd)"""


def dirichlet_rows(spark, sf):
    from ..functions.arrays import asum, l2_distance
    bd = band_deltas(spark, sf)

    def rough(c):
        return asum(F.zip_with(F.slice(c, 2, 63), F.slice(c, 1, 63), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))))
    cast = {c: F.transform(c, lambda x: x.cast("double")) for c in ("clean", "pert")}
    return bd.withColumns(cast).withColumns({
        "delta_energy": rough("pert") - rough("clean"), "drift": l2_distance("pert", "clean"),
        "ratio": F.col("d_high") / (F.col("d_low") + 1e-8)})


@query("a11_dirichlet_correlations", f"{_DIR_SQL} " + " UNION ALL ".join(
    f"SELECT perturbation, '{lab}' AS subset, CAST(count(*) AS BIGINT) AS n, {R('coalesce(avg(delta_energy), 0)')} AS mean, {R('coalesce(stddev_samp(delta_energy), 0)')} AS std, "
    f"{R(CORR('delta_energy', 'drift', 2, 'NULL'))} AS r_drift, {R(CORR('delta_energy', 'd_low', 2, 'NULL'))} AS r_low, {R(CORR('delta_energy', 'd_high', 2, 'NULL'))} AS r_high, {R(CORR('delta_energy', 'ratio', 2, 'NULL'))} AS r_ratio "
    f"FROM dl WHERE {w} GROUP BY perturbation" for lab, w in (("all", "true"), ("flip", "is_flip"), ("non_flip", "NOT is_flip"))))
def a11(spark, sf):
    d = dirichlet_rows(spark, sf)
    own = F.when(F.col("is_flip"), "flip").otherwise("non_flip")
    return d.withColumn("subset", F.explode(F.array(F.lit("all"), own))).groupBy("perturbation", "subset").agg(
        F.count("*").alias("n"), r6(mean0("delta_energy")).alias("mean"), r6(sd0("delta_energy")).alias("std"),
        r6(safe_corr("delta_energy", "drift", 2, None)).alias("r_drift"),
        r6(safe_corr("delta_energy", "d_low", 2, None)).alias("r_low"),
        r6(safe_corr("delta_energy", "d_high", 2, None)).alias("r_high"),
        r6(safe_corr("delta_energy", "ratio", 2, None)).alias("r_ratio"))


@query("a14_level_summary", f"""{b.T()}, cell AS (SELECT level_no, item_id, max(clean_correct) AS c FROM tr GROUP BY 1, 2)
SELECT level_no, {R('(SELECT avg(c) FROM cell WHERE cell.level_no = tr.level_no)')} AS clean_accuracy, {R('avg(pert_correct)')} AS perturbed_accuracy,
  {R('avg(accuracy_drop)')} AS mean_drop, {R('stddev_pop(accuracy_drop)')} AS std_drop, {R('avg(loglik_drift)')} AS mean_drift,
  {R('stddev_pop(loglik_drift)')} AS std_drift, {R('coalesce(avg(loglik_drift) FILTER (WHERE loglik_drift > 0), 0)')} AS mean_erosion,
  {R('coalesce(avg(loglik_drift) FILTER (WHERE loglik_drift < 0), 0)')} AS mean_recovery, {R('avg(volatility)')} AS mean_volatility,
  (SELECT CAST(count(*) AS BIGINT) FROM cell WHERE cell.level_no = tr.level_no) AS num_samples, CAST(count(*) AS BIGINT) AS num_evals
FROM tr GROUP BY level_no""")
def a14(spark, sf):
    out = ag.level_summary(outcomes(spark, sf))
    return rounded(out, *[c for c in out.columns if c not in ("level_no", "num_samples", "num_evals")])


@query("a15_level_perturbation", f"""{b.T()} SELECT level_no, perturbation, {R('avg(accuracy_drop)')} AS mean_drop, {R('stddev_pop(accuracy_drop)')} AS std_drop,
  CAST(count(*) AS BIGINT) AS n FROM tr GROUP BY level_no, perturbation""")
def a15(spark, sf):
    return outcomes(spark, sf).groupBy("level_no", "perturbation").agg(
        r6(F.avg("accuracy_drop")).alias("mean_drop"), r6(sdp0("accuracy_drop")).alias("std_drop"), F.count("*").alias("n"))


@query("a16_directional_summary", f"""{b.T()} SELECT perturbation, {R('coalesce(avg(loglik_drift) FILTER (WHERE loglik_drift > 0), 0)')} AS mean_erosion,
  {R('coalesce(avg(loglik_drift) FILTER (WHERE loglik_drift < 0), 0)')} AS mean_recovery, {R('coalesce(avg(abs(loglik_drift)), 0)')} AS mean_volatility
FROM tr GROUP BY perturbation""")
def a16(spark, sf):
    return rounded(outcomes(spark, sf).groupBy("perturbation").agg(*ag.directional()), "mean_erosion", "mean_recovery", "mean_volatility")


@query("a17_extraction_coverage", f"""SELECT event_type, CAST(count(*) FILTER (WHERE user_id % 3 <> 0) AS BIGINT) AS requested,
  CAST(count(*) FILTER (WHERE user_id % 3 <> 0 AND value > 5) AS BIGINT) AS extracted,
  {R(DIV0('count(*) FILTER (WHERE user_id % 3 <> 0 AND value > 5)', 'count(*) FILTER (WHERE user_id % 3 <> 0)'))} AS rate FROM events GROUP BY event_type""")
def a17(spark, sf):
    req = F.col("user_id") % 3 != 0
    return b.table(spark, sf, "events").groupBy("event_type").agg(
        F.count_if(req).alias("requested"), F.count_if(req & (F.col("value") > 5)).alias("extracted")).withColumn(
        "rate", r6(div0("extracted", "requested")))


_SC, _MT = ("csem", "cprompt", "hopt"), ("accuracy_drop", "loglik_drift", "volatility")


@query("a18_summary_by_score", b.T() + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS score_name, {R(s)} AS score, '{m}' AS metric, {R(f'avg({m})')} AS mean, {R(f'stddev_pop({m})')} AS std, CAST(count(*) AS BIGINT) AS n FROM tr GROUP BY {s}"
    for s in _SC for m in _MT))
def a18(spark, sf):
    return rounded(ag.summarize_by_score(outcomes(spark, sf), _SC, _MT), "score", "mean", "std")


_GP = f"""{b.PAIRS()}, g AS (SELECT item_id, level_no, family, avg(predicted) AS predicted, avg(predicted_quadratic) AS predicted_quadratic,
  avg(csem) AS csem, avg(cprompt) AS cprompt, avg(accuracy_drop) AS accuracy_drop, avg(loglik_drift) AS loglik_drift, avg(volatility) AS volatility, avg(erosion) AS erosion,
  avg(clean_correct) AS clean_accuracy, avg(pert_correct) AS perturbed_accuracy,
  CAST(sum((clean_correct = 1 AND pert_correct = 0)::INT) AS BIGINT) AS ci_count, CAST(sum((clean_correct = 0 AND pert_correct = 1)::INT) AS BIGINT) AS ic_count,
  CAST(count(*) AS BIGINT) AS n, avg(clean_correct - pert_correct) AS net_drop, avg(hopt) AS hopt, avg(is_binary) AS is_binary FROM pairs GROUP BY 1, 2, 3)"""
_GM = ("predicted", "predicted_quadratic", "csem", "cprompt", "hopt", "is_binary", "accuracy_drop", "loglik_drift", "volatility", "erosion")


def grouped(spark, sf, *extra):
    return ag.grouped_pairs(b.pairs(spark, sf, *extra), ["item_id", "level_no", "family"], _GM, b.table(spark, sf, "lineitem").count())


def grouped_by_item(spark, sf):
    """`grouped` with all groups of an item in one task, for what folds them by item: rows move once, and an item's rows to one task."""
    p = b.pairs(spark, sf, item_tasks=ag.group_tasks(spark, b.table(spark, sf, "lineitem").count()))
    return ag.grouped_pairs(p, ["item_id", "level_no", "family"], _GM, dealt=True)


@query("a19_grouped_pairs", f"{_GP} SELECT item_id, level_no, family, " + ", ".join(
    f"{R(c)} AS {c}" for c in (*_GM, "clean_accuracy", "perturbed_accuracy")) + ", n FROM g")
def a19(spark, sf):
    g = grouped(spark, sf).drop("ci_count", "ic_count", "net_drop", "relative_drop")
    return rounded(g, *_GM, "clean_accuracy", "perturbed_accuracy")


@query("a20_net_change", f"""{_GP} SELECT item_id, level_no, family, ci_count, ic_count, {R('net_drop')} AS net_drop,
  {R('CASE WHEN clean_accuracy > 1e-8 THEN net_drop / clean_accuracy END')} AS relative_drop FROM g""")
def a20(spark, sf):
    return rounded(grouped(spark, sf).select("item_id", "level_no", "family", "ci_count", "ic_count", "net_drop", "relative_drop"),
                   "net_drop", "relative_drop")


def CI(v, p):
    return (f"CAST(count({v}) AS BIGINT) AS n, {R(f'avg({v})')} AS mean_{p}, {R(f'quantile_cont(CAST({v} AS DOUBLE), 0.5)')} AS median_{p}, "
            f"{R(f'coalesce(stddev_samp({v}), 0)')} AS std_{p}, {R(f'1.96 * coalesce(stddev_samp({v}), 0) / sqrt(count({v}))')} AS ci95_{p}")


@query("a28_mean_ci", f"{b.T()} SELECT family, level_no, {CI('volatility', 'volatility')} FROM tr GROUP BY family, level_no")
def a28(spark, sf):
    out = ag.mean_ci(outcomes(spark, sf), ["family", "level_no"], "volatility", "volatility")
    return rounded(out, *[c for c in out.columns if c.endswith("_volatility")])


_SIG = b.PAIRS() + """, ft AS (SELECT *, list_transform(d, lambda x: x / greatest(list_sum(d), 1e-12)) AS p, list_sum(d) AS tot FROM pairs),
f2 AS (SELECT *, list_sum(p[1:3]) AS lo, list_sum(p[4:6]) AS mi, list_sum(p[7:8]) AS hi,
  -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(8) AS ent FROM ft),
sg AS (SELECT *, CASE WHEN tot <= 1e-12 THEN 'broadband'
  WHEN ent >= 0.86 AND greatest(lo, mi, hi) - (lo + mi + hi - greatest(lo, mi, hi) - least(lo, mi, hi)) < 0.12 THEN 'broadband'
  WHEN lo = greatest(lo, mi, hi) THEN 'low' WHEN mi = greatest(lo, mi, hi) THEN 'mid' ELSE 'high' END AS delta_signature,
  list_transform(w, lambda x: x) AS w2 FROM f2),
sw AS (SELECT *, list_sum(w[1:3]) AS wl, list_sum(w[4:6]) AS wm, list_sum(w[7:8]) AS wh,
  -list_sum(list_transform(w, lambda x: x * ln(greatest(x, 1e-12)))) / ln(8) AS went FROM sg),
sig AS (SELECT *, CASE WHEN went >= 0.86 AND greatest(wl, wm, wh) - (wl + wm + wh - greatest(wl, wm, wh) - least(wl, wm, wh)) < 0.12
  THEN 'broadband' ELSE 'narrow' END AS filter_signature FROM sw)"""


def signature_rows(spark, sf):
    """Trials with the label of their delta and of their filter. A filter is labelled once, before it meets its trials."""
    from ..functions.arrays import band_overlap, spectral_features, with_band_signature
    from ..operators.joins import with_filters

    def labelled(filters):
        kind = F.when(spectral_features("w")["signature"] == "broadband", "broadband").otherwise("narrow")
        return filters.withColumn("w", F.when(F.col("w").isNotNull(), F.struct("w", kind.alias("kind"))))
    own, level = b.filter_tables(spark, sf)
    # the delta is labelled below the join: labels and overlap in one step make a method too large for the JVM to compile
    t = outcomes(spark, sf, "d").select("item_id", "level_no", "family", "volatility", "erosion", "d")
    p = with_filters(with_band_signature(t, "d", "delta_signature", b.BANDS), labelled(own), labelled(level))
    return p.select("family", band_overlap(F.col("w.w"), "d", b.BANDS).alias("predicted"), "volatility", "erosion", "delta_signature", F.col("w.kind").alias("filter_signature"))


@query("a29_signature_matrix", f"""{_SIG} SELECT delta_signature, filter_signature, {CI('volatility', 'volatility')},
  {CI('erosion', 'erosion').split(', ', 1)[1]}, {R(CORR('predicted', 'volatility', 3, 'NULL'))} AS r_volatility, {R(CORR('predicted', 'erosion', 3, 'NULL'))} AS r_erosion
FROM sig GROUP BY 1, 2""")
def a29(spark, sf):
    # moments and medians read these rows several times: label them once, keep six narrow columns
    out = ag.signature_matrix(materialize(spark, signature_rows(spark, sf), "signatures"), ["delta_signature", "filter_signature"])
    return rounded(out, *[c for c in out.columns if c not in ("delta_signature", "filter_signature", "n")])


@query("a58_signature_share", f"""{_SIG}, c AS (SELECT family, delta_signature, count(*) AS k FROM sig GROUP BY 1, 2),
t AS (SELECT family, sum(k) AS n FROM c GROUP BY 1)
SELECT family, delta_signature, CAST(k AS BIGINT) AS k, {R('k / n')} AS share,
  delta_signature = (SELECT x.delta_signature FROM c x WHERE x.family = c.family ORDER BY x.k DESC, x.delta_signature DESC LIMIT 1) AS dominant
FROM c JOIN t USING (family)""")
def a58(spark, sf):
    c = materialize(spark, signature_rows(spark, sf).groupBy("family", "delta_signature").agg(F.count("*").alias("k")), "shares")
    t = c.groupBy("family").agg(F.sum("k").alias("n"), F.max(F.struct("k", "delta_signature")).alias("top"))
    return c.join(t, "family").select("family", "delta_signature", "k", r6(F.col("k") / F.col("n")).alias("share"),
                                      (F.col("delta_signature") == F.col("top.delta_signature")).alias("dominant"))


@query("a32_overlap_per_severity", f"""{b.PAIRS()}, g AS (SELECT severity, item_id, level_no, family, avg(predicted) AS p, avg(volatility) AS v FROM pairs GROUP BY 1, 2, 3, 4)
SELECT severity, CAST(count(*) AS BIGINT) AS n, {R(CORR('p', 'v'))} AS r FROM g GROUP BY severity""")
def a32(spark, sf):
    g = b.pairs(spark, sf).groupBy("severity", "item_id", "level_no", "family").agg(
        F.avg("predicted").alias("p"), F.avg("volatility").alias("v"))
    return g.groupBy("severity").agg(F.count("*").alias("n"), r6(safe_corr("p", "v")).alias("r"))


_MIR = """cell AS (SELECT item_id, level_no, avg(volatility) AS v, avg(clean_correct) AS c FROM tr GROUP BY 1, 2),
mir AS (SELECT x.item_id, x.level_no AS rung, x.v AS base_v, x.c AS base_c, y.v AS wordy_v, y.c AS wordy_c
  FROM cell x JOIN cell y ON x.item_id = y.item_id AND y.level_no = x.level_no + 4 WHERE x.level_no <= 4)"""


@query("a33_baseline_audit", f"""{b.T()}, {_MIR} SELECT rung, CAST(count(*) AS BIGINT) AS n, {R('avg((wordy_v > base_v)::INT)')} AS frac_higher,
  {R('avg((wordy_v < base_v)::INT)')} AS frac_smaller, {R('avg((base_c >= 0.95)::INT)')} AS frac_ceiling, {R('avg(wordy_c - wordy_v)')} AS end_state
FROM mir GROUP BY rung""")
def a33(spark, sf):
    from ..operators.joins import mirror_cells
    m = mirror_cells(outcomes(spark, sf), ["volatility", "clean_correct"])
    hi = F.col("wordy_volatility") > F.col("base_volatility")
    lo = F.col("wordy_volatility") < F.col("base_volatility")
    return m.groupBy("rung").agg(
        F.count("*").alias("n"), r6(F.avg(hi.cast("double"))).alias("frac_higher"), r6(F.avg(lo.cast("double"))).alias("frac_smaller"),
        r6(F.avg((F.col("base_clean_correct") >= 0.95).cast("double"))).alias("frac_ceiling"),
        r6(F.avg(F.col("wordy_clean_correct") - F.col("wordy_volatility"))).alias("end_state"))


_MS = f"WITH {b.METRIC_SQL}, ms AS (SELECT model, metric, perturb, severity, avg(value) AS mean, count(value) AS n FROM obs GROUP BY 1, 2, 3, 4)"
_FAM = "CASE WHEN perturb IN ('2-HIGH', '3-MEDIUM') THEN 'lowfreq' ELSE 'highfreq' END"


def metric_means(spark, sf):
    return ag.metric_summary(b.metric_obs(spark, sf), "model", "metric", "perturb", "severity")


@query("a34_metric_summary", f"{_MS} SELECT model, metric, perturb, severity, {R('mean')} AS mean, CAST(n AS BIGINT) AS count FROM ms")
def a34(spark, sf):
    return rounded(metric_means(spark, sf), "mean")


_DROP = _MS + """, dr AS (SELECT m.model, m.metric, m.perturb, m.severity, b.mean - m.mean AS d, m.n FROM ms m
  JOIN ms b ON b.model = m.model AND b.metric = m.metric AND b.perturb = 'Base' AND b.severity = 0 WHERE NOT (m.perturb = 'Base' AND m.severity = 0))"""


@query("a35_drop_by_family", f"{_DROP} SELECT model, metric, {_FAM} AS family, severity, {R('avg(d)')} AS mean_drop FROM dr GROUP BY 1, 2, 3, 4")
def a35(spark, sf):
    from ..operators.joins import relative_to_base
    d = relative_to_base(metric_means(spark, sf)).withColumn("family", F.expr(_FAM))
    return d.groupBy("model", "metric", "family", "severity").agg(r6(F.avg("drop")).alias("mean_drop"))


@query("a36_segmentation_levels", f"""WITH m AS (SELECT o_orderstatus AS model, CAST(o_custkey % 3 + 1 AS INT) AS level_no, (o_totalprice % 1000) / 1000 AS clean_iou,
  ((o_totalprice * 7) % 1000) / 1000 AS pert_iou FROM orders)
SELECT model, level_no, {R('avg(clean_iou - pert_iou)')} AS mean_drop, {R('stddev_pop(clean_iou - pert_iou)')} AS std_drop, {R('avg(clean_iou)')} AS mean_clean,
  {R('stddev_pop(clean_iou)')} AS std_clean, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1, 2""")
def a36(spark, sf):
    m = b.table(spark, sf, "orders").selectExpr(
        "o_orderstatus AS model", "CAST(o_custkey % 3 + 1 AS INT) AS level_no", "(o_totalprice % 1000) / 1000 AS clean_iou",
        "((o_totalprice * 7) % 1000) / 1000 AS pert_iou").withColumn("d", F.col("clean_iou") - F.col("pert_iou"))
    return m.groupBy("model", "level_no").agg(
        r6(mean0("d")).alias("mean_drop"), r6(sdp0("d")).alias("std_drop"), r6(mean0("clean_iou")).alias("mean_clean"),
        r6(sdp0("clean_iou")).alias("std_clean"), F.count("*").alias("n"))


_ATT = "mode, severity AS eps, changed, clean_correct = 1 AND changed AS success, volatility AS fidelity"


@query("a37_attack_summary", f"""{b.T('mode')}, a AS (SELECT {_ATT} FROM tr)
SELECT mode, eps, CAST(count(*) AS BIGINT) AS n, {R('avg(success::INT)')} AS success_rate, {R('avg(changed::INT)')} AS flip_rate, {R('avg(fidelity)')} AS mean_fidelity
FROM a GROUP BY GROUPING SETS ((mode, eps), (mode))""")
def a37(spark, sf):
    a = outcomes(spark, sf, "mode").selectExpr(*_ATT.split(", "))
    return a.groupingSets([["mode", "eps"], ["mode"]], "mode", "eps").agg(
        F.count("*").alias("n"), r6(F.avg(F.col("success").cast("double"))).alias("success_rate"),
        r6(F.avg(F.col("changed").cast("double"))).alias("flip_rate"), r6(F.avg("fidelity")).alias("mean_fidelity"))


_FT = """ft AS (SELECT mode, order_id, min(cutoff) FILTER (WHERE changed) AS t FROM tr GROUP BY 1, 2)"""


@query("a38_ablation_summary", f"""{b.T('mode', 'cutoff', 'order_id')}, {_FT}, th AS (SELECT mode, avg(t) AS m, quantile_cont(t, 0.5) AS md FROM ft GROUP BY mode)
SELECT tr.mode, cutoff, CAST(sum(changed::INT) AS BIGINT) AS flips, CAST(count(*) AS BIGINT) AS total, {R('avg(changed::INT)')} AS rate, {R('any_value(m)')} AS mean_threshold, {R('any_value(md)')} AS median_threshold
FROM tr JOIN th ON th.mode = tr.mode GROUP BY tr.mode, cutoff""")
def a38(spark, sf):
    from ..operators.windows import flip_threshold
    t = outcomes(spark, sf, "mode", "cutoff", "order_id")
    th = flip_threshold(t, ["mode", "order_id"]).groupBy("mode").agg(
        r6(F.avg("threshold")).alias("mean_threshold"), r6(F.percentile("threshold", F.lit(0.5))).alias("median_threshold"))   # a handful of distinct cutoffs
    return t.groupBy("mode", "cutoff").agg(
        F.sum(F.col("changed").cast("long")).alias("flips"), F.count("*").alias("total"),
        r6(F.avg(F.col("changed").cast("double"))).alias("rate")).join(th, "mode")


@query("a39_random_noise", f"""{b.T('mode')}, i AS (SELECT item_id, mode, severity, avg(changed::INT) AS fr, avg(loglik_drift) AS m, stddev_pop(loglik_drift) AS s FROM tr GROUP BY 1, 2, 3)
SELECT mode, severity AS eps, CAST(count(*) AS BIGINT) AS items, {R('avg(fr)')} AS flip_rate, {R('avg(m)')} AS margin_mean, {R('avg(s)')} AS margin_std FROM i GROUP BY 1, 2""")
def a39(spark, sf):
    i = outcomes(spark, sf, "mode").groupBy("item_id", "mode", F.col("severity").alias("eps")).agg(
        F.avg(F.col("changed").cast("double")).alias("fr"), F.avg("loglik_drift").alias("m"), sdp0("loglik_drift").alias("s"))
    return i.groupBy("mode", "eps").agg(F.count("*").alias("items"), r6(F.avg("fr")).alias("flip_rate"),
                                        r6(F.avg("m")).alias("margin_mean"), r6(F.avg("s")).alias("margin_std"))


@query("a41_conditional_shares", f"""{b.T()}, c AS (SELECT family, {_TRANS} FROM tr GROUP BY family)
SELECT *, {R(f"100 * {DIV0('r2w', 'r2w + r2r')}")} AS r2w_pct, {R(f"100 * {DIV0('r2r', 'r2w + r2r')}")} AS r2r_pct,
  {R(f"100 * {DIV0('w2r', 'w2r + w2w')}")} AS w2r_pct, {R(f"100 * {DIV0('w2w', 'w2r + w2w')}")} AS w2w_pct FROM c""")
def a41(spark, sf):
    return rounded(ag.conditional_shares(ag.transitions(outcomes(spark, sf), "family")), "r2w_pct", "r2r_pct", "w2r_pct", "w2w_pct")


@query("a42_run_overview", f"""{b.T('supp_id')}, l AS (SELECT supp_id % 10 AS run_id, level_no, avg(clean_correct) AS c, avg(pert_correct) AS p, count(*) AS n FROM tr GROUP BY 1, 2)
SELECT run_id, {R('avg(c)')} AS mean_clean, {R('avg(p)')} AS mean_perturbed, CAST(max(n) AS BIGINT) AS max_n FROM l GROUP BY run_id""")
def a42(spark, sf):
    lv = outcomes(spark, sf, "supp_id").groupBy((F.col("supp_id") % 10).alias("run_id"), "level_no").agg(
        F.avg("clean_correct").alias("c"), F.avg("pert_correct").alias("p"), F.count("*").alias("n"))
    return lv.groupBy("run_id").agg(r6(F.avg("c")).alias("mean_clean"), r6(F.avg("p")).alias("mean_perturbed"), F.max("n").alias("max_n"))


@query("a43_grid_tally", """SELECT coalesce(CASE WHEN vec_id % 4 <> 0 THEN concat(8, 'x', 8 - vec_id % 2) END, '(none)') AS grid, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE label % 3 = 0) AS BIGINT) AS missing_filters FROM embeddings GROUP BY 1""")
def a43(spark, sf):
    g = F.expr("CASE WHEN vec_id % 4 <> 0 THEN concat(8, 'x', 8 - vec_id % 2) END")
    return b.table(spark, sf, "embeddings").groupBy(F.coalesce(g, F.lit("(none)")).alias("grid")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") % 3 == 0).alias("missing_filters"))


@query("a44_pipeline_coverage", """WITH f AS (SELECT user_id, max((event_type = 'click')::INT) AS has_click, max((event_type = 'view')::INT) AS has_view,
  max((event_type = 'error')::INT) AS has_error FROM events GROUP BY user_id)
SELECT has_click, has_view, has_error, CAST(count(*) AS BIGINT) AS items FROM f GROUP BY ALL""")
def a44(spark, sf):
    return ag.coverage_flags(b.table(spark, sf, "events"), "user_id", "event_type", ["click", "view", "error"])


@query("a45_metric_partition", f"""WITH m AS (SELECT concat(CASE o_custkey % 4 WHEN 0 THEN 'conditional_' WHEN 1 THEN 'vl_alignment_' WHEN 2 THEN 'visual_' ELSE 'box_' END, lower(o_orderstatus)) AS metric,
  o_totalprice / 1e5 AS value FROM orders)
SELECT CASE WHEN metric LIKE 'conditional!_%' ESCAPE '!' THEN 'conditional' WHEN metric LIKE 'vl!_alignment%' ESCAPE '!' THEN 'alignment' WHEN metric LIKE 'visual!_%' ESCAPE '!' THEN 'visual' ELSE 'box' END AS class,
  metric, CAST(count(*) AS BIGINT) AS n, {R('avg(value)')} AS mean FROM m GROUP BY 1, 2""")
def a45(spark, sf):
    m = b.table(spark, sf, "orders").selectExpr(
        "concat(CASE o_custkey % 4 WHEN 0 THEN 'conditional_' WHEN 1 THEN 'vl_alignment_' WHEN 2 THEN 'visual_' ELSE 'box_' END, lower(o_orderstatus)) AS metric",
        "o_totalprice / 1e5D AS value")
    c = F.col("metric")
    cls = (F.when(c.startswith("conditional_"), "conditional").when(c.startswith("vl_alignment"), "alignment")
           .when(c.startswith("visual_"), "visual").otherwise("box"))
    return m.groupBy(cls.alias("class"), "metric").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("a46_mirror_variance_ratio", f"""{b.T()}, s AS (SELECT level_no, stddev_pop(loglik_drift) AS sd FROM tr GROUP BY level_no)
SELECT x.level_no AS rung, {R('x.sd')} AS base_std, {R('y.sd')} AS wordy_std, {R('y.sd * y.sd / (x.sd * x.sd)')} AS ratio
FROM s x JOIN s y ON y.level_no = x.level_no + 4 WHERE x.level_no <= 4 AND x.sd > 0""")
def a46(spark, sf):
    return rounded(ag.std_ratio(ag.level_summary(outcomes(spark, sf))), "base_std", "wordy_std", "ratio")


@query("a48_family_level_matrix", f"{_GP} SELECT family, " + ", ".join(
    f"{R(f'avg(predicted) FILTER (WHERE level_no = {i})')} AS l{i}" for i in range(1, 9)) + " FROM g GROUP BY family")
def a48(spark, sf):
    m = grouped(spark, sf).groupBy("family").pivot("level_no", list(range(1, 9))).agg(F.avg("predicted"))
    return m.select("family", *[r6(f"`{i}`").alias(f"l{i}") for i in range(1, 9)])


@query("a50_row_counts", f"""{b.T()} SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(clean_correct) AS BIGINT) AS clean_correct_rows, CAST(count(DISTINCT item_id) AS BIGINT) AS items,
  CAST(count(DISTINCT perturbation) AS BIGINT) AS perturbations, CAST(count(DISTINCT level_no) AS BIGINT) AS levels FROM tr""")
def a50(spark, sf):
    cell = b.trials(spark, sf).groupBy("item_id", "perturbation", "level_no").agg(
        F.count("*").alias("n"), F.sum("clean_correct").alias("c"))
    return cell.agg(F.sum("n").alias("total"), F.sum("c").alias("clean_correct_rows"), F.count_distinct("item_id").alias("items"),
                    F.count_distinct("perturbation").alias("perturbations"), F.count_distinct("level_no").alias("levels"))


@query("a55_heatmap_matrices", f"{b.T()} SELECT perturbation, " + ", ".join(
    f"{R(f'avg(accuracy_drop) FILTER (WHERE level_no = {i})')} AS l{i}" for i in range(1, 9)) + " FROM tr GROUP BY perturbation")
def a55(spark, sf):
    m = outcomes(spark, sf).groupBy("perturbation").pivot("level_no", list(range(1, 9))).agg(F.avg("accuracy_drop"))
    return m.select("perturbation", *[r6(f"`{i}`").alias(f"l{i}") for i in range(1, 9)])


@query("a56_family_points", f"""WITH {b.RECORDS_SQL} SELECT item_id, level_no, family, {R('avg(accuracy_drop)')} AS mean_drop, {R('avg(coalesce(loglik_drift, 0))')} AS mean_drift,
  {R('avg(greatest(coalesce(loglik_drift, 0), 0))')} AS mean_erosion, {R('avg(least(coalesce(loglik_drift, 0), 0))')} AS mean_recovery, {R('avg(abs(coalesce(loglik_drift, 0)))')} AS mean_volatility FROM rp GROUP BY 1, 2, 3""")
def a56(spark, sf):
    rows = tr.flatten_records(b.records(spark, sf), drop_null_drift=False)
    d = F.col("loglik_drift")
    return rows.groupBy("item_id", "level_no", "family").agg(
        r6(F.avg("accuracy_drop")).alias("mean_drop"), r6(F.avg(d)).alias("mean_drift"), r6(F.avg(F.greatest(d, F.lit(0.0)))).alias("mean_erosion"),
        r6(F.avg(F.least(d, F.lit(0.0)))).alias("mean_recovery"), r6(F.avg(F.abs(d))).alias("mean_volatility"))


@query("a57_worst_perturbation", f"""{b.T('order_id', 'line_no')}, w AS (SELECT *, row_number() OVER (PARTITION BY order_id, level_no ORDER BY volatility DESC, line_no, loglik_drift DESC, perturbation) AS rn FROM tr)
SELECT order_id, level_no, max(perturbation) FILTER (WHERE rn = 1) AS worst, {R('max(loglik_drift) FILTER (WHERE rn = 1)')} AS worst_drift, {R('quantile_cont(volatility, 0.5)')} AS median_volatility,
  {R('max(volatility)')} AS max_volatility, coalesce(string_agg(perturbation, ',' ORDER BY line_no, perturbation) FILTER (WHERE accuracy_drop > 0), '') AS dropping FROM w GROUP BY 1, 2""")
def a57(spark, sf):
    t = outcomes(spark, sf, "order_id", "line_no")
    cell = t.groupBy("order_id", "level_no").agg(
        F.max(F.struct("volatility", (-F.col("line_no")).alias("k"), "loglik_drift")).alias("top"),
        r6(F.percentile("volatility", F.lit(0.5))).alias("median_volatility"), r6(F.max("volatility")).alias("max_volatility"),
        # the trials of one card (an order's level) are a handful of rows by the shape of the input
        F.array_sort(F.collect_list(F.when(F.col("accuracy_drop") > 0, F.struct("line_no", "perturbation")))).alias("drops"),
        F.min(F.struct((-F.col("volatility")).alias("v"), "line_no", (-F.col("loglik_drift")).alias("dr"), "perturbation")).alias("first"))
    return cell.select("order_id", "level_no", F.col("first.perturbation").alias("worst"), r6(-F.col("first.dr")).alias("worst_drift"),
                       "median_volatility", "max_volatility", F.array_join(F.transform("drops", lambda s: s["perturbation"]), ",").alias("dropping"))


@query("a59_item_cards", f"{b.T()} SELECT item_id, " + ", ".join(
    f"CAST(coalesce(sum(accuracy_drop) FILTER (WHERE level_no = {i}), 0) AS BIGINT) AS drops_l{i}, {R(f'coalesce(avg(volatility) FILTER (WHERE level_no = {i}), 0)')} AS volatility_l{i}"
    for i in range(1, 9)) + " FROM tr GROUP BY item_id")
def a59(spark, sf):
    aggs = []
    for i in range(1, 9):
        here = F.col("level_no") == i
        aggs += [F.count_if(here & (F.col("accuracy_drop") > 0)).alias(f"drops_l{i}"),
                 r6(mean0(F.when(here, F.col("volatility")))).alias(f"volatility_l{i}")]
    return outcomes(spark, sf).groupBy("item_id").agg(*aggs)


@query("a60_first_pair_matrix", f"{_GP}, f AS (SELECT family, level_no, arg_min(predicted, item_id) AS p FROM g GROUP BY 1, 2) SELECT family, " + ", ".join(
    f"{R(f'max(p) FILTER (WHERE level_no = {i})')} AS l{i}" for i in range(1, 9)) + " FROM f GROUP BY family")
def a60(spark, sf):
    first = grouped(spark, sf).groupBy("family", "level_no").agg(F.min(F.struct("item_id", "predicted")).alias("f"))
    m = first.groupBy("family").pivot("level_no", list(range(1, 9))).agg(F.first("f.predicted"))
    return m.select("family", *[r6(f"`{i}`").alias(f"l{i}") for i in range(1, 9)])


@query("t05_cohens_d", f"""WITH s AS (SELECT source, quality, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT x.source, CAST(x.n AS BIGINT) AS n_good, CAST(y.n AS BIGINT) AS n_bad, {R('CASE WHEN x.n >= 2 AND y.n >= 2 AND ((x.n-1)*x.v + (y.n-1)*y.v) > 0 THEN (x.m - y.m) / sqrt(((x.n-1)*x.v + (y.n-1)*y.v) / (x.n + y.n - 2)) ELSE 0 END')} AS d
FROM s x JOIN s y ON x.source = y.source AND x.quality = 1 AND y.quality = 0""")
def t05(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(b.table(spark, sf, "labels"), "doc_id")
    aggs = []
    for lab, q in (("good", 1), ("bad", 0)):
        x = F.when(F.col("quality") == q, F.col("n_chars").cast("double"))
        aggs += [F.count(x).alias(f"n_{lab}"), F.avg(x).alias(f"m_{lab}"), F.var_samp(x).alias(f"v_{lab}")]
    g = d.groupBy("source").agg(*aggs).where("n_good > 0 AND n_bad > 0")
    return g.select("source", "n_good", "n_bad", r6(cohens_d("n_good", "m_good", "v_good", "n_bad", "m_bad", "v_bad")).alias("d"))
