"""Group aggregates. Each is one shuffle with map-side partials; where item counts matter the rows are
first folded to (item, group), so that distinct counts become plain counts."""
from pyspark.sql import functions as F

from ..functions.numeric import div0, mean0, safe_corr, sd0, sdp0
from .windows import exact_quantiles

ANY = "Any"


def flip_rates(trials, key="perturbation", item="item_id"):
    """AVg = flips / instances, Ve = items with a flip / items used, per key and as an 'Any' row.

    A missing prediction (null `changed`) counts as an instance but never as a flip. Facts are folded
    once to (item, key); the 'Any' row folds that table again, so no distinct expansion of the facts.
    """
    cell = trials.groupBy(item, key).agg(
        F.sum(F.coalesce(F.col("changed"), F.lit(False)).cast("long")).alias("c"), F.count("*").alias("n"))
    per_item = cell.groupBy(item).agg(F.sum("c").alias("c"), F.sum("n").alias("n"))

    def close(df, *keys):
        return df.groupBy(*keys).agg(F.sum("c").alias("changed"), F.sum("n").alias("instances"),
                                     F.count_if(F.col("c") > 0).alias("items_affected"))
    used = per_item.agg(F.count("*").alias("n_used")).select("n_used").scalar()
    out = close(cell, key).unionByName(close(per_item).withColumn(key, F.lit(ANY)))
    return out.select(key, "changed", "instances", "items_affected",
                      div0("changed", "instances").alias("avg_rate"),
                      div0(F.col("items_affected"), used).alias("ve_rate"))


def transitions(trials, *keys):
    """R->W, W->R, R->R, W->W counts over rows where both the truth and the prediction are known."""
    c, p = F.col("clean_correct") == 1, F.col("pert_correct") == 1
    known = trials.where(c.isNotNull() & p.isNotNull())
    return known.groupBy(*keys).agg(
        F.count_if(c & ~p).alias("r2w"), F.count_if(~c & p).alias("w2r"),
        F.count_if(c & p).alias("r2r"), F.count_if(~c & ~p).alias("w2w"))


def binary_metrics(df, pred, truth, *keys):
    """Accuracy, precision, recall, F1, FPR and yes-rate; 0/0 is 0."""
    p, t = F.col(pred), F.col(truth)
    g = df.groupBy(*keys).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return (g.withColumn("accuracy", div0(F.col("tp") + F.col("tn"), n))
            .withColumn("precision", div0("tp", F.col("tp") + F.col("fp")))
            .withColumn("recall", div0("tp", F.col("tp") + F.col("fn")))
            .withColumn("f1", div0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .withColumn("fpr", div0("fp", F.col("fp") + F.col("tn")))
            .withColumn("yes_rate", div0(F.col("tp") + F.col("fp"), n)))


def answer_entropy(answers, item, answer):
    """Shannon entropy (nats) of the answers of each item, from (item, answer) counts; nulls removed."""
    counts = answers.where(F.col(answer).isNotNull()).groupBy(item, answer).agg(F.count("*").alias("k"))
    # sum p*ln(p+eps) needs the total first; both come from the same folded table
    tot = counts.groupBy(item).agg(F.sum("k").alias("n"))
    p = F.col("k") / F.col("n")
    return counts.join(tot, item).groupBy(item).agg((-F.sum(p * F.log(p + F.lit(1e-12)))).alias("entropy"))


def mean_std(df, value, *keys):
    return df.groupBy(*keys).agg(mean0(value).alias("mean"), sd0(value).alias("std"))


def mean_ci_columns(value, prefix):
    """n, mean, sample std and the 1.96*s/sqrt(n) half-width as mergeable aggregate columns."""
    v = F.col(value).cast("double")
    s = F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, F.lit(0.0)))
    return [F.count(v).alias("n"), F.avg(v).alias(f"mean_{prefix}"), s.alias(f"std_{prefix}"),
            (F.lit(1.96) * F.try_divide(s, F.sqrt(F.count(v).cast("double")))).alias(f"ci95_{prefix}")]


def with_medians(summary, df, keys, values):
    """Add the exact median of each value column to a summary keyed by `keys` (one pass for all columns)."""
    pair = F.explode(F.array(*[F.struct(F.lit(p).alias("_p"), F.col(v).cast("double").alias("_v")) for v, p in values.items()]))
    long = df.select(*keys, pair.alias("z")).select(*keys, "z.*")
    med = exact_quantiles(long, "_v", [0.5], [*keys, "_p"])
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("_p") == p, F.col("q0"))).alias(f"median_{p}") for p in values.values()])
    return summary.join(wide, list(keys))


def mean_ci(df, keys, value, prefix):
    """n, mean, exact median, sample std and confidence half-width per group."""
    return with_medians(df.groupBy(*keys).agg(*mean_ci_columns(value, prefix)), df, keys, {value: prefix})


def directional(drift="loglik_drift"):
    """Mean of positive drifts, mean of negative drifts and mean |drift|; 0 when there is none."""
    d = F.col(drift)
    return [mean0(F.when(d > 0, d)).alias("mean_erosion"), mean0(F.when(d < 0, d)).alias("mean_recovery"),
            mean0(F.abs(d)).alias("mean_volatility")]


def level_summary(trials, clean_key=("item_id", "level_no"), level="level_no"):
    """Per-level accuracies, drops, drifts and counts; the clean side counts each cell once."""
    cell = trials.groupBy(*clean_key).agg(
        F.max("clean_correct").alias("clean"), F.count("*").alias("n"), F.sum("pert_correct").alias("s_ok"),
        F.sum("accuracy_drop").alias("s_drop"), F.sum(F.pow("accuracy_drop", F.lit(2))).alias("q_drop"),
        F.sum("loglik_drift").alias("s_dr"), F.sum(F.pow("loglik_drift", F.lit(2))).alias("q_dr"),
        F.sum("erosion").alias("s_pos"), F.count_if(F.col("loglik_drift") > 0).alias("n_pos"),
        F.sum("recovery").alias("s_neg"), F.count_if(F.col("loglik_drift") < 0).alias("n_neg"),
        F.sum("volatility").alias("s_abs"))

    def sd(q, s):
        m = F.sum(s) / F.sum("n")
        return F.sqrt(F.greatest(F.sum(q) / F.sum("n") - m * m, F.lit(0.0)))
    return cell.groupBy(level).agg(
        F.avg("clean").alias("clean_accuracy"), (F.sum("s_ok") / F.sum("n")).alias("perturbed_accuracy"),
        (F.sum("s_drop") / F.sum("n")).alias("mean_drop"), sd("q_drop", "s_drop").alias("std_drop"),
        (F.sum("s_dr") / F.sum("n")).alias("mean_drift"), sd("q_dr", "s_dr").alias("std_drift"),
        div0(F.sum("s_pos"), F.sum("n_pos")).alias("mean_erosion"),
        div0(F.sum("s_neg"), F.sum("n_neg")).alias("mean_recovery"),
        (F.sum("s_abs") / F.sum("n")).alias("mean_volatility"),
        F.count("*").alias("num_samples"), F.sum("n").alias("num_evals"))


GROUP_ROWS = 1_000_000       # rows a task folds to groups


def group_tasks(spark, rows):
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // GROUP_ROWS))


def grouped_pairs(trials, keys, measures, rows=0, dealt=False):
    """Means of the measures per (item, level, family) with right->wrong / wrong->right counts.

    A group has few rows, so rows move as they are: partial aggregates of a whole input split would be held by one task, and save nothing.
    `rows`, their number at most, sets how many tasks share them where Spark's own number would give one task too many. Rows that are `dealt` by a part
    of the keys stay where they are.
    """
    ci = ((F.col("clean_correct") == 1) & (F.col("pert_correct") == 0)).cast("double")
    ic = ((F.col("clean_correct") == 0) & (F.col("pert_correct") == 1)).cast("double")
    rows_by_key = trials if dealt else trials.repartition(group_tasks(trials.sparkSession, rows), *keys)
    g = rows_by_key.groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in measures], F.avg("clean_correct").alias("clean_accuracy"),
        F.avg("pert_correct").alias("perturbed_accuracy"), F.sum(ci).cast("long").alias("ci_count"),
        F.sum(ic).cast("long").alias("ic_count"), F.avg(ci - ic).alias("net_drop"), F.count("*").alias("n"))
    return g.withColumn("relative_drop", F.when(F.col("clean_accuracy") > 1e-8,
                                                F.try_divide("net_drop", "clean_accuracy")))


def summarize_by_score(df, score_cols, metric_cols):
    """Mean, population std and n of every metric by exact value of every score, in one pass."""
    sc = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("score"))
                             for s in score_cols]))
    mt = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                             for m in metric_cols]))
    long = df.select(*metric_cols, sc.alias("s")).select("s.*", mt.alias("m")).select("score_name", "score", "m.*")
    return long.where(F.col("score").isNotNull() & F.col("value").isNotNull()).groupBy(
        "score_name", "score", "metric").agg(F.avg("value").alias("mean"), sdp0("value").alias("std"),
                                             F.count("*").alias("n"))


def conditional_shares(df):
    """r2w and r2r as % of base-right, w2r and w2w as % of base-wrong; 0 where there is no base."""
    right, wrong = F.col("r2w") + F.col("r2r"), F.col("w2r") + F.col("w2w")
    return df.select("*", (100 * div0("r2w", right)).alias("r2w_pct"), (100 * div0("r2r", right)).alias("r2r_pct"),
                     (100 * div0("w2r", wrong)).alias("w2r_pct"), (100 * div0("w2w", wrong)).alias("w2w_pct"))


def metric_summary(obs, *keys):
    return obs.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("count"))


def signature_matrix(rows, keys):
    """Volatility and erosion statistics and overlap correlations per key combination."""
    out = rows.groupBy(*keys).agg(
        *mean_ci_columns("volatility", "volatility"),
        *mean_ci_columns("erosion", "erosion")[1:],
        safe_corr("predicted", "volatility", 3, None).alias("r_volatility"),
        safe_corr("predicted", "erosion", 3, None).alias("r_erosion"))
    return with_medians(out, rows, keys, {"volatility": "volatility", "erosion": "erosion"})


def coverage_flags(df, item, kind, kinds):
    """How many items each combination of pipelines saw: flags per item, then counts per combination."""
    flags = df.groupBy(item).agg(*[F.max((F.col(kind) == k).cast("int")).alias(f"has_{k}") for k in kinds])
    return flags.groupBy(*[f"has_{k}" for k in kinds]).agg(F.count("*").alias("items"))


def std_ratio(summary, level="level_no", offset=4):
    """Variance ratio wordy/base of the drift per rung; rungs without base variance are skipped."""
    rung = (F.col(level) - 1) % offset + 1
    base = F.col(level) <= offset
    g = summary.groupBy(rung.alias("rung")).agg(F.max(F.when(base, F.col("std_drift"))).alias("base_std"),
                                                F.max(F.when(~base, F.col("std_drift"))).alias("wordy_std"))
    return g.where(F.col("base_std") > 0).withColumn("ratio", F.pow("wordy_std", F.lit(2)) / F.pow("base_std", F.lit(2)))


def mean_vector(df, vec, *keys):
    """Element-wise mean of equally long vectors: a sum per position, never a list per group."""
    cells = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # one value per band remains, so the gathered array is as long as the vector itself
    arr = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return means.groupBy(*keys).agg(arr.alias("mean_vec"))
