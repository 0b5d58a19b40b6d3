"""Trial tables: flattening, outcome columns, views and filters (no shuffles unless stated)."""
from pyspark.sql import functions as F

from ..functions.numeric import col, is_finite

# fixed values: level views over the eight-step ladder (terse 1-4, wordy mirrors 5-8)
PRIMARY_LEVELS = (1, 2, 3, 4)
WORDY_LEVELS = (5, 6, 7, 8)
WORDY_LEVELS = (5, 6, 7, 8)
MIRROR_OFFSET = 4


def with_outcomes(trials):
    """Add changed, accuracy_drop and the signed split of the drift."""
    d = F.col("loglik_drift")
    return (trials
            .withColumn("changed", F.col("clean_correct") != F.col("pert_correct"))
            .withColumn("accuracy_drop", ((F.col("clean_correct") == 1) & (F.col("pert_correct") == 0)).cast("double"))
            .withColumn("erosion", F.greatest(d, F.lit(0.0)))
            .withColumn("recovery", F.least(d, F.lit(0.0)))
            .withColumn("volatility", F.abs(d)))


def exploded_levels(records):
    """One row per (record, level). The outer form and a filter on the key: Spark would guard an inner `explode` by filters on the map below it, which
    compute (or parse) the map anew for each."""
    return records.select("rec_id", "rec_no", "item_id", F.explode_outer("levels").alias("level_no", "lv")).where(F.col("level_no").isNotNull())


def flatten_records(records, drop_null_drift=True):
    """Nested records -> one row per (record, level, perturbation), in one narrow pass.

    Rows without a drift are dropped (long table) or get drift 0 (per-perturbation table).
    """
    lv = exploded_levels(records)
    rows = lv.select("rec_id", "rec_no", "item_id", "level_no", "lv.csem", "lv.cprompt", "lv.clean_correct",
                     F.explode("lv.perturbations").alias("p"))
    rows = rows.select("rec_id", "rec_no", "item_id", "level_no", "csem", "cprompt", "clean_correct",
                       F.col("p.name").alias("perturbation"), "p.family", "p.severity", "p.accuracy_drop",
                       "p.loglik_drift")
    if drop_null_drift:
        return rows.where(F.col("loglik_drift").isNotNull())
    return rows.withColumn("loglik_drift", F.coalesce("loglik_drift", F.lit(0.0)))


def complexity_points(records):
    """One row per (record, level) with mean drop and drift; levels without perturbations are dropped.

    The means are array folds inside the row, so nothing is shuffled.
    """
    lv = exploded_levels(records)

    def mean_of(field):
        vals = F.transform("lv.perturbations", lambda p: F.coalesce(p[field], F.lit(0.0)))
        return F.try_divide(F.aggregate(vals, F.lit(0.0), lambda a, x: a + x), F.size(vals))
    return lv.where(F.size("lv.perturbations") > 0).select(
        "rec_id", "rec_no", "item_id", "level_no", "lv.csem", "lv.cprompt", "lv.clean_correct",
        mean_of("accuracy_drop").alias("mean_drop"), mean_of("loglik_drift").alias("mean_drift"))


def level_views(df, level="level_no"):
    """Each row once per view it belongs to: primary or wordy, and always pooled (a narrow explode)."""
    own = F.when(F.col(level).isin(*PRIMARY_LEVELS), F.lit("primary")).otherwise(F.lit("wordy"))
    return df.withColumn("view", F.explode(F.array(own, F.lit("pooled"))))


def clean_correct_only(df):
    return df.where(F.col("clean_correct") == 1)


def is_complete(numeric, keys=()):
    cond = F.lit(True)
    for c in numeric:
        cond = cond & is_finite(F.col(c).cast("double"))
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def complete_cases(df, numeric, keys=()):
    """Rows whose numeric columns are all finite and whose key columns are present."""
    return df.where(is_complete(numeric, keys))


def allow_kinds(df, kinds, kind_col="family"):
    """Keep the listed kinds; an empty list keeps all."""
    return df.where(F.lower(kind_col).isin([k.lower() for k in kinds])) if kinds else df


def complete_ladder(df, required, item="item_id", level="level_no"):
    """Rows of the items that have every required level: one partial aggregate and a semi join."""
    full = (df.where(F.col(level).isin(*required)).groupBy(item, level).agg(F.lit(1).alias("one"))
            .groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") == len(set(required))).select(item))
    return df.join(full, item, "left_semi")


def keep_flipped_items(df, flips, item="item_id"):
    """Drop rows of items without any flip (semi join on the distinct flipped items)."""
    return df.join(flips.where(F.coalesce("changed", F.lit(False))).select(item).distinct(), item, "left_semi")


def unpivot_targets(df, keys):
    """Long (target, value) rows for the chosen outcomes; missing or non-finite values are dropped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), F.col(k).cast("double").alias("value"))
                                for k in keys]))
    rest = [c for c in df.columns if c not in keys]
    out = df.select(*rest, pairs.alias("_p")).select(*rest, "_p.target", "_p.value")
    return out.where(is_finite("value"))


def drop_marked_columns(df, *markers):
    """Project away the columns whose name holds one of the markers."""
    return df.select(*[c for c in df.columns if not any(m in c for m in markers)])


def predictor_names(columns, base=("csem", "cprompt", "hopt")):
    """Aggregate giving the design columns of a slice: `is_binary` and `prediction_entropy` only where they vary / exist."""
    names = [F.lit(c) for c in base]
    if "is_binary" in columns:
        names.append(F.when((F.min("is_binary") == 0) & (F.max("is_binary") == 1), F.lit("is_binary")))
    if "prediction_entropy" in columns:
        names.append(F.when(F.count("prediction_entropy") > 0, F.lit("prediction_entropy")))
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def predictor_list(df, base=("csem", "cprompt", "hopt")):
    """The design columns of one slice as a Python list; one aggregate row reaches the driver."""
    return list(df.agg(predictor_names(df.columns, base).alias("p")).first()["p"])


def spectrum_sources(df, spaces=("image", "vision")):
    """Unpivot raw and relative spectra of each space, relative preferred and raw as fallback."""
    def non_empty(c):
        return F.when(F.size(c) > 0, F.col(c))
    rows = F.explode(F.array(*[F.struct(
        F.lit(s).alias("space"),
        F.coalesce(non_empty(f"{s}_relative"), non_empty(f"{s}_raw")).alias("delta"),
        F.when(non_empty(f"{s}_relative").isNotNull(), F.lit("relative")).otherwise(F.lit("raw"))
        .alias("normalization")) for s in spaces]))
    drop = {f"{s}_{k}" for s in spaces for k in ("raw", "relative")}
    rest = [c for c in df.columns if c not in drop]
    return df.select(*rest, rows.alias("_s")).select(*rest, "_s.*").where(F.col("delta").isNotNull())


def valid_mirror_pairs(questions, min_valid=0.99):
    """Terse/wordy pairs per (item, rung) with the validity rule, kept only for rungs above the rate.

    `questions`: item_id, level_no, question, answer_label, options, csem, cprompt. Both sides are merged, never broadcast: Spark's size estimate does
    not see the rows that an `explode` by level adds.
    """
    b, w = questions.alias("b"), questions.alias("w")
    joined = b.where(F.col("level_no") <= MIRROR_OFFSET).join(
        w.hint("merge"), (F.col("b.item_id") == F.col("w.item_id")) & (F.col("w.level_no") == F.col("b.level_no") + MIRROR_OFFSET))
    valid = ((F.col("b.answer_label") == F.col("w.answer_label")) & (F.col("b.options") == F.col("w.options"))
             & (F.abs(F.col("b.csem") - F.col("w.csem")) <= 1e-9) & (F.col("w.cprompt") > F.col("b.cprompt"))
             & (F.length(F.trim("b.question")) > 0)
             & F.contains(F.trim("w.question"), F.trim("b.question")))
    pairs = joined.select(F.col("b.item_id").alias("item_id"), F.col("b.level_no").alias("base_level"),
                          valid.alias("valid"))
    rates = pairs.groupBy("base_level").agg(F.avg(F.col("valid").cast("double")).alias("valid_rate"))
    good = rates.where(F.col("valid_rate") >= min_valid)
    return pairs.join(F.broadcast(good), "base_level")  # at most one row per rung of the ladder


def export_trials(trials, examples, keys=("rec_id", "perturbation")):
    """Wide flat export: a left join of the example files on the trial name (P20)."""
    return trials.join(examples, list(keys), "left")


def first_present(*cols):
    return F.coalesce(*[col(c) for c in cols])
