"""Joins of clean and perturbed tables. All are equi joins; adaptive execution broadcasts a side by its measured bytes."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_int


def argmax_label(scores, labels):
    """Label of the largest score, the first listed one on ties; null for an empty map."""
    sc, lb = F.col(scores) if isinstance(scores, str) else scores, F.col(labels) if isinstance(labels, str) else labels
    ranked = F.filter(F.transform(lb, lambda x, i: F.struct(F.try_element_at(sc, x).alias("s"), (-i).alias("p"),
                                                            x.alias("label"))), lambda z: z["s"].isNotNull())
    return F.array_max(ranked)["label"]


def clean_vs_perturbed(clean, pert, keys=("item_id", "level_no")):
    """Predicted labels, correctness, accuracy drop and drift of the gold score.

    A gold label missing among the perturbed scores takes the clean value, so its drift is 0. The clean table is merged, never broadcast: Spark's
    size estimate does not see the rows that an `explode` by level adds.
    """
    c = clean.select(*keys, "answer_label", F.col("scores").alias("clean_scores"),
                     argmax_label("scores", "option_labels").alias("clean_pred"))
    p = pert.withColumn("pert_pred", argmax_label("scores", "option_labels"))
    gold = F.try_element_at("clean_scores", F.col("answer_label"))
    pert_gold = F.coalesce(F.try_element_at("scores", F.col("answer_label")), gold)
    ok_c, ok_p = F.col("clean_pred") == F.col("answer_label"), F.col("pert_pred") == F.col("answer_label")
    return (p.join(c.hint("merge"), list(keys))
            .withColumn("clean_correct", ok_c).withColumn("pert_correct", F.coalesce(ok_p, F.lit(False)))
            .withColumn("accuracy_drop", (F.col("clean_correct") & ~F.col("pert_correct")).cast("double"))
            .withColumn("loglik_drift", gold - pert_gold)
            .drop("clean_scores"))


def with_filters(trials, item_filters, level_filters, by_item=False):
    """Each trial with its own filter or the level average; trials with neither are dropped. `by_item` keeps trials that were dealt by item where they are."""
    own = item_filters.select("item_id", "level_no", F.col("w").alias("w_own"))
    avg = level_filters.select("level_no", F.col("w").alias("w_avg"))
    if by_item:
        # the level between bounds is no key of the join; as one, Spark would deal both sides anew by item and level
        own = own.withColumnsRenamed({"item_id": "_item", "level_no": "_level"})
        same = (F.col("item_id") == F.col("_item")) & (F.col("level_no") >= F.col("_level")) & (F.col("level_no") <= F.col("_level"))
        joined = trials.join(own, same, "left").drop("_item", "_level")
    else:
        joined = trials.join(own, ["item_id", "level_no"], "left")
    return (joined.join(F.broadcast(avg), "level_no", "left")   # one row per rung of the eight-step ladder
            .withColumn("w", F.coalesce("w_own", "w_avg")).drop("w_own", "w_avg")
            .where(F.col("w").isNotNull()))


def mirror_cells(trials, measures, item="item_id", level="level_no", offset=4):
    """Item-level means of the measures on the terse level and on its wordy mirror, side by side.

    Trials are averaged per (item, level) first, so the self-join is one row per cell and one
    aggregate shuffle on (item, rung): the pair is folded by conditional aggregation, not joined twice.
    """
    cell = trials.groupBy(item, level).agg(*[F.avg(m).alias(m) for m in measures])
    rung = ((F.col(level) - 1) % offset + 1).alias("rung")
    base = F.col(level) <= offset
    folded = cell.groupBy(item, rung).agg(
        *[F.max(F.when(base, F.col(m))).alias(f"base_{m}") for m in measures],
        *[F.max(F.when(~base, F.col(m))).alias(f"wordy_{m}") for m in measures])
    keep = F.lit(True)
    for m in measures:
        keep = keep & F.col(f"base_{m}").isNotNull() & F.col(f"wordy_{m}").isNotNull()
    return folded.where(keep)


def shared_keys(a, b, keys):
    """Key intersection join of two keyed tables."""
    return a.join(b, list(keys))


def relative_to_base(summary, base=("Base", 0), keys=("model", "metric")):
    """Base mean minus the mean of every other (perturb, severity); metrics without a base drop out."""
    is_base = (F.col("perturb") == base[0]) & (F.col("severity") == base[1])
    ref = summary.where(is_base).select(*keys, F.col("mean").alias("base_mean"))
    return (summary.where(~is_base).join(ref, list(keys))
            .withColumn("drop", F.col("base_mean") - F.col("mean")).drop("base_mean"))


def dense_index(df, key, buckets=4096, seed="index"):
    """Give every distinct key a dense 0-based position without sorting all of them in one task.

    Keys fall into hash buckets; a small table of bucket sizes gives each bucket its offset and a
    window inside the bucket the rest. Returns (key, pos) and the total as a one-row table.
    """
    keys = df.select(key).distinct().withColumn("h", hash_int(seed, key)).withColumn("bucket", F.col("h") % buckets)
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"))
    # at most `buckets` rows take part in this ordered window
    offs = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("off"))
    inside = keys.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)) - 1)
    pos = inside.join(F.broadcast(offs), "bucket").select(key, (F.col("off") + F.col("rn")).alias("pos"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return pos, total


def control_draws(items, key, k=3, seed=7):
    """k distinct other items for every item: one per stratum of the remaining positions.

    Position arithmetic plus one equi join; no pair set is ever enumerated.
    """
    pos, total = dense_index(items, key)
    n = total.select("total").scalar()
    others = n - 1
    d = pos.withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo = F.floor(others * F.col("j") / k)
    width = F.floor(others * (F.col("j") + 1) / k) - lo
    d = d.withColumn("lo", lo).withColumn("width", width).where("width > 0")
    d = d.withColumn("pick", (F.col("pos") + 1 + F.col("lo") + hash_int(seed, key, "j") % F.col("width")) % F.col("n"))
    other = pos.select(F.col("pos").alias("pick"), F.col(key).alias("other"))
    return d.join(other, "pick").select(key, F.col("j").cast("int").alias("draw"), "other")


def fan_out(items, specs):
    """Item x spec grid: the grid is a literal array of structs, exploded row by row (no join, no shuffle)."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in specs])
    return items.withColumn("spec", F.explode(rows)).select(*items.columns, "spec.*")


def prior_success(trials, baseline_ok, key):
    """Conditional metric: kept where the threshold is met, 0 after a baseline success, null otherwise."""
    base = baseline_ok.select(key).distinct().withColumn("base_ok", F.lit(True))
    joined = trials.join(base, key, "left")
    return joined.withColumn("conditional", F.when(F.coalesce("base_ok", F.lit(False)),
                                                   F.when(F.col("passed"), F.col("metric_value")).otherwise(0.0)))


def missing_keys(wanted, present, key):
    return wanted.join(present.select(key).distinct(), key, "left_anti")
