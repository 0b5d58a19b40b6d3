"""Evaluation manifests from annotation tables, and filtered metric extraction."""
from pyspark.sql import functions as F

from .scenes import negative_names
from .topk import largest, seeded_quota


def build_manifest(annotations, negative_ratio, name_seed, pick_seed):
    """One positive per image (its largest annotation with all boxes of that category) and a quota of negatives.

    The quota is round(positives * ratio); negatives name a category absent from their image.
    """
    top = largest(annotations, ["image_id"], "area", "k", ["cat"])
    same = annotations.groupBy("image_id", "cat").agg(F.count("*").alias("n_boxes"))
    pos = top.select("image_id", "cat").join(same, ["image_id", "cat"]).select("image_id", F.col("cat").alias("concept"), F.lit(True).alias("present"), "n_boxes")
    quota = int(pos.select(F.round(F.count("*") * F.lit(float(negative_ratio))).alias("q")).first()["q"])   # one number
    names = annotations.select(F.col("image_id").alias("scene"), F.col("cat").alias("name"))
    neg = negative_names(names, name_seed).select(F.col("scene").alias("image_id"), F.col("negative").alias("concept"))
    if quota <= 0:
        return pos
    picked = seeded_quota(neg, quota, pick_seed, "image_id").select("image_id", "concept", F.lit(False).alias("present"), F.lit(0).cast("long").alias("n_boxes"))
    return pos.unionByName(picked)


def metric_values(trials, condition, value):
    """Rows under a caller's column condition (None keeps all) with the chosen value column."""
    rows = trials if condition is None else trials.where(condition)
    return rows.withColumn("value", F.col(value).cast("double")).where(F.col("value").isNotNull())
