"""Top-k, argmax and seeded samples. Limits are the feature here; orders are md5 of (seed, key)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_hex


TAKE_ORDERED = 10_000        # rows that one task merges and sorts


def seeded_sample(df, n, seed, *keys):
    """n rows in hash order (all of them if n <= 0 or n covers the table): a distributed take-ordered, beyond TAKE_ORDERED rows whole hash buckets."""
    if n <= 0:
        return df
    if n > TAKE_ORDERED:
        return seeded_quota(df, n, seed, *keys)
    h = hash_hex(seed, *keys)
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def seeded_quota(df, n, seed, *keys):
    """The same n rows as `seeded_sample`, for an n that grows with the data: whole hash buckets, and an ordered take inside the last one alone.

    One row, the last bucket and what stands before it, reaches the driver; the window runs over at most 65,536 bucket counts.
    """
    h = df.withColumn("_h", hash_hex(seed, *keys)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = h.groupBy("_b").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    last = sizes.where(F.col("upto") >= n).orderBy("_b").limit(1).first()
    if last is None:
        return df
    whole = h.where(F.col("_b") < last["_b"])
    part = h.where(F.col("_b") == last["_b"]).orderBy("_h", *keys).limit(int(n - last["upto"] + last["k"]))
    return whole.union(part).drop("_h", "_b")


def largest(df, keys, score, order, payload):
    """Row with the largest score per key, the first in `order` on ties: one partial aggregate."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"), *[F.col(c) for c in payload])).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("b.s").alias(score), *[F.col(f"b.{c}").alias(c) for c in payload])


def salted_row_number(df, keys, seed, *id_cols):
    """Exact row_number per key in hash order without one task per key.

    The first two hex digits of the hash split every key into 256 ordered buckets; a window numbers each
    bucket and the bucket counts (256 rows per key) give its offset.
    """
    h = df.withColumn("_h", hash_hex(seed, *id_cols)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = h.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b")
    offs = sizes.select(*keys, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *id_cols)
    numbered = h.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(offs, [*keys, "_b"]).withColumn("rn", F.col("_off") + F.col("_rn")).drop("_h", "_b", "_n", "_off", "_rn")


def complement(pattern):
    return F.translate(pattern, "01", "10")


def balanced_capacity(patterns):
    """Counts of each answer pattern beside its complement's, and the total balanced capacity."""
    counts = patterns.groupBy("pattern").agg(F.count("*").alias("k"))
    other = counts.select(complement("pattern").alias("pattern"), F.col("k").alias("k_other"))
    pairs = counts.join(other, "pattern").withColumn("capacity", F.least("k", "k_other"))
    return pairs


def balanced_sample(patterns, target, seed=3, id_col="item_id"):
    """Equal numbers from each pattern and its complement, up to an even target.

    Quotas are filled pattern pair by pattern pair in hash order; the pattern table has 2^levels rows.
    """
    pairs = balanced_capacity(patterns)
    head = pairs.where(F.col("pattern") < complement("pattern"))
    w = Window.orderBy(hash_hex(seed, "pattern"), "pattern")
    room = F.floor(F.least(F.lit(int(target)), 2 * F.sum("capacity").over(Window.partitionBy())) / 2)
    before = F.sum("capacity").over(w) - F.col("capacity")
    quota = head.select("pattern", F.greatest(F.least(F.col("capacity"), room - before), F.lit(0)).alias("quota"))
    both = quota.unionByName(quota.select(complement("pattern").alias("pattern"), "quota"))
    numbered = salted_row_number(patterns, ["pattern"], seed, id_col)
    return numbered.join(F.broadcast(both), "pattern").where(F.col("rn") <= F.col("quota")).drop("quota", "rn")


def representatives(scores, k, item="item_id"):
    """Worst item on the first rung, worst other item on the fourth, then the worst overall, k in all.

    `scores`: item, first, fourth, overall. Each ranking is a take-ordered of at most k+1 rows.
    """
    picks = None
    for pri, (col_name, take) in enumerate((("first", 1), ("fourth", 2), ("overall", k + 2))):
        top = scores.where(F.col(col_name).isNotNull()).orderBy(F.col(col_name).desc(), item).limit(take)
        top = top.select(item, F.lit(pri).alias("priority"), F.col(col_name).alias("score"))
        picks = top if picks is None else picks.unionByName(top)
    # at most k+5 rows from here on: keep one row of the second ranking, no item twice
    first = picks.where("priority = 0").select(F.col(item).alias("f")).limit(1)
    taken = picks.join(first, picks[item] == first["f"], "left").where("priority = 0 OR f IS NULL").drop("f")
    w4 = Window.partitionBy("priority").orderBy(F.col("score").desc(), item)
    taken = taken.withColumn("rn", F.row_number().over(w4)).where("priority <> 1 OR rn = 1").drop("rn")
    once = taken.groupBy(item).agg(F.min(F.struct("priority", "score")).alias("b")).select(item, "b.*")
    return once.orderBy("priority", F.col("score").desc(), item).limit(k)
