"""Bounded samples of labelled rows for fits, and the fold that fits may read."""
from pyspark.sql import functions as F

_SPAN = 1 << 30


def held_out(key="doc_id"):
    """True for the fifth of all ids that no fit may read; a null id counts as empty text and is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def share(rate, key="doc_id"):
    """Rows whose hashed id falls under `rate` (a number or a column)."""
    return F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(_SPAN)) < F.lit(_SPAN) * rate


def per_group(rows, group, most):
    """About `most` rows of each value of `group` that fits may read, by hashed id: the rate is `most` over the group's count."""
    counts = {r[0]: r[1] for r in rows.where(~held_out()).groupBy(group).count().where(F.col(group).isNotNull()).collect()}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(group) == value, F.lit(min(1.0, most / n))).otherwise(rate)
    return counts, rows.where(~held_out() & share(rate))
