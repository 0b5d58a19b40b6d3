"""Guarded arithmetic and moment expressions shared by the operators."""
from pyspark.sql import functions as F

INF = float("inf")


def col(c):
    return F.col(c) if isinstance(c, str) else c


def r6(c):
    """Round to six digits and turn -0.0 into 0.0."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def is_finite(c):
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def optional_double(c):
    """Unparsable or non-finite text or number -> null."""
    d = col(c).try_cast("double")
    return F.when(is_finite(d), d)


def div0(a, b):
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def mean0(c):
    return F.coalesce(F.avg(c), F.lit(0.0))


def sd0(c):
    """Sample standard deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def sdp0(c):
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def paired(x, y):
    """Mask both columns to the rows where neither is missing."""
    x, y = col(x).cast("double"), col(y).cast("double")
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def safe_corr(x, y, min_n=3, default=0.0):
    """Pearson r as one mergeable aggregate; `default` if n < min_n or a side is constant."""
    x, y = paired(x, y)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
    varies = (F.count(x) >= min_n) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, r).otherwise(F.lit(default).cast("double"))


def safe_slope(x, y, default=0.0):
    """OLS slope of y on x as one mergeable aggregate."""
    x, y = paired(x, y)
    s = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return F.when(F.min(x) < F.max(x), s).otherwise(F.lit(default).cast("double"))


def cohens_d(n1, m1, v1, n2, m2, v2):
    """Pooled-variance effect size from counts, means and sample variances; 0 when undefined."""
    n1, m1, v1, n2, m2, v2 = map(col, (n1, m1, v1, n2, m2, v2))
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), F.try_divide(m1 - m2, pooled)).otherwise(0.0)


def hash_hex(seed, *cols):
    """md5 of (seed, key columns): the order used by every seeded draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def hash_int(seed, *cols):
    """A non-negative 60-bit integer from `hash_hex`."""
    return F.conv(F.substring(hash_hex(seed, *cols), 1, 15), 16, 10).cast("long")
