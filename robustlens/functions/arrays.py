"""Spectrum and vector arithmetic on array columns: everything stays in the JVM, row by row, no shuffle."""
from pyspark.sql import functions as F

from .numeric import col

# fixed values: guards below which a norm or total counts as zero
EPS = 1e-8
TINY = 1e-12


def let(value, body):
    """Bind `value` once and use it many times in `body`.

    Inside a lambda an expression is evaluated per element; a bound variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(a):
    return F.transform(col(a), lambda x: x.cast("double"))


def asum(a):
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def amean(a):
    return F.try_divide(asum(a), F.size(col(a)))


def dot(a, b):
    n = F.least(F.size(col(a)), F.size(col(b)))
    return asum(F.zip_with(F.slice(col(a), F.lit(1), n), F.slice(col(b), F.lit(1), n), lambda x, y: x * y))


def norm(a):
    return F.sqrt(asum(F.transform(col(a), lambda x: x * x)))


def sq_norm(a):
    return asum(F.transform(col(a), lambda x: x * x))


def l2_distance(a, b):
    return F.sqrt(asum(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def cosine(a, b):
    """Cosine similarity, 0 when a norm vanishes."""
    den = norm(a) * norm(b)
    return F.when(den > EPS, F.try_divide(dot(a, b), den)).otherwise(0.0)


def normalize(a, kind="l1"):
    """Filter normalisation; an all-zero filter becomes the uniform one."""
    n = F.size(col(a)).cast("double")
    flat = F.lit(1.0) / n if kind == "l1" else F.lit(1.0) / F.sqrt(n)
    return let(asum(a) if kind == "l1" else norm(a), lambda total: F.when(
        total == 0, F.array_repeat(flat, F.size(col(a)))).otherwise(F.transform(col(a), lambda x: F.try_divide(x, total))))


def bandwidth(a):
    """Inverse participation ratio: 0 for an empty array, 1 for a zero sum."""
    total = asum(a)
    p2 = F.try_divide(sq_norm(a), total * total)
    return (F.when(F.size(col(a)) == 0, 0.0).when((total == 0) | (p2 == 0), 1.0)
            .otherwise(F.try_divide(F.lit(1.0), p2)))


def overlap(w, d):
    return dot(w, d)


def band_overlap(w, d, bands):
    """`overlap` of arrays of `bands` values, written out: a plain sum in the same order, without a lambda for every element."""
    total = F.lit(0.0)
    for i in range(bands):
        total = total + F.get(col(w), F.lit(i)) * F.get(col(d), F.lit(i))
    return total


def band_quadratic_overlap(w, d, bands):
    total = F.lit(0.0)
    for i in range(bands):
        x, y = F.get(col(w), F.lit(i)), F.get(col(d), F.lit(i))
        total = total + (x * x) * (y * y)
    return total


def quadratic_overlap(w, d):
    def squares(a):
        return F.transform(col(a), lambda x: x * x)
    return dot(squares(w), squares(d))


def centred(a):
    return let(amean(a), lambda m: F.transform(col(a), lambda x: x - m))


def centred_overlap(w, d, mode):
    """Overlap after truncating both to the shorter and centring filter, delta, both or none."""
    n = F.least(F.size(col(w)), F.size(col(d)))
    w, d = F.slice(col(w), F.lit(1), n), F.slice(col(d), F.lit(1), n)
    if mode in ("filter_centered", "both_centered"):
        w = centred(w)
    if mode in ("delta_centered", "both_centered"):
        d = centred(d)
    return dot(w, d)


def top_k_mass(a, k):
    return asum(F.slice(F.sort_array(col(a), asc=False), 1, k))


def tail_mass(a, split=0.5):
    n = F.size(col(a))
    start = F.ceil(F.lit(split) * (n - 1)).cast("int")
    return asum(F.slice(col(a), start + 1, F.greatest(n - start, F.lit(0))))


def moment1(a):
    return asum(F.transform(col(a), lambda x, i: x * i))


def centroid(a):
    """Mass-weighted mean band index; the middle of the axis when there is no mass."""
    total = asum(a)
    return (F.when(F.size(col(a)) == 0, 0.0).when(total <= EPS, (F.size(col(a)) - 1) / F.lit(2.0))
            .otherwise(F.try_divide(moment1(a), total)))


def centroid_norm(a):
    return F.try_divide(centroid(a), F.greatest(F.size(col(a)) - 1, F.lit(1)))


def delta_family(d):
    """zero / low_freq / high_freq / broadband by the centroid of |delta|."""
    def label(s):
        c = F.try_divide(s["m1"], s["total"])
        return (F.when((s["n"] == 0) | (s["total"] <= 1e-6), "zero").when(c < s["n"] / F.lit(3.0), "low_freq")
                .when(c > s["n"] * F.lit(2.0) / F.lit(3.0), "high_freq").otherwise("broadband"))
    return let(F.transform(col(d), lambda x: F.abs(x)), lambda mag: let(
        F.struct(asum(mag).alias("total"), moment1(mag).alias("m1"), F.size(mag).alias("n")), label))


def spectral_features(a, entropy_threshold=0.86, dominance_margin=0.12):
    """Struct of third masses, normalised entropy, centroid and the dominant-third or broadband label."""
    mag = F.transform(F.filter(col(a), lambda x: x.isNotNull() & ~F.isnan(x)), lambda x: F.abs(x))

    def measure(p, s):
        n = s["n"]
        n1 = F.ceil(n / F.lit(3.0)).cast("int")            # the first third takes the larger share
        n2 = F.ceil((n - n1) / F.lit(2.0)).cast("int")
        plogp = asum(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(TINY)))))
        return F.struct(asum(F.slice(p, F.lit(1), n1)).alias("low"), asum(F.slice(p, n1 + 1, n2)).alias("mid"),
                        asum(F.slice(p, n1 + n2 + 1, n - n1 - n2)).alias("high"),
                        F.try_divide(-plogp, F.log(n.cast("double"))).alias("ent"), moment1(p).alias("cen"))

    def close(q, s):
        low, mid, high, ent = q["low"], q["mid"], q["high"], q["ent"]
        empty = (s["n"] == 0) | (s["total"] <= TINY)
        top = F.greatest(low, mid, high)
        second = low + mid + high - top - F.least(low, mid, high)
        label = (F.when((ent >= entropy_threshold) & (top - second < dominance_margin), "broadband")
                 .when(low == top, "low").when(mid == top, "mid").otherwise("high"))
        return F.struct(F.when(empty, "broadband").otherwise(label).alias("signature"),
                        F.when(empty, 0.0).otherwise(low).alias("low_mass"),
                        F.when(empty, 0.0).otherwise(mid).alias("mid_mass"),
                        F.when(empty, 0.0).otherwise(high).alias("high_mass"),
                        F.when(empty | (s["n"] <= 1), 0.0).otherwise(ent).alias("entropy"),
                        F.when(~empty, q["cen"]).alias("centroid"))
    return let(mag, lambda m: let(F.struct(asum(m).alias("total"), F.size(m).alias("n")), lambda s: let(
        F.transform(m, lambda x: F.try_divide(x, s["total"])), lambda p: let(measure(p, s), lambda q: close(q, s)))))


def with_band_signature(df, a, name, bands):
    """Add the `signature` of `spectral_features` of an array of `bands` values, written out band by band. Each step is a projection of its own, so shared
    terms are computed once. An array of another length, or with a null or NaN, takes the general form."""
    x = [F.get(col(a), F.lit(i)) for i in range(bands)]
    plain = F.size(col(a)) == bands
    for v in x:
        plain = plain & v.isNotNull() & ~F.isnan(v)

    def total(terms):
        out = F.lit(0.0)
        for t in terms:
            out = out + t
        return out
    own = df.columns
    n1 = -(-bands // 3)
    n2 = -(-(bands - n1) // 2)
    df = df.select(*own, F.coalesce(plain, F.lit(False)).alias("_plain"), total([F.abs(v) for v in x]).alias("_total"))
    df = df.select(*own, "_plain", "_total", *[F.try_divide(F.abs(v), F.col("_total")).alias(f"_p{i}") for i, v in enumerate(x)])
    p = [F.col(f"_p{i}") for i in range(bands)]
    ent = F.try_divide(-total([v * F.log(F.greatest(v, F.lit(TINY))) for v in p]), F.log(F.lit(float(bands))))
    df = df.select(*own, "_plain", "_total", ent.alias("_ent"), total(p[:n1]).alias("_low"), total(p[n1:n1 + n2]).alias("_mid"), total(p[n1 + n2:]).alias("_high"))
    low, mid, high = F.col("_low"), F.col("_mid"), F.col("_high")
    df = df.select(*own, "_plain", "_total", "_ent", "_low", "_mid", "_high", F.greatest(low, mid, high).alias("_top"))
    top = F.col("_top")
    label = (F.when(F.col("_total") <= TINY, "broadband").when((F.col("_ent") >= 0.86) & (top - (low + mid + high - top - F.least(low, mid, high)) < 0.12), "broadband")
             .when(low == top, "low").when(mid == top, "mid").otherwise("high"))
    # Spark evaluates a lambda's branch for every row, so the general form gets its array in one that is null for plain rows, and runs over those left
    df = df.select(*own, F.when(F.col("_plain"), label).alias(name), F.when(~F.col("_plain"), F.array(a)).alias("_odd"))
    general = F.transform("_odd", lambda z: spectral_features(z)["signature"])
    return df.select(*own, F.coalesce(name, F.get(general, F.lit(0))).alias(name))


def js_divergence(p, q):
    """Jensen-Shannon divergence (nats) after clipping to EPS and renormalising; 0 when a side is empty."""
    def prep(a):
        clipped = let(asum(a), lambda t: F.transform(col(a), lambda x: F.greatest(F.try_divide(x, t), F.lit(EPS))))
        return let(clipped, lambda c: let(asum(c), lambda t: F.transform(c, lambda x: x / t)))

    def half(x, y):
        m = (x + y) / 2
        return x * F.log(x / m) + y * F.log(y / m)
    js = asum(F.zip_with(prep(p), prep(q), half)) / 2
    return F.when((asum(p) > EPS) & (asum(q) > EPS), js).otherwise(0.0)


def softmax_entropy(values):
    """Entropy of the softmax of the finite scores; null when there are none."""
    v = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def entropy(e):
        return let(asum(e), lambda t: -asum(F.transform(e, lambda x: (x / t) * F.log(F.greatest(x / t, F.lit(1e-12))))))
    return let(v, lambda f: F.when(F.size(f) > 0, let(F.array_max(f), lambda top: let(
        F.transform(f, lambda x: F.exp(x - top)), entropy))))


def mass_entropy(values):
    """Entropy of non-negative scores normalised to sum one (0 if no mass)."""
    def entropy(p):
        return let(asum(p), lambda t: F.when(t > 0, -asum(F.transform(
            p, lambda x: F.when(x > 0, (x / t) * F.log(x / t + 1e-12)).otherwise(0.0)))).otherwise(0.0))
    return let(F.transform(values, lambda x: F.greatest(x, F.lit(0.0))), entropy)
