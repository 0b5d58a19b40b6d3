"""2-D grid jobs. Grids are row-major arrays, one per row; FFTs run on stacked Arrow batches in NumPy, while
Spark partitions the rows. Nothing crosses rows, so the jobs are narrow and need no shuffle of their own."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.arrays import EPS, asum, cosine, l2_distance
from .windows import exact_quantiles


# --- relational pieces -------------------------------------------------------------------------
def band_count(grids, *keys, coefficient=0.6, minimum=8, maximum=20):
    """Band count per run: ceil(0.6*sqrt(median tokens)) clamped, capped by the smallest grid's radius."""
    g = grids.groupBy(*keys).agg(F.min("h").alias("mh"), F.min("w").alias("mw"))
    mid = exact_quantiles(grids.select(*keys, (F.col("h") * F.col("w")).cast("double").alias("tokens")), "tokens", [0.5], keys).withColumnRenamed("q0", "tokens")
    g = g.join(mid, list(keys)) if keys else g.withColumn("tokens", mid.scalar())
    rule = F.least(F.greatest(F.ceil(F.lit(coefficient) * F.sqrt("tokens")), F.lit(minimum)), F.lit(maximum))
    cap = F.greatest(F.lit(1), F.ceil(F.hypot(F.floor(F.col("mh") / 2), F.floor(F.col("mw") / 2))))
    return g.select(*keys, "tokens", F.least(rule, cap).alias("num_bands"))


def radial_bands(cells, key, h, w, bands, suppress_dc=False):
    """Sum of power per band from the corner distance; the last band is closed."""
    cy, cx = h // 2, w // 2
    top = float(np.hypot(cy, cx))
    dist = F.sqrt(F.pow(F.col("r") - cy, F.lit(2)) + F.pow(F.col("c") - cx, F.lit(2)))
    band = F.when(dist >= top - 1e-12, bands - 1).otherwise(F.least(F.lit(bands - 1), F.floor(dist / top * bands).cast("int")))
    power = F.when((F.col("r") == cy) & (F.col("c") == cx), 0.0).otherwise(F.col("power")) if suppress_dc else F.col("power")
    return cells.groupBy(key, band.cast("int").alias("band")).agg(F.sum(power).alias("power"))


def half_pixel_profile(cells, key, h, w, bins):
    """Normalised mass per radius bin about the half-pixel centre, with the mass-weighted radius."""
    cy, cx = (h - 1) / 2.0, (w - 1) / 2.0
    rad = F.sqrt(F.pow(F.col("r") - cy, F.lit(2)) + F.pow(F.col("c") - cx, F.lit(2))) / float(np.hypot(cy, cx))
    b = F.least(F.lit(bins - 1), F.floor(rad * bins).cast("int"))
    g = cells.groupBy(key, b.alias("bin")).agg(F.sum("power").alias("m"), F.sum(F.col("power") * rad).alias("mr"))
    tot = g.groupBy(key).agg(F.sum("m").alias("t"), F.sum("mr").alias("tr"))
    return g.join(tot, key).select(key, "bin", F.try_divide("m", "t").alias("mass"), F.try_divide("tr", "t").alias("centroid"))


def window_weight(pos, n, kind):
    """Hann / Hamming weight of a position."""
    a = {"hann": 0.5, "hamming": 0.54}[kind]
    return F.lit(a) - F.lit(1 - a) * F.cos(F.lit(2 * np.pi) * F.col(pos) / (n - 1))


def dirichlet_energy(grid, h, w):
    """Mean squared difference over the 4-neighbour edges of a scalar grid, as an array fold."""
    g = F.transform(grid, lambda x: x.cast("double"))
    down = F.zip_with(F.slice(g, w + 1, h * w - w), F.slice(g, 1, h * w - w), lambda a, b: (a - b) * (a - b))
    right = F.zip_with(F.slice(g, 2, h * w - 1), F.slice(g, 1, h * w - 1), lambda a, b: (a - b) * (a - b))
    right = F.transform(right, lambda q, i: F.when((i + 1) % w == 0, 0.0).otherwise(q))
    return (asum(down) + asum(right)) / float(h * (w - 1) + (h - 1) * w)


def token_drift(variants, n_tokens, dim):
    """Mean L2 and mean cosine distance over the tokens of a grid."""
    def token(c, k):
        return F.transform(F.slice(c, k * dim + 1, dim), lambda x: x.cast("double"))
    l2 = [l2_distance(token("clean", k), token("pert", k)) for k in range(n_tokens)]
    cs = [1 - cosine(token("clean", k), token("pert", k)) for k in range(n_tokens)]
    return variants.select("vec_id", (sum(l2[1:], l2[0]) / n_tokens).alias("mean_token_l2"), (sum(cs[1:], cs[0]) / n_tokens).alias("mean_token_cosine"))


def nearest_resize(grid, h, w, th, tw):
    """Nearest-neighbour resize of a row-major grid by index arithmetic (positions known at plan time)."""
    ys = np.linspace(0, h - 1, th).round().astype(int)
    xs = np.linspace(0, w - 1, tw).round().astype(int)
    return F.array(*[F.try_element_at(grid, F.lit(int(y * w + x + 1))) for y in ys for x in xs])


# --- NumPy kernels, applied to stacked batches (n, h, w) ------------------------------------------
def stack(col, h, w):
    return np.stack(col.to_numpy()).astype(np.float64).reshape(-1, h, w)


def window_2d(h, w, kind):
    one = {"hann": np.hanning, "hamming": np.hamming, "none": np.ones}[kind]
    return np.outer(one(h) if h > 1 else np.ones(1), one(w) if w > 1 else np.ones(1))


def band_index(h, w, bands):
    y, x = np.indices((h, w))
    dist = np.hypot(y - h // 2, x - w // 2)
    top = np.hypot(h // 2, w // 2)
    if top <= EPS:
        return np.zeros((h, w), dtype=int)
    edges = np.linspace(0, top, bands + 1)
    return np.clip(np.searchsorted(edges, dist, side="right") - 1, 0, bands - 1)


def bin_power(power, bands, suppress_dc):
    """Band sums of shifted power grids: one matrix product for the whole batch."""
    n, h, w = power.shape
    idx = band_index(h, w, bands).ravel()
    onehot = np.eye(bands)[idx]
    if suppress_dc:
        onehot[(h // 2) * w + w // 2] = 0.0
    return power.reshape(n, h * w) @ onehot


def shifted_power(stacked):
    return np.fft.fftshift(np.abs(np.fft.fft2(stacked, axes=(1, 2))) ** 2, axes=(1, 2))


def lists(matrix):
    return pd.Series(list(matrix))


def fft_bands(df, vec, h, w, bands, window="hann", suppress_dc=True):
    """Radial band energies of the windowed 2-D power spectrum of every grid."""
    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        return lists(bin_power(shifted_power(stack(col, h, w) * window_2d(h, w, window)), bands, suppress_dc))
    return df.withColumn("bands", run(vec))


def long_bands(df, key):
    return df.select(key, F.posexplode("bands").alias("band", "power"))


def delta_spectrum(variants, h, w, bands, suppress_dc=True):
    """Band energies of |F(pert) - F(clean)|^2, raw and relative to the clean energy."""
    @F.pandas_udf("struct<delta: array<double>, relative: array<double>>")
    def run(clean: pd.Series, pert: pd.Series) -> pd.DataFrame:
        c, p = stack(clean, h, w), stack(pert, h, w)
        fc = np.fft.fft2(c, axes=(1, 2))
        d = np.abs(np.fft.fft2(p, axes=(1, 2)) - fc) ** 2
        raw = bin_power(np.fft.fftshift(d, axes=(1, 2)), bands, suppress_dc)
        energy = (np.abs(fc) ** 2).sum(axis=(1, 2))
        return pd.DataFrame({"delta": lists(raw), "relative": lists(raw / np.maximum(energy, EPS)[:, None])})
    return variants.withColumn("_s", run("clean", "pert")).select("vec_id", "perturbation", "_s.delta", "_s.relative")


# where the two inner edges stand: shares of the largest radius, of its logarithm, or of the cells
INNER_EDGES = {"equal": (1 / 3, 2 / 3), "log": (1 / 3, 2 / 3), "percentile": (0.333, 0.666)}


def radial_thirds(radius, scheme):
    """Band (0, 1, 2) of every cell by its radius; coinciding edges are set a millionth apart."""
    share, top = np.array(INNER_EDGES[scheme]), float(radius.max())
    edges = {"equal": lambda: top * share, "log": lambda: (top + 1.0) ** share - 1.0, "percentile": lambda: np.quantile(radius, share)}[scheme]()
    apart = 1e-6 * np.arange(1, 3)
    return np.searchsorted(np.maximum.accumulate(np.maximum(edges - apart, 0.0)) + apart, radius, side="right")


def three_band_power(df, vec, h, w, scheme="equal"):
    """Mean power overall and in three radial bands about the real-valued centre."""
    @F.pandas_udf("struct<total: double, low: double, mid: double, high: double>")
    def run(col: pd.Series) -> pd.DataFrame:
        p = shifted_power(stack(col, h, w)).reshape(-1, h * w)
        y, x = np.indices((h, w))
        rad = np.hypot(y - h / 2.0, x - w / 2.0).ravel()
        cut = radial_thirds(rad, scheme)
        out = {"total": p.mean(axis=1)}
        for i, name in enumerate(("low", "mid", "high")):
            sel = cut == i
            out[name] = p[:, sel].mean(axis=1) if sel.any() else np.zeros(len(p))
        return pd.DataFrame(out)
    return df.select("vec_id", run(vec).alias("s")).select("vec_id", "s.*")


def token_fft_drift(variants, low_frac=0.25, high_frac=0.25):
    """Mean |rfft difference| over the lowest and highest quarter of the token frequencies."""
    @F.pandas_udf("struct<low: double, high: double>")
    def run(clean: pd.Series, pert: pd.Series) -> pd.DataFrame:
        c, p = np.stack(clean.to_numpy()).astype(float), np.stack(pert.to_numpy()).astype(float)
        d = np.abs(np.fft.rfft(p, axis=1) - np.fft.rfft(c, axis=1))
        k, m = max(1, int(d.shape[1] * low_frac)), max(1, int(d.shape[1] * high_frac))
        return pd.DataFrame({"low": d[:, :k].mean(axis=1), "high": d[:, -m:].mean(axis=1)})
    s = variants.select("vec_id", run("clean", "pert").alias("s")).select("vec_id", "s.*")
    return s.withColumn("ratio", F.col("high") / (F.col("low") + EPS))


def interp_matrix(n, m):
    """Weights that linearly resample n points on [-1, 1] to m points."""
    pos = np.linspace(0, n - 1, m)
    lo = np.minimum(np.floor(pos).astype(int), max(n - 2, 0))
    out = np.zeros((m, n))
    out[np.arange(m), lo] = 1 - (pos - lo)
    if n > 1:
        out[np.arange(m), lo + 1] += pos - lo
    return out


def linear_resize(df, vec, h, w, th, tw):
    """Separable linear resize of non-negative mass grids, renormalised to sum one."""
    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        g = np.maximum(np.nan_to_num(stack(col, h, w)), 0.0)
        r = np.einsum("ij,njk,lk->nil", interp_matrix(h, th), g, interp_matrix(w, tw)).reshape(len(g), -1)
        t = r.sum(axis=1, keepdims=True)
        return lists(np.divide(r, t, out=r.copy(), where=t > 1e-12))
    return df.withColumn("resized", run(vec))


def noise(rows, cells):
    """Standard normal values (len(rows), cells) from 60-bit row hashes: the same wherever a row is processed."""
    def uniform(salt):
        with np.errstate(over="ignore"):
            x = rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(salt, salt + cells, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):   # fixed values: a published 64-bit finaliser
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53
    return np.sqrt(-2 * np.log1p(-uniform(1))) * np.cos(2 * np.pi * uniform(1 + cells))


def frequency_radius(h, w):
    """Distance of every frequency from zero, 1 at the farthest."""
    rad = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :])
    return rad / max(rad.max(), 1e-6)


def kernel(g, kind, s, rows):
    """One kind of perturbation of strength s on a stack (n, h, w); `rows` are the rows' hashes, used by noise."""
    n, h, w = g.shape

    def keep(mask):
        return np.fft.ifft2(np.fft.fft2(g, axes=(1, 2)) * mask, axes=(1, 2)).real
    if kind == "shift":
        return np.roll(g, int(s), axis=2)          # horizontal, cyclic
    if kind == "pad_crop":
        k = int(s)
        return np.pad(g, ((0, 0), (k, k), (k, k)))[:, :h, :w]
    if kind == "motion_blur":
        k = int(s)
        pad = np.pad(g, ((0, 0), (0, 0), (k // 2, k - 1 - k // 2)), mode="edge")
        return np.mean([pad[:, :, i:i + w] for i in range(k)], axis=0)
    if kind == "occlusion":                      # a centred box that covers the share s of the area
        bh, bw = max(1, round(h * s ** 0.5)), max(1, round(w * s ** 0.5))
        out = g.copy()
        out[:, (h - bh) // 2:(h - bh) // 2 + bh, (w - bw) // 2:(w - bw) // 2 + bw] = 0.0
        return out
    if kind == "brightness":
        return g + s
    if kind == "contrast":
        mean = g.mean(axis=(1, 2), keepdims=True)
        return (g - mean) * s + mean
    if kind == "gaussian_noise":
        return g + s * noise(rows, h * w).reshape(n, h, w)
    if kind == "lowpass":
        return keep(frequency_radius(h, w) <= s)
    if kind == "highpass":
        return keep(frequency_radius(h, w) >= s)
    if kind == "band_noise":                     # noise of the upper half of the frequencies, scaled to deviation s
        z = np.fft.fft2(noise(rows, h * w).reshape(n, h, w), axes=(1, 2)) * (frequency_radius(h, w) >= 0.5)
        z = np.fft.ifft2(z, axes=(1, 2)).real
        return g + s * z / np.maximum(z.std(axis=(1, 2), keepdims=True), EPS)
    raise ValueError(f"unknown kind {kind}")


def perturb_grids(df, specs, h, w, seed, low=None, high=None):
    """Every grid under every spec: a row-wise fan-out of literals, then one kernel call per spec of an Arrow batch; clipped to [low, high] if given."""
    from ..functions.numeric import hash_int
    from .joins import fan_out
    fanned = fan_out(df, specs).withColumn("_h", hash_int(seed, df.columns[0], "kind", F.col("strength")))

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series, grid: pd.Series, kind: pd.Series, strength: pd.Series) -> pd.Series:
        g, out = stack(grid, h, w), np.empty((len(grid), h * w))
        for (k, s), at in pd.DataFrame({"k": kind.to_numpy(), "s": strength.to_numpy()}).groupby(["k", "s"]).indices.items():
            out[at] = kernel(g[at], k, float(s), rows.to_numpy()[at]).reshape(len(at), -1)
        return lists(out if low is None and high is None else np.clip(out, low, high))
    return fanned.withColumn("perturbed", run("_h", "grid", "kind", "strength")).drop("grid", "_h")
