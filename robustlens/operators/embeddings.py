"""Principal components of embedding channels from second-moment sums."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment_parts(df, key, vec):
    """Count, sum and cross-product matrix of every channel, added up over a task's batches: d x d numbers per task and channel, never the rows."""
    schema = T.StructType([df.schema[key], T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType())),
                           T.StructField("q", T.ArrayType(T.DoubleType()))])

    def run(batches):
        total, held = {}, 256

        def rows():
            out = [(k, n, s.tolist(), q.ravel().tolist()) for k, (n, s, q) in total.items()]
            total.clear()
            return pd.DataFrame(out, columns=[f.name for f in schema])
        for pdf in batches:
            for k, part in pdf.groupby(key):
                x = np.stack(part[vec].to_numpy()).astype(float)
                n, s, q = total.get(k, (0, 0.0, 0.0))
                total[k] = n + len(x), s + x.sum(axis=0), q + x.T @ x
            if len(total) > held:
                yield rows()
        yield rows()
    return df.select(key, vec).mapInPandas(run, schema)


def pca(df, key, vec, n_components):
    """Mean, components and explained variance per channel: partial matrices are added position by position."""
    parts = moment_parts(df, key, vec)

    def add(name):
        cells = parts.select(key, F.posexplode(name).alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
        arr = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"])  # d or d*d numbers
        return cells.groupBy(key).agg(arr.alias(name))
    tot = parts.groupBy(key).agg(F.sum("n").alias("n")).join(add("s"), key).join(add("q"), key)
    schema = T.StructType([df.schema[key], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("explained_variance", T.DoubleType()), T.StructField("explained_ratio", T.DoubleType()),
                           T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("axis", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                n, s = int(r["n"]), np.asarray(r["s"])
                d = len(s)
                mean = s / n
                cov = (np.asarray(r["q"]).reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
                val, vecs = np.linalg.eigh(cov)
                for c in range(n_components):
                    v = vecs[:, d - 1 - c]
                    v = v * np.sign(v[np.argmax(np.abs(v))])   # fixed sign
                    rows.append((r[key], c, n, float(val[d - 1 - c]), float(val[d - 1 - c] / val.sum()), mean.tolist(), v.tolist()))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])
    return tot.mapInPandas(solve, schema)


def pca_variance(df, key, vec, n_components):
    return pca(df, key, vec, n_components).select(key, "component", "n", "explained_variance", "explained_ratio")


def pca_coordinates(df, key, vec, n_components):
    """Each row projected on its channel's components; the component table is a few d-vectors per channel."""
    axes = pca(df, key, vec, n_components).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("component", "axis", "mean"))).alias("axes"))
    from ..functions.arrays import dot, doubles
    x = df.join(axes, key).withColumn("_x", doubles(vec))
    coords = F.transform("axes", lambda a: dot(F.zip_with("_x", a["mean"], lambda p, q: p - q), a["axis"]))
    return x.withColumn("coords", coords).drop("axes", "_x")
