"""Run one registered query in Spark and its SQL in DuckDB and compare them as row multisets."""
import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}" if v != 0 else "0.000000"
    return repr(v)


def run_spark(df):
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    return cols, rows


def run_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in cur.fetchall()]


def compare(spark_side, duck_side):
    """Empty list if equal, otherwise readable differences."""
    (sc, sr), (dc, dr) = spark_side, duck_side
    if sc != dc:
        return [f"columns differ: {sc} vs {dc}"]
    out = []
    if len(sr) != len(dr):
        out.append(f"row counts differ: {len(sr)} vs {len(dr)}")
    for i, c in enumerate(sc):
        ks = {_kind(r[i]) for r in sr} - {None}
        kd = {_kind(r[i]) for r in dr} - {None}
        if ks != kd:
            out.append(f"type of {c}: {ks} vs {kd}")
    a = Counter(tuple(_norm(v) for v in r) for r in sr)
    b = Counter(tuple(_norm(v) for v in r) for r in dr)
    if a != b:
        only_a, only_b = a - b, b - a
        out.append(f"{sum(only_a.values())} rows only in Spark, {sum(only_b.values())} only in DuckDB")
        out.append(f"spark: {sorted(only_a)[:3]}")
        out.append(f"duck:  {sorted(only_b)[:3]}")
    return out
