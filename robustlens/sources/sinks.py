"""Writers. All are distributed; fact tables keep their partitioning, summaries are a few rows anyway."""
import hashlib

import pandas as pd
from pyspark.sql import functions as F


PACKED_ROWS = 1_000_000     # rows of a packed file, which one task reads whole


def write_jsonl(df, path, packed=False):
    """JSON lines; `packed` by gzip, in files of bounded rows since such a file can not be split."""
    writer = df.write.mode("overwrite")
    if packed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", PACKED_ROWS)
    writer.json(path)


def write_json_arrays(df, path, packed=False):
    """Files that each hold one JSON array: an Arrow batch becomes one array, one array one file; `packed` by gzip."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": ["[" + ",\n".join(pdf["value"]) + "]"]})
    text = df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(run, "value string")
    text.write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "gzip" if packed else "none").text(path)


def write_summary(df, path):
    """Result rows as JSON; values without a JSON form become strings."""
    cols = [F.col(c).cast("string").alias(c) if t in ("date", "timestamp", "timestamp_ntz", "binary") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_delimited(df, path, fields, sep=","):
    df.select(*fields).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_arrays(df, path, *partition_by):
    """Array sidecars as Parquet (array columns beside h and w), partitioned for pruning."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def cache_key(version, **parts):
    return hashlib.sha256("|".join([version] + [f"{k}={parts[k]}" for k in sorted(parts)]).encode()).hexdigest()[:16]


def cached_table(spark, root, version, build, **parts):
    """Parquet table keyed by (version, parts): read if present and complete, else built once and read back."""
    path = f"{root}/cache-{cache_key(version, **parts)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):   # absent or half written
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def part_files(spark, path):
    """Names of the part files of one written folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))


def rename_parts(spark, path, prefix):
    """Rename the part files of one written folder to <prefix>-<n>.<ext> through the Hadoop file system."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, name in enumerate(part_files(spark, path)):
        ext = name.rsplit(".", 1)[-1]
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}-{i:05d}.{ext}"))
