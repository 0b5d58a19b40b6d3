"""Session helpers: a tuned local session for tests and benches, and the shared scratch folder."""
import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus="8", app="robustlens"):
    """A single-JVM session. On a cluster the caller passes its own session instead."""
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app)
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


def shared_dir(spark):
    """The folder all executors can reach, named by `spark.checkpoint.dir`.

    Only where that is unset (tests, local mode) is a temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, base, ignore_errors=True)   # its own folder, local mode alone
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_SCRATCH = []


def scratch_path(spark, name):
    """A fresh path under the shared folder; `release` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def release(spark):
    """Delete the scratch tables made so far by this process. Results that still read them must have been written before."""
    for path in _SCRATCH:
        discard(spark, path)
    _SCRATCH.clear()


def discard(spark, path):
    """Delete one folder through the Hadoop file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def shuffles_dropped(spark):
    """What is written inside leaves no shuffle files; Spark would keep them until its driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(spark, df, name, partition_by=None):
    """Write `df` once as a Parquet table in the shared folder and read it back (cuts lineage)."""
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
