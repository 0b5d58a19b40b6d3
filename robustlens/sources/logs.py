"""Worker summary logs: writing the fixed text layout and scanning it back into rows."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.wordlists import SUMMARY_TYPES

# fixed values: header texts of the summary layout
FLIP_HEADER = "Type  AVg  Ve"
CONFUSION_HEADER = "Confusion vs ground truth"
SECTION_MARKS = (("FLIP", "AVg"), ("CONFUSION", CONFUSION_HEADER), ("FREQUENCY", "FREQUENCY ANALYSIS"), ("DIRICHLET", "DIRICHLET ANALYSIS"),
                 ("DRIFT", "EMBEDDING DRIFT ANALYSIS"), ("", "======"))


def log_lines(spark, path):
    """(file, worker, pos, line) of summary files. A summary is one worker's short report, so it is read whole and keeps its line order."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    f = files.select(F.col("_metadata.file_path").alias("file"), F.regexp_extract(F.col("_metadata.file_path"), "worker=?([0-9]+)", 1).cast("int").alias("worker"), F.split("value", "\n").alias("l"))
    return f.select("file", "worker", F.posexplode("l").alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def fields(line="line"):
    return F.split(F.col(line), r"\s+")


def flip_rows(lines):
    """Rows of the flip-rate table: (worker, type, avg_rate, ve_rate)."""
    p = fields()
    d = lines.select("worker", F.try_element_at(p, F.lit(1)).alias("type"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("avg_rate"),
                     F.try_element_at(p, F.lit(3)).try_cast("double").alias("ve_rate"), F.size(p).alias("n"))
    return d.where(F.col("type").isin(*SUMMARY_TYPES) & (F.col("n") >= 3) & F.col("avg_rate").isNotNull() & F.col("ve_rate").isNotNull()).drop("n")


def sections(lines):
    """Each line with the section it belongs to: the last header seen above it in the same file."""
    mark = F.lit(None).cast("string")
    for name, text in reversed(SECTION_MARKS):
        mark = F.when(F.contains("line", F.lit(text)), name).otherwise(mark)
    cond = F.when(F.contains("line", F.lit(CONFUSION_HEADER)), F.coalesce(F.nullif(F.regexp_extract("line", r"\[(.*)\]", 1), F.lit("")), F.lit("all")))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines.withColumn("_m", mark).withColumn("_c", cond)
    return d.withColumn("section", F.last("_m", ignorenulls=True).over(w)).withColumn("condition", F.last("_c", ignorenulls=True).over(w)).where("_m IS NULL").drop("_m", "_c")


def base_accuracy(lines):
    a = F.regexp_extract("line", r"Base accuracy vs ground truth:\s+([0-9.]+)", 1)
    return lines.where(a != "").select("worker", a.try_cast("double").alias("base_accuracy"))


def section_rows(lines):
    """Long rows (worker, section, condition, type, metric, value) of the sectioned layout."""
    s = sections(lines)
    p = fields()
    typ = F.try_element_at(p, F.lit(1))

    def num(i):
        return F.try_element_at(p, F.lit(i)).try_cast("double")
    vals = (F.when(F.col("section") == "FLIP", F.map_from_arrays(F.array(F.lit("avg_rate"), F.lit("ve_rate")), F.array(num(2), num(3))))
            .when(F.col("section") == "CONFUSION", F.map_from_arrays(F.array(*[F.lit(x) for x in ("r2w", "w2r", "r2r", "w2w")]), F.array(num(2), num(3), num(4), num(5))))
            .when(F.col("section") == "FREQUENCY", F.map_from_arrays(F.array(F.lit("low")), F.array(F.regexp_extract("line", r"low=\s*([-0-9.eE+]+)", 1).try_cast("double"))))
            .when(F.col("section") == "DIRICHLET", F.map_from_arrays(F.array(F.lit("delta_energy")), F.array(F.regexp_extract("line", r"mean=\s*([-0-9.eE]+)", 1).try_cast("double"))))
            .when(F.col("section") == "DRIFT", F.map_from_arrays(F.array(F.lit("pert_mean_cos")), F.array(num(2)))))
    d = s.where(typ.isin(*SUMMARY_TYPES)).select("worker", "section", F.when(F.col("section") == "CONFUSION", F.col("condition")).alias("condition"), typ.alias("type"), F.explode(vals).alias("metric", "value"))
    return d.where(F.col("value").isNotNull())


def mean_over_workers(rows):
    """Unweighted mean of the workers' rates per type, in the fixed display order."""
    order = F.array_position(F.array(*[F.lit(t) for t in SUMMARY_TYPES]), F.col("type")).cast("int")
    return rows.groupBy("type").agg(F.avg("avg_rate").alias("avg_rate"), F.avg("ve_rate").alias("ve_rate"), F.count("*").alias("workers")).withColumn("position", order).orderBy("position")


def write_logs(lines, path):
    """One text file per worker from (worker, line_no, line) rows: a report is short, so one task writes one report."""
    ordered = lines.repartition("worker").sortWithinPartitions("worker", "line_no")
    ordered.select("worker", F.col("line").alias("value")).write.mode("overwrite").partitionBy("worker").text(path)
