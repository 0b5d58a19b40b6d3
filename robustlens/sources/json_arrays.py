"""Splittable scan of files that each hold one top-level JSON array of objects.

Spark's text scan cuts the bytes at every closing brace, so one large file is read by many tasks. Whether such a fragment begins inside a string, and at
which depth, follows from prefix sums: over the fragments of a byte range, then over one summary row a range. A fragment that comes back to the array's
own depth ends a record. Records are put together within their range; only those that cross a border of ranges are grouped a second time.

That is for files too large for one value. A smaller one is parsed whole in one step, and counts only if it is surely one array of objects that fit.
"""
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import materialize

_BROKEN = "__broken"
_END = "__end"
WHOLE_BYTES = 16 << 20      # a file up to this size is one value; a packed one takes up to a 16th
_PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def _fragments(spark, path, keep):
    """(path, block, pos, value, size, quotes, out, within): `out` and `within` are the changes of depth for a start outside and inside a string."""
    rows = spark.read.option("lineSep", "}").text(path)
    rows = (rows if keep is None else rows.where(keep)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.translate(plain, '"', ""))

    def change(text, odd):
        open_text = F.regexp_replace(text, '"[^"]*("|$)', "")
        brackets = F.length(F.translate(open_text, "]", "")) - F.length(F.translate(open_text, "{[", ""))
        return (brackets - F.when(quotes % 2 == odd, 1).otherwise(0)).cast("long")
    return rows.select("*", (F.octet_length("value") + 1).cast("long").alias("size"), (quotes % 2).alias("quotes"), change(plain, 0).alias("out"), change(F.concat(F.lit('"'), plain), 1).alias("within"))


def _run(fragments):
    """Running sums within a byte range: `odd` is the quote parity before a fragment, `begin` its offset, `d0` and `d1` the depth after it."""
    upto = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    f = fragments.withColumn("odd", (F.sum("quotes").over(upto) - F.col("quotes")) % 2).withColumn("begin", F.sum("size").over(upto) - F.col("size"))
    even = F.col("odd") == 0
    return f.withColumn("d0", F.sum(F.when(even, F.col("out")).otherwise(F.col("within"))).over(upto)).withColumn(
        "d1", F.sum(F.when(even, F.col("within")).otherwise(F.col("out"))).over(upto))


def _starts(fragments):
    """(path, block, inside, depth, offset) where each byte range begins; one row a range."""
    last = F.max_by(F.struct("d0", "d1"), "pos")
    ranges = _run(fragments.drop("value")).groupBy("path", "block").agg((F.sum("quotes") % 2).alias("quotes"), last.alias("d"), F.sum("size").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    gain = F.when(F.col("inside") == 0, F.col("d.d0")).otherwise(F.col("d.d1"))
    ranges = ranges.withColumn("gain", gain).withColumn("depth", F.coalesce(F.sum("gain").over(before), F.lit(0))).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # The last fragment of a file has no brace behind it but counts one, so a closed array leaves depth -1.
    last_range = F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()
    fail = F.raise_error(F.concat(F.lit("JSON array is not closed: "), "path", F.lit(" at byte "), (F.col("offset") + F.col("size") - 1).cast("string"))).cast("boolean")
    ranges = ranges.withColumn("last", last_range).where(F.when(F.col("last") & (F.col("depth") + F.col("gain") != -1), fail).otherwise(True))
    return ranges.select("path", "block", "inside", "depth", "offset")


def array_records(spark, path, keep=None):
    """(path, offset, text) of every object in the arrays; offset counts bytes from the file's begin. `keep` is a condition on `_metadata` that files meet.

    A blank file and an empty array give no row. An element that is no object, a missing comma, a file that is no array, one that is not closed and
    anything behind the closing bracket fail the scan with path and offset. Memory follows the longest record and the size of a byte range
    (`spark.sql.files.maxPartitionBytes`). The pieces are written once to the shared folder.
    """
    fragments = _fragments(spark, path, keep)
    starts = materialize(spark, _starts(fragments), "ranges")
    f = _run(fragments).join(starts, ["path", "block"])
    inside = (F.col("odd") + F.col("inside") + F.col("quotes")) % 2
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    f = f.withColumn("ended", ((depth == 1) & (inside == 0)).cast("int"))
    upto = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("n", F.sum("ended").over(upto) - F.col("ended"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "value")))
    pieces = f.groupBy("path", "block", "n").agg(F.max("ended").alias("ended"), F.min(F.col("offset") + F.col("begin")).alias("offset"), parts.alias("parts"))
    pieces = materialize(spark, pieces.select("path", "block", "n", "ended", "offset", F.concat(F.array_join("parts.value", "}"), F.lit("}")).alias("text")), "pieces")

    whole = (F.col("n") > 0) & (F.col("ended") == 1)
    order = Window.partitionBy("path").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    edges = pieces.where(~whole).withColumn("no", F.sum("ended").over(order) - F.col("ended"))
    sewn = edges.groupBy("path", "no").agg(F.max("ended").alias("ended"), F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("parts"))
    sewn = sewn.select("path", "offset", "ended", (F.col("no") == 0).alias("first"), F.array_join("parts.text", "").alias("text"))
    rows = sewn.unionByName(pieces.where(whole).select("path", "offset", "ended", F.lit(False).alias("first"), "text"))

    opens = F.when(F.col("first"), F.col("text").rlike(r"^\s*\[\s*\{")).otherwise(F.col("text").rlike(r"^\s*,\s*\{"))
    closes = F.when(F.col("first"), F.col("text").rlike(r"^\s*(\[\s*\]\s*)?\}$")).otherwise(F.col("text").rlike(r"^\s*\]\s*\}$"))
    fail = F.raise_error(F.concat(F.lit("no JSON array of objects: "), "path", F.lit(" at byte "), F.col("offset").cast("string"))).cast("boolean")
    is_record = F.when((F.col("ended") == 1) & opens, True).when((F.col("ended") == 0) & closes, False).otherwise(fail)
    body = F.regexp_replace("text", r"^\s*[\[,]\s*", "")
    return rows.where(is_record).select("path", (F.col("offset") + F.octet_length("text") - F.octet_length(body)).alias("offset"), body.alias("text"))


def _struct(schema):
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def small_files(spark):
    """Condition on `_metadata`: the file is parsed whole. No file beyond a byte range is, so a larger one is still read by several tasks."""
    ranges = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = F.when(F.col("_metadata.file_name").rlike(_PACKED), F.col("_metadata.file_size") * 16).otherwise(F.col("_metadata.file_size"))
    return size <= min(WHOLE_BYTES, ranges)


def whole_files(spark, path, schema):
    """(path, ok, r) from the small files: a row per object, or one row that is not `ok` for a file that `array_records` has to judge.

    Spark's parser ignores what stands behind the first value. So the file's text is the first of two elements of an outer array, whose second holds
    a mark no file can know; both must come out, which leaves exactly one array in the file.
    """
    mark = uuid.uuid4().hex
    element = StructType([*_struct(schema).fields, StructField(_END, StringType())])
    outer = StructType([StructField("a", ArrayType(ArrayType(element))), StructField(_BROKEN, StringType())])
    files = spark.read.text(path, wholetext=True).where(small_files(spark)).select(F.col("_metadata.file_path").alias("path"), "value")
    text = F.concat(F.lit('{"a": ['), "value", F.lit(f', [{{"{_END}": "{mark}"}}]]}}'))
    parsed = files.where(F.trim("value", F.lit(" \t\r\n")) != "").select("path", F.from_json(text, outer, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("p"))
    parts = parsed.select("path", F.col(f"p.{_BROKEN}").isNull().alias("fits"), F.col("p.a").alias("a"))
    ok = (F.col("fits") & (F.size("a") == 2) & F.get("a", F.lit(0)).isNotNull() & (F.get(F.get("a", F.lit(1)), F.lit(0))[_END] == mark)
          & ~F.exists(F.get("a", F.lit(0)), lambda r: r.isNull() | r[_END].isNotNull()))
    judged = parts.select("path", F.coalesce(ok, F.lit(False)).alias("ok"), F.get("a", F.lit(0)).alias("a"))
    # an array of a null stands for a file that is not ok; an empty array gives no row
    rows = judged.select("path", "ok", F.explode(F.when(F.col("ok"), F.col("a")).otherwise(F.array(F.lit(None).cast(element)))).alias("r"))
    return rows.select("path", "ok", F.struct(*[F.col("r")[f.name].alias(f.name) for f in _struct(schema).fields]).alias("r"))


def read_arrays(spark, path, schema):
    """Columns of `schema` from every object in the arrays. Small files are parsed whole and written once, larger ones are read by byte ranges. If the
    whole parse finds anything amiss, all files are read by byte ranges, which gives their rows or fails with path and offset."""
    whole = materialize(spark, whole_files(spark, path, schema), "whole")
    if not whole.where("NOT ok").isEmpty():
        return parse_records(array_records(spark, path), schema)
    rows = whole.select(*[F.col("r")[f.name].alias(f.name) for f in _struct(schema).fields])
    large = ~small_files(spark)
    if spark.read.format("binaryFile").load(path).where(large).select("path").isEmpty():
        return rows
    return rows.unionByName(parse_records(array_records(spark, path, large), schema))


def parse_records(records, schema):
    """Columns of `schema` from (path, offset, text); a record that does not fit it fails with its offset."""
    schema = _struct(schema)
    marked = StructType([*schema.fields, StructField(_BROKEN, StringType())])
    parsed = records.select("path", "offset", F.from_json("text", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("r"))
    fail = F.raise_error(F.concat(F.lit("broken JSON record: "), "path", F.lit(" at byte "), F.col("offset").cast("string"))).cast("boolean")
    return parsed.where(F.when(F.col(f"r.{_BROKEN}").isNull(), True).otherwise(fail)).select(*[F.col("r")[name].alias(name) for name in schema.names])
