"""File scans. Every scan is splittable where the format allows it and carries its schema."""
import io

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.labels import letter_labels, parse_options
from . import schemas
from .json_arrays import read_arrays


def read_jsonl(spark, path, schema, streaming=False):
    """JSON lines with a declared schema; blank lines give no row, a malformed one fails the scan, a missing path gives an empty table."""
    try:
        reader = spark.readStream if streaming else spark.read
        df = reader.schema(schema).option("mode", "FAILFAST").json(path)
        df.columns
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_json_arrays(spark, path, schema):
    """Files that each hold one top-level JSON array of objects, large ones read by byte ranges (`json_arrays`); a broken record fails the scan with its offset."""
    return read_arrays(spark, path, schema)


def to_parquet(spark, df, name):
    from ..session import materialize
    return materialize(spark, df, name)


def read_split(spark, root, split):
    """Parquet shards named <split>-*.parquet anywhere under a root."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{split}-*.parquet").parquet(root)


def yes_no_items(shards, dataset="yes_no"):
    """Yes/no benchmark rows with image bytes; the id falls back from question_id to id to the image path."""
    rid = F.coalesce(F.col("question_id").cast("string"), F.col("id").cast("string"), F.concat(F.lit("row:"), F.col("image.path")))
    return shards.where(F.col("image.bytes").isNotNull() & (F.length("image.bytes") > 0)).select(
        rid.alias("item_id"), F.lit(dataset).alias("dataset"), F.trim("question").alias("question"), "category",
        F.when(F.lower(F.trim("answer")) == "yes", "A").when(F.lower(F.trim("answer")) == "no", "B").alias("answer_label"),
        F.create_map(F.lit("A"), F.lit("Yes"), F.lit("B"), F.lit("No")).alias("options"), F.array("image").alias("images"))


def multi_images(df, n=7):
    """image_1..image_n -> array of the images that have bytes."""
    return df.withColumn("images", F.filter(F.array(*[F.col(f"image_{i}") for i in range(1, n + 1)]), lambda x: x["bytes"].isNotNull()))


def choice_items(shards, n_images=7):
    """Multiple-choice rows: literal option strings become lettered options; two options and an image are required."""
    d = multi_images(shards, n_images).withColumn("_o", parse_options("options"))
    d = d.where((F.size("_o") >= 2) & (F.size("images") > 0))
    return d.select(F.col("id").alias("item_id"), "question", F.map_from_arrays(letter_labels(F.col("_o")), F.col("_o")).alias("options"),
                    F.upper(F.trim("answer")).alias("answer_label"), "images")


def read_delimited(spark, path, schema, sep="\t"):
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def wide_option_items(tsv, letters="ABCDEFGHIJKLMNOPQRSTUVWXYZ", answers=("answer", "answer_label", "label", "gt"), categories=("category", "type", "ability")):
    """TSV rows with wide option columns and alternative answer and category columns (first non-empty wins)."""
    have = [c for c in letters if c in tsv.columns]
    options = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in have]), F.array(*[F.col(c) for c in have])), lambda k, v: v.isNotNull() & (F.trim(v) != ""))

    def first(cols):
        return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in cols if c in tsv.columns], F.lit(None).cast("string"))
    return tsv.select(F.col("index").alias("item_id"), "question", options.alias("options"), first(answers).alias("answer"), first(categories).alias("category"))


def decode_images(tsv, column="image"):
    """Base64 column -> binary; undecodable rows are dropped."""
    return tsv.withColumn("image_bytes", F.try_to_binary(F.col(column), F.lit("base64"))).drop(column).where(F.col("image_bytes").isNotNull() & (F.length("image_bytes") > 0))


def manifest_frames(manifest):
    """One row per frame with the defaults filled: gt boxes from boxes, gt masks from the single mask."""
    f = manifest.select("id", "split", "text_prompt", "concept", F.coalesce("concept_present", F.lit(True)).alias("concept_present"), F.posexplode("frames").alias("frame_no", "f"))
    no_boxes = F.col("f.gt_boxes_all").isNull() | (F.size("f.gt_boxes_all") == 0)
    no_masks = F.col("f.gt_masks_all").isNull() | (F.size("f.gt_masks_all") == 0)
    return f.select("id", "split", "text_prompt", "concept", "concept_present", "frame_no", "f.image", "f.mask", "f.instance_id", "f.boxes",
                    F.when(no_boxes, F.col("f.boxes")).otherwise(F.col("f.gt_boxes_all")).alias("gt_boxes_all"),
                    F.when(no_masks & F.col("f.mask").isNotNull(), F.array("f.mask")).otherwise(F.col("f.gt_masks_all")).alias("gt_masks_all"))


def coco_annotations(docs):
    """Images, annotations and categories of annotation documents, joined to one row per annotation."""
    im = docs.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    an = docs.select(F.explode("annotations").alias("a")).select("a.*")
    ca = docs.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category")).distinct()
    rows = an.join(ca, "category_id", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    return im.join(rows, "image_id", "left")


def scene_tables(graphs):
    """Object and relation edge tables of scene-graph documents."""
    o = graphs.select("image_id", F.explode("objects").alias("oid", "o"))
    objects = o.select("image_id", "oid", "o.name", "o.attributes")
    relations = o.select("image_id", F.col("oid").alias("subject"), F.explode("o.relations").alias("r")).select(
        "image_id", "subject", F.col("r.object").alias("target"), F.col("r.name").alias("relation"))
    return objects, relations


def synthetic_tables(scenes):
    """Object table and (relation, target, reference) edges of synthetic scenes."""
    objects = scenes.select("image_index", F.posexplode("objects").alias("idx", "o")).select("image_index", "idx", "o.*")
    edges = scenes.select("image_index", F.explode("relationships").alias("relation", "adj")).select("image_index", "relation", F.posexplode("adj").alias("target", "refs"))
    return objects, edges.select("image_index", "relation", "target", F.explode("refs").alias("ref"))


def has_relation(pairs, edges):
    """Pairs (image_index, relation, target, ref) that hold: a left-semi join on the edge table."""
    return pairs.join(edges, ["image_index", "relation", "target", "ref"], "left_semi")


def filter_bank(records, group="overall"):
    """(item, level, w) from nested filter records; a named layer group or the overall filter."""
    lv = records.select(F.col("image_id").alias("item_id"), F.explode("levels").alias("level", "f"))
    w = F.col("f.W_t") if group == "overall" else F.try_element_at("f.layer_groups", F.lit(group))["W_t"]
    return lv.select("item_id", "level", w.alias("w")).where(F.col("w").isNotNull() & (F.size("w") > 0))


def encode_array(array_col, h, w, key="a"):
    """Grid -> compressed array bytes, the content of one sidecar file."""
    @F.pandas_udf("binary")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for v in col:
            buf = io.BytesIO()
            np.savez_compressed(buf, **{key: np.asarray(v, dtype=float).reshape(h, w)})
            out.append(buf.getvalue())
        return pd.Series(out)
    return run(array_col)


def decode_arrays(files, key="a"):
    """Sidecar files (path, content) -> (path, h, w, data); missing key or corrupt content gives nulls."""
    @F.pandas_udf("struct<h: int, w: int, data: array<double>>")
    def run(col: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in col:
            try:
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    a = np.asarray(z[key], dtype=float)
                rows.append((a.shape[0], a.shape[1], a.ravel().tolist()))
            except Exception:
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["h", "w", "data"]).astype({"h": "Int32", "w": "Int32"})
    return files.select("path", run("content").alias("a")).select("path", "a.*")


def discover_runs(spark, root, include_sanity=False):
    """Summaries of all runs under a root, once per path; 'sanity' runs are left out on request."""
    df = spark.read.schema(schemas.RUN_SUMMARY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    df = df.withColumn("path", F.col("_metadata.file_path")).dropDuplicates(["path"])
    return df if include_sanity else df.where(~F.lower("path").contains("sanity"))


# the fixed dispatch of dataset names to item builders
LOADERS = {"yes_no": yes_no_items, "choice": choice_items, "wide_tsv": wide_option_items}


def load_items(name, table, **options):
    key = name.strip().lower()
    if key not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}; expected one of {sorted(LOADERS)}")
    return LOADERS[key](table, **options)
