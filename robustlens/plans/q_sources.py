"""S and U: each query lets Spark write the exchanged format from the given tables and scans it back."""
from pyspark.sql import functions as F

from ..functions.arrays import asum, doubles
from ..functions.numeric import r6
from ..functions.wordlists import SUMMARY_TYPES
from ..operators import aggregates as ag
from ..operators import topk as tk
from ..operators import trials as tr
from ..session import materialize, scratch_path, shared_dir
from ..sources import logs, readers, schemas, sinks
from . import bindings as b
from .q_aggregates import _TRANS, outcomes, rounded
from .registry import query
from .sqlkit import DIV0, H, HI, R


def record_rows(spark, sf):
    """Nested records with text level keys, as they stand in JSON."""
    return b.records(spark, sf).withColumn("levels", F.transform_keys("levels", lambda k, v: k.cast("string")))


_FLAT = f"""WITH {b.RECORDS_SQL} SELECT level_no, perturbation, CAST(count(*) AS BIGINT) AS n, {R('sum(loglik_drift)')} AS total_drift, {R('sum(accuracy_drop)')} AS total_drop FROM rp WHERE loglik_drift IS NOT NULL GROUP BY 1, 2"""


def flat_totals(records):
    rows = tr.flatten_records(records).withColumn("level_no", F.col("level_no").cast("int"))
    return rows.groupBy("level_no", "perturbation").agg(F.count("*").alias("n"), r6(F.sum("loglik_drift")).alias("total_drift"), r6(F.sum("accuracy_drop")).alias("total_drop"))


@query("s01_jsonl_scan", _FLAT)
def s01(spark, sf):
    path = scratch_path(spark, "records")
    sinks.write_jsonl(record_rows(spark, sf), path, packed=True)
    return flat_totals(readers.read_jsonl(spark, path, schemas.RECORD))


@query("s02_json_array_scan", _FLAT)
def s02(spark, sf):
    path = scratch_path(spark, "arrays")
    sinks.write_json_arrays(record_rows(spark, sf), path, packed=True)
    return flat_totals(readers.read_json_arrays(spark, path, schemas.RECORD))     # written once by the scan


def image(cond, key):
    return f"CASE WHEN {cond} THEN named_struct('bytes', CAST({key} AS BINARY), 'path', CONCAT({key}, '.png')) END"


@query("s03_yes_no_shards", """SELECT CASE WHEN page_id % 4 <> 0 THEN concat('q', page_id) WHEN page_id % 8 <> 0 THEN concat('i', page_id) ELSE concat('row:', 'img', page_id, '.png') END AS item_id, CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END AS answer_label,
  length(trim(concat('Is ', url, ' there?'))) AS question_length, CAST(length(concat('img', page_id)) AS INT) AS n_bytes FROM pages WHERE page_id % 5 <> 0""")
def s03(spark, sf):
    shards = b.table(spark, sf, "pages").selectExpr(
        "CASE WHEN page_id % 4 <> 0 THEN concat('q', page_id) END AS question_id", "CASE WHEN page_id % 8 <> 0 THEN concat('i', page_id) END AS id", "concat(' Is ', url, ' there?') AS question",
        "CASE WHEN page_id % 2 = 0 THEN ' Yes' ELSE 'no' END AS answer", "'objects' AS category",
        "named_struct('bytes', CASE WHEN page_id % 5 <> 0 THEN CAST(concat('img', page_id) AS BINARY) END, 'path', concat('img', page_id, '.png')) AS image")
    path = scratch_path(spark, "yesno")
    shards.write.parquet(path)
    items = readers.load_items("yes_no", spark.read.schema(shards.schema).parquet(path))
    return items.select("item_id", "answer_label", F.length("question").cast("long").alias("question_length"), F.length(F.col("images")[0]["bytes"]).alias("n_bytes"))


_IMG = ", ".join(f"CASE WHEN p_partkey % {i + 1} = 0 THEN named_struct('bytes', CAST(concat('i', {i}) AS BINARY), 'path', 'x.png') ELSE named_struct('bytes', CAST(NULL AS BINARY), 'path', 'x.png') END AS image_{i}" for i in range(1, 8))


@query("s04_choice_shards", """SELECT concat('m', p_partkey) AS item_id, concat('A=', p_type, ';B=', p_brand) AS options, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS answer_label FROM part
WHERE p_partkey % 6 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0)""")
def s04(spark, sf):
    src = b.table(spark, sf, "part").selectExpr(
        "concat('m', p_partkey) AS id", "p_name AS question", """CASE WHEN p_partkey % 6 = 0 THEN concat("['", p_type, "']") ELSE concat("['", p_type, "', '", p_brand, "']") END AS options""",
        "CASE WHEN p_size % 2 = 0 THEN 'a ' ELSE 'B' END AS answer", *_IMG.split(", CASE")[:1], *["CASE" + x for x in _IMG.split(", CASE")[1:]])
    root = scratch_path(spark, "choice")
    src.write.parquet(f"{root}/validation")
    sinks.rename_parts(spark, f"{root}/validation", "validation")
    src.limit(5).write.parquet(f"{root}/dev")
    sinks.rename_parts(spark, f"{root}/dev", "dev")
    items = readers.load_items("choice", readers.read_split(spark, root, "validation"))
    pairs = F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return items.select("item_id", F.array_join(pairs, ";").alias("options"), "answer_label")


_TSV = "index BIGINT, image STRING, question STRING, A STRING, B STRING, C STRING, answer STRING, gt STRING, category STRING, ability STRING"


def tsv_source(spark, sf):
    return b.table(spark, sf, "part").selectExpr(
        "p_partkey AS index", "CASE WHEN p_partkey % 9 = 0 THEN '*bad*' ELSE base64(CAST(p_name AS BINARY)) END AS image", "p_name AS question", "p_brand AS A", "p_type AS B",
        "CASE WHEN p_size % 3 = 0 THEN ' ' ELSE lower(p_type) END AS C", "CASE WHEN p_partkey % 2 = 0 THEN 'A' END AS answer", "'B' AS gt", "CAST(NULL AS STRING) AS category", "concat('cap', p_size % 4) AS ability")


def tsv_table(spark, sf):
    path = scratch_path(spark, "tsv")
    src = tsv_source(spark, sf)
    sinks.write_delimited(src, path, src.columns, "\t")
    return readers.read_delimited(spark, path, _TSV)


@query("s05_wide_option_tsv", "SELECT p_partkey AS item_id, CAST(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 3 END AS INT) AS n_options, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS answer, concat('cap', p_size % 4) AS category FROM part")
def s05(spark, sf):
    i = readers.load_items("wide_tsv", tsv_table(spark, sf))
    return i.select("item_id", F.size("options").alias("n_options"), "answer", "category")


@query("s06_base64_images", "SELECT p_partkey AS item_id, p_name AS decoded FROM part WHERE p_partkey % 9 <> 0")
def s06(spark, sf):
    d = readers.decode_images(tsv_table(spark, sf))
    d = materialize(spark, d.select(F.col("index").alias("item_id"), "image_bytes"), "images")
    return d.select("item_id", F.col("image_bytes").cast("string").alias("decoded"))


@query("s07_multi_images", f"SELECT p_partkey AS item_id, CAST({' + '.join(f'(p_partkey % {i + 1} = 0)::INT' for i in range(1, 8))} AS INT) AS n_images, array_to_string(list_filter([{', '.join(f'CASE WHEN p_partkey % {i + 1} = 0 THEN {chr(39)}i{i}{chr(39)} END' for i in range(1, 8))}], lambda x: x IS NOT NULL), ',') AS images FROM part")
def s07(spark, sf):
    src = b.table(spark, sf, "part").selectExpr("p_partkey AS item_id", *_IMG.split(", CASE")[:1], *["CASE" + x for x in _IMG.split(", CASE")[1:]])
    m = readers.multi_images(src)
    return m.select("item_id", F.size("images").alias("n_images"), F.array_join(F.transform("images", lambda x: x["bytes"].cast("string")), ",").alias("images"))


_MAN = """WITH f AS (SELECT l_orderkey AS id, l_linenumber AS k, max(l_quantity) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)"""


def manifest_source(spark, sf):
    """Samples with one frame per line number; some frames carry explicit ground truth, others rely on defaults."""
    f = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").alias("s"), F.min("l_partkey").alias("p"))
    box = "named_struct('x0', 0D, 'y0', 0D, 'x1', s, 'y1', s + 1)"
    frame = f"""named_struct('image', concat('f', k, '.png'), 'mask', CASE WHEN p % 5 <> 0 THEN array(CAST(p % 64 AS INT)) END, 'instance_id', CAST(p % 3 AS INT), 'boxes', array({box}),
      'gt_boxes_all', CASE WHEN k % 2 = 0 THEN array({box}, {box}) END, 'gt_masks_all', CASE WHEN k % 3 = 0 THEN array(array(1), array(2)) ELSE array() END)"""
    f = f.select("id", "k", F.expr(frame).alias("frame"))
    g = f.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "frame"))).alias("fr"))   # one frame per line number, at most seven
    return g.select(F.col("id").cast("string").alias("id"), F.lit("val").alias("split"), F.lit("the part").alias("text_prompt"), F.lit("part").alias("concept"),
                    F.expr("CASE WHEN id % 4 = 0 THEN false WHEN id % 4 = 1 THEN true END").alias("concept_present"), F.transform("fr", lambda x: x["frame"]).alias("frames"))


@query("s08_manifest_frames", f"""{_MAN} SELECT id % 4 <> 0 AS concept_present, CAST(k AS INT) % 2 AS odd_frame, CAST(count(*) AS BIGINT) AS frames, CAST(sum(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS gt_boxes, CAST(sum(CASE WHEN k % 3 = 0 THEN 2 WHEN p % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS gt_masks FROM f GROUP BY 1, 2""")
def s08(spark, sf):
    path = scratch_path(spark, "manifest")
    sinks.write_jsonl(manifest_source(spark, sf), path)
    f = readers.manifest_frames(readers.read_jsonl(spark, path, schemas.MANIFEST))
    k = F.regexp_extract("image", "([0-9]+)", 1).cast("int")
    return f.groupBy("concept_present", (k % 2).alias("odd_frame")).agg(F.count("*").alias("frames"), F.sum(F.size("gt_boxes_all")).alias("gt_boxes"),
                                                                        F.sum(F.coalesce(F.size("gt_masks_all"), F.lit(0))).alias("gt_masks"))


@query("s09_annotation_documents", """SELECT o_orderkey AS image_id, CAST(count(l_orderkey) AS BIGINT) AS n_annotations, round(coalesce(sum(l_quantity), 0), 6) + 0e0 AS total_area, coalesce(max(CASE WHEN l_linenumber <= 5 THEN concat('cat', l_linenumber) WHEN l_linenumber IS NOT NULL THEN 'unknown' END), 'none') AS last_category
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def s09(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 64).alias("shard"))
    li = b.table(spark, sf, "lineitem")
    im = o.groupBy("o_orderkey", "shard").agg(F.lit(1)).select("shard", F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("file_name"), F.lit(8).alias("width"), F.lit(8).alias("height")).alias("x"))
    an = li.select((F.col("l_orderkey") % 64).alias("shard"), F.struct(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("category_id"), F.col("l_quantity").alias("area"), F.array(F.lit(0.0)).alias("bbox")).alias("x"))
    # one document per annotation line keeps every document small
    cats = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"cat{i}").alias("name"), F.lit("s").alias("supercategory")) for i in range(1, 6)])
    docs = im.select(F.array("x").alias("images"), F.expr("CAST(array() AS ARRAY<STRUCT<image_id: BIGINT, category_id: INT, area: DOUBLE, bbox: ARRAY<DOUBLE>>>)").alias("annotations"), cats.alias("categories")).unionByName(
        an.select(F.expr("CAST(array() AS ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT>>)").alias("images"), F.array("x").alias("annotations"), cats.alias("categories")))
    path = scratch_path(spark, "coco")
    sinks.write_jsonl(docs, path, packed=True)
    rows = readers.coco_annotations(readers.read_jsonl(spark, path, schemas.COCO))
    return rows.groupBy("image_id").agg(F.count("area").alias("n_annotations"), r6(F.coalesce(F.sum("area"), F.lit(0.0))).alias("total_area"), F.coalesce(F.max("category"), F.lit("none")).alias("last_category"))


def graph_source(spark, sf):
    so = b.scene_objects(spark, sf)
    rel = b.scene_relations(so).groupBy("scene", F.col("subject").alias("oid")).agg(F.collect_list(F.struct(F.col("relation").alias("name"), F.col("target").cast("string").alias("object"))).alias("relations"))
    o = so.join(rel, ["scene", "oid"], "left")
    st = F.struct("name", F.array("adj", "kind").alias("attributes"), F.coalesce("relations", F.expr("CAST(array() AS ARRAY<STRUCT<name: STRING, object: STRING>>)")).alias("relations"))
    e = F.struct(F.col("oid").cast("string").alias("key"), st.alias("value"))
    return o.groupBy("scene").agg(F.map_from_entries(F.collect_list(e)).alias("objects")).select(F.col("scene").cast("string").alias("image_id"), "objects")   # a scene holds at most seven objects


@query("s10_scene_graph_scan", f"""WITH {b.SCENE_SQL} SELECT s.name AS subject_name, relation, t.name AS target_name, CAST(count(*) AS BIGINT) AS n FROM rel JOIN so s ON s.scene = rel.scene AND s.oid = subject JOIN so t ON t.scene = rel.scene AND t.oid = target GROUP BY 1, 2, 3""")
def s10(spark, sf):
    path = scratch_path(spark, "graphs")
    sinks.write_jsonl(graph_source(spark, sf), path)
    o, r = readers.scene_tables(readers.read_jsonl(spark, path, schemas.SCENE_GRAPH))
    s = o.select("image_id", F.col("oid").alias("subject"), F.col("name").alias("subject_name"))
    t = o.select("image_id", F.col("oid").alias("target"), F.col("name").alias("target_name"))
    return r.join(s, ["image_id", "subject"]).join(t, ["image_id", "target"]).groupBy("subject_name", "relation", "target_name").agg(F.count("*").alias("n"))


@query("s11_synthetic_scene_scan", """WITH n AS (SELECT l_orderkey AS scene, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT relation, CAST(sum(n - 1) AS BIGINT) AS edges, CAST(sum((n >= 2)::INT) AS BIGINT) AS first_holds FROM n, (VALUES ('left'), ('front')) v(relation) GROUP BY relation""")
def s11(spark, sf):
    n = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_index")).agg(F.size(F.collect_set("l_linenumber")).alias("n"))
    obj = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.lit("small").alias("size"), F.lit("red").alias("color"), F.lit("metal").alias("material"), F.lit("cube").alias("shape")))
    left = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i < F.col("n"), F.array(i)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)")))
    front = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i > 1, F.array(i - 2)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)")))
    scenes = n.select("image_index", obj.alias("objects"), F.create_map(F.lit("left"), left, F.lit("front"), front).alias("relationships"))
    path = scratch_path(spark, "scenes")
    sinks.write_jsonl(scenes, path)
    o, e = readers.synthetic_tables(readers.read_jsonl(spark, path, schemas.SYNTHETIC_SCENE))
    first = o.where("idx = 0").select("image_index", F.explode(F.array(F.struct(F.lit("left").alias("relation"), F.lit(0).alias("target"), F.lit(1).alias("ref")), F.struct(F.lit("front").alias("relation"), F.lit(1).alias("target"), F.lit(0).alias("ref")))).alias("p")).select("image_index", "p.*")
    holds = readers.has_relation(first, e).groupBy("relation").agg(F.count("*").alias("first_holds"))
    return e.groupBy("relation").agg(F.count("*").alias("edges")).join(holds, "relation")


@query("s12_filter_bank", f"""WITH {b.FILTERS_SQL} SELECT item_id, level_no, 'overall' AS grp, {R('w[1]')} AS w1, {R('w[8]')} AS w8 FROM filters UNION ALL SELECT item_id, level_no, 'late', {R('w[8]')}, {R('w[1]')} FROM filters WHERE item_id % 2 = 0""")
def s12(spark, sf):
    f = b.filters(spark, sf)
    late = F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("late"), F.struct(F.reverse("w").alias("W_t"))))
    rec = f.select(F.col("item_id").alias("image_id"), F.create_map(F.col("level_no").cast("string"), F.struct(F.col("w").alias("W_t"), late.alias("layer_groups"))).alias("levels"))
    path = scratch_path(spark, "filters")
    sinks.write_json_arrays(rec, path)
    records = readers.to_parquet(spark, readers.read_json_arrays(spark, path, schemas.FILTER_RECORD), "filters")
    parts = [readers.filter_bank(records, g).withColumn("grp", F.lit(g)) for g in ("overall", "late")]
    u = parts[0].unionByName(parts[1])
    return u.select("item_id", F.col("level").cast("int").alias("level_no"), "grp", r6(F.element_at("w", 1)).alias("w1"), r6(F.element_at("w", -1)).alias("w8"))


@query("s13_array_sidecars", f"SELECT concat('v', vec_id) AS path, CASE WHEN vec_id % 10 <> 0 THEN 8 END AS h, CASE WHEN vec_id % 10 <> 0 THEN 8 END AS w, {R('CASE WHEN vec_id % 10 <> 0 THEN list_sum(CAST(embedding AS DOUBLE[])) END')} AS total FROM embeddings")
def s13(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("path"), "vec_id", readers.encode_array("embedding", 8, 8).alias("content"))
    e = e.withColumn("content", F.when(F.col("vec_id") % 10 == 0, F.lit("broken").cast("binary")).otherwise(F.col("content")))
    d = readers.decode_arrays(e)
    return d.select("path", "h", "w", r6(F.when(F.col("data").isNotNull(), asum("data"))).alias("total"))


_TYPE = "CASE l_linenumber % 6 WHEN 0 THEN 'Translation' WHEN 1 THEN 'Pad/Crop' WHEN 2 THEN 'Scale' WHEN 3 THEN 'Scale+Pad' WHEN 4 THEN 'Rotation' ELSE 'TextOverlay' END"
b.TRIAL_EXTRA["type"] = _TYPE
b.TRIAL_EXTRA["worker"] = "CAST(l_suppkey % 4 AS INT)"


def log_path(spark, sf):
    """Per-worker summary reports in the fixed layout, written from the trials."""
    t = outcomes(spark, sf, "type", "worker")
    cell = t.groupBy("worker", "type", "item_id").agg(F.sum(F.col("changed").cast("long")).alias("c"), F.count("*").alias("n"), F.sum("loglik_drift").alias("d"))
    g = cell.groupBy("worker", "type").agg((F.sum("c") / F.sum("n")).alias("a"), (F.count_if(F.col("c") > 0) / F.count("*")).alias("v"), (F.sum("d") / F.sum("n")).alias("d"))
    tr_ = ag.transitions(t, "worker", "type")
    acc = t.groupBy("worker").agg(F.avg("clean_correct").alias("a"))
    pos = F.array_position(F.array(*[F.lit(x) for x in SUMMARY_TYPES]), F.col("type")).cast("int")

    def line(df, base, fmt, *cols):
        return df.select("worker", (F.lit(base) + pos).alias("line_no"), F.format_string(fmt, "type", *cols).alias("line"))
    heads = {1: "========== SUMMARY ==========", 3: "Type          AVg        Ve  (#img_affected / #img_used, #changed / #total)", 20: "Confusion vs ground truth (perturbation instances)",
             40: "Confusion vs ground truth (perturbation instances) [base pred=Yes, gt=Yes]", 60: "====== FREQUENCY ANALYSIS ======", 80: "====== DIRICHLET ANALYSIS ======", 100: "====== EMBEDDING DRIFT ANALYSIS ======"}
    h = F.explode(F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(v).alias("line")) for k, v in heads.items()]))
    parts = [acc.select("worker", h.alias("h")).select("worker", "h.*"),
             acc.select("worker", F.lit(2).alias("line_no"), F.format_string("Base accuracy vs ground truth: %.3f (1/2)", "a").alias("line")),
             line(g, 3, "%-12s  %8.3f  %8.3f  (1/2, 3/4)", "a", "v"), line(tr_, 20, "%-12s  %7d  %7d  %7d  %7d", "r2w", "w2r", "r2r", "w2w"),
             line(tr_, 40, "%-12s  %7d  %7d  %7d  %7d", "w2r", "r2w", "w2w", "r2r"), line(g, 60, "%-12s  low= %.3f", "a"), line(g, 80, "%-12s  mean= %.3f", "v"), line(g, 100, "%-12s  %.4f", "a")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    path = scratch_path(spark, "logs")
    logs.write_logs(out, path)
    return path


# rates in the reports carry three decimals; compare the parsed value with the exact one to that precision
_LOGS = f"""{b.T('type', 'worker')}, ce AS (SELECT worker, type, item_id, sum(changed::INT) AS c, count(*) AS n FROM tr GROUP BY 1, 2, 3), lg AS (SELECT worker, type, sum(c) / sum(n) AS a, avg((c > 0)::INT) AS v FROM ce GROUP BY 1, 2), lt AS (SELECT worker, type, {_TRANS} FROM tr GROUP BY 1, 2)"""


def F3(x):
    return f"(round(CAST({x} AS DOUBLE), 3) + 0e0)"


@query("s14_flip_table_logs", f"{_LOGS} SELECT worker, type, {F3('a')} AS avg_rate, {F3('v')} AS ve_rate FROM lg")
def s14(spark, sf):
    lines = logs.log_lines(spark, log_path(spark, sf))
    return logs.flip_rows(logs.sections(lines).where("section = 'FLIP'"))


@query("s15_sectioned_logs", f"""{_LOGS} SELECT worker, 'FLIP' AS section, NULL AS condition, type, 'avg_rate' AS metric, {F3('a')} AS value FROM lg UNION ALL SELECT worker, 'FLIP', NULL, type, 've_rate', {F3('v')} FROM lg
""" + " ".join(f"UNION ALL SELECT worker, 'CONFUSION', '{c}', type, '{m}', CAST({s} AS DOUBLE) FROM lt" for c, order in (("all", "r2w w2r r2r w2w"), ("base pred=Yes, gt=Yes", "w2r r2w w2w r2r"))
               for m, s in zip(("r2w", "w2r", "r2r", "w2w"), order.split())) + f""" UNION ALL SELECT worker, 'FREQUENCY', NULL, type, 'low', {F3('a')} FROM lg UNION ALL SELECT worker, 'DIRICHLET', NULL, type, 'delta_energy', {F3('v')} FROM lg
UNION ALL SELECT worker, 'DRIFT', NULL, type, 'pert_mean_cos', round(CAST(a AS DOUBLE), 4) FROM lg""")
def s15(spark, sf):
    return logs.section_rows(logs.log_lines(spark, log_path(spark, sf)))


@query("a40_mean_over_workers", f"{_LOGS}, r AS (SELECT type, worker, {F3('a')} AS a, {F3('v')} AS v FROM lg) SELECT type, {R('avg(a)')} AS avg_rate, {R('avg(v)')} AS ve_rate, CAST(count(*) AS BIGINT) AS workers, CAST(list_position(['Translation', 'Pad/Crop', 'Scale', 'Scale+Pad', 'Rotation', 'TextOverlay', 'Any'], type) AS INT) AS position FROM r GROUP BY type")
def a40(spark, sf):
    rows = logs.flip_rows(logs.sections(logs.log_lines(spark, log_path(spark, sf))).where("section = 'FLIP'"))
    return rounded(logs.mean_over_workers(rows), "avg_rate", "ve_rate")


@query("u1_worker_union", f"{b.T('type', 'worker')} SELECT worker, CAST(count(*) AS BIGINT) AS n, {R('sum(loglik_drift)')} AS total FROM tr GROUP BY worker")
def u1(spark, sf):
    t = outcomes(spark, sf, "worker")
    parts = [t.where(F.col("worker") == w).drop("worker").withColumn("worker", F.lit(w)) for w in range(4)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("worker").agg(F.count("*").alias("n"), r6(F.sum("loglik_drift")).alias("total"))


_RUNS = f"""{b.T('supp_id')}, ru AS (SELECT supp_id % 8 AS run, level_no, avg(clean_correct) AS c, avg(pert_correct) AS p, count(*) AS n FROM tr GROUP BY 1, 2)"""


def run_root(spark, sf):
    """One summary document per run under <root>/run=<n>/, one of them a sanity run."""
    t = outcomes(spark, sf, "supp_id").groupBy((F.col("supp_id") % 8).alias("run_no"), "level_no").agg(F.avg("clean_correct").alias("c"), F.avg("pert_correct").alias("p"), F.count("*").alias("n"))
    e = F.struct(F.col("level_no").cast("string").alias("key"), F.struct(F.col("c").alias("clean_accuracy"), F.col("p").alias("perturbed_accuracy"), F.col("n").alias("n")).alias("value"))
    d = t.groupBy("run_no").agg(F.map_from_entries(F.collect_list(e)).alias("per_level"))   # eight rungs
    d = d.select(F.when(F.col("run_no") == 7, "sanity7").otherwise(F.concat(F.lit("qwen"), F.col("run_no"))).alias("run"),
                 F.struct(F.struct(F.when(F.col("run_no") % 2 == 0, "big").alias("primary")).alias("model")).alias("config"), "per_level")
    root = scratch_path(spark, "runs")
    d.write.partitionBy("run").json(root)
    return root


@query("s16_run_discovery", f"{_RUNS} SELECT concat('qwen', run) AS run, CASE WHEN run % 2 = 0 THEN 'big' ELSE 'qwen' END AS model, CAST(count(*) AS BIGINT) AS levels, CAST(max(n) AS BIGINT) AS max_n FROM ru WHERE run <> 7 GROUP BY run")
def s16(spark, sf):
    from ..functions.labels import infer_from_path
    d = readers.discover_runs(spark, run_root(spark, sf)).withColumn("cfg", F.col("config.model.primary"))
    run = F.regexp_extract("path", "run=([^/]+)/", 1)
    n = F.array_max(F.transform(F.map_values("per_level"), lambda x: x["n"]))
    return d.select(run.alias("run"), infer_from_path("cfg", "path", (("llava", "llava"), ("qwen", "qwen"))).alias("model"), F.size("per_level").cast("long").alias("levels"), n.alias("max_n"))


@query("s26_named_statistics", f"{_RUNS} SELECT concat('qwen', run) AS run, {R('max(c) FILTER (WHERE level_no = 1)')} AS l1_clean, {R('max(p) FILTER (WHERE level_no = 4)')} AS l4_perturbed FROM ru WHERE run <> 7 GROUP BY run")
def s26(spark, sf):
    d = readers.discover_runs(spark, run_root(spark, sf))
    return d.select(F.regexp_extract("path", "run=([^/]+)/", 1).alias("run"), r6(F.try_element_at("per_level", F.lit("1"))["clean_accuracy"]).alias("l1_clean"),
                    r6(F.try_element_at("per_level", F.lit("4"))["perturbed_accuracy"]).alias("l4_perturbed"))


_SIGCSV = f"{b.T()} SELECT family, " + ", ".join(f"{R(f'avg(volatility) FILTER (WHERE severity = {s})')} AS s{s}" for s in (1, 2, 3)) + " FROM tr GROUP BY family"


def severity_csv(spark, sf, sep):
    g = outcomes(spark, sf).groupBy("family", "severity").agg(r6(F.avg("volatility")).alias("mean"), F.count("*").alias("n"))
    path = scratch_path(spark, "csv")
    sinks.write_delimited(g, path, ["family", "severity", "mean"], sep)
    return readers.read_delimited(spark, path, "family STRING, severity INT, mean DOUBLE", sep)


@query("s17_matrix_csv", _SIGCSV)
def s17(spark, sf):
    m = severity_csv(spark, sf, ",").groupBy("family").pivot("severity", [1, 2, 3]).agg(F.first("mean"))
    return m.select("family", *[r6(f"`{i}`").alias(f"s{i}") for i in (1, 2, 3)])


_SEV = f"{b.T()} SELECT family, severity, {R('avg(volatility)')} AS mean FROM tr GROUP BY family, severity"


@query("s20_csv_sink", _SEV)
def s20(spark, sf):
    return severity_csv(spark, sf, ",")


@query("s21_tsv_sink", _SEV)
def s21(spark, sf):
    return severity_csv(spark, sf, "\t")


@query("s18_jsonl_sink", f"{b.T('order_id')} SELECT order_id, CAST(count(*) AS BIGINT) AS n, {R('sum(loglik_drift)')} AS total FROM tr GROUP BY order_id")
def s18(spark, sf):
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl(b.trials(spark, sf, "order_id").select("order_id", "loglik_drift"), path)
    return readers.read_jsonl(spark, path, "order_id BIGINT, loglik_drift DOUBLE").groupBy("order_id").agg(F.count("*").alias("n"), r6(F.sum("loglik_drift")).alias("total"))


@query("s19_json_summary_sink", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_seen FROM events GROUP BY event_type")
def s19(spark, sf):
    g = b.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    path = scratch_path(spark, "summary")
    sinks.write_summary(g, path)
    return readers.read_jsonl(spark, path, "event_type STRING, n BIGINT, last_seen STRING").withColumn("last_seen", F.substring("last_seen", 1, 16))


@query("s22_array_sidecar_sink", f"WITH {b.FILTERS_SQL} SELECT level_no, CAST(count(*) AS BIGINT) AS n, {R('sum(list_sum(radial))')} AS total FROM filters GROUP BY level_no")
def s22(spark, sf):
    path = scratch_path(spark, "sidecars")
    f = b.filters(spark, sf)
    sinks.write_arrays(f.select("item_id", "level_no", F.lit(1).alias("h"), F.lit(8).alias("w"), F.col("radial").alias("data")), path, "level_no")
    d = spark.read.schema("item_id BIGINT, h INT, w INT, data ARRAY<DOUBLE>, level_no INT").parquet(path)
    return d.groupBy("level_no").agg(F.count("*").alias("n"), r6(F.sum(asum("data"))).alias("total"))


@query("s23_versioned_cache", f"SELECT o_orderkey AS item_id FROM orders ORDER BY {H(5, 'o_orderkey')}, o_orderkey LIMIT 100")
def s23(spark, sf):
    def build():
        return tk.seeded_sample(b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")), 100, 5, "item_id")
    args = dict(root=shared_dir(spark), version="v1", build=build, split=sf, seed=5, size=100)
    sinks.cached_table(spark, **args)
    return sinks.cached_table(spark, **args)   # the second call reads what the first wrote


@query("s24_nested_round_trip", _FLAT)
def s24(spark, sf):
    r = record_rows(spark, sf).select(F.to_json(F.struct("rec_id", "rec_no", "item_id", "levels")).alias("doc"))
    back = r.select(F.from_json("doc", schemas.RECORD).alias("d")).select("d.*")
    return flat_totals(back)


@query("s25_manifest_build", f"""WITH a AS (SELECT l_orderkey AS image_id, l_quantity AS area, l_linenumber AS k, concat('c', l_partkey % 12) AS cat FROM lineitem),
top AS (SELECT image_id, area, k, cat FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, k, cat DESC) AS rn FROM a) WHERE rn = 1),
pos AS (SELECT t.image_id, t.cat AS concept, true AS present, (SELECT count(*) FROM a WHERE a.image_id = t.image_id AND a.cat = t.cat) AS n_boxes FROM top t),
v AS (SELECT cat AS name, row_number() OVER (ORDER BY cat) - 1 AS rk FROM (SELECT DISTINCT cat FROM a)), miss AS (SELECT i.image_id, v.name, row_number() OVER (PARTITION BY i.image_id ORDER BY v.rk) - 1 AS j, count(*) OVER (PARTITION BY i.image_id) AS n
  FROM (SELECT DISTINCT image_id FROM a) i, v WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.image_id = i.image_id AND a.cat = v.name)),
neg AS (SELECT image_id, name FROM miss WHERE j = {HI(31, 'image_id')} % n),
quota AS (SELECT CAST(round(count(*) * 0.5) AS BIGINT) AS q FROM pos)
SELECT image_id, concept, present, CAST(n_boxes AS BIGINT) AS n_boxes FROM pos UNION ALL SELECT image_id, name, false, 0 FROM (SELECT *, row_number() OVER (ORDER BY {H(32, 'image_id')}, image_id) AS rn FROM neg) WHERE rn <= (SELECT q FROM quota)""")
def s25(spark, sf):
    from ..operators.manifests import build_manifest
    a = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS image_id", "l_quantity AS area", "l_linenumber AS k", "concat('c', l_partkey % 12) AS cat")
    path = scratch_path(spark, "manifest")
    sinks.write_jsonl(build_manifest(a, 0.5, 31, 32), path)
    return readers.read_jsonl(spark, path, "image_id BIGINT, concept STRING, present BOOLEAN, n_boxes BIGINT")


@query("u03_row_predicates", f"{b.T()} SELECT severity, CAST(count(*) AS BIGINT) AS n, {R('avg(volatility)')} AS mean FROM tr WHERE family LIKE 'A%' AND severity > 1 GROUP BY severity")
def u03(spark, sf):
    from ..operators.manifests import metric_values
    v = metric_values(outcomes(spark, sf), F.col("family").startswith("A") & (F.col("severity") > 1), "volatility")
    return v.groupBy("severity").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("u04_loader_dispatch", "SELECT 'wide_tsv' AS dataset, CAST(count(*) AS BIGINT) AS items FROM part")
def u04(spark, sf):
    return readers.load_items(" Wide_TSV ", tsv_source(spark, sf)).agg(F.count("*").alias("items")).withColumn("dataset", F.lit("wide_tsv"))


@query("u05_item_fan_out", """SELECT o_orderkey AS item_id, kind, CAST(level AS INT) AS level, round(cutoff, 6) + 0e0 AS cutoff FROM orders, (VALUES ('lowpass'), ('highpass')) k(kind), (SELECT i AS level, 0.02 + 0.48 * i / 4.0 AS cutoff FROM range(0, 5) r(i))""")
def u05(spark, sf):
    from ..operators.joins import fan_out
    specs = [{"kind": k, "level": i, "cutoff": round(0.02 + 0.48 * i / 4, 6)} for k in ("lowpass", "highpass") for i in range(5)]
    return fan_out(b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")), specs)
