"""O: argmax, top-k, seeded and balanced sampling; A49-A52 scene and pattern counts."""
from pyspark.sql import functions as F

from ..functions.arrays import top_k_mass
from ..functions.numeric import div0, mean0, r6
from ..functions.wordlists import INTERPRETABLE_WORDS, ODD_WORDS
from ..operators import joins as jn
from ..operators import scenes as sc
from ..operators import topk as tk
from ..operators import trials as tr
from . import bindings as b
from .q_aggregates import outcomes, rounded
from .registry import query
from .sqlkit import DIV0, H, R


@query("o01_argmax_label", f"WITH {b.SCORES_SQL} SELECT item_id, level_no, {b.ARGMAX_SQL()} AS predicted FROM cs")
def o01(spark, sf):
    return b.clean_scores(spark, sf).select("item_id", "level_no", jn.argmax_label("scores", "option_labels").alias("predicted"))


@query("o02_top_k_mass", f"WITH {b.FILTERS_SQL} SELECT item_id, " + ", ".join(
    f"{R(f'list_sum(list_sort(w, {chr(39)}DESC{chr(39)})[1:{k}])')} AS top_{k}" for k in (1, 2, 3, 5)) + " FROM filters")
def o02(spark, sf):
    return b.filters(spark, sf).select("item_id", *[r6(top_k_mass("w", k)).alias(f"top_{k}") for k in (1, 2, 3, 5)])


@query("o03_reservoir_sample", f"SELECT doc_id, lang FROM documents ORDER BY {H(42, 'doc_id')}, doc_id LIMIT 100")
def o03(spark, sf):
    return tk.seeded_sample(b.table(spark, sf, "documents").select("doc_id", "lang"), 100, 42, "doc_id")


@query("o04_seeded_subset", f"SELECT item_id FROM benchmark ORDER BY {H(7, 'item_id')}, item_id LIMIT 25")
def o04(spark, sf):
    return tk.seeded_sample(b.table(spark, sf, "benchmark").select("item_id"), 25, 7, "item_id")


@query("o05_head_rows", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20")
def o05(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", "url").orderBy("page_id").limit(20)


_Q6 = "lower(any_value(name))"


def _hits(col, words):
    return " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words)


@query("o06_ranked_candidates", f"""{b.T()}, q AS (SELECT p_partkey AS item_id, lower(concat(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN 'tree' WHEN p_size % 3 = 1 THEN 'dog ear' ELSE '' END)) AS question FROM part),
c AS (SELECT item_id, level_no, max(clean_correct) AS clean, sum(accuracy_drop) AS drops, avg(volatility) AS vol FROM tr WHERE level_no <= 4 GROUP BY 1, 2),
i AS (SELECT item_id, sum(clean) AS pc, coalesce(sum(drops) FILTER (WHERE level_no = 4), 0) AS d4, coalesce(sum(drops) FILTER (WHERE level_no = 3), 0) AS d3, coalesce(sum(drops) FILTER (WHERE level_no = 2), 0) AS d2,
  coalesce(sum(drops) FILTER (WHERE level_no = 1), 0) AS d1, coalesce(max(vol) FILTER (WHERE level_no = 4), 0) AS v4 FROM c GROUP BY 1),
s AS (SELECT item_id, pc * 40 + d4 * 8 + d3 * 3 + d2 * 1.5e0 + d1 + v4 * 8 + 8 * ({_hits('question', INTERPRETABLE_WORDS)}) - 12 * ({_hits('question', ODD_WORDS)}) AS score FROM i JOIN q USING (item_id))
SELECT item_id, {R('score')} AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, item_id) AS INT) AS rank FROM s ORDER BY round(score, 6) DESC, item_id LIMIT 50""")
def o06(spark, sf):
    q = b.table(spark, sf, "part").selectExpr("p_partkey AS item_id", "lower(concat(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN 'tree' WHEN p_size % 3 = 1 THEN 'dog ear' ELSE '' END)) AS question")
    c = outcomes(spark, sf).where("level_no <= 4").groupBy("item_id", "level_no").agg(
        F.max("clean_correct").alias("clean"), F.sum("accuracy_drop").alias("drops"), F.avg("volatility").alias("vol"))

    def at(col_name, lv):
        return F.coalesce(F.max(F.when(F.col("level_no") == lv, F.col(col_name))), F.lit(0.0))
    weights = ((4, 8.0), (3, 3.0), (2, 1.5), (1, 1.0))   # fixed values: drop weight per rung
    score = F.sum("clean") * 40.0 + at("vol", 4) * 8.0
    for lv, wt in weights:
        score = score + at("drops", lv) * wt
    i = c.groupBy("item_id").agg(score.alias("base")).join(q, "item_id")

    def hits(words):
        return sum((F.contains("question", F.lit(w)).cast("int") for w in words), F.lit(0))
    s = i.select("item_id", r6(F.col("base") + 8.0 * hits(INTERPRETABLE_WORDS) - 12.0 * hits(ODD_WORDS)).alias("score"))
    top = s.orderBy(F.desc("score"), "item_id").limit(50)
    from pyspark.sql import Window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))   # 50 rows


@query("o07_largest_annotation", """SELECT l_orderkey AS image_id, l_quantity AS area, l_linenumber AS ann, l_partkey % 20 AS category FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey % 20 DESC) AS rn FROM lineitem) WHERE rn = 1""")
def o07(spark, sf):
    a = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS image_id", "l_quantity AS area", "l_linenumber AS ann", "l_partkey % 20 AS category")
    return tk.largest(a, ["image_id"], "area", "ann", ["ann", "category"])


_PAT = """pt AS (SELECT o_orderkey AS item_id, concat(o_custkey % 2, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS pattern FROM orders),
ct AS (SELECT pattern, count(*) AS k FROM pt GROUP BY 1), cp AS (SELECT a.pattern, a.k, o.k AS k_other, least(a.k, o.k) AS capacity FROM ct a JOIN ct o ON o.pattern = translate(a.pattern, '01', '10'))"""


def patterns(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS item_id", "concat(o_custkey % 2, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS pattern")


@query("a49_balanced_capacity", f"WITH {_PAT} SELECT pattern, CAST(k AS BIGINT) AS k, CAST(k_other AS BIGINT) AS k_other, CAST(capacity AS BIGINT) AS capacity, (SELECT CAST(sum(capacity) AS BIGINT) FROM cp) AS total_capacity FROM cp")
def a49(spark, sf):
    c = tk.balanced_capacity(patterns(spark, sf))
    return c.withColumn("total_capacity", c.agg(F.sum("capacity").alias("t")).select("t").scalar())


@query("o08_balanced_sample", f"""WITH {_PAT}, hd AS (SELECT *, sum(capacity) OVER (ORDER BY {H(3, 'pattern')}, pattern) - capacity AS before, floor(least(601, 2 * sum(capacity) OVER ()) / 2) AS room FROM cp WHERE pattern < translate(pattern, '01', '10')),
q AS (SELECT pattern, greatest(least(capacity, room - before), 0) AS quota FROM hd), q2 AS (SELECT * FROM q UNION ALL SELECT translate(pattern, '01', '10'), quota FROM q),
rn AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY {H(3, 'item_id')}, item_id) AS rn FROM pt) SELECT item_id, pattern FROM rn JOIN q2 USING (pattern) WHERE rn <= quota""")
def o08(spark, sf):
    return tk.balanced_sample(patterns(spark, sf), 601)


@query("o09_top_matrix_rows", f"{b.T()}, m AS (SELECT perturbation, level_no, avg(accuracy_drop) AS v FROM tr GROUP BY 1, 2), r AS (SELECT perturbation, round(avg(v), 6) AS m FROM m GROUP BY 1) SELECT perturbation, m + 0e0 AS row_mean FROM r ORDER BY m DESC NULLS LAST, perturbation LIMIT 10")
def o09(spark, sf):
    m = outcomes(spark, sf).groupBy("perturbation", "level_no").agg(F.avg("accuracy_drop").alias("v"))
    r = m.groupBy("perturbation").agg(r6(F.avg("v")).alias("row_mean"))
    return r.orderBy(F.col("row_mean").desc_nulls_last(), "perturbation").limit(10)


@query("o10_best_prediction", """SELECT l_orderkey AS frame, l_discount AS score, l_linenumber AS k, l_partkey AS mask_id FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def o10(spark, sf):
    a = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS frame", "l_discount AS score", "l_linenumber AS k", "l_partkey AS mask_id")
    return tk.largest(a, ["frame"], "score", "k", ["k", "mask_id"])


@query("o11_first_per_level", f"""{b.T('order_id', 'line_no')}, f AS (SELECT *, row_number() OVER (PARTITION BY item_id, rung ORDER BY order_id, line_no, perturbation) AS rn FROM tr WHERE rung <= 3)
SELECT item_id, rung, order_id, line_no FROM f WHERE rn = 1 AND item_id IN (SELECT item_id FROM f GROUP BY 1 HAVING count(DISTINCT rung) = 3)""")
def o11(spark, sf):
    t = b.trials(spark, sf, "order_id", "line_no").where("rung <= 3")
    first = t.groupBy("item_id", "rung").agg(F.min(F.struct("order_id", "line_no")).alias("f")).select("item_id", "rung", "f.*")
    return tr.complete_ladder(first, (1, 2, 3), "item_id", "rung")


@query("o12_scatter_sample", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY {H(1, 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500")
def o12(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return tk.seeded_sample(li, 500, 1, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").drop("l_suppkey")


@query("o13_best_mask_vs_truth", """WITH p AS (SELECT vec_id // 5 AS frame, vec_id % 5 AS k, vec_id, embedding FROM embeddings), x AS (SELECT p.frame, p.k, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN p.embedding[i] > 0 AND g.embedding[i] > 0 THEN 1 ELSE 0 END)) AS i,
  list_sum(list_transform(range(1, 65), lambda i: CASE WHEN p.embedding[i] > 0 OR g.embedding[i] > 0 THEN 1 ELSE 0 END)) AS u FROM p JOIN p g ON g.frame = p.frame AND g.k = 0 WHERE p.k > 0)
SELECT frame, round(max(iou), 6) + 0e0 AS iou, arg_min(k, -iou * 1000000 + k / 1000.0) AS k FROM (SELECT frame, k, CASE WHEN u > 0 THEN i / u ELSE 0 END AS iou FROM x) GROUP BY frame""")
def o13(spark, sf):
    from ..operators.masks import mask_iou, masks
    m = masks(b.table(spark, sf, "embeddings")).withColumn("frame", F.floor(F.col("vec_id") / 5)).withColumn("k", F.col("vec_id") % 5)
    gt = m.where("k = 0").select("frame", F.col("mask").alias("gt"))
    x = m.where("k > 0").join(gt, "frame").withColumn("iou", mask_iou("mask", "gt"))
    return rounded(tk.largest(x, ["frame"], "iou", "k", ["k"]), "iou")


@query("o14_representatives", f"""{b.T()}, s AS (SELECT item_id, round(avg(accuracy_drop) FILTER (WHERE level_no = 1), 6) AS f1, round(avg(accuracy_drop) FILTER (WHERE level_no = 4), 6) AS f4, round(avg(accuracy_drop), 6) AS fa FROM tr GROUP BY 1),
a AS (SELECT item_id, 0 AS priority, f1 AS score FROM s WHERE f1 IS NOT NULL ORDER BY f1 DESC, item_id LIMIT 1),
bb AS (SELECT item_id, 1 AS priority, f4 AS score FROM s WHERE f4 IS NOT NULL AND item_id NOT IN (SELECT item_id FROM a) ORDER BY f4 DESC, item_id LIMIT 1),
c AS (SELECT item_id, 2 AS priority, fa AS score FROM s WHERE item_id NOT IN (SELECT item_id FROM a UNION ALL SELECT item_id FROM bb) ORDER BY fa DESC, item_id LIMIT 3)
SELECT item_id, CAST(priority AS INT) AS priority, score + 0e0 AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM bb UNION ALL SELECT * FROM c)""")
def o14(spark, sf):
    t = outcomes(spark, sf)
    s = t.groupBy("item_id").agg(r6(F.avg(F.when(F.col("level_no") == 1, F.col("accuracy_drop")))).alias("first"),
                                 r6(F.avg(F.when(F.col("level_no") == 4, F.col("accuracy_drop")))).alias("fourth"),
                                 r6(F.avg("accuracy_drop")).alias("overall"))
    return tk.representatives(s, 5)


@query("a51_attribute_inventory", f"WITH {b.SCENE_SQL} SELECT DISTINCT scene, attr FROM (SELECT scene, adj AS attr FROM so UNION ALL SELECT scene, kind FROM so)")
def a51(spark, sf):
    return sc.attribute_inventory(b.scene_objects(spark, sf))


@query("a52_named_object_count", f"WITH {b.SCENE_SQL} SELECT scene, name, CAST(count(*) AS BIGINT) AS n FROM so GROUP BY 1, 2")
def a52(spark, sf):
    return sc.name_counts(b.scene_objects(spark, sf))
