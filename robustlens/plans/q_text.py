"""F: text, label and prompt expressions over documents, conversations, pages and scenes."""
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.numeric import r6
from ..functions.wordlists import (BOOLEAN_OPTIONS, LEVEL_NAMES, MEANINGFUL_FILLER, NEUTRAL_PHRASES, OPPOSITE_RELATION, PSEUDO_WORDS, STOPWORDS,
                                   STRUCTURED_PREFIX, TOKEN_PATTERN, WORDY_FILLER, WORDY_PREFIX, WORDY_SUFFIX)
from ..operators import scenes as sc
from ..session import materialize
from . import bindings as b
from .q_aggregates import rounded
from .registry import query
from .sqlkit import CORR, H, HI, R


def q(s):
    return "'" + s.replace("'", "''") + "'"


def LIST(ws):
    return "[" + ", ".join(q(w) for w in ws) + "]"


PAT = q(TOKEN_PATTERN)


def TOK(t):
    return f"list_transform(regexp_extract_all(coalesce({t}, ''), {PAT}), lambda w: lower(w))"


def CW(t):
    return f"list_filter({TOK(t)}, lambda w: NOT list_contains({LIST(STOPWORDS)}, w))"


def NORM(t):
    return f"trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"


@query("f01_normalize_text", f"SELECT doc_id, md5({NORM('text')}) AS norm_md5, CAST(length({NORM('text')}) AS INT) AS n FROM documents")
def f01(spark, sf):
    n = b.table(spark, sf, "documents").select("doc_id", lb.normalize_text("text").alias("t"))
    return n.select("doc_id", F.md5("t").alias("norm_md5"), F.length("t").alias("n"))


# options of an item: label -> adjective of the scene vocabulary; the raw answer comes in several spellings
_F2 = """it AS (SELECT p_partkey AS item_id, ['red', 'blue', 'Small!', 'large'] AS opts, ['A', 'B', 'C', 'D'] AS labs,
  CASE p_partkey % 8 WHEN 0 THEN 'b' WHEN 1 THEN '0' WHEN 2 THEN '4' WHEN 3 THEN 'small' WHEN 4 THEN ' LARGE ' WHEN 5 THEN 'none' WHEN 6 THEN '' ELSE '3' END AS raw FROM part)"""


def answer_items(spark, sf):
    return b.table(spark, sf, "part").selectExpr(
        "p_partkey AS item_id", "map('A', 'red', 'B', 'blue', 'C', 'Small!', 'D', 'large') AS options", "array('A','B','C','D') AS labs",
        "CASE p_partkey % 8 WHEN 0 THEN 'b' WHEN 1 THEN '0' WHEN 2 THEN '4' WHEN 3 THEN 'small' WHEN 4 THEN ' LARGE ' WHEN 5 THEN 'none' WHEN 6 THEN '' ELSE '3' END AS raw")


@query("f02_answer_label", f"""WITH {_F2}, v AS (SELECT *, trim(raw) AS v FROM it) SELECT item_id, CASE WHEN v = '' THEN NULL WHEN length(v) = 1 AND list_contains(labs, upper(v)) THEN upper(v)
  WHEN regexp_full_match(v, '[0-9]+') THEN CASE WHEN CAST(v AS INT) < 4 THEN labs[CAST(v AS INT) + 1] WHEN CAST(v AS INT) = 4 THEN labs[4] END
  ELSE list_filter(labs, lambda l: {NORM('opts[list_position(labs, l)]')} = {NORM('v')})[1] END AS label FROM (SELECT item_id, opts, labs, CASE WHEN regexp_full_match(trim(raw), '[0-9]+') THEN trim(raw) ELSE trim(raw) END AS v FROM v)""")
def f02(spark, sf):
    return answer_items(spark, sf).select("item_id", lb.answer_label("raw", "options", "labs").alias("label"))


@query("f03_yes_no_margin", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'B' END END AS yes_label,
  CASE WHEN l_orderkey % 2 = 0 THEN 'B' ELSE 'A' END AS no_label, {R('CASE WHEN l_linenumber % 4 <> 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN l_discount - l_tax ELSE l_tax - l_discount END END')} AS margin,
  CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE 'Yes' END ELSE 'No' END AS first_is FROM lineitem""")
def f03(spark, sf):
    li = b.table(spark, sf, "lineitem").withColumn("yes_text", F.expr("CASE WHEN l_linenumber % 4 = 3 THEN 'maybe' ELSE 'Yes.' END"))
    li = li.withColumn("options", F.expr("CASE WHEN l_orderkey % 2 = 0 THEN map('A', yes_text, 'B', ' no') ELSE map('A', ' no', 'B', yes_text) END"))
    li = li.withColumn("scores", F.expr("map('A', l_discount, 'B', l_tax)")).withColumn("lab", F.lit("A"))
    y, n = lb.yes_no_labels("options")
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "options", "scores", "lab", y.alias("yes_label"), n.alias("no_label"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "yes_label", "no_label", r6(lb.yes_no_margin("scores", "yes_label", "no_label")).alias("margin"),
                    lb.label_to_yes_no("lab", "options").alias("first_is"))


_RAW = """CASE p_partkey % 5 WHEN 0 THEN concat('["', p_type, '", " ', p_name, ' "]') WHEN 1 THEN concat("['", p_type, "', '', None, True, '", p_brand, "',]")
  WHEN 2 THEN 'not a list' WHEN 3 THEN concat("('", p_name, "', 'x',)") ELSE concat("{'a': '", p_brand, "', 'b': '", p_type, "'}") END"""


@query("f04_parse_options", """SELECT p_partkey AS item_id, CASE p_partkey % 5 WHEN 0 THEN concat(p_type, '|', p_name) WHEN 1 THEN concat(p_type, '|True|', p_brand) WHEN 2 THEN '' WHEN 3 THEN concat(p_name, '|x') ELSE concat(p_brand, '|', p_type) END AS opts,
  CAST(CASE p_partkey % 5 WHEN 2 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS INT) AS n FROM part""")
def f04(spark, sf):
    p = b.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.expr(_RAW).alias("raw"))
    return p.select("item_id", lb.parse_options("raw").alias("o")).select("item_id", F.array_join("o", "|").alias("opts"), F.size("o").alias("n"))


@query("f05_letter_labels", """SELECT scene, array_to_string(list_transform(range(0, n), lambda i: chr(CAST(65 + i AS INT))), '') AS letters FROM (SELECT l_orderkey AS scene, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)""")
def f05(spark, sf):
    s = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.collect_set("l_linenumber").alias("o"))  # at most seven line numbers
    return s.select("scene", F.array_join(lb.letter_labels(F.col("o")), "").alias("letters"))


@query("f06_tokens", f"WITH t AS (SELECT doc_id, {TOK('text')} AS w FROM documents) SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, md5(array_to_string(w, ' ')) AS token_md5 FROM t")
def f06(spark, sf):
    t = b.table(spark, sf, "documents").select("doc_id", lb.tokens("text").alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("token_md5"))


@query("f07_prompt_load", f"SELECT conv_id, turn, CAST(len({CW('text')}) AS INT) AS prompt_load FROM conversations WHERE role = 'user'")
def f07(spark, sf):
    c = b.table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", lb.content_word_count("text").alias("prompt_load"))


def _ATOM(prefix, t):
    return f"list_transform({CW(t)}, lambda w: concat('{prefix}:', w))"


@query("f08_semantic_atoms", f"""WITH {b.SCENE_SQL}, j AS (SELECT rel.scene, subject, s.name AS sn, t.name AS tn, relation, s.kind FROM rel JOIN so s ON s.scene = rel.scene AND s.oid = subject JOIN so t ON t.scene = rel.scene AND t.oid = target)
SELECT scene, subject, array_to_string(list_concat(list_concat(list_concat({_ATOM('entity', 'sn')}, {_ATOM('entity', 'tn')}), {_ATOM('attribute', "concat('the ', kind)")}),
  [concat('relation:', array_to_string(list_filter({TOK('relation')}, lambda w: NOT list_contains({LIST(('a', 'an', 'the', 'to', 'of', 'is', 'are'))}, w)), '_')), 'op:verify_relation']), ',') AS atoms,
  array_to_string(list_filter({TOK("concat(kind, ' Yes')")}, lambda w: NOT list_contains({LIST(STOPWORDS + BOOLEAN_OPTIONS)}, w)), ',') AS option_atoms FROM j""")
def f08(spark, sf):
    so = b.scene_objects(spark, sf)
    kinds = so.select("scene", F.col("oid").alias("subject"), "kind")
    j = sc.named_relations(so, b.scene_relations(so)).join(kinds, ["scene", "subject"])
    a = F.concat(lb.atoms("entity", F.array("subject_name", "target_name")), lb.atoms("attribute", F.array(F.concat(F.lit("the "), F.col("kind")))),
                 lb.atoms("relation", F.array("relation")), lb.atoms("op", F.array(F.lit(" Verify_Relation "))))
    return j.select("scene", "subject", F.array_join(a, ",").alias("atoms"), F.array_join(lb.option_atoms(F.array(F.concat(F.col("kind"), F.lit(" Yes")))), ",").alias("option_atoms"))


@query("f09_semantic_complexity", f"""WITH {b.SCENE_SQL}, n AS (SELECT scene, name, count(*) AS k FROM so GROUP BY 1, 2) SELECT so.scene, oid, {R('1 + (oid % 2) + 1 + 2 + (oid % 4 - 1 + abs(oid % 4 - 1)) / 2 + ln(1 + k)')} AS score FROM so JOIN n ON n.scene = so.scene AND n.name = so.name""")
def f09(spark, sf):
    so = b.scene_objects(spark, sf)
    k = sc.name_counts(so)
    x = so.join(k, ["scene", "name"])
    attrs = F.when(F.col("oid") % 2 == 1, F.array("kind")).otherwise(F.array().cast("array<string>"))
    s = lb.semantic_complexity(F.array("name"), attrs, F.array(F.lit("near")), F.array(F.lit("a"), F.lit(" "), F.lit("b")), F.col("oid") % 4 - 1, F.col("n"))
    return x.select("scene", "oid", r6(s).alias("score"))


@query("f10_refreshed_load", f"""SELECT conv_id, turn, CAST(len({CW('text')}) AS DOUBLE) AS prompt_load, CASE WHEN turn % 3 = 0 THEN CAST(len({CW('text')}) AS DOUBLE) ELSE CAST(turn AS DOUBLE) END AS complexity FROM conversations""")
def f10(spark, sf):
    c = b.table(spark, sf, "conversations").withColumn("sc", F.expr("CASE WHEN turn % 3 = 0 THEN 0e0 ELSE CAST(turn AS DOUBLE) END")).withColumn("zero", F.lit(0.0))
    return c.select("conv_id", "turn", lb.content_word_count("text").cast("double").alias("prompt_load"),
                    lb.refreshed_load("sc", "zero", "zero", "text", "zero").alias("complexity"))


def CYC(vocab, n):
    return f"array_to_string(list_transform(range(0, greatest({n}, 0)), lambda i: {LIST(vocab)}[CAST(i % {len(vocab)} AS INT) + 1]), ' ')"


_WORDY = f"""w0 AS (SELECT *, trim(regexp_replace(concat({q(WORDY_PREFIX)}, trim(text), {q(' ' + WORDY_SUFFIX)}), '\\s+', ' ', 'g')) AS cand, len({CW('text')}) AS base_n FROM src),
w1 AS (SELECT *, base_n + 12 - len({CW('cand')}) AS need FROM w0), w2 AS (SELECT *, CASE WHEN trim(text) = '' THEN '' WHEN need <= 0 THEN cand ELSE concat(cand, ' ', {CYC(WORDY_FILLER, 'need')}, '.') END AS wordy FROM w1)"""


@query("f11_wordy_variant", f"WITH src AS (SELECT item_id, text FROM benchmark), {_WORDY} SELECT item_id, md5(wordy) AS wordy_md5, CAST(len({CW('wordy')}) AS INT) AS wordy_load FROM w2")
def f11(spark, sf):
    s = b.table(spark, sf, "benchmark").withColumn("n", lb.content_word_count("text"))
    w = s.select("item_id", lb.wordify("text", "n").alias("wordy"))
    return w.select("item_id", F.md5("wordy").alias("wordy_md5"), lb.content_word_count("wordy").alias("wordy_load"))


# --- question building -----------------------------------------------------------------------------------
_OPP = "CASE relation " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in OPPOSITE_RELATION.items()) + " END"
_QS = f"""WITH {b.SCENE_SQL}, {sc.CLASSIFIED_SQL},
v AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS rk FROM (SELECT DISTINCT name FROM so)), scn AS (SELECT DISTINCT scene FROM so),
miss AS (SELECT s.scene, v.name, row_number() OVER (PARTITION BY s.scene ORDER BY v.rk) - 1 AS i, count(*) OVER (PARTITION BY s.scene) AS n FROM scn s, v WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.scene = s.scene AND so.name = v.name)),
neg AS (SELECT scene, name AS negative FROM miss WHERE i = {HI(21, 'scene')} % n),
tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {H(22, 'scene', 'oid')}) AS rn FROM so) WHERE rn = 1),
l1 AS (SELECT tg.scene, CASE WHEN {HI(23, 'tg.scene')} % 2 = 0 THEN concat('Is there a ', tg.name, ' in this image?') ELSE concat('Is there a ', negative, ' in this image?') END AS question, CASE WHEN {HI(23, 'tg.scene')} % 2 = 0 THEN 'A' ELSE 'B' END AS answer
  FROM tg LEFT JOIN neg USING (scene) WHERE {HI(23, 'tg.scene')} % 2 = 0 OR negative IS NOT NULL),
l2o AS (SELECT * FROM (SELECT cls.*, so.name, row_number() OVER (PARTITION BY scene ORDER BY {H(24, 'scene', 'oid')}) AS rn FROM cls JOIN so USING (scene, oid)) WHERE rn = 1),
ro AS (SELECT rel.scene, subject, s.name AS sn, t.name AS tn, relation FROM rel JOIN so s ON s.scene = rel.scene AND s.oid = subject JOIN so t ON t.scene = rel.scene AND t.oid = target),
l3 AS (SELECT scene, sn, tn, relation, {HI(26, 'scene')} % 2 = 0 AS pos, row_number() OVER (PARTITION BY scene ORDER BY {H(25, 'scene', 'subject')}) AS rn FROM ro WHERE {HI(26, 'scene')} % 2 = 0 OR {_OPP} IS NOT NULL)"""


@query("f12_scene_questions", f"""{_QS} SELECT scene, 1 AS level_no, question, answer FROM l1
UNION ALL SELECT l2o.scene, 2, concat('What ', category, ' is the ', name, '?'), chr(CAST(65 + (SELECT count(*) FROM dis d WHERE d.scene = l2o.scene AND d.oid = l2o.oid AND {H(27, 'l2o.scene', 'd.word')} < {H(27, 'l2o.scene', 'l2o.value')}) AS INT)) FROM l2o
UNION ALL SELECT scene, 3, concat('Is the ', sn, ' ', CASE WHEN pos THEN relation ELSE {_OPP} END, ' the ', tn, '?'), CASE WHEN pos THEN 'A' ELSE 'B' END FROM l3 WHERE rn = 1
UNION ALL SELECT l2o.scene, 4, concat('What ', category, ' is the ', name, ' that is ', relation, ' the ', tn, '?'), chr(CAST(65 + (SELECT count(*) FROM dis d WHERE d.scene = l2o.scene AND d.oid = l2o.oid AND {H(27, 'l2o.scene', 'd.word')} < {H(27, 'l2o.scene', 'l2o.value')}) AS INT))
  FROM l2o JOIN ro ON ro.scene = l2o.scene AND ro.subject = l2o.oid""")
def f12(spark, sf):
    so = materialize(spark, b.scene_objects(spark, sf).drop("full_name", "size"), "objects")     # every rung reads them
    return sc.scene_questions(so, b.scene_relations(so))


@query("f13_attribute_options", f"WITH {b.SCENE_SQL}, {sc.CLASSIFIED_SQL} SELECT scene, oid, category, value, string_agg(word, ',' ORDER BY k) AS distractors FROM dis GROUP BY 1, 2, 3, 4")
def f13(spark, sf):
    c = sc.classified_attribute(b.scene_objects(spark, sf))
    d = sc.distractors(F.col("category"), F.col("value"), 3, 11, "scene", "oid")
    return c.select("scene", "oid", "category", "value", F.array_join(d, ",").alias("distractors"))


_SYN = """sy AS (SELECT l_orderkey AS scene, l_linenumber AS oid, ['gray','red','blue','green','brown','purple','cyan','yellow'][CAST(p % 8 + 1 AS INT)] AS color, ['rubber','metal'][CAST(p % 2 + 1 AS INT)] AS material,
  ['cube','sphere','cylinder'][CAST(p % 3 + 1 AS INT)] AS shape, ['small','large'][CAST((p // 8) % 2 + 1 AS INT)] AS size FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2))"""


@query("f14_identifying_attribute", f"""WITH {_SYN}, c AS (SELECT *, count(*) OVER (PARTITION BY scene, size, material, shape, color) AS x0, count(*) OVER (PARTITION BY scene, size, material, shape) AS k_color, count(*) OVER (PARTITION BY scene, size, color, material) AS k_shape,
  count(*) OVER (PARTITION BY scene, size, color, shape) AS k_material, count(*) OVER (PARTITION BY scene, color, material, shape) AS k_size FROM sy)
SELECT scene, oid, CASE WHEN k_color = 1 THEN 'color' WHEN k_shape = 1 THEN 'shape' WHEN k_material = 1 THEN 'material' WHEN k_size = 1 THEN 'size' END AS attribute, concat_ws(' ', size, color, material, shape) AS full_phrase,
  CASE WHEN k_color = 1 THEN concat_ws(' ', size, material, shape) WHEN k_shape = 1 THEN concat_ws(' ', size, color, material, 'object') WHEN k_material = 1 THEN concat_ws(' ', size, color, shape) WHEN k_size = 1 THEN concat_ws(' ', color, material, shape) END AS phrase FROM c""")
def f14(spark, sf):
    o = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("oid")).agg(F.min("l_partkey").alias("p"))
    o = o.selectExpr("scene", "oid", "element_at(array('gray','red','blue','green','brown','purple','cyan','yellow'), CAST(p % 8 + 1 AS INT)) AS color",
                     "element_at(array('rubber','metal'), CAST(p % 2 + 1 AS INT)) AS material", "element_at(array('cube','sphere','cylinder'), CAST(p % 3 + 1 AS INT)) AS shape",
                     "element_at(array('small','large'), CAST(floor(p / 8) % 2 + 1 AS INT)) AS size")
    return sc.identifying_attribute(o)


@query("f15_family_name", "SELECT name, CASE WHEN trim(split_part(split_part(name, '|sev', 1), '(', 1)) = '' THEN 'unknown' ELSE trim(split_part(split_part(name, '|sev', 1), '(', 1)) END AS family, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN concat(' ', l_returnflag, ' (', l_linenumber, ')|sev', l_suppkey % 3) WHEN 1 THEN concat(l_returnflag, l_linestatus, '|sev2') ELSE concat('(', l_linestatus, ')') END AS name FROM lineitem) GROUP BY 1, 2")
def f15(spark, sf):
    n = b.table(spark, sf, "lineitem").selectExpr("CASE l_linenumber % 3 WHEN 0 THEN concat(' ', l_returnflag, ' (', l_linenumber, ')|sev', l_suppkey % 3) WHEN 1 THEN concat(l_returnflag, l_linestatus, '|sev2') ELSE concat('(', l_linestatus, ')') END AS name")
    return n.groupBy("name", lb.family_name("name").alias("family")).agg(F.count("*").alias("n"))


_KEY16 = "CASE o_custkey % 4 WHEN 0 THEN concat(o_orderpriority, '|sev', o_custkey % 5) WHEN 1 THEN concat('a|sev1|sev', o_custkey % 3) WHEN 2 THEN o_orderstatus ELSE concat(o_orderstatus, '|sevX') END"


@query("f16_parse_severity", f"SELECT key, CASE WHEN regexp_matches(key, '\\|sev[0-9]+$') THEN regexp_extract(key, '^(.*)\\|sev([0-9]+)$', 1) END AS pert, TRY_CAST(regexp_extract(key, '^(.*)\\|sev([0-9]+)$', 2) AS INT) AS sev, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_KEY16} AS key FROM orders) GROUP BY key")
def f16(spark, sf):
    k = b.table(spark, sf, "orders").select(F.expr(_KEY16).alias("key"))
    p, s = lb.parse_severity("key")
    return k.groupBy("key").agg(F.count("*").alias("n")).select("key", p.alias("pert"), s.alias("sev"), "n")


_SPEC17 = "CASE o_custkey % 3 WHEN 0 THEN 'natural' WHEN 1 THEN 'frequency' ELSE 'video' END AS family, CASE WHEN o_orderkey % 2 = 0 THEN 'fft_keep' ELSE 'fft_noise' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'all' END AS mode"


@query("f17_family_group", f"""WITH s AS (SELECT {_SPEC17} FROM orders) SELECT family, kind, mode, CASE family WHEN 'natural' THEN 'natural' WHEN 'frequency' THEN CASE WHEN mode = 'low' THEN 'lowfreq' ELSE 'highfreq' END ELSE family END AS grp,
  CASE family WHEN 'natural' THEN 'natural' WHEN 'frequency' THEN CASE WHEN kind = 'fft_keep' THEN CASE WHEN mode = 'low' THEN 'lowfreq_keep' ELSE 'highfreq_keep' END ELSE CASE mode WHEN 'low' THEN 'lowfreq_noise' WHEN 'high' THEN 'highfreq_noise' ELSE 'allfreq_noise' END END ELSE family END AS split_grp, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2, 3""")
def f17(spark, sf):
    s = b.table(spark, sf, "orders").selectExpr(*_SPEC17.split(", CASE")[:1], *["CASE" + x for x in _SPEC17.split(", CASE")[1:]])
    g = s.groupBy("family", "kind", "mode").agg(F.count("*").alias("n"))
    return g.select("family", "kind", "mode", lb.family_group("family", "kind", "mode").alias("grp"), lb.family_group("family", "kind", "mode", True).alias("split_grp"), "n")


@query("f18_safe_names", """SELECT page_id, CASE WHEN f = '' THEN 'item' ELSE left(f, 120) END AS file_name, CASE WHEN s = '' THEN 'image' ELSE s END AS stem FROM (
  SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS f, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)""")
def f18(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", lb.safe_filename("url").alias("file_name"), lb.safe_stem("url").alias("stem"))


@query("f19_prompt_rendering", f"""WITH i AS (SELECT p_partkey AS item_id, p_name AS question, CASE WHEN p_size % 2 = 0 THEN p_type END AS hint, concat('A. ', p_brand, chr(10), 'B. ', p_type) AS opts, p_size % 5 = 0 AS none FROM part),
h AS (SELECT *, CASE WHEN hint IS NULL THEN '' ELSE concat('Hint: ', hint, chr(10)) END || concat('Question: ', question, chr(10)) AS head FROM i)
SELECT item_id, 'mcq' AS style, CASE WHEN none THEN concat(head, 'Please answer the question concisely.') ELSE concat(head, 'Options:', chr(10), opts, chr(10), 'Please select the correct answer from the options above.') END AS prompt FROM h
UNION ALL SELECT item_id, 'open', concat(head, 'Please answer the question concisely.') FROM h
UNION ALL SELECT item_id, 'open_with_options', CASE WHEN none THEN concat(head, 'Provide the best answer in your own words.') ELSE concat(head, 'Options (for your reference; answer freely):', chr(10), opts, chr(10), 'Provide the best answer in your own words.') END FROM h
UNION ALL SELECT item_id, 'yes_no', concat('Question: ', question, chr(10), 'Answer with exactly one word: Yes or No.') FROM i""")
def f19(spark, sf):
    i = b.table(spark, sf, "part").selectExpr(
        "p_partkey AS item_id", "p_name AS question", "CASE WHEN p_size % 2 = 0 THEN p_type END AS hint",
        "CASE WHEN p_size % 5 = 0 THEN slice(array(named_struct('label', 'A', 'text', p_brand)), 1, 0) ELSE array(named_struct('label', 'A', 'text', p_brand), named_struct('label', 'B', 'text', p_type)) END AS options")
    styles = F.array(*[F.struct(F.lit(s).alias("style"), lb.render_prompt(s, "hint", "question", "options").alias("prompt")) for s in ("mcq", "open", "open_with_options", "yes_no")])
    return i.select("item_id", F.explode(styles).alias("z")).select("item_id", "z.*")


_NEU = "[" + ", ".join(f"{{'h': md5(concat_ws('|', CAST(item_id AS VARCHAR), {q(p)})), 'p': {q(p)}}}" for p in NEUTRAL_PHRASES) + "]"


@query("f20_template_fan_out", f"""WITH src AS (SELECT item_id, text FROM benchmark), {_WORDY}, t AS (SELECT item_id, text, wordy, greatest(len({CW('wordy')}), len({CW('text')})) - len({CW('text')}) AS extra, list_sort({_NEU})[1:3] AS nz FROM w2),
r AS (SELECT item_id, 'original_primary' AS template, text AS x FROM t UNION ALL SELECT item_id, 'current_wordy_mirror', wordy FROM t UNION ALL SELECT item_id, 'random_neutral_wrapper', concat(nz[1].p, ' ', nz[2].p, ' ', nz[3].p, ' ', text) FROM t
  UNION ALL SELECT item_id, 'meaningful_same_content_count', CASE WHEN extra <= 0 THEN text ELSE concat({CYC(MEANINGFUL_FILLER, 'extra')}, '. ', text) END FROM t UNION ALL SELECT item_id, 'structured_instruction', concat({q(STRUCTURED_PREFIX)}, text) FROM t)
SELECT item_id, template, md5(x) AS text_md5, CAST(len({CW('x')}) AS INT) AS content_words FROM r""")
def f20(spark, sf):
    s = b.table(spark, sf, "benchmark").withColumn("n", lb.content_word_count("text")).withColumn("wordy", lb.wordify("text", "n"))
    v = s.select("item_id", F.explode(lb.template_variants("text", "wordy", "item_id")).alias("z")).select("item_id", "z.*")
    return v.select("item_id", "template", F.md5("text").alias("text_md5"), lb.content_word_count("text").alias("content_words"))


_PN = "CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN replace(p_name, ' ', '_') ELSE concat(replace(p_name, ' ', '_'), '_', lower(p_type)) END"


@query("f21_part_level_prompt", f"""WITH n AS (SELECT {_PN} AS name, count(*) AS k FROM part GROUP BY 1), s AS (SELECT *, string_split(name, '_') AS p FROM n)
SELECT name, ['L1_COARSE', 'L2_MEDIUM', 'L3_FINE'][CAST(least(len(p), 3) AS INT)] AS level, concat('segment the ', array_to_string(list_concat(list_reverse(p[2:]), [p[1]]), ' of the ')) AS prompt, CAST(k AS BIGINT) AS n FROM s""")
def f21(spark, sf):
    n = b.table(spark, sf, "part").select(F.expr(_PN).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return n.select("name", lb.part_level("name").alias("level"), lb.part_prompt("name").alias("prompt"), "n")


@query("f22_yes_no_items", "SELECT p_partkey AS item_id, p_size % 3 = 0 AS is_binary, CAST(2 + (p_size % 3 = 1)::INT AS INT) AS num_options FROM part")
def f22(spark, sf):
    i = b.table(spark, sf, "part").selectExpr("p_partkey AS item_id", "CASE p_size % 3 WHEN 0 THEN array(' Yes', 'NO') WHEN 1 THEN array('yes', 'no', p_type) ELSE array('rubber', 'metal') END AS options")
    return i.select("item_id", lb.is_yes_no("options").alias("is_binary"), F.size("options").alias("num_options"))


@query("f23_overlays_and_size", f"""WITH {b.SCORES_SQL} SELECT item_id, level_no, array_to_string(list_transform(list_filter(['A','B','C','D'], lambda l: l <> {b.ARGMAX_SQL()}), lambda l: concat('Answer is ', l)), ';') AS overlays,
  concat(1 + item_id % 9, CASE WHEN item_id % 2 = 0 THEN 'p8B' ELSE 'M' END) AS size_tag FROM cs""")
def f23(spark, sf):
    from ..operators.joins import argmax_label
    c = b.clean_scores(spark, sf).withColumn("base", argmax_label("scores", "option_labels"))
    m = F.expr("concat('org/model-', 1 + item_id % 9, CASE WHEN item_id % 2 = 0 THEN '.8b-instruct' ELSE 'm_it' END)")
    return c.select("item_id", "level_no", F.array_join(lb.overlay_phrases("option_labels", "base"), ";").alias("overlays"), lb.model_size(m).alias("size_tag"))


@query("f24_level_sort_key", f"SELECT level, coalesce(nullif(list_position({LIST(LEVEL_NAMES)}, level), 0) - 1, 8) AS sort_key, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce({LIST(LEVEL_NAMES)}[CAST(l_linenumber + 3 AS INT)], 'other') AS level FROM lineitem) GROUP BY 1, 2")
def f24(spark, sf):
    lv = F.coalesce(F.try_element_at(lb.words(LEVEL_NAMES), F.col("l_linenumber") + 3), F.lit("other"))
    return b.table(spark, sf, "lineitem").select(lv.alias("level")).groupBy("level", lb.level_order("level").alias("sort_key")).agg(F.count("*").alias("n"))


@query("f25_infer_run_tags", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'given' WHEN contains(lower(url), 'ref') THEN 'referred' WHEN contains(lower(url), 'example') THEN 'plain' ELSE '' END AS tag FROM pages""")
def f25(spark, sf):
    p = b.table(spark, sf, "pages").withColumn("cfg", F.get_json_object(F.expr("CASE WHEN page_id % 3 = 0 THEN '{\"model\": {\"primary\": \"given\"}}' ELSE '{}' END"), "$.model.primary"))
    return p.select("page_id", lb.infer_from_path("cfg", "url", (("ref", "referred"), ("example", "plain"))).alias("tag"))


@query("f26_verbal_labels", f"""{b.T()}, c AS (SELECT perturbation, {CORR('csem', 'volatility')} AS r, (avg(loglik_drift) FILTER (WHERE changed) - avg(loglik_drift) FILTER (WHERE NOT changed)) / stddev_samp(loglik_drift) AS d FROM tr GROUP BY 1)
SELECT perturbation, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS correlation FROM c""")
def f26(spark, sf):
    from ..functions.numeric import safe_corr
    from .q_aggregates import outcomes
    d = F.col("loglik_drift")
    c = outcomes(spark, sf).groupBy("perturbation").agg(safe_corr("csem", "volatility").alias("r"), ((F.avg(F.when(F.col("changed"), d)) - F.avg(F.when(~F.col("changed"), d))) / F.stddev_samp(d)).alias("d"))
    return c.select("perturbation", lb.effect_label(F.col("d")).alias("effect"), lb.correlation_label(F.col("r")).alias("correlation"))


@query("f27_control_prompts", f"""WITH p AS (SELECT item_id, greatest(len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda t: t <> '')), 4) AS n FROM benchmark)
SELECT item_id, 'empty_language' AS control, '.' AS prompt FROM p UNION ALL SELECT item_id, 'random_language', array_to_string(list_transform(range(1, n + 1), lambda i: {LIST(PSEUDO_WORDS)}[CAST({HI(9, 'item_id', 'i')} % 15 AS INT) + 1]), ' ') FROM p""")
def f27(spark, sf):
    p = b.table(spark, sf, "benchmark").withColumn("control", F.explode(lb.words(["empty_language", "random_language"])))
    return p.select("item_id", "control", lb.control_prompt("text", "control", 9, "item_id").alias("prompt"))


@query("f28_option_table", """SELECT p_partkey AS item_id, v.label, CASE v.label WHEN 'A' THEN p_brand WHEN 'B' THEN p_type ELSE p_name END AS text FROM part, (VALUES ('A'), ('B'), ('C')) v(label)""")
def f28(spark, sf):
    i = b.table(spark, sf, "part").selectExpr("p_partkey AS item_id", "map('C', p_name, 'A', p_brand, 'B', p_type) AS options")
    e = F.explode(F.array_sort(F.map_entries("options")))
    return i.select("item_id", e.alias("o")).select("item_id", F.col("o.key").alias("label"), F.col("o.value").alias("text"))
