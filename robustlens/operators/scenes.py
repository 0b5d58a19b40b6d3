"""Scene tables: relation lookups, closed-form pair counts, negatives and question building."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_hex, hash_int
from ..functions.wordlists import ATTRIBUTE_CATEGORIES, OPPOSITE_RELATION, attribute_category
from ..session import materialize


def map_of(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def named_relations(objects, relations):
    """Edges with the names of both ends: two equi joins on (scene, object), merged, as a small file may hold many objects."""
    s = objects.select("scene", F.col("oid").alias("subject"), F.col("name").alias("subject_name"))
    t = objects.select("scene", F.col("oid").alias("target"), F.col("name").alias("target_name"))
    return relations.join(s.hint("merge"), ["scene", "subject"]).join(t.hint("merge"), ["scene", "target"])


def name_counts(objects):
    return objects.groupBy("scene", F.lower(F.trim("name")).alias("name")).agg(F.count("*").alias("n"))


def named_pair_counts(objects, named):
    """Ordered pairs of distinct objects with the two names, from the counts: n_s*n_t - [s=t]*n_s."""
    n = name_counts(objects)
    s = n.select("scene", F.col("name").alias("s"), F.col("n").alias("ns"))
    t = n.select("scene", F.col("name").alias("t"), F.col("n").alias("nt"))
    k = named.withColumn("s", F.lower(F.trim("subject_name"))).withColumn("t", F.lower(F.trim("target_name")))
    j = k.join(s, ["scene", "s"]).join(t, ["scene", "t"])
    same = (F.col("s") == F.col("t")).cast("long")
    return j.select("scene", "subject_name", "target_name", (F.col("ns") * F.col("nt") - same * F.col("ns")).alias("n_pairs"))


NAME_RANGES = 256        # ranges of the sorted vocabulary, each ranked by its own task


def name_ranks(objects):
    """Alphabetical 0-based rank of every distinct name; null has none.

    Spark's range partitioning draws the splitters from a sample of the names, so any common prefix spreads; the ranges are written once, and a range's
    offset comes from the NAME_RANGES counts.
    """
    names = objects.select("name").where("name IS NOT NULL").distinct().repartitionByRange(NAME_RANGES, "name")
    names = materialize(objects.sparkSession, names.withColumn("range_no", F.spark_partition_id()), "names")
    sizes = names.groupBy("range_no").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("range_no", "n"))).alias("s"))
    before = F.expr("transform(s, (x, i) -> named_struct('range_no', x.range_no, 'off', aggregate(slice(s, 1, i), 0L, (a, y) -> a + y.n)))")
    offs = sizes.select(F.explode(before).alias("o")).select("o.range_no", "o.off")
    rn = F.row_number().over(Window.partitionBy("range_no").orderBy("name")) - 1
    return names.withColumn("rn", rn).join(offs, "range_no").select("name", (F.col("off") + F.col("rn")).alias("rk"))


def negative_names(objects, seed):
    """For every scene one name that does not occur in it, uniform by hash; scenes holding every name drop out.

    The j-th missing rank is j plus the number of present ranks below it, which needs only the scene's own
    ranks: no scene x vocabulary product is formed. Cost is the distinct (scene, name) rows.
    """
    ranks = name_ranks(objects)
    vocab = ranks.agg(F.count("*").alias("v")).select("v").scalar()
    present = materialize(objects.sparkSession, objects.select("scene", "name").distinct().join(ranks, "name").select("scene", "rk"), "present")     # read twice
    w = Window.partitionBy("scene").orderBy("rk")
    # distinct names of one scene, at most the vocabulary
    gaps = present.withColumn("gap", F.col("rk") - (F.row_number().over(w) - 1))
    k = present.groupBy("scene").agg(F.count("*").alias("k"))
    pick = k.withColumn("v", vocab).where("v > k").withColumn("j", hash_int(seed, "scene") % (F.col("v") - F.col("k")))
    chosen = gaps.join(pick.hint("merge"), "scene").groupBy("scene").agg(
        (F.max("j") + F.count_if(F.col("gap") <= F.col("j"))).alias("rk"))
    return chosen.join(ranks, "rk").select("scene", F.col("name").alias("negative"))


def attribute_inventory(objects):
    """Distinct lower-case attributes per scene, in long form."""
    attr = F.explode(F.array(F.lower(F.trim("adj")), F.lower(F.trim("kind"))))
    return objects.select("scene", attr.alias("attr")).where("attr <> ''").distinct()


def classified_attribute(objects, seed=11):
    """One recognised (category, value) per object: first per category, the category picked by hash order."""
    cats = map_of(attribute_category())
    adj, kind = F.lower(F.trim("adj")), F.lower(F.trim("kind"))
    a, k = F.try_element_at(cats, adj), F.try_element_at(cats, kind)
    # adj wins where both fall into the same category; the survivors are ordered by hash of (scene, oid, category)
    both = F.when(a.isNull(), F.struct(k.alias("category"), kind.alias("value"))).when(
        k.isNull() | (a == k), F.struct(a.alias("category"), adj.alias("value"))).otherwise(
        F.when(hash_hex(seed, "scene", "oid", a) <= hash_hex(seed, "scene", "oid", k),
               F.struct(a.alias("category"), adj.alias("value"))).otherwise(F.struct(k.alias("category"), kind.alias("value"))))
    return objects.withColumn("_c", both).withColumn("category", F.col("_c.category")).withColumn("value", F.col("_c.value")) \
        .drop("_c").where("category IS NOT NULL")


def distractors(category, value, n, seed, *keys):
    """n values of the category other than the right one, in hash order (a fold over the fixed vocabulary)."""
    pool = map_of_arrays(ATTRIBUTE_CATEGORIES)[category]
    ranked = F.transform(F.filter(pool, lambda x: x != value),
                         lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], x)).alias("h"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda s: s["x"])


def map_of_arrays(d):
    return F.create_map(*[e for k, v in d.items() for e in (F.lit(k), F.array(*[F.lit(x) for x in v]))])


def option_hardness(objects, seed=11):
    """Distractors of the answer's category plus half the distractors present in the scene."""
    c = classified_attribute(objects, seed)
    c = c.withColumn("opts", distractors(F.col("category"), F.col("value"), 3, seed, "scene", "oid"))
    # The outer form: below an inner `explode` Spark's filters on the list would compute it anew for each.
    one = c.select("scene", "oid", "category", F.posexplode_outer("opts").alias("k", "attr")).where(F.col("k").isNotNull()).drop("k")
    inv = attribute_inventory(objects).withColumn("hit", F.lit(1))
    same = (F.try_element_at(map_of(attribute_category()), F.col("attr")) == F.col("category")).cast("long")
    g = one.join(inv, ["scene", "attr"], "left").groupBy("scene", "oid").agg(
        F.sum(F.coalesce(same, F.lit(0))).alias("same_category"), F.count("hit").alias("scene_present"))
    return g.withColumn("hardness", F.col("same_category") + 0.5 * F.col("scene_present"))


def best_box_match(pred, gt):
    """Best-IoU ground-truth box of the same frame for every predicted box; first wins, 0 if none overlaps.

    Equal predictions are matched once and come back as often as they were given.
    """
    p = pred.groupBy("frame", "k", "x", "y", "s").agg(F.count("*").alias("copies"))
    g = gt.select("frame", *[F.col(c).alias(f"g_{c}") for c in ("k", "x", "y", "s")])

    def side(a, ga):
        return F.greatest(F.lit(0.0), F.least(F.col(a) + F.col("s"), F.col(ga) + F.col("g_s")) - F.greatest(F.col(a), F.col(ga)))
    inter = side("x", "g_x") * side("y", "g_y")
    union = F.col("s") * F.col("s") + F.col("g_s") * F.col("g_s") - inter
    j = p.join(g, "frame", "left").withColumn("iou", F.coalesce(F.when(union > 0, inter / union), F.lit(0.0)))
    best = F.max(F.struct("iou", (-F.col("g_k")).alias("nk"))).alias("b")
    return j.groupBy("frame", "k", "x", "y", "s", "copies").agg(best).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "frame", "k", "x", "y", "s", F.col("b.iou").alias("best_iou"), F.when(F.col("b.iou") > 0, -F.col("b.nk")).alias("matched"))


def opposite(relation):
    return F.try_element_at(map_of(OPPOSITE_RELATION), relation)


# DuckDB text of the attribute classification and hardness (reads the `so` table of a query)
_CATS = ", ".join(f"('{c}', '{w}', {i})" for c, ws in ATTRIBUTE_CATEGORIES.items() for i, w in enumerate(ws))
CLASSIFIED_SQL = f"""voc(category, word, i) AS (VALUES {_CATS}),
att AS (SELECT scene, oid, 0 AS pos, adj AS value FROM so UNION ALL SELECT scene, oid, 1, kind FROM so),
cat AS (SELECT scene, oid, category, arg_min(value, pos) AS value FROM att JOIN voc ON word = value GROUP BY 1, 2, 3),
cls AS (SELECT scene, oid, category, value FROM (SELECT *, row_number() OVER (PARTITION BY scene, oid
  ORDER BY md5(concat_ws('|', '11', CAST(scene AS VARCHAR), CAST(oid AS VARCHAR), category))) AS rn FROM cat) WHERE rn = 1),
dis AS (SELECT * FROM (SELECT cls.*, word, row_number() OVER (PARTITION BY scene, oid
  ORDER BY md5(concat_ws('|', '11', CAST(scene AS VARCHAR), CAST(oid AS VARCHAR), word))) AS k FROM cls JOIN voc USING (category) WHERE word <> value) WHERE k <= 3)"""
HARDNESS_SQL = CLASSIFIED_SQL + """, hard AS (SELECT scene, oid, count(*) AS same_category,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM att WHERE att.scene = dis.scene AND att.value = dis.word)) AS scene_present FROM dis GROUP BY 1, 2)"""


def first_by_hash(df, seed, group, *order):
    """The row of each group with the smallest hash, as one partial aggregate over the needed columns."""
    cols = [c for c in df.columns if c not in group]
    pick = F.min(F.struct(hash_hex(seed, *order).alias("_h"), *cols)).alias("_p")
    return df.groupBy(*group).agg(pick).select(*group, *[F.col(f"_p.{c}").alias(c) for c in cols])


def answer_position(category, value, opts, seed):
    """Letter of the right value once the value and its distractors are put in hash order."""
    def h(x):
        return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("scene").cast("string"), x))
    smaller = F.size(F.filter(opts, lambda x: h(x) < h(value)))
    return F.char(F.lit(65) + smaller)


def scene_questions(objects, relations):
    """One question per scene and rung from a scene graph (F12): presence, attribute, relation, attribute by relation.

    Targets, polarity and options come from hash order. A negative relation needs a provably false opposite; the
    fourth rung reuses the second's target, options and answer and adds the relation clause. What several rungs read is written once.
    """
    spark = objects.sparkSession
    scene = ["scene"]
    yes = hash_int(23, "scene") % 2 == 0
    target = first_by_hash(objects.select("scene", "oid", "name"), 22, scene, "scene", "oid")
    l1 = target.join(negative_names(objects.select("scene", "name"), 21).hint("merge"), "scene", "left").where(yes | F.col("negative").isNotNull())
    l1 = l1.select("scene", F.lit(1).alias("level_no"), F.concat(F.lit("Is there a "), F.when(yes, F.col("name")).otherwise(F.col("negative")), F.lit(" in this image?")).alias("question"),
                   F.when(yes, "A").otherwise("B").alias("answer"))
    cls = classified_attribute(objects).select("scene", "oid", "name", "category", "value")
    t2 = first_by_hash(cls, 24, scene, "scene", "oid").withColumn("opts", distractors(F.col("category"), F.col("value"), 3, 11, "scene", "oid"))
    t2 = t2.withColumn("answer", answer_position(F.col("category"), F.col("value"), F.col("opts"), 27))
    t2 = materialize(spark, t2.drop("opts", "value"), "targets")
    l2 = t2.select("scene", F.lit(2).alias("level_no"), F.concat(F.lit("What "), "category", F.lit(" is the "), "name", F.lit("?")).alias("question"), "answer")
    named = materialize(spark, named_relations(objects, relations).select("scene", "subject", "subject_name", "target_name", "relation"), "named")
    pos = hash_int(26, "scene") % 2 == 0
    usable = named.where(pos | opposite(F.col("relation")).isNotNull()).select("scene", "subject", "subject_name", "target_name", "relation")
    l3 = first_by_hash(usable, 25, scene, "scene", "subject")
    l3 = l3.select("scene", F.lit(3).alias("level_no"), F.concat(F.lit("Is the "), "subject_name", F.lit(" "), F.when(pos, F.col("relation")).otherwise(opposite(F.col("relation"))), F.lit(" the "), "target_name", F.lit("?")).alias("question"),
                   F.when(pos, "A").otherwise("B").alias("answer"))
    r4 = named.select("scene", F.col("subject").alias("oid"), "relation", "target_name")
    l4 = t2.join(r4.hint("merge"), ["scene", "oid"]).select("scene", F.lit(4).alias("level_no"), F.concat(F.lit("What "), "category", F.lit(" is the "), "name", F.lit(" that is "), "relation", F.lit(" the "), "target_name", F.lit("?")).alias("question"), "answer")
    return l1.unionByName(l2).unionByName(l3).unionByName(l4)


def identifying_attribute(objects):
    """First category (color, shape, material, size) whose remaining description is unique in the scene.

    Each description is counted by its own key, so no scene is held as a whole.
    """
    from ..functions.wordlists import IDENTIFYING_ORDER
    all_attrs = ("size", "color", "material", "shape")
    out = objects
    for c in IDENTIFYING_ORDER:
        rest = ["scene", *[a for a in all_attrs if a != c]]
        out = out.join(objects.groupBy(*rest).agg(F.count("*").alias(f"k_{c}")), rest)
    attr, phrase = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(IDENTIFYING_ORDER):
        parts = [F.col(a) for a in all_attrs if a != c] + ([F.lit("object")] if c == "shape" else [])
        attr = F.when(F.col(f"k_{c}") == 1, c).otherwise(attr)
        phrase = F.when(F.col(f"k_{c}") == 1, F.concat_ws(" ", *parts)).otherwise(phrase)
    return out.select("scene", "oid", attr.alias("attribute"), F.concat_ws(" ", *all_attrs).alias("full_phrase"), phrase.alias("phrase"))
