"""How the evaluation tables are derived from the given Parquet tables, for Spark and for DuckDB.

The expressions are plain column arithmetic that both engines read the same way; the operators
themselves are written separately on each side.
"""
from pyspark.sql import functions as F

# --- trials: one row per (item, level, perturbation) replicate, from lineitem -----------------
TRIAL_COLS = {
    "item_id": "l_partkey",
    "level_no": "CAST((l_orderkey + l_linenumber) % 8 + 1 AS INT)",
    "rung": "CAST((l_orderkey + l_linenumber) % 4 + 1 AS INT)",
    "family": "concat(l_returnflag, l_linestatus)",
    "severity": "CAST(l_linenumber % 3 + 1 AS INT)",
    "perturbation": "concat(l_returnflag, l_linestatus, '(', l_linenumber, ')|sev', l_linenumber % 3 + 1)",
    "clean_correct": "CASE WHEN (l_partkey * 7 + (l_orderkey + l_linenumber) % 8 * 3) % 10 < 7 THEN 1 ELSE 0 END",
    "pert_correct": "CASE WHEN (l_orderkey * 3 + l_linenumber) % 10 < 6 THEN 1 ELSE 0 END",
    "loglik_drift": "round((l_discount - 0.05) * 20 + (l_quantity - 25) / 50, 6)",
    "csem": "round((l_orderkey + l_linenumber) % 4 + 1 + ln(1 + l_partkey % 5), 6)",
    "cprompt": "CAST(5 + (l_orderkey + l_linenumber) % 4 + l_partkey % 3 "
               "+ CASE WHEN (l_orderkey + l_linenumber) % 8 >= 4 THEN 12 ELSE 0 END AS DOUBLE)",
    "hopt": "CASE WHEN (l_orderkey + l_linenumber) % 2 = 1 THEN 3 + 0.5e0 * (l_partkey % 3) ELSE 0e0 END",
    "is_binary": "CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 1e0 ELSE 0e0 END",
}
# columns some queries add to the trial rows
TRIAL_EXTRA = {
    "order_id": "l_orderkey",
    "line_no": "l_linenumber",
    "mode": "l_linestatus",
    "cutoff": "round(0.02e0 + 0.48e0 * l_linenumber / 7, 6)",
    "supp_id": "l_suppkey",
}
LINEITEM_DOUBLES = ("l_discount", "l_quantity")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark, sf_dir, *extra, dealt=None):
    """`dealt` deals the raw rows to tasks, which are narrower than the trials computed from them."""
    cols = {**TRIAL_COLS, **{k: TRIAL_EXTRA[k] for k in extra}}
    raw = table(spark, sf_dir, "lineitem")
    return (dealt(raw) if dealt else raw).selectExpr(*[f"{e} AS {a}" for a, e in cols.items()])


def trials_cte(*extra):
    cols = {**TRIAL_COLS, **{k: TRIAL_EXTRA[k] for k in extra}}
    return "trials AS (SELECT " + ", ".join(f"{e} AS {a}" for a, e in cols.items()) + " FROM lineitem)"


OUTCOMES_SQL = """tr AS (SELECT *, clean_correct <> pert_correct AS changed,
  CASE WHEN clean_correct = 1 AND pert_correct = 0 THEN 1e0 ELSE 0e0 END AS accuracy_drop,
  greatest(loglik_drift, 0e0) AS erosion, least(loglik_drift, 0e0) AS recovery,
  abs(loglik_drift) AS volatility FROM trials)"""


def T(*extra):
    """`WITH trials AS (..), tr AS (..)` prefix of most oracles."""
    return "WITH " + trials_cte(*extra) + ", " + OUTCOMES_SQL


# --- nested records: one row per record, levels as a map, perturbations as an array -------------
def records(spark, sf_dir):
    # written out: lambdas are interpreted for every element
    one = """named_struct(
        'name', concat(l_returnflag, '({s})|sev{s}'), 'family', l_returnflag, 'severity', {s},
        'accuracy_drop', CASE WHEN {cc} = 1 AND (l_orderkey + {s}) % 3 = 0 THEN 1e0 ELSE 0e0 END,
        'loglik_drift', CASE WHEN (l_orderkey + {s}) % 5 = 0 THEN NULL
                        ELSE round((l_discount - 0.05) * 20 * {s} * {k}, 6) END)"""
    pert = "slice(array(" + ", ".join(one.replace("{s}", str(i)) for i in (1, 2, 3)) + "), 1, greatest(l_linenumber % 4, 0))"
    base_no = "CAST((l_orderkey + l_linenumber) % 4 + 1 AS INT)"
    cc = "(CASE WHEN (l_partkey + l_linenumber) % 4 < 3 THEN 1 ELSE 0 END)"

    def lev(off, k):
        return (f"named_struct('csem', CAST(l_linenumber + l_partkey % 5 AS DOUBLE), 'cprompt', "
                f"CAST(6 + {off} * 3 AS DOUBLE), 'clean_correct', {cc}, 'perturbations', {pert.format(cc=cc, k=k)})")
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS rec_id", "l_linenumber AS rec_no", "l_partkey AS item_id",
        f"map({base_no}, {lev(0, '1e0')}, {base_no} + 4, {lev(4, '0.5e0')}) AS levels")


RECORDS_SQL = """lev AS (SELECT l_orderkey AS rec_id, l_linenumber AS rec_no, l_partkey AS item_id,
    CAST((l_orderkey + l_linenumber) % 4 + 1 + m AS INT) AS level_no, l_returnflag, l_discount,
    CAST(l_linenumber + l_partkey % 5 AS DOUBLE) AS csem, CAST(6 + m * 3 AS DOUBLE) AS cprompt,
    CASE WHEN (l_partkey + l_linenumber) % 4 < 3 THEN 1 ELSE 0 END AS clean_correct,
    CASE WHEN m = 0 THEN 1e0 ELSE 0.5e0 END AS k
  FROM lineitem, (VALUES (0), (4)) v(m)),
rp AS (SELECT lev.*, concat(l_returnflag, '(', s, ')|sev', s) AS perturbation, l_returnflag AS family,
    CAST(s AS INT) AS severity,
    CASE WHEN clean_correct = 1 AND (rec_id + s) % 3 = 0 THEN 1e0 ELSE 0e0 END AS accuracy_drop,
    CASE WHEN (rec_id + s) % 5 = 0 THEN NULL ELSE round((l_discount - 0.05) * 20 * s * k, 6) END AS loglik_drift
  FROM lev, (VALUES (1), (2), (3)) q(s) WHERE s <= rec_no % 4)"""


# --- option scores: clean per (item, level) from part, perturbed per trial from lineitem ---------
LABELS = ("A", "B", "C", "D")
LABEL_K = {"A": 1, "B": 3, "C": 5, "D": 7}


def clean_scores(spark, sf_dir):
    """One row per (item, level): label -> log-likelihood; ties occur on purpose."""
    sc = ", ".join(f"'{a}', -((p_size * {k} + level_no) % 17) / 4e0" for a, k in LABEL_K.items())
    return (table(spark, sf_dir, "part")
            .selectExpr("p_partkey AS item_id", "p_size", "explode(sequence(1, 8)) AS level_no")
            .selectExpr("item_id", "CAST(level_no AS INT) AS level_no",
                        "element_at(array('A','B','C','D'), CAST(item_id % 4 + 1 AS INT)) AS answer_label",
                        f"map({sc}) AS scores", "array('A','B','C','D') AS option_labels"))


def pert_scores(spark, sf_dir):
    """One row per lineitem: scores of the perturbed input; the gold label is missing on some rows."""
    sc = ", ".join(f"'{a}', -((l_orderkey * {k} + l_linenumber) % 17) / 4e0" for a, k in LABEL_K.items())
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS item_id", "CAST((l_orderkey + l_linenumber) % 8 + 1 AS INT) AS level_no",
        "concat(l_returnflag, l_linestatus) AS perturbation", "CAST(l_linenumber % 3 + 1 AS INT) AS severity",
        f"map_filter(map({sc}), (k, v) -> NOT (l_orderkey % 11 = 0 AND k = 'B')) AS scores",
        "array('A','B','C','D') AS option_labels")


_clean = ", ".join(f"-((p_size * {k} + level_no) % 17) / 4e0 AS s{a}" for a, k in LABEL_K.items())
_pert = ", ".join((f"CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE -((l_orderkey * {k} + l_linenumber) % 17) / 4e0 END"
                   if a == "B" else f"-((l_orderkey * {k} + l_linenumber) % 17) / 4e0") + f" AS s{a}"
                  for a, k in LABEL_K.items())


def ARGMAX_SQL(p=""):
    """First of A..D among the largest present scores."""
    m = f"greatest({p}sA, {p}sB, {p}sC, {p}sD)"
    return f"CASE WHEN {p}sA = {m} THEN 'A' WHEN {p}sB = {m} THEN 'B' WHEN {p}sC = {m} THEN 'C' ELSE 'D' END"


SCORES_SQL = f"""cs AS (SELECT p_partkey AS item_id, CAST(level_no AS INT) AS level_no,
    ['A','B','C','D'][CAST(p_partkey % 4 + 1 AS INT)] AS answer_label, {_clean}
  FROM part, range(1, 9) g(level_no)),
ps AS (SELECT l_partkey AS item_id, CAST((l_orderkey + l_linenumber) % 8 + 1 AS INT) AS level_no,
    concat(l_returnflag, l_linestatus) AS perturbation, CAST(l_linenumber % 3 + 1 AS INT) AS severity, {_pert}
  FROM lineitem)"""


# --- metric observations from orders ------------------------------------------------------------
METRIC_COLS = {
    "model": "o_orderstatus",
    "metric": "CASE WHEN o_orderkey % 2 = 0 THEN 'iou' ELSE 'dice' END",
    "perturb": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Base' ELSE o_orderpriority END",
    "severity": "CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_custkey % 3 + 1 END AS INT)",
    "value": "o_totalprice / 100000e0",
    "obs_id": "o_orderkey",
}


def metric_obs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {a}" for a, e in METRIC_COLS.items()])


METRIC_SQL = "obs AS (SELECT " + ", ".join(f"{e} AS {a}" for a, e in METRIC_COLS.items()) + " FROM orders)"


# --- embeddings as vectors, filters, deltas and grids -------------------------------------------
def embedding_cols(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")
    # (rows: vec_id, embedding of 64 values = an 8x8 grid, label)


BANDS = 8


def filters(spark, sf_dir):
    """Eight-band radial power per vector: band b is the energy of grid row b; w is its l1 filter."""
    from ..functions.arrays import asum, normalize
    e = table(spark, sf_dir, "embeddings")
    bands = F.array(*[asum(F.transform(F.slice("embedding", BANDS * k + 1, BANDS),
                                       lambda x: x.cast("double") * x.cast("double"))) for k in range(BANDS)])
    out = e.select(F.col("vec_id").alias("item_id"), (F.col("label") % 8 + 1).cast("int").alias("level_no"),
                   bands.alias("radial"))
    return out.withColumn("w", normalize("radial"))


FILTERS_SQL = """filters AS (SELECT *, list_transform(radial, lambda x: x / list_sum(radial)) AS w FROM (
  SELECT vec_id AS item_id, CAST(label % 8 + 1 AS INT) AS level_no,
    list_transform(range(0, 8), lambda k: list_sum(list_transform(CAST(embedding[8*k+1:8*k+8] AS DOUBLE[]), lambda x: x * x))) AS radial
  FROM embeddings)),
avgf AS (SELECT level_no, list_transform(m, lambda x: x / list_sum(m)) AS w FROM (
  SELECT level_no, list(m ORDER BY k) AS m FROM (
    SELECT level_no, k, avg(radial[k]) AS m FROM filters, range(1, 9) t(k) GROUP BY level_no, k) GROUP BY level_no))"""


def variants(spark, sf_dir):
    """Clean vector v beside its perturbed variant v+1; the perturbation is the label of v+1."""
    e = table(spark, sf_dir, "embeddings")
    c = e.select("vec_id", F.col("embedding").alias("clean"), F.col("label").alias("channel"))
    p = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("pert"),
                 F.col("label").alias("perturbation"))
    return c.join(p, "vec_id")


VARIANTS_SQL = """variants AS (SELECT c.vec_id, CAST(c.embedding AS DOUBLE[]) AS clean, CAST(p.embedding AS DOUBLE[]) AS pert,
  c.label AS channel, p.label AS perturbation FROM embeddings c JOIN embeddings p ON p.vec_id = c.vec_id + 1)"""

DELTA_ELEMENTS = [f"((l_orderkey * {i} + l_linenumber * {i * i}) % 11) / 10e0" for i in range(1, BANDS + 1)]
TRIAL_EXTRA["d"] = "array(" + ", ".join(DELTA_ELEMENTS) + ")"
_DUCK_DELTA = "[" + ", ".join(DELTA_ELEMENTS) + "]"


def filter_tables(spark, sf_dir):
    """Filters of items, and the average filter of each level."""
    from ..functions.arrays import normalize
    from ..operators.aggregates import mean_vector
    f = filters(spark, sf_dir)
    return f, mean_vector(f, "radial", "level_no").select("level_no", normalize("mean_vec").alias("w"))


def pairs(spark, sf_dir, *extra, item_tasks=0):
    """Trials with outcome columns, their filter and the first-order and quadratic overlap. With `item_tasks` they move once, as raw rows by item to so
    many tasks, and stay there."""
    from ..functions.arrays import band_overlap, band_quadratic_overlap
    from ..operators.joins import with_filters
    from ..operators.trials import with_outcomes
    f, avg = filter_tables(spark, sf_dir)
    t = with_outcomes(trials(spark, sf_dir, "d", *extra, dealt=(lambda raw: raw.repartition(item_tasks, "l_partkey")) if item_tasks else None))
    return (with_filters(t, f, avg, by_item=bool(item_tasks)).withColumn("predicted", band_overlap("w", "d", BANDS))
            .withColumn("predicted_quadratic", band_quadratic_overlap("w", "d", BANDS)))


def PAIRS(*extra):
    """`WITH .. pairs AS (..)` prefix for oracles over trials joined with filters."""
    cols = {**TRIAL_COLS, **{k: TRIAL_EXTRA[k] for k in extra}, "d": _DUCK_DELTA}
    t = "trials AS (SELECT " + ", ".join(f"{e} AS {a}" for a, e in cols.items()) + " FROM lineitem)"
    return ("WITH " + t + ", " + OUTCOMES_SQL + ", " + FILTERS_SQL + """, pw AS (
  SELECT tr.*, coalesce(f.w, a.w) AS w, f.w IS NOT NULL AS own FROM tr LEFT JOIN filters f USING (item_id, level_no)
  LEFT JOIN avgf a USING (level_no)),
pairs AS (SELECT *, list_dot_product(w, d) AS predicted,
  list_dot_product(list_transform(w, lambda x: x * x), list_transform(d, lambda x: x * x)) AS predicted_quadratic
  FROM pw WHERE w IS NOT NULL)""")


def scene_objects(spark, sf_dir):
    """Scene = order, object = line number (its lowest part key), named by the noun of the part name,
    described by its adjective and part type."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("oid")) \
        .agg(F.min("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "split_part(p_name, ' ', 2) AS name", "split_part(p_name, ' ', 1) AS adj", "lower(p_type) AS kind",
        "p_name AS full_name", "p_size AS size")
    return li.join(part, "p_partkey").select("scene", "oid", "name", "adj", "kind", "full_name", "size")


SCENE_SQL = """so AS (SELECT scene, oid, split_part(p_name, ' ', 2) AS name, split_part(p_name, ' ', 1) AS adj, lower(p_type) AS kind,
    p_name AS full_name, p_size AS size FROM (
    SELECT l_orderkey AS scene, l_linenumber AS oid, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1, 2) JOIN part USING (p_partkey)),
rel AS (SELECT a.scene, a.oid AS subject, b.oid AS target,
  CASE a.oid % 4 WHEN 0 THEN 'to the left of' WHEN 1 THEN 'behind' WHEN 2 THEN 'near' ELSE 'above' END AS relation
  FROM so a JOIN so b ON a.scene = b.scene AND b.oid = a.oid + 1)"""


def scene_relations(objects):
    """Edge to the object with the next line number of the same scene."""
    a = objects.select("scene", F.col("oid").alias("subject"), (F.col("oid") + 1).alias("target"))
    t = objects.select("scene", F.col("oid").alias("target"))
    return a.join(t.hint("merge"), ["scene", "target"]).select("scene", "subject", "target", F.expr(
        "CASE subject % 4 WHEN 0 THEN 'to the left of' WHEN 1 THEN 'behind' WHEN 2 THEN 'near' ELSE 'above' END").alias("relation"))


def grid_cells(spark, sf_dir):
    """Each embedding as an 8x8 grid in long form: (vec_id, label, r, c, x)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", "label", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"),
                    F.col("x").cast("double").alias("x"))


CELLS_SQL = """cells AS (SELECT vec_id, label, CAST((pos - 1) // 8 AS INT) AS r, CAST((pos - 1) % 8 AS INT) AS c, CAST(x AS DOUBLE) AS x
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""
