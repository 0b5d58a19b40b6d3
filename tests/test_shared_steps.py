"""Steps that several branches of a query read are done once."""
from pyspark.sql import functions as F

from robustlens.plans import bindings as b
from robustlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scene_objects_are_built_once(spark):
    """No rung's branch goes back to the line items."""
    import __spark_entry__  # noqa: F401
    text = plan(QUERIES["f12_scene_questions"](spark, SF))
    assert "l_orderkey" not in text and "p_partkey" not in text


def test_band_forms_equal_the_general_ones(spark):
    """Also for arrays that are short, long, null, empty, or hold null, NaN, zeros or negatives."""
    import random

    from robustlens.functions import arrays as ar
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.1, 0.5, 1.0, -0.3, r.random()]) for _ in range(8)], [r.random() for _ in range(8)]) for i in range(300)]
    rows += [(300, None, [0.1] * 8), (301, [], [0.1] * 8), (302, [0.0] * 8, [0.1] * 8), (303, [0.1] * 7 + [None], [0.2] * 8), (304, [0.3] * 7 + [float("nan")], [0.2] * 8),
             (305, [1.0, 2.0, 0.5], [0.1] * 8), (306, [1.0] * 9, [0.1] * 8), (307, [1e-14] * 8, [0.1] * 8), (308, [0.4] * 8, None)]
    df = spark.createDataFrame(rows, "i int, d array<double>, w array<double>")
    got = ar.with_band_signature(df, "d", "got", 8).withColumn("want", ar.spectral_features("d")["signature"]).collect()
    assert len(got) == len(rows) and [(x.i, x.got) for x in got] == [(x.i, x.want) for x in got]
    assert len({x.got for x in got}) >= 4
    full = df.where("i < 300 OR i IN (300, 302, 303, 308)")
    for a, b_ in ((ar.band_overlap("w", "d", 8), ar.overlap("w", "d")), (ar.band_quadratic_overlap("w", "d", 8), ar.quadratic_overlap("w", "d"))):
        assert full.where(~a.eqNullSafe(b_)).count() == 0


def test_filters_are_labelled_before_they_meet_trials(spark):
    """Above the join no lambda runs over a whole filter."""
    from robustlens.plans.q_aggregates import signature_rows
    text = plan(signature_rows(spark, SF))
    top = text[:text.index("Join LeftOuter")]
    assert "lambda" not in top


def test_a_fit_that_is_not_asked_for_is_not_worked_out(spark, monkeypatch):
    """Fixed effects alone give the same rows, with fewer written tables, and sums by cluster need no sort."""
    from robustlens.operators import regression as rg
    df = spark.range(400).select((F.col("id") % 23).alias("c"), (F.col("id") % 5).cast("string").alias("p"), (F.col("id") % 7 * 1.0).alias("x"), F.sin("id").alias("z"), F.cos(F.col("id") * 3).alias("y"))
    names, plans, write = [], [], rg.materialize

    def counted(spark, df, name, *a):
        names.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(spark, df, name, *a)
    monkeypatch.setattr(rg, "materialize", counted)
    cols = ["predictor", "beta", "stderr", "classical_stderr", "n", "n_clusters", "r_squared"]
    both = rg.long_format_fit(df, ["x", "z"], "y", "c", "p").where("model = 'fe'").select(cols).orderBy("predictor").collect()
    assert names.count("sums") == 2 and not any("SortAggregate" in p for n, p in zip(names, plans) if n in ("sums", "totals"))
    names.clear()
    alone = rg.long_format_fit(df, ["x", "z"], "y", "c", "p", ["fe"]).select(cols).orderBy("predictor").collect()
    assert names.count("sums") == 1
    assert [x.predictor for x in alone] == [x.predictor for x in both] == ["x", "z"]
    assert all(abs(a - b_) < 1e-9 for r, s in zip(alone, both) for a, b_ in zip(r[1:], s[1:]))


def test_pair_rows_are_shared_by_their_number(spark, monkeypatch):
    """Rows move before they are folded, to more tasks where there are more rows."""
    from robustlens.operators import aggregates as ag
    from robustlens.plans.q_aggregates import grouped
    monkeypatch.setattr(ag, "GROUP_ROWS", 100)
    got = grouped(spark, SF).select("item_id", "level_no", "family", "net_drop")
    n = b.table(spark, SF, "lineitem").count()
    text = got._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(item_id" in text and f", {-(-n // 100)})" in text
    assert text.index("partial_avg") < text.index(f", {-(-n // 100)})")      # the partial step stands above the exchange


def test_view_correlations_do_not_copy_cells(spark):
    """The same as a copy of the cells for each view, also with ties, NaN, a constant rung and rungs of few rows; and no view is made of cells."""
    import math
    import random

    from robustlens.operators import stats as st
    r = random.Random(3)
    rows = [(g, level, round(r.random() * (1 if g else 3), 1), 1.0 if level == 2 else round(r.random(), 2), r.randint(1, 4)) for g in (0, 1) for level in (1, 2, 3, 5, 6, 8) for _ in range(150)]
    rows += [(1, 7, 0.5, 0.25, 1), (1, 7, None, 0.5, 1)] + [(2, 1, 0.5, float("nan"), 1), (2, 1, 0.25, 0.5, 2), (2, 6, 0.75, 0.5, 2), (2, 6, 0.5, 0.75, 3)]
    df = spark.createDataFrame(rows, "g int, level int, x double, y double, k long").groupBy("g", "level", "x", "y").agg(F.sum("k").alias("k"))
    own = F.when(F.col("level") < 5, "primary").otherwise("wordy")
    views = df.withColumn("view", F.explode(F.array(own, F.lit("pooled"), F.concat(F.lit("level_"), "level"))))
    both = st.pearson(views, ["g", "view"], "x", "y", weight="k").join(st.spearman(views, ["g", "view"], "x", "y", weight="k").drop("n"), ["g", "view"])
    want = {(w.g, w.view): (w.n, w.r, w.rho) for w in both.collect()}
    got = {(w.g, w.view): (w.n, w.r, w.rho) for w in st.view_correlations(df, ["g"], "x", "y", "level", "k", {"primary": (1, 2, 3, 4), "wordy": (5, 6, 7, 8)}).collect()}
    assert set(got) == set(want)
    for key, (n, *cs) in want.items():
        assert got[key][0] == n and all(math.isclose(a, b, abs_tol=1e-9) or math.isnan(a) and math.isnan(b) for a, b in zip(got[key][1:], cs)), (key, got[key], want[key])


def test_records_are_made_without_lambdas(spark):
    """Each record holds its first l_linenumber % 4 perturbations, none of them interpreted element by element."""
    rec = b.records(spark, SF)
    assert "lambda" not in plan(rec)
    for r in rec.where("rec_id < 50").collect():
        for lv in r.levels.values():
            assert [p.severity for p in lv.perturbations] == list(range(1, r.rec_no % 4 + 1)) and all(p.name == f"{p.family}({p.severity})|sev{p.severity}" for p in lv.perturbations)
