"""Degenerate inputs, closed forms and brute-force checks of the operators without SQL."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from robustlens.functions import arrays as ar
from robustlens.functions import pvalues as pv
from robustlens.functions.numeric import safe_corr
from robustlens.operators import aggregates as ag
from robustlens.operators import grids as gr
from robustlens.operators import joins as jn
from robustlens.operators import masks as mk
from robustlens.operators import regression as rg
from robustlens.operators import stats as st
from robustlens.operators import windows as wn


def test_safe_corr_guards(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 5.0),
                               ("c", 1.0, 3.0), ("c", 2.0, 2.0), ("c", 3.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.r for r in d.groupBy("k").agg(safe_corr("x", "y").alias("r")).collect()}
    assert got["a"] == 0.0 and got["b"] == 0.0 and got["c"] == pytest.approx(-1.0)


def test_null_prediction_counts_as_instance_only(spark):
    d = spark.createDataFrame([(1, "p", True), (1, "p", None), (2, "p", False)], "item_id long, perturbation string, changed boolean")
    r = {x.perturbation: x for x in ag.flip_rates(d).collect()}
    assert r["p"].instances == 3 and r["p"].changed == 1 and r["Any"].ve_rate == 0.5


def test_argmax_takes_first_label_on_ties(spark):
    d = spark.createDataFrame([({"B": 1.0, "A": 1.0, "C": 0.0}, ["B", "A", "C"])], "s map<string,double>, l array<string>")
    assert d.select(jn.argmax_label("s", "l")).first()[0] == "B"


def test_p_values_match_tables():
    assert float(pv.t_sf2(2.228, 10)) == pytest.approx(0.05, abs=1e-4)
    assert float(pv.t_ppf(0.975, 30)) == pytest.approx(2.0423, abs=1e-4)
    assert float(pv.f_sf(3.1, 3, 20)) == pytest.approx(0.0500, abs=3e-4)
    assert float(pv.norm_sf2(1.959964)) == pytest.approx(0.05, abs=1e-6)


def design(seed, n, deficient=False):
    g = np.random.default_rng(seed)
    cl = g.integers(0, 20, n)
    x1 = g.normal(5, 1, n)
    x2 = 2 * x1 if deficient else g.normal(-3, 2, n)
    x3 = g.normal(0, 1, n)
    y = 1 + 0.5 * x1 - 0.2 * x2 + 0.1 * x3 + g.normal(0, 1, n) + 0.3 * (cl % 3)
    return cl, np.column_stack([x1, x2, x3]), y


@pytest.mark.parametrize("deficient", [False, True])
def test_regression_equals_lstsq_and_sandwich(spark, deficient):
    cl, x, y = design(3, 300, deficient)
    df = spark.createDataFrame([(int(c), *map(float, r), float(v)) for c, r, v in zip(cl, x, y)], "c int, x1 double, x2 double, x3 double, y double")
    got = {r.predictor: r for r in rg.fit(df, ["x1", "x2", "x3"], "y", "c").collect()}
    xd = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(xd, y, rcond=None)[0]
    e = y - xd @ beta
    bread = np.linalg.pinv(xd.T @ xd)
    u = np.array([xd[cl == c].T @ e[cl == c] for c in np.unique(cl)])
    n, k, g = len(y), xd.shape[1], len(u)
    cov = (g / (g - 1)) * ((n - 1) / (n - k)) * bread @ (u.T @ u) @ bread
    for i, name in enumerate(["intercept", "x1", "x2", "x3"]):
        assert got[name].beta == pytest.approx(beta[i], rel=1e-6, abs=1e-8)
        assert got[name].stderr == pytest.approx(np.sqrt(cov[i, i]), rel=1e-5, abs=1e-8)


def test_average_ranks_and_quantiles_against_numpy(spark):
    g = np.random.default_rng(0)
    v = np.concatenate([np.zeros(400), g.integers(0, 50, 600), g.normal(0, 30, 200)]).astype(float)   # one hot value
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    q = wn.exact_quantiles(d, "v", [0.025, 0.5, 0.9]).first()
    assert [q.q0, q.q1, q.q2] == pytest.approx(list(np.quantile(v, [0.025, 0.5, 0.9])))
    ranks = {r.v: r["rank"] for r in wn.average_ranks(d, "v").collect()}
    order = np.sort(v)
    for x in np.unique(v):
        at = np.flatnonzero(order == x) + 1
        assert ranks[x] == pytest.approx(at.mean())


def test_bootstrap_mean_is_near_the_estimate(spark):
    d = spark.range(500).select("id", (F.col("id") % 17).cast("double").alias("s"), F.lit(1.0).alias("n"))
    ci = st.bootstrap_ci(d, [], ["id"], "mean", 300).first()
    mean = np.mean([i % 17 for i in range(500)])
    assert ci.ci_lower < mean < ci.ci_upper and ci.ci_upper - ci.ci_lower < 1.2 and ci.estimate == pytest.approx(mean)


def test_draw_hashes_and_poisson_table():
    g = np.random.default_rng(5)
    x, a, c = (g.integers(0, st.PRIME, 500).astype(np.uint64) for _ in range(3))
    assert st.hash_residues(x, a, c).tolist() == [(int(p) * int(q) + int(r)) % st.PRIME for p, q, r in zip(x, a, c)]
    assert st.hash_residues(np.array([st.PRIME - 1], np.uint64), np.array([st.PRIME - 1], np.uint64), np.array([st.PRIME - 1], np.uint64))[0] == ((st.PRIME - 1) ** 2 + st.PRIME - 1) % st.PRIME
    assert len(st.POISSON_CDF) > 15 and 1 - st.POISSON_CDF[-1] < 2e-15 and list(st.POISSON_CDF) == sorted(st.POISSON_CDF)


def test_control_draws_are_distinct_and_never_self(spark):
    rows = jn.control_draws(spark.range(50).select(F.col("id").alias("k")), "k").collect()
    per = {}
    for r in rows:
        per.setdefault(r.k, []).append(r.other)
    assert len(per) == 50 and all(len(set(v)) == 3 and k not in v for k, v in per.items())


def test_spectra_closed_forms(spark):
    flat = [1.0] * 64
    ramp = [float(i % 8) for i in range(64)]
    d = spark.createDataFrame([(1, flat, flat), (2, ramp, ramp[8:] + ramp[:8])], "vec_id long, clean array<double>, pert array<double>")
    d = d.withColumn("perturbation", F.lit(0))
    dc = {r.vec_id: r.bands for r in gr.fft_bands(d, "clean", 8, 8, 8, "none", False).collect()}
    assert dc[1][0] == pytest.approx(64.0 ** 2) and sum(dc[1][1:]) == pytest.approx(0, abs=1e-9)
    same = {r.vec_id: r.delta for r in gr.delta_spectrum(d, 8, 8, 8).collect()}
    assert np.allclose(same[1], 0)
    shifted = {r.vec_id: r.bands for r in gr.fft_bands(d, "pert", 8, 8, 8, "none", False).collect()}
    assert np.allclose(shifted[2], dc[2])   # a cyclic shift leaves the power bands alone


def test_token_fft_against_numpy(spark):
    g = np.random.default_rng(1)
    a, b = g.normal(size=64), g.normal(size=64)
    d = spark.createDataFrame([(1, a.tolist(), b.tolist())], "vec_id long, clean array<double>, pert array<double>")
    r = gr.token_fft_drift(d).first()
    m = np.abs(np.fft.rfft(b) - np.fft.rfft(a))
    assert r.low == pytest.approx(m[:8].mean()) and r.high == pytest.approx(m[-8:].mean())


def brute_boundary_f(p, q, tol):
    def edge(m):
        return {(y, x) for y in range(8) for x in range(8) if m[y, x] and any(
            not (0 <= y + a < 8 and 0 <= x + b < 8 and m[y + a, x + b]) for a in (-1, 0, 1) for b in (-1, 0, 1))}
    def near(s):
        return {(y + a, x + b) for y, x in s for a in range(-tol, tol + 1) for b in range(-tol, tol + 1)}
    a, b = edge(p), edge(q)
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    pr, rc = len(a & near(b)) / len(a), len(b & near(a)) / len(b)
    return 2 * pr * rc / (pr + rc) if pr + rc else 0.0


def test_boundary_f_against_brute_force():
    g = np.random.default_rng(2)
    for _ in range(50):
        p, q = g.random((8, 8)) > 0.6, g.random((8, 8)) > 0.6
        assert mk.rim_scores(p[None], q[None], 1)[0] == pytest.approx(brute_boundary_f(p, q, 1))
    empty, full = np.zeros((2, 8, 8), bool), np.ones((2, 8, 8), bool)
    assert mk.rim_scores(empty, empty, 1).tolist() == [1.0, 1.0] and mk.rim_scores(empty, full, 1).tolist() == [0.0, 0.0]
    assert mk.rim_scores(full, full, 2).tolist() == [1.0, 1.0]


def test_grid_kernels_keep_their_invariants():
    g = np.random.default_rng(3).normal(size=(5, 8, 8))
    rows = np.arange(5)
    assert np.sort(gr.kernel(g, "shift", 2, rows).ravel()) == pytest.approx(np.sort(g.ravel()))
    assert gr.kernel(g, "brightness", 0.1, rows) == pytest.approx(g + 0.1)
    assert gr.kernel(g, "contrast", 0.5, rows).mean(axis=(1, 2)) == pytest.approx(g.mean(axis=(1, 2)))
    rad = gr.frequency_radius(8, 8)
    assert rad.max() == 1.0 and gr.kernel(g, "lowpass", 1.0, rows) == pytest.approx(g) and gr.kernel(g, "highpass", 0.0, rows) == pytest.approx(g)
    f = np.abs(np.fft.fft2(gr.kernel(g, "highpass", 0.5, rows), axes=(1, 2)))
    assert np.allclose(f[:, rad < 0.5], 0) and not np.allclose(f[:, rad >= 0.5], 0)
    box = gr.kernel(np.ones((1, 8, 8)), "occlusion", 0.25, rows)[0]
    assert (box == 0).sum() == 16 and (box[2:6, 2:6] == 0).all()
    many = gr.noise(np.arange(4000), 64)
    assert abs(many.mean()) < 0.01 and abs(many.std() - 1) < 0.01 and np.allclose(many[7], gr.noise(np.array([7]), 64)[0])
    assert (gr.kernel(g, "band_noise", 0.1, rows) - g).std(axis=(1, 2)) == pytest.approx(np.full(5, 0.1))


def test_part_counts_against_flood_fill():
    g = np.random.default_rng(6)
    stack = g.random((40, 7, 9)) > 0.55
    for m, n in zip(stack, mk.part_counts(stack)):
        left, parts = {(int(y), int(x)) for y, x in np.argwhere(m)}, 0
        while left:
            parts, todo = parts + 1, [left.pop()]
            while todo:
                y, x = todo.pop()
                near = {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & left
                left -= near
                todo += near
        assert parts == n


@pytest.mark.parametrize("scheme", ["equal", "log", "percentile"])
def test_radial_thirds(scheme):
    rad = np.hypot(*np.indices((9, 9)))
    assert set(gr.radial_thirds(rad, scheme).ravel()) == {0, 1, 2} and gr.radial_thirds(rad, scheme)[0, 0] == 0
    assert set(gr.radial_thirds(np.zeros(4), scheme)) == {0}


def test_pca_equals_numpy(spark):
    from robustlens.operators.embeddings import pca
    x = np.random.default_rng(4).normal(size=(200, 6)) * np.arange(1, 7)
    d = spark.createDataFrame([(0, r.tolist()) for r in x], "channel int, v array<double>")
    got = sorted(pca(d, "channel", "v", 2).collect(), key=lambda r: r.component)
    val = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r.explained_variance for r in got] == pytest.approx(val[:2])


def test_critical_cutoff_boundaries(spark):
    rows = [("up", 0.1, 0.2), ("up", 0.2, 0.6), ("late", 0.1, 0.1), ("late", 0.2, 0.2), ("done", 0.1, 0.7), ("done", 0.2, 0.9)]
    d = spark.createDataFrame(rows, "k string, cutoff double, acc double")
    got = {r.k: r for r in wn.critical_cutoff(d, ["k"], 0.5, "increasing").collect()}
    assert got["up"].critical_cutoff == pytest.approx(0.175) and got["up"].crossed
    assert got["late"].critical_cutoff == 0.2 and got["done"].critical_cutoff == 0.1 and not got["done"].crossed


def test_js_divergence_of_equal_filters_is_zero(spark):
    d = spark.createDataFrame([([0.5, 0.3, 0.2],)], "w array<double>")
    r = d.select(ar.js_divergence("w", "w").alias("js"), ar.bandwidth("w").alias("bw")).first()
    assert r.js == pytest.approx(0.0) and r.bw == pytest.approx(1 / (0.25 + 0.09 + 0.04))


def test_sources_missing_path_and_blank_lines(spark, tmp_path):
    from robustlens.sources import readers
    assert readers.read_jsonl(spark, str(tmp_path / "nowhere"), "a INT").count() == 0
    (tmp_path / "x.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "x.json"), "a INT").collect()) == [1, 2]
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_jsonl(spark, str(tmp_path / "bad.json"), "a INT").collect()


def test_array_sidecar_files(spark, tmp_path):
    from robustlens.sources import readers
    np.savez(tmp_path / "good.npz", a=np.arange(6.0).reshape(2, 3))
    (tmp_path / "bad.npz").write_bytes(b"junk")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.decode_arrays(files).collect()}
    assert got["good.npz"].h == 2 and got["good.npz"].data == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and got["bad.npz"].data is None


def test_log_sections_follow_line_order_within_their_file(spark, tmp_path):
    from robustlens.sources import logs
    for run, extra in (("a", 0), ("b", 40)):
        (tmp_path / run / "worker=0").mkdir(parents=True)
        body = ["====== SUMMARY ======"] + ["filler"] * extra + [logs.FLIP_HEADER, "Scale 0.1 0.2", logs.CONFUSION_HEADER, "Scale 1 2 3 4"]
        (tmp_path / run / "worker=0" / "summary.txt").write_text("\n".join(body))
    lines = logs.log_lines(spark, str(tmp_path)).repartition(7, "line")
    assert {r.pos for r in lines.where("line = 'Scale 1 2 3 4'").collect()} == {4, 44}
    got = sorted((r.section, r.metric, r.value) for r in logs.section_rows(lines).collect())
    assert got == sorted([("FLIP", "avg_rate", 0.1), ("FLIP", "ve_rate", 0.2)] * 2 + [("CONFUSION", m, float(i + 1)) for i, m in enumerate(("r2w", "w2r", "r2r", "w2w"))] * 2)


@pytest.mark.parametrize("raw, want", [
    ("('a','b',)", ["a", "b"]), ("['a', 'b',]", ["a", "b"]), ("['x', None, True]", ["x", "True"]), ("['None', \"it's, None, here\", False]", ["None", "it's, None, here", "False"]),
    ("{'k': None, 'm': 'v',}", ["v"]), ("nonsense", []), (None, []), ("[1, 2.5]", ["1", "2.5"])])
def test_option_literals(spark, raw, want):
    from robustlens.functions.labels import parse_options
    assert spark.createDataFrame([(raw,)], "o string").select(parse_options("o").alias("o")).first().o == want


def test_part_prompt_keeps_every_part(spark):
    from robustlens.functions.labels import part_prompt
    name = "_".join(f"p{i}" for i in range(130))
    text = spark.createDataFrame([(name,)], "n string").select(part_prompt("n").alias("t")).first().t
    assert text == "segment the " + " of the ".join([f"p{i}" for i in range(129, 0, -1)] + ["p0"])


def test_tau_below_three_points_and_quantiles_with_nan(spark):
    d = spark.createDataFrame([([(1.0, 2.0), (2.0, 1.0)],), ([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)],)], "pts array<struct<ord: double, v: double>>")
    assert [r.t for r in d.select(st.kendall_tau(d.pts, "ord", "v").alias("t")).collect()] == [1.0, 1.0]
    q = wn.exact_quantiles(spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (3.0,), (None,)], "v double"), "v", [0.5]).first()
    assert q.q0 == 2.0


def test_repeated_predictions_are_all_matched(spark):
    from robustlens.operators.scenes import best_box_match
    box = "frame int, k int, x double, y double, s double"
    got = best_box_match(spark.createDataFrame([(1, 2, 0.0, 0.0, 2.0)] * 3, box), spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0)], box)).collect()
    assert len(got) == 3 and {(r.best_iou, r.matched) for r in got} == {(1.0, 1)}


def test_half_written_cache_is_built_again(spark, tmp_path):
    from robustlens.sources import sinks
    build = lambda: spark.range(3)
    sinks.cached_table(spark, str(tmp_path), "v", build, a=1)
    done = next(tmp_path.glob("cache-*/_SUCCESS"))
    done.unlink()
    assert sinks.cached_table(spark, str(tmp_path), "v", lambda: spark.range(5), a=1).count() == 5 and done.exists()


def test_no_cartesian_product_without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        d = spark.range(100).select((F.col("id") % 7).cast("double").alias("v"), "id")
        for df in (wn.exact_quantiles(d, "v", [0.5]), wn.average_ranks(d, "v"), st.spearman(d.withColumn("id", F.col("id").cast("double")), [], "v", "id")):
            assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_predictor_list_and_pca_coordinates(spark):
    from robustlens.operators.embeddings import pca_coordinates
    from robustlens.operators.trials import predictor_list
    d = spark.createDataFrame([(0.0, None), (1.0, None)], "is_binary double, prediction_entropy double")
    assert predictor_list(d, ("a",)) == ["a", "is_binary"]
    assert predictor_list(d.where("is_binary = 1").withColumn("prediction_entropy", F.lit(0.5)), ("a",)) == ["a", "prediction_entropy"]
    x = np.random.default_rng(8).normal(size=(60, 4)) * np.arange(1, 5)
    df = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x)], "channel int, i int, v array<double>")
    got = np.array([r.coords for r in pca_coordinates(df, "channel", "v", 2).orderBy("i").collect()])
    assert np.var(got, axis=0, ddof=1) == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])


def test_weighted_correlations_equal_the_repeated_rows(spark):
    g = np.random.default_rng(9)
    rows = [(int(a), float(b), float(c), int(k)) for a, b, c, k in zip(g.integers(0, 2, 40), g.integers(0, 6, 40), g.normal(size=40), g.integers(1, 5, 40))]
    d = spark.createDataFrame(rows, "key int, x double, y double, k int")
    full = d.select("key", "x", "y", F.explode(F.sequence(F.lit(1), "k")).alias("_")).drop("_")
    for fn in (st.pearson, st.spearman):
        for keys in ([], ["key"]):
            a = {tuple(r[:-1]): r[-1] for r in fn(full, keys, "x", "y").collect()}
            b = {tuple(r[:-1]): r[-1] for r in fn(d, keys, "x", "y", weight="k").collect()}
            assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("span", [1, 7, 1024])
def test_consecutive_masks_do_not_depend_on_ranges(spark, span):
    r = np.random.default_rng(3)
    rows = [(v, int(k), None if r.random() < 0.2 else [int(c) for c in np.flatnonzero(r.random(12) < 0.5)]) for v in ("a", "b") for k in sorted(r.choice(60, 25, False))] + [("c", 5, [1])]
    want = {}
    for v in ("a", "b"):
        m = [x[2] for x in rows if x[0] == v]
        ious = [0.0 if p is None or q is None or not set(p) | set(q) else len(set(p) & set(q)) / len(set(p) | set(q)) for p, q in zip(m, m[1:])]
        want[v] = sum(ious) / len(ious)
    d = spark.createDataFrame(rows, "video string, frame long, mask array<int>").repartition(5)
    got = {x.video: x.id_stability for x in mk.id_stability(d, "video", "frame", span).collect()}
    assert got == pytest.approx(want)


def test_name_ranks_with_one_common_prefix(spark):
    names = [f"common prefix {i:05d}" for i in range(3000)]
    d = spark.createDataFrame([(i % 40, n) for i, n in enumerate(names + names[:500] + [None])], "scene long, name string")
    from robustlens.operators.scenes import name_ranks
    ranks = name_ranks(d)
    assert {r.name: r.rk for r in ranks.collect()} == {n: i for i, n in enumerate(sorted(names))}
    parts = d.select("name").where("name IS NOT NULL").distinct().repartitionByRange(256, "name").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert parts < 100
    assert name_ranks(d.where("false")).count() == 0


def test_slope_trend_interval(spark):
    r = np.random.default_rng(1)
    rows = [(g, float(x), float((1 + 0.2 * r.standard_normal()) * x)) for g in range(200) for x in range(4)]
    d = spark.createDataFrame(rows, "g long, x double, y double")
    t = st.slope_trend(d, "g", "x", "y").first()
    half = 1.96 * t.std_slope / np.sqrt(t.n_groups)
    assert t.slope_ci_lower == pytest.approx(t.mean_slope - half, abs=half / 5) and t.slope_ci_upper == pytest.approx(t.mean_slope + half, abs=half / 5)
    one = st.slope_trend(d.where("g = 1"), "g", "x", "y").first()
    assert one.slope_ci_lower == one.slope_ci_upper == one.mean_slope


def test_large_seeded_sample_is_the_take_ordered_one(spark, monkeypatch):
    from robustlens.operators import topk as tk
    d = spark.range(5000).withColumnRenamed("id", "k")
    small = {r.k for r in tk.seeded_sample(d, 1234, 5, "k").collect()}
    monkeypatch.setattr(tk, "TAKE_ORDERED", 100)
    assert {r.k for r in tk.seeded_sample(d, 1234, 5, "k").collect()} == small and len(small) == 1234


def test_band_count_with_and_without_keys(spark):
    d = spark.createDataFrame([("a", 8, 8), ("a", 10, 40), ("b", 30, 30), ("b", 30, 31)], "run string, h int, w int")
    got = {r.run: (r.tokens, r.num_bands) for r in gr.band_count(d, "run").collect()}
    assert got == {"a": (232.0, 6), "b": (915.0, 19)}
    assert gr.band_count(d).first().tokens == 650.0


@pytest.mark.parametrize("n", [1, 33, 1500, 40000])
def test_ordered_counts_spread_over_buckets(spark, n):
    r = np.random.default_rng(n)
    v = np.concatenate([r.lognormal(0, 4, n), np.full(n // 2, 1.0), r.integers(0, 5, n // 3)])
    d = spark.createDataFrame([(g, float(x)) for g, part in (("a", v), ("b", v[:7])) for x in part], "g string, v double")
    got = {(x.g, x.v): (x.k, x.first, x.total) for x in wn.ordered_counts(d, "v", ["g"]).collect()}
    want = {}
    for g, part in (("a", np.sort(v)), ("b", np.sort(v[:7]))):
        values, first, k = np.unique(part, return_index=True, return_counts=True)
        want |= {(g, float(x)): (int(c), int(f), len(part)) for x, c, f in zip(values, k, first)}
    assert got == want


def _joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_exploded_clean_scores_are_not_broadcast(spark, sf_dir):
    from robustlens.operators import joins as jn
    from robustlens.plans import bindings as b
    assert _joins(jn.clean_vs_perturbed(b.clean_scores(spark, sf_dir), b.pert_scores(spark, sf_dir))) == (0, 1)


def test_exploded_questions_are_not_broadcast(spark):
    from robustlens.operators.trials import valid_mirror_pairs
    q = spark.range(20).withColumn("level_no", F.explode(F.sequence(F.lit(1), F.lit(8)))).selectExpr(
        "id AS item_id", "level_no", "concat(id, CASE WHEN level_no > 4 THEN ' longer' ELSE '' END) AS question", "'A' AS answer_label", "'x' AS options", "1e0 AS csem", "CAST(level_no AS DOUBLE) AS cprompt")
    pairs = valid_mirror_pairs(q)
    assert _joins(pairs) == (1, 2) and pairs.where("valid").count() == 80     # only the four rates are broadcast


def test_one_cell_a_cluster_is_not_aggregated_again(spark, sf_dir):
    from robustlens.operators import regression as rg
    from robustlens.plans import bindings as b
    cells = rg.fold(b.trials(spark, sf_dir), ["csem", "cprompt"], ["perturbation", "item_id"])
    one, many = (rg.cluster_sums(cells, ["csem", "cprompt"], ["perturbation"], "item_id", single=x) for x in (True, False))
    centred = rg.cluster_sums(cells, ["csem", "cprompt"], ["perturbation"], "item_id", centred=True, single=True)     # without the subquery of the grand mean
    assert "Aggregate" not in centred._jdf.queryExecution().sparkPlan().toString()
    a, c = ({(r.perturbation, r.item_id): (r.n, r.s0, r.s1, r.q0_0, r.q0_1, r.q1_1) for r in x.collect()} for x in (one, many))
    assert a.keys() == c.keys() and all(a[k] == pytest.approx(c[k]) for k in a)


def test_export_sends_no_rows_to_a_task_per_name(spark, sf_dir):
    from robustlens.plans.registry import QUERIES
    import robustlens.plans.q_projections  # noqa: F401
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")         # as where Spark's estimate of the names is large
    try:
        assert _joins(QUERIES["p20_trial_export"](spark, sf_dir)) == (1, 0)
    finally:
        spark.conf.set(name, before)
