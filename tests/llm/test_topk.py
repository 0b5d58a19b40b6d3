"""Top-k against a full sort, with ties, repeats and unusable vectors."""
import math
import random

from robustlens.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = {}
    for i, v in ok:
        if i % 5 == 0:
            best[i] = min(best.get(i, v), v)
    out = []
    for q, v in best.items():
        s = sorted(((sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != q), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, r + 1, j, x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_equals_a_full_sort(spark):
    g = random.Random(2)
    rows = [(i, [g.choice([0.0, g.uniform(-1, 1)]) for _ in range(g.choice([6, 6, 6, 4]))]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]                       # ties
    rows += [(150, None), (155, [1.0, None]), (160, [float("nan")]), (165, [float("inf"), 1.0]), (None, [1.0]), (170, []), (10, rows[10][1]), (7, rows[7][1])]
    df = topk.integer_rows(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(5))
    for k, block in ((10, 4096), (3, 7), (1000, 4096)):
        got = sorted(map(tuple, topk.search(df.where("id % 5 = 0"), df, k, block).collect()))
        assert got == brute(rows, k)


def test_empty(spark):
    df = topk.integer_rows(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(df, df).count() == 0
    one = topk.integer_rows(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert topk.search(one, one).count() == 0


def test_large_components_are_not_cut(spark):
    import pytest
    rows = [(100, [1.0, 0.0]), (1, [200000.0, 0.5]), (2, [300000.0, -0.5]), (3, [2e9, 1.0]), (200, [3e5, 2e9])]
    v = topk.integer_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): (r["rank"], r.score) for r in topk.search(v.where("id = 100"), v, 10).collect()}
    assert got == {(100, 3): (1, 1024 * 2048 * 10 ** 9), (100, 200): (2, 314572800000), (100, 2): (3, 314572800000), (100, 1): (4, 209715200000)} or \
        got == {(100, 3): (1, 1024 * 2048 * 10 ** 9), (100, 2): (2, 314572800000), (100, 200): (3, 314572800000), (100, 1): (4, 209715200000)}
    assert got[100, 2][0] < got[100, 200][0]          # equal scores by the smaller id
    wide = topk.integer_rows(spark.createDataFrame([(100, [3e6] * 2), (1, [3e6, -3e6]), (2, [2e6, -1e6])], "vec_id long, embedding array<double>"))
    assert [(r.vec_id, r.score) for r in topk.search(wide.where("id = 100"), wide, 2).orderBy("rank").collect()] == [(2, 1024 ** 2 * 3 * 10 ** 12), (1, 0)]
    with pytest.raises(Exception, match="does not fit into a long"):
        topk.search(wide.where("id = 100"), wide.where("id = 100").selectExpr("id + 1 AS id", "w"), 2).collect()
    with pytest.raises(Exception, match="does not fit into a long"):
        topk.integer_rows(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()
