"""Quality classifier: held-out accuracy, class prior, risk and edge cases."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from robustlens.llm import quality as ql
from robustlens.llm import sample


def test_held_out_accuracy_from_positives_alone(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = ql.fit(docs, labels.where("quality = 1"))
    assert 0.7 < model.prior < 0.95
    rows = ql.score_quality(docs.withColumn("held_out", sample.held_out()).where("held_out"), model).join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert len(bad) > 50 and sum(r.predicted == 0 for r in bad) >= 0.95 * len(bad)
    assert sum(r.predicted == 1 for r in good) >= 0.99 * len(good)


def test_edge_cases(spark):
    texts = [None, "", "x", "der der der " * 50000, "a b c", "a b c"]
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(texts)], "doc_id long, text string, source string, predicted int")
    trusted = spark.createDataFrame([(i,) for i in range(6)] * 2 + [(None,)], "doc_id long")
    got = ql.score_quality(docs, ql.fit(docs, trusted)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.source == "s" for r in got)
    none = ql.fit(docs, trusted.where(F.lit(False)))
    assert none is None and {r.score for r in ql.score_quality(docs, none).collect()} == {0.5}
    assert ql.score_quality(docs.where(F.lit(False)), none).count() == 0


def test_class_prior_and_risk_on_known_mixture():
    g = np.random.default_rng(1)
    p = g.normal(2, 1, 4000)
    u = np.concatenate([g.normal(2, 1, 3000), g.normal(-2, 1, 7000)])
    assert ql.class_prior(p, u) == pytest.approx(0.3, abs=0.05)
    x_p, x_u = p[:, None].astype(np.float32), u[:, None].astype(np.float32)
    w = ql.minimise(x_p, x_u, 0.3)
    assert ((u * w[0] + w[1] > 0) == (np.arange(10000) < 3000)).mean() > 0.95
    a, b = ql.risk_parts(x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1], 0.3)
    assert a > 0 and b > -0.05
