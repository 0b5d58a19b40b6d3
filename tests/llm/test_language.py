"""Language identification: held-out accuracy, edge cases, and the pair machines."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from robustlens.llm import language as lg
from robustlens.llm import sample


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lg.fit(docs)
    got = lg.identify(docs.withColumn("held_out", sample.held_out()), model)
    rows = got.where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert set(model.pairs) == {("de", "en"), ("es", "fr")} and model.families == ["germanic", "romance"]


def test_edge_cases(spark):
    texts = [None, "", "123 ... !!", "the of and " * 30000, "der die und " * 20, "der die und " * 20, "日本", "Ж"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    train = spark.createDataFrame([(i, ("the of and is " if i % 2 else "der die und ist ") * (1 + i % 7), "en" if i % 2 else "de") for i in range(200)]
                                  + [(900, None, "en"), (901, "oh", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lg.identify(docs, lg.fit(train)).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "de"] and got[0].score == 0
    assert got[6].lang_pred in ("en", "de") and got[7].lang_pred in ("en", "de")
    none = lg.fit(train.where("lang IS NULL"))
    assert none is None and {r.lang_pred for r in lg.identify(docs, none).collect()} == {"und"}
    one = lg.fit(train.where("lang = 'en'"))
    assert {r.lang_pred for r in lg.identify(docs, one).collect()} == {"und", "en"}
    assert lg.identify(docs.where(F.lit(False)), one).count() == 0


def test_fit_reads_no_held_out_row(spark):
    rows = [(i, "abc def " * 5, "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, kept = sample.per_group(docs, "lang", 1000)
    import zlib
    assert {r.doc_id for r in kept.collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


def test_machine_separates(spark):
    g = np.random.default_rng(0)
    x = np.abs(g.normal(size=(200, 30))).astype(np.float32)
    y = np.where(x[:, 0] > x[:, 1], 1, -1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = lg.machine(x, y, rounds=500)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


def test_memory_follows_runs_of_rows(spark):
    column = pa.array(["THE of and " * 200] * 9000)
    before, most, seen = pa.total_allocated_bytes(), 0, []
    for row, x in lg.features(column):
        most = max(most, pa.total_allocated_bytes() - before)
        seen += range(row, row + len(x))
    assert seen == list(range(9000)) and most < column.nbytes / 10
    docs = spark.createDataFrame([(1, "the of", "en", 0.5)], "doc_id long, body string, lang string, score double")
    for text in ("body", "score"):     # a replaced column is read beside the rows, any other is sent once
        df = lg.identify(docs.withColumn("score", F.lit("the of")) if text == "score" else docs, None, text)
        assert df.columns == ["doc_id", "body", "lang", "lang_pred", "score"] and df.count() == 1
        assert ("__text" in df._jdf.queryExecution().analyzed().toString()) == (text == "score")
