"""Rows that move or are written: once, and no wider than they must be."""
import pytest
from pyspark.sql import functions as F

from robustlens.operators import regression as rg
from robustlens.operators import stats as st
from robustlens.operators import trials as tr
from robustlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_prediction_fit_moves_raw_rows_once(spark, monkeypatch):
    """Groups, filters and cells stay with the item their rows were dealt by, also where the filters are not broadcast."""
    import __spark_entry__  # noqa: F401

    class Seen(Exception):
        pass

    def seen(session, df, name):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(rg, "materialize", seen)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(Seen) as plan:
            QUERIES["t25_prediction_factor_fit"](spark, SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moves = [x for x in str(plan.value).splitlines() if "Exchange hashpartitioning(" in x]
    assert sum("(l_partkey" in x for x in moves) == 1
    assert not [x for x in moves if "(item_id" in x or "(view" in x]


def test_prediction_fit_equals_the_fit_on_standardized_rows(spark, monkeypatch):
    """With holes in every column, NaN, a constant prediction, and a binary column that reaches 0 and 1 or not."""
    import random
    r = random.Random(3)

    def rows(binary, predicted, holes):
        def x(v):
            return None if holes and r.random() < 0.04 else v
        out = [(x(i % 40), i % 8 + 1, x(predicted()), x(r.gauss(2, 1)), x(float(i % 7)), x(r.random()), x(binary(i)), x(r.gauss(0, 1))) for i in range(600)]
        return spark.createDataFrame(out, "item_id bigint, level_no int, predicted double, csem double, cprompt double, hopt double, is_binary double, volatility double")
    holes = rows(lambda i: float(i % 3 == 0), lambda: r.gauss(0.3, 0.5), True).withColumn("csem", F.when(F.col("level_no") == 3, float("nan")).otherwise(F.col("csem")))
    flat = rows(lambda i: i % 2 / 2, lambda: 0.5, True)
    nan = flat.withColumn("predicted", F.when(F.col("csem") > 2, float("nan")).otherwise(F.col("predicted")))
    monkeypatch.setattr(rg, "materialize", lambda session, df, name: session.createDataFrame(df.collect(), df.schema))
    for df in (holes, flat, nan):
        z = st.standardized_bridge(df, "predicted", "volatility").withColumnRenamed("pred_z", "overlap_z")
        want = rg.fit(tr.level_views(z), tr.predictor_list(z, ("overlap_z", "csem", "cprompt", "hopt")), "volatility", "item_id", ["view"])
        got = rg.prediction_fit(df, "predicted", ["csem", "cprompt", "hopt"], "volatility", "item_id")
        assert got.schema == want.schema
        a, b = ({(x.view, x.predictor): x for x in d.collect()} for d in (got, want))
        assert a.keys() == b.keys() and bool(a) == (df is not nan)
        for k, x in a.items():
            for c in got.columns[2:]:
                assert x[c] == b[k][c] or abs(x[c] - b[k][c]) <= 1e-8 * max(1, abs(b[k][c])), (k, c, x[c], b[k][c])


def test_running_pairs_feed_is_packed_narrow_and_gone(spark, monkeypatch):
    """Files by gzip with the columns the job reads, each of bounded rows, in BATCHES batches; nothing of the feed is left with the result."""
    import glob
    import os

    from robustlens.plans import bindings as b
    from robustlens.plans import q_streaming as q
    from robustlens.sources import sinks
    monkeypatch.setattr(sinks, "PACKED_ROWS", 1000)
    seen, start = {}, q.jobs.write_partials

    def noted(stream, partial, out, cp):
        path = stream._jdf.queryExecution().toString().split("FileSource[")[1].split("]")[0].removeprefix("file:")
        seen.update(path=path, columns=set(stream.columns), files=[f for f in os.listdir(path) if f.startswith("part-")], cp=cp, names=spark.read.json(path).columns,
                    most=max(spark.read.json(f).count() for f in glob.glob(f"{path}/part-*")))
        return start(stream, partial, out, cp)
    monkeypatch.setattr(q.jobs, "write_partials", noted)
    n = QUERIES["x02_running_pairs"](spark, SF).agg(F.sum("n")).first()[0]
    assert n == b.table(spark, SF, "lineitem").count()
    assert all(f.endswith(".json.gz") for f in seen["files"]) and seen["most"] <= 1000 and len(seen["files"]) >= q.BATCHES
    assert not {"rung", "severity", "perturbation"} & {*seen["names"], *seen["columns"]}
    assert len([f for f in os.listdir(f"{seen['cp']}/commits") if f.isdigit()]) == q.BATCHES
    assert not os.path.exists(seen["path"])


def test_packed_feed_has_its_batches_whatever_files_were_written(spark, monkeypatch):
    """More files than asked for, as where a task's rows exceed a file, or fewer, as where tasks are empty, make no more batches."""
    import os

    from robustlens.plans import q_streaming as q
    from robustlens.session import scratch_path
    monkeypatch.setattr(q.sinks, "PACKED_ROWS", 50)
    for rows, tasks in ((1000, 13), (3, 40), (0, 4)):
        out, cp = scratch_path(spark, "out"), scratch_path(spark, "cp")
        s = q.packed_feed(spark, lambda n: spark.range(rows).repartition(max(n, tasks), "id"), 100, scratch_path(spark, "feed"))
        q.jobs.append_parquet(s, out, cp).awaitTermination()
        assert spark.read.parquet(out).count() == rows
        assert len([f for f in os.listdir(f"{cp}/commits") if f.isdigit()]) <= q.BATCHES


def test_batches_leave_no_shuffle_files(spark):
    """The setting holds for what is written inside, then it is as it was."""
    import time

    from robustlens.session import scratch_path, shuffles_dropped
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk, before = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(key)

    def files():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}
    old, made, path = files(), set(), scratch_path(spark, "dropped")
    with shuffles_dropped(spark):
        spark.range(1000).repartition(3, "id").groupBy("id").count().write.parquet(path)
    for _ in range(50):
        made = files() - old
        if not made:
            break
        time.sleep(0.2)
    assert not made and spark.conf.get(key) == before and spark.read.parquet(path).count() == 1000
    spark.range(1000).repartition(3, "id").groupBy("id").count().write.mode("overwrite").parquet(path)
    assert files() - old


def test_running_means_leave_missing_values_out(spark):
    """Also where a whole batch, or all of a group, has none."""
    from robustlens.streaming import jobs
    schema = "item_id bigint, level_no int, family string, clean_correct int, pert_correct int, loglik_drift double, csem double, cprompt double, hopt double, is_binary double, d array<double>"
    w = spark.createDataFrame([(1, 1, [0.5, 0.5])], "item_id bigint, level_no int, w array<double>")
    partial = jobs.pair_partials(w, w.select("level_no", "w"), 2, 2)

    def row(drift, csem=1.0, d=(1.0, 3.0)):
        return (1, 1, "A", 1, 0, drift, csem, 2.0, None, 1.0, list(d))
    batches = [spark.createDataFrame(x, schema) for x in ([row(0.2), row(None, 3.0), row(0.6, d=(None, 1.0))], [row(None)])]
    x = jobs.merge_pairs(partial(batches[0]).unionByName(partial(batches[1]))).first()
    assert (x.n, x.csem, x.hopt, x.predicted, x.ci_count) == (4, 1.5, None, 2.0, 4)
    assert abs(x.loglik_drift - 0.4) < 1e-12 and abs(x.volatility - 0.4) < 1e-12 and abs(x.erosion - 0.2) < 1e-12
