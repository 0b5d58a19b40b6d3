"""Exchanged records: parsed once, written packed in bounded files, and the rows that nulls and empty levels give."""
import os

import __spark_entry__
from robustlens.operators import trials as tr
from robustlens.sources import readers, schemas, sinks


def test_round_trip_parses_each_record_once(spark):
    plan = __spark_entry__.queries()["s24_nested_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_null_and_empty_levels_give_no_row(spark):
    p = ("p", "f", 1, 1.0, None)
    rows = [(1, 1, 1, None), (2, 1, 1, {}), (3, 1, 1, {"1": None, "2": (1.0, 2.0, 1, None), "3": (1.0, 2.0, 1, []), "4": (1.0, 2.0, 1, [p, ("q", "f", 2, 0.0, 0.5)])})]
    records = spark.createDataFrame(rows, schemas.RECORD)
    assert [(r.rec_id, r.level_no, r.perturbation) for r in tr.flatten_records(records).collect()] == [(3, "4", "q")]
    assert sorted((r.rec_id, r.perturbation, r.loglik_drift) for r in tr.flatten_records(records, False).collect()) == [(3, "p", 0.0), (3, "q", 0.5)]


def test_packed_files_are_bounded_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PACKED_ROWS", 100)
    sinks.write_jsonl(spark.range(1000).coalesce(1), str(tmp_path / "x"), packed=True)
    files = [f for f in os.listdir(tmp_path / "x") if f.startswith("part-")]
    assert len(files) == 10 and all(f.endswith(".json.gz") for f in files)
    assert sorted(r.id for r in readers.read_jsonl(spark, str(tmp_path / "x"), "id BIGINT").collect()) == list(range(1000))


def test_option_lists_are_computed_once(spark):
    plan = __spark_entry__.queries()["j17_option_hardness"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 5      # three times as many if filters on the list stand below its explode
