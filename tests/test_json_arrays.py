"""The splittable scan of JSON arrays against the json module, for byte ranges of every size."""
import json
import random

import pytest

from robustlens.sources.json_arrays import array_records
from robustlens.sources.readers import read_json_arrays

SCHEMA = "id long, s string, m map<string,string>, x array<struct<k: array<long>>>"
WORDS = ['}', '{', '"', '\\', '},{', '"}', ']', '[', '\\"', 'é', '日本', ' ', '\n', 'a', ',', '"],[{"', '\\\\}']


def rows(n, seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(WORDS) for _ in range(r.randrange(9)))
    return [{"id": i, "s": r.choice([text(), None]), "m": {f"{text()}{j}": text() for j in range(r.randrange(3))}, "x": [{"k": list(range(r.randrange(3)))} for _ in range(r.randrange(3))]} for i in range(n)]


def scan(spark, path, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return sorted((r.id, r.s, json.dumps(r.m, sort_keys=True), json.dumps([list(e.k) for e in r.x])) for r in read_json_arrays(spark, str(path), SCHEMA).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", ["37b", "701b", "20kb", "128mb"])
def test_every_split_size_gives_the_same_rows(spark, tmp_path, size):
    want = []
    for k, style in enumerate([dict(), dict(indent=2), dict(separators=(",", ":")), dict(ensure_ascii=False)]):
        data = [{**r, "id": r["id"] + 1000 * k} for r in rows(12 if size == "37b" else 60, k)]
        (tmp_path / f"{k}.json").write_text(("\n " if k == 1 else "") + json.dumps(data, **style) + ("\n" if k else ""), encoding="utf-8")
        want += data
    (tmp_path / "none.json").write_text(" [ \n] ")
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "zero.json").write_text("")
    want = sorted((r["id"], r["s"], json.dumps(r["m"], sort_keys=True), json.dumps([e["k"] for e in r["x"]])) for r in want)
    assert [w[0] for w in scan(spark, tmp_path, size)] == [w[0] for w in want]
    assert scan(spark, tmp_path, size) == want


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(rows(400, 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4kb")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        found = array_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = (tmp_path / "a.json").read_bytes()
    assert len(found) == 400
    assert all(raw[r.offset:r.offset + len(r.text.encode())].decode() == r.text for r in found)


@pytest.mark.parametrize("text,at", [
    ('[{"id": 1}, {"id": "x"}, {"id": 3}]', 12), ('[{"id": 1}, {"id": 2', 20), ('[{"id": 1}', 9), ('[{"id": 1}, {"s": "}', 19), ('[{"id": 1} {"id": 2}]', 10), ('[{"id": 1}][{"id": 2}]', 10),
    ('[{"id": 1}] x', 10), ('{"id": 1}', 8), ('[1, {"id": 1}]', 0), ('[{"id": 1}, 2]', 10), ('[{"id": 1}, {"id": tru}]', 12)])
def test_broken_files_fail_with_their_offset(spark, tmp_path, text, at):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=rf"a.json at byte {at}\b"):
        read_json_arrays(spark, str(tmp_path), "id long").collect()


def test_small_files_are_parsed_whole_and_only_when_surely_one_array(spark, tmp_path):
    from robustlens.sources.json_arrays import whole_files
    data = rows(300, 7)
    (tmp_path / "a.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "none.json").write_text(" [ \n] ")
    (tmp_path / "blank.json").write_text(" \n")
    got = whole_files(spark, str(tmp_path), SCHEMA)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert got._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    assert sorted((r.r.id, r.ok) for r in got.collect()) == [(i, True) for i in range(300)]
    for n, text in enumerate(['[{"id": 1}][{"id": 2}]', '[{"id": 1}]] [[', '[{"id": 1}], []', '[{"id": 1}], []]} x', '{"id": 1}', '[{"id": 1}], "b": [1]', '[{"id": 1}, null]', '[[{"id": 1}]]', 'null', '[1]', '[{"id": "x"}]']):
        folder = tmp_path / f"odd{n}"
        folder.mkdir()
        (folder / "a.json").write_text(text)
        assert [r.ok for r in whole_files(spark, str(folder), "id long").collect()] == [False], text
