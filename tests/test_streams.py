"""Streams with state: items that leave when they are whole or their timer fires, and the early stop with its sample."""
import time

from robustlens.operators import topk
from robustlens.session import scratch_path
from robustlens.streaming import jobs

VARIANT = "item_id BIGINT, changed BOOLEAN, margin DOUBLE, family STRING, expected BIGINT, at TIMESTAMP"


def put(spark, folder, rows, schema):
    time.sleep(0.02)     # files are read in the order of their times
    spark.createDataFrame(rows, "item_id BIGINT, changed BOOLEAN, margin DOUBLE, family STRING, expected BIGINT, at STRING" if schema == VARIANT else schema).coalesce(1).write.mode("append").json(folder)


def items(spark, folder, out, cp):
    jobs.append_parquet(jobs.item_states(jobs.json_stream(spark, folder, VARIANT, 1), 3_600_000, "10 minutes"), out, cp).awaitTermination()
    return sorted((r.item_id, r.n, r.flips, r.flip_margin, r.keep_margin, r.any_flip, ",".join(r.flipped_types), r.complete) for r in spark.read.parquet(out).collect())


def test_items_leave_when_whole_or_by_timer(spark):
    feed, out, cp = (scratch_path(spark, x) for x in ("feed", "out", "cp"))
    put(spark, feed, [(1, True, 1.0, "A", 3, "2020-01-01 00:00:00"), (2, False, 2.0, "A", 2, "2020-01-01 00:00:01"), (3, True, None, "B", 4, "2020-01-01 00:00:02")], VARIANT)
    assert items(spark, feed, out, cp) == []
    put(spark, feed, [(1, True, 3.0, "B", 3, "2020-01-01 00:01:00"), (1, False, 5.0, "C", 3, "2020-01-01 00:01:00"), (2, False, 4.0, "A", 2, "2020-01-01 00:01:00")], VARIANT)
    whole = [(1, 3, 2, 2.0, 5.0, True, "A,B", True), (2, 2, 0, None, 3.0, False, "", True)]
    assert items(spark, feed, out, cp) == whole                       # in the batch of their last variant, after a restart from the checkpoint
    put(spark, feed, [(2, True, 7.0, "D", 2, "2020-01-01 00:02:00")], VARIANT)      # after it has left: opens anew
    assert items(spark, feed, out, cp) == whole
    put(spark, feed, [(9, False, 0.0, "A", 1, "2020-01-01 05:00:00")], VARIANT)     # moves the watermark past both timers
    assert items(spark, feed, out, cp) == sorted([*whole, (2, 1, 1, 7.0, None, True, "D", False), (3, 1, 1, 0.0, None, True, "B", False), (9, 1, 0, None, 0.0, False, "", True)])


def test_early_stop_keeps_its_sample_and_reads_no_more(spark):
    feed, out, cp = (scratch_path(spark, x) for x in ("feed", "out", "cp"))
    schema = "item_id BIGINT, pattern STRING"
    parts = [[(100 * f + i, ["00", "11", "01", "10"][(i * 7 + f) % 4 if i % 3 else 0]) for i in range(60)] for f in range(6)]
    for p in parts:
        put(spark, feed, p, schema)
    capacity, got = jobs.until_balanced(spark, jobs.json_stream(spark, feed, schema, 1), 50, out, cp)
    read, n = [], 0
    for p in parts:
        read += p
        n = sum(min(sum(x == a for _, x in read), sum(x == b for _, x in read)) for a, b in (("00", "11"), ("11", "00"), ("01", "10"), ("10", "01")))
        if n >= 50:
            break
    assert capacity == n and len(read) < 360
    want = topk.balanced_sample(spark.createDataFrame(read, schema), 50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 50
    again, same = jobs.until_balanced(spark, jobs.json_stream(spark, feed, schema, 1), 50, out, cp)      # a restart refuses the next file too
    assert again == n and sorted(map(tuple, same.collect())) == sorted(map(tuple, want.collect()))


def test_early_stop_on_an_empty_feed(spark):
    feed = scratch_path(spark, "feed")
    spark.createDataFrame([], "item_id BIGINT, pattern STRING").write.json(feed)
    capacity, got = jobs.until_balanced(spark, jobs.json_stream(spark, feed, "item_id BIGINT, pattern STRING", 1), 10, scratch_path(spark, "out"), scratch_path(spark, "cp"))
    assert capacity == 0 and got.count() == 0


def test_early_stop_that_reads_all_and_is_asked_again(spark):
    feed, out, cp = (scratch_path(spark, x) for x in ("feed", "out", "cp"))
    put(spark, feed, [(1, "0"), (2, "1"), (3, "0")], "item_id BIGINT, pattern STRING")
    for _ in range(2):
        capacity, got = jobs.until_balanced(spark, jobs.json_stream(spark, feed, "item_id BIGINT, pattern STRING", 1), 10, out, cp)
        assert capacity == 2 and got.count() == 2


def test_item_states_fold_without_python_and_keep_no_old_state(spark):
    import os
    feed, out, cp = (scratch_path(spark, x) for x in ("feed", "out", "cp"))
    for k in range(4):
        put(spark, feed, [(i, i % 2 == 0, float(k), "AB"[k % 2], 4 + (i == 7), f"2020-01-01 00:0{k}:00") for i in range(10)], VARIANT)
    states = jobs.item_states(jobs.json_stream(spark, feed, VARIANT, 1), 3_600_000, "10 minutes")
    assert "Pandas" not in states.fold(spark.read.schema(VARIANT).json(feed))._jdf.queryExecution().toString()
    jobs.append_parquet(states, out, cp).awaitTermination()
    got = sorted((r.item_id, r.n, r.flips, r.flip_margin, r.keep_margin, ",".join(r.flipped_types)) for r in spark.read.parquet(out).collect())
    assert got == [(i, 4, 0, None, 1.5, "") if i % 2 else (i, 4, 4, 1.5, None, "A,B") for i in range(10) if i != 7]
    assert sorted(os.listdir(f"{cp}/items")) == ["2", "3"]


def test_feed_grows_in_files_not_in_their_size(spark, monkeypatch):
    import os
    from robustlens.plans import q_streaming as q
    monkeypatch.setattr(q, "FILE_ROWS", 100)
    d = spark.range(2000).selectExpr("id AS item_id")
    s = q.feed(spark, d, "item_id BIGINT", 2000)
    folder, out, cp = s._jdf.queryExecution().toString(), scratch_path(spark, "out"), scratch_path(spark, "cp")
    path = folder.split("FileSource[")[1].split("]")[0]
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    assert len(files) == 20 and max(sum(1 for _ in open(f"{path}/{f}")) for f in files) <= 110
    jobs.append_parquet(s, out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 2000 and len([f for f in os.listdir(f"{cp}/commits") if f.isdigit()]) == q.BATCHES
