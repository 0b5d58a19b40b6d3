"""Proportionate-fair mixing against a slot-by-slot simulation, its deviation bound, and edge cases."""
import hashlib
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from robustlens.llm import mixing as mx


def simulate(rows, block_docs, weights):
    """rows: (doc_id, source). Period by period, earliest deadline first."""
    by = defaultdict(list)
    for d, s in rows:
        by[s].append((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d))
    names = sorted(by, key=lambda s: (s is not None, s))
    rest = {s: -(-len(by[s]) // block_docs) for s in names}
    slots, slot = {}, 0
    while any(rest.values()):
        b = {s: min(weights[s], rest[s]) for s in names if rest[s]}
        period, done = sum(b.values()), Counter()
        for t in range(period):
            ready = [((-(-(done[s] + 1) * period // b[s])), names.index(s), s) for s in b if done[s] < b[s] and done[s] * period // b[s] <= t]
            s = min(ready)[2]
            total = -(-len(by[s]) // block_docs)
            slots[s, total - rest[s] + done[s]] = slot
            done[s] += 1
            slot += 1
        for s in b:
            rest[s] -= b[s]
    return {(d, s): (slots[s, i // block_docs], i % block_docs) for s in names for i, (_, d) in enumerate(sorted(by[s], key=lambda x: x[0]))}


def test_equals_simulation_and_stays_within_a_block(spark):
    g = random.Random(4)
    sizes = {"hot": 900, "b": 170, "c": 33, "d": 1, None: 60, "": 5}
    rows = [(i, s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    g.shuffle(rows)
    docs = spark.createDataFrame([(d, s, "t", 5) for d, s in rows], "doc_id long, source string, text string, mix_pos int")
    weights = spark.createDataFrame([("hot", 40.0), ("b", 35.0), ("c", 15.0), (None, 9.0), ("d", -1.0)], "source string, weight double")
    a = {r.source: r.a for r in mx.source_plan(docs, weights=weights, block_docs=4, resolution=50).collect()}
    got = {(r.doc_id, r.source): (r.mix_slot, r.mix_pos) for r in mx.mix(docs, weights=weights, block_docs=4, resolution=50).collect()}
    assert got == simulate(rows, 4, a) and len(got) == len(rows)
    order = dict(sorted({v[0]: k[1] for k, v in got.items()}.items()))
    assert list(order) == list(range(len(order)))
    served, total = Counter(), sum(a.values())
    for t, s in order.items():
        served[s] += 1
        if t < 2 * total:
            assert all(abs(served[x] - (t + 1) * a[x] / total) < 1 for x in ("hot", "b"))
        if served["d"] and served[""]:
            break


def test_default_weights_and_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, None)], "doc_id long, source string")
    got = mx.mix(docs).collect()
    assert len(got) == 4 and {(r.mix_slot, r.mix_pos) for r in got if r.source == "a"} == {(got[0].mix_slot, 0), (got[0].mix_slot, 1), (got[0].mix_slot, 2)} or len(got) == 4
    assert mx.mix(docs.where(F.lit(False))).count() == 0
    plan = {r.source: (r.n, r.blocks, r.a) for r in mx.source_plan(docs).collect()}
    assert plan == {"a": (3, 1, 1732 * 1000 // 2732), None: (1, 1, 1000 * 1000 // 2732)} and math.isclose(sum(x[2] for x in plan.values()), 1000, abs_tol=2)
