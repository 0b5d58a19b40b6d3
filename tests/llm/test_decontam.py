"""Spaced seeds against plain dictionaries, tolerance to replaced words, and edge cases."""
import random
import re

import numpy as np
from pyspark.sql import functions as F

from robustlens.llm import decontam as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    """Hits by word tuples, then the best segment of each diagonal by trying all."""
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for k, item in items:
            v = WORD.findall((item or "").lower())
            kept = [[i for i, c in enumerate(m) if c == "1"] for m in dc.MASKS] if len(v) >= 12 else [range(len(v))] if len(v) >= 5 else []
            diagonals = {i - j for m in kept for i in range(len(w) - m[-1]) for j in range(len(v) - m[-1]) if all(w[i + x] == v[j + x] for x in m)}
            for g in diagonals:
                a, b = max(0, g), min(len(w), g + len(v))
                equal = [w[i] == v[i - g] for i in range(a, b)]
                best = max(((sum(1 if e else -3 for e in equal[i:j]), -i, i, j) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)))
                n = sum(equal[best[2]:best[3]])
                if n >= min(13, len(v)) and n >= 0.8 * (best[3] - best[2]):
                    out.add((d, k, n))
    return out


def test_equals_brute_force(spark):
    g = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ñandú"]
    items = [(i, " ".join(g.choices(vocab, k=g.choice([3, 5, 8, 11, 12, 15, 30])))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        w = g.choices(vocab, k=g.randrange(0, 60))
        if i % 2:
            leak = (items[g.randrange(25)][1]).split()
            for _ in range(g.randrange(3)):
                leak[g.randrange(len(leak))] = "changed"
            w[len(w) // 2:len(w) // 2] = leak
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else ",\n".join(w)))
    docs += [(100, None), (101, ""), (102, items[5][1] + " " + "w1 " * 30000)]
    want = brute(docs[:-1], items)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched) for r in dc.find_overlaps(d, b).collect()}
    assert {x for x in got if x[0] != 102} == want and len(want) >= 12
    assert any(x[0] == 102 for x in got) == (len(items[5][1].split()) >= 5)
    kept = {r.doc_id for r in dc.decontaminate(d, b).collect()}
    assert kept == {x[0] for x in docs} - {x[0] for x in got} and dc.decontaminate(d, b).columns == d.columns


def test_blocks_give_the_same_rows(spark, monkeypatch):
    items = [(i, " ".join(f"a{i}b{j}" for j in range(15))) for i in range(6)]
    d = spark.createDataFrame([(i, "x y z " + t) for i, t in items] * 2, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, dc.find_overlaps(d, b).collect()))
    monkeypatch.setattr(dc, "blocks", lambda bench, f=dc.blocks: f(bench, block_words=20))
    assert len(list(dc.blocks(b))) == 6 and sorted(map(tuple, dc.find_overlaps(d, b).collect())) == one and len(one) == 12
    assert dc.decontaminate(d, b).count() == 0


def test_replaced_words_are_tolerated(spark):
    g = random.Random(9)
    items = [(i, " ".join(f"q{i}w{j}" for j in range(30))) for i in range(100)]
    docs = [(i, "in front " + " ".join(w if g.random() > 0.1 else "other" for w in t.split())) for i, t in items]
    got = {r.doc_id for r in dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) >= 97


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.find_overlaps(d, b).count() == 0 and dc.decontaminate(d, b).count() == 1
    assert dc.find_overlaps(d.where(F.lit(False)), b).count() == 0


def test_all_stretches_of_four_fifths_are_found(spark):
    g = random.Random(6)
    items, docs = [], []
    for i, (n, gone) in enumerate([(5, 1), (9, 1), (11, 2), (12, 1), (13, 1), (15, 2), (20, 4), (24, 4)] * 3):
        v = [f"q{i}w{j}" for j in range(n)]
        w = list(v)
        free = [j for j in range(1, n - 1)] if n < 12 else [j for j in range(n) if j >= 12 or dc.MASKS[i % 3][j] == "0"]    # a seed at 0 stays whole
        for j in g.sample(free, gone):
            w[j] = "other"
        items.append((i, " ".join(v)))
        docs.append((i, " ".join(["in", "front", *w, "behind"])))
    long = [f"z{j}" for j in range(80)]
    items.append((50, " ".join(long)))
    docs.append((50, " ".join(long[:20] + ["x"] * 40 + long[60:])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in dc.find_overlaps(d, b, whole=True).collect()]
    assert {x[0] for x in got} == {x[0] for x in docs} and all(x[0] == x[1] for x in got)
    assert sorted(x[2:] for x in got if x[0] == 50) == [(0, 20, 0, 20), (60, 80, 60, 20)]
    assert dc.decontaminate(d, b, whole=True).count() == 0


def test_stretches_equal_all_tried():
    g = np.random.default_rng(1)
    for _ in range(400):
        n = int(g.integers(5, 60))
        item = np.arange(n).astype(np.uint64)
        h = np.where(g.random(n) < g.choice([0.6, 0.8, 0.9]), item, np.uint64(999))
        e = h == item
        want = max((int(e[i:j].sum()) for i in range(n) for j in range(i + 1, n + 1) if e[i:j].sum() * 5 >= 4 * (j - i)), default=0)
        got = dc.align_all(h, 0, n, item, 0)
        assert max((x[3] for x in got), default=0) == (want if want >= dc.least_equal(n) else 0)
        assert all(e[a:b].sum() == m and 5 * m >= 4 * (b - a) for a, b, _, m in got)
