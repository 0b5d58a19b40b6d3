"""Near duplicates against all pairs in plain Python, consistency of the samples, and edge cases."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from robustlens.llm import graph
from robustlens.llm import neardup as nd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall((t or "").lower())
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows, similarity=0.8):
    """Classes by all pairs of texts; ids may repeat."""
    bags = [shingles(t) for _, t in rows]
    df = Counter(s for b in bags for s in b)
    w = [{s: n * (1 + math.log((len(rows) + 1) / (df[s] + 1))) for s, n in b.items()} for b in bags]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if not w[i] or not w[j]:
                continue
            low = sum(min(v, w[j].get(s, 0)) for s, v in w[i].items())
            if rows[i][1] == rows[j][1] or low / (sum(w[i].values()) + sum(w[j].values()) - low) >= similarity:
                parent[root(i)] = root(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[root(i)].append(i)
    return sorted(sorted(rows[i][0] for i in v) for v in out.values())


def fixture():
    g = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ñandú"]
    rows = []
    for _ in range(40):
        base = g.choices(vocab, k=g.choice([3, 30, 80, 300]))
        for _ in range(g.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(g.choice([0, 0, 1, 2, 5])):
                w[g.randrange(len(w))] = g.choice(vocab)
            rows.append(" ".join(w))
    shared = g.choices(vocab, k=60)
    rows += [" ".join(shared + g.choices(vocab, k=60)) for _ in range(40)]      # a common passage, else unlike
    chain = g.choices(vocab, k=200)
    for i in range(12):                                                            # neighbours alike, ends not
        chain = chain[:i * 8] + g.choices(vocab, k=2) + chain[i * 8 + 2:]
        rows.append(" ".join(chain))
    rows += [None, "", " .. ", "one two", "one  TWO", "same " * 5000, "same " * 5000]
    return [(i, t) for i, t in enumerate(rows)]


def test_equals_all_pairs(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, node string, class_id int")
    got = defaultdict(list)
    for r in nd.near_duplicates(docs).collect():
        got[r.class_id].append(r.doc_id)
    assert all(min(v) == k for k, v in got.items())
    assert sorted(sorted(v) for v in got.values()) == brute_classes(rows)
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(got)


def test_ids_that_repeat_or_are_null(spark):
    t = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (1, "quite another text of some words"), (None, "alone with a null id here"), (None, "alone with a null id here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in nd.near_duplicates(docs).collect())
    assert got == [(0, 0, 2), (0, 0, 2), (0, 1, 4), (1, 1, 1), (1, 1, 4), (1, 1, 4), (2, 1, 4)]
    assert sorted((r.doc_id or 0, r.text) for r in nd.drop_near_duplicates(docs).collect()) == [(0, "alone with a null id here"), (1, t), (1, "quite another text of some words")]
    assert nd.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_samples_agree_as_often_as_weights_are_alike():
    g = np.random.default_rng(0)
    agree, want = [], []
    for _ in range(300):
        s = g.integers(0, 2 ** 63, 60).astype(np.uint64)
        w1, w2 = g.uniform(0.5, 8, 60), g.uniform(0.5, 8, 60)
        agree.append((nd.samples(s, w1) == nd.samples(s, w2)).mean())
        want.append(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum())
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


def test_components(spark):
    g = random.Random(1)
    links = [(g.randrange(300), g.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}
    for _ in range(len(parent)):
        new = dict(parent)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == parent:
            break
        parent = new
    assert got == {x: r for x, r in parent.items() if any(x in e and e[0] != e[1] for e in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_beside_the_centre_are_kept(spark):
    """Points on a line: distance 1 - similarity; alike up to 0.2. All share one band, the last one; the centre is the middle point."""
    at = {1: 0.0, 2: 0.15, 3: 0.3, 4: 0.45, 5: -0.15, 6: -0.3, 7: 0.9, 8: 0.95}
    bands = spark.createDataFrame([(n, 8, 1) for n in at] + [(1, 0, 2), (2, 0, 2)], "node long, band int, key long")
    where = spark.createDataFrame(list(at.items()), "id long, x double")

    def compare(pairs):
        a, b = (where.select(F.col("id").alias(c), F.col("x").alias(f"x{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", (1 - F.abs(F.col("xa") - F.col("xb"))).alias("similarity"))

    got = {r.node: r.root for r in graph.components(graph.banded_links(bands, lambda nodes: None, compare, 0.8)).collect()}
    assert got == {n: 7 if n > 6 else 1 for n in at}


def test_chains_of_versions_are_whole(spark):
    g = random.Random(5)
    vocab, rows = [f"w{i}" for i in range(5000)], []
    for c in range(12):
        base = g.choices(vocab, k=200)
        for k in range(12):                                                        # neighbours at about 0.85
            base = list(base)
            for i in range(3):
                base[(k * 3 + i) * 5 % 200] = g.choice(vocab)
            rows.append((len(rows), " ".join(base)))
    got = defaultdict(list)
    for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].append(r.doc_id)
    want = brute_classes(rows)
    together = {i: k for k, v in got.items() for i in v}
    lost = sum(len({together[i] for i in v}) - 1 for v in want)
    assert lost <= 1 and sum(len(v) for v in want if len(v) > 1) > 100


def test_no_link_of_a_bucket_is_lost(spark):
    """Sixty far pairs of alike points, and two clusters that only one pair of nodes beside the heads joins, all in one bucket."""
    at = {2 * i + k: 10.0 * i + 0.1 * k for i in range(60) for k in (0, 1)}
    at |= {1000: 1000.0, 1001: 1000.15, 1002: 1000.3, 1003: 1000.45} | {1010 + i: 1000.0 - 0.01 * i for i in range(8)} | {1020 + i: 1000.45 + 0.01 * i for i in range(8)}
    bands = spark.createDataFrame([(n, 0, 1) for n in at], "node long, band int, key long")
    where = spark.createDataFrame(list(at.items()), "id long, x double")

    def compare(pairs):
        a, b = (where.select(F.col("id").alias(c), F.col("x").alias(f"x{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", (1 - F.abs(F.col("xa") - F.col("xb"))).alias("similarity"))

    got = {r.node: r.root for r in graph.components(graph.banded_links(bands, lambda nodes: None, compare, 0.8)).collect()}
    assert got == {n: 1000 if n >= 1000 else n // 2 * 2 for n in at}


def test_pairs_of_a_bucket_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_A_TASK", 50)
    r = random.Random(3)
    at = {i: r.random() * 20 for i in range(150)}
    bands = spark.createDataFrame([(n, k, n % (k + 1)) for n in at for k in range(2)], "node long, band int, key long")
    where = spark.createDataFrame(list(at.items()), "id long, x double")

    def compare(pairs):
        a, b = (where.select(F.col("id").alias(c), F.col("x").alias(f"x{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", (1 - F.abs(F.col("xa") - F.col("xb"))).alias("similarity"))

    got = {x.node: x.root for x in graph.components(graph.banded_links(bands, lambda nodes: None, compare, 0.9)).collect()}
    line, want, run = sorted(at, key=at.get), {}, []
    for a, b in zip(line, line[1:] + [None]):
        run.append(a)
        if b is None or 1 - abs(at[a] - at[b]) < 0.9:
            want |= {x: min(run) for x in run} if len(run) > 1 else {}
            run = []
    assert got == want


def test_unlike_texts_of_a_bucket_are_not_all_compared(spark, monkeypatch):
    """300 texts share a passage, which puts them into the same buckets; only those that share rare shingles too are compared, and no class is lost."""
    g = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    shared, rows = g.choices(vocab, k=60), []
    for i in range(150):
        own = g.choices(vocab, k=25)
        rows += [" ".join(shared + own), " ".join(shared + (own[:-1] + ["end"] if i % 3 == 0 else g.choices(vocab, k=25)))]
    rows = list(enumerate(rows))
    asked, compare = [], nd.similarities
    monkeypatch.setattr(nd, "similarities", lambda pairs, *a: (asked.append(pairs.count()), compare(pairs, *a))[1])
    got = defaultdict(list)
    for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(sorted(v) for v in got.values()) == brute_classes(rows)
    assert sum(len(v) == 2 for v in got.values()) >= 50 and sum(asked) < 8 * len(rows)


def test_prefixes_lose_no_alike_pair(spark):
    """Weighted sets of all degrees of likeness in one bucket against all pairs."""
    g = random.Random(4)
    sets = {}
    for c in range(12):
        base = {g.randrange(500): g.uniform(0.5, 6) for _ in range(40)}
        for k in range(8):
            s = dict(base)
            for _ in range(k):
                s.pop(g.choice(sorted(s)))
                s[g.randrange(500)] = g.uniform(0.5, 6)
            sets[c * 8 + k] = s

    def alike(a, b):
        low = sum(min(w, sets[b].get(i, 0)) for i, w in sets[a].items())
        return low / (sum(sets[a].values()) + sum(sets[b].values()) - low) >= 0.8

    live = spark.createDataFrame([(0, n, n) for n in sets], "bucket long, node long, root long")
    items = spark.createDataFrame([(n, list(s), list(s.values())) for n, s in sets.items()], "node long, items array<long>, weights array<double>")

    def read(batch):
        for n, i, w in zip(*(c.to_pylist() for c in batch.columns)):
            yield n, np.array(i, np.uint64) << np.uint64(50), np.array(w)

    rounds = graph.Rounds(spark)
    made = {(r.lo, r.hi) for r in graph.able(rounds, live, lambda nodes: (items.join(nodes, "node"), read), 0.8).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    assert len(want) > 30 and want <= made and len(made) < len(sets) * (len(sets) - 1) / 8
