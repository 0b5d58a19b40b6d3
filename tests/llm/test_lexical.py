"""Ranked lexical search against scoring every document in plain Python."""
import math
import random
import re
from collections import Counter

from robustlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, best=50):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms, ranked = set(TERM.findall((text or "").translate(LOWER))), []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                ranked.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(ranked)[:best])]
    return out


def corpus(seed=3, n=700):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(4000)] + ["Été", "ÉTÉ", "naïve", "X1", "日本"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + i, "the same words w1 w2 w3 w3 w3") for i in range(300)]                    # more copies than places: ties by id
    docs += [(5, docs[5][1]), (None, docs[7][1]), (n + 400, None), (n + 401, ""), (n + 402, "-- !!"), (n + 403, " ".join(rng.choice(words) for _ in range(60000)))]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 8, 40])))) for i in range(30)]
    return docs, items + [(3, "w1 W2 w3"), (None, "w5 w6"), (90, None), (91, "nowhere")]


def test_equals_scoring_all(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, item string, score int").repartition(5)
    q = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, rank int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], -r[3], r[2] is None, r[2] or 0)
    want = sorted(brute(docs, items), key=key)
    assert sorted((tuple(r) for r in lexical.search(d, q).collect()), key=key) == want
    assert sorted((tuple(r) for r in lexical.search(d, q, block_items=7, block_terms=60).collect()), key=key) == want


def test_bounds_never_fall_short():
    import numpy as np
    import pyarrow as pa
    docs, items = corpus(9, 200)
    texts = [t for _, t in docs if t and TERM.search(t)][:300]
    block = lexical.Items([t or "" for _, t in items])
    block.weigh(np.full(len(block.terms), 3), 300, 9000)
    column = pa.array(texts)
    n = np.array([len(TERM.findall(t)) for t in texts])
    ids = pa.array(range(len(texts)), pa.int64())
    exact, seen = block.scores(n, column).T, 0
    for row, begins, h, *_ in lexical.tx.words(column, unicode_lower=False):
        packed, ends = lexical.signatures(begins, h)
        bits = [packed[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends]), ends)]
        batch = pa.RecordBatch.from_arrays([ids.slice(row, len(bits)), pa.array(n[row:row + len(bits)]), pa.array(bits, pa.binary())], ["doc_id", "n", "bits"])
        for rows, _, m, signatures in lexical._widths(batch):
            bound = block.bounds(m, signatures)
            assert (bound >= exact[:, row + rows]).all()
            seen += len(rows)
    assert seen == len(texts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item, no_item = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(none, item).collect() == [] and lexical.search(one, no_item).collect() == []
    assert len(lexical.search(one, item).collect()) == 1
    assert lexical.search(one, item).columns == ["item_id", "rank", "doc_id", "score"]
