"""Repeated passages against plain Python: classes of lines, shared runs of words, and what is cut."""
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from robustlens.llm import passages as ps

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").lower())


def brute_lines(rows, similarity=0.8):
    """{(doc, first, end): class} of lines of 20 words or more that are alike to another place."""
    places, bags = [], []
    for d, t in rows:
        at = 0
        for x in (t or "").split("\n"):
            w = words(x)
            if len(w) >= 20:
                places.append((d, at, at + len(w)))
                bags.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
            at += len(w)
    parent = list(range(len(places)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(places)):
        for j in range(i):
            if len(bags[i] & bags[j]) >= similarity * len(bags[i] | bags[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(places)):
        groups[root(i)].append(places[i])
    return sorted(sorted(v) for v in groups.values() if len(v) > 1)


def fixture(g):
    vocab = [f"w{i}" for i in range(3000)] + ["É", "ñandú"]
    new = lambda n: g.choices(vocab, k=n)
    common, rows = [new(60), new(25)], []
    for i in range(50):
        ls = [new(g.choice([3, 12, 25, 50])) for _ in range(g.randrange(1, 5))]
        if i % 5 == 1:
            ls.insert(0, list(common[0]))
        if i % 5 == 2:
            x = list(common[1])
            x[g.choice([0, 24])] = "other"
            ls.append(x)
        rows.append((i, "\n".join(" ".join(x) for x in ls)))
    return rows, vocab


def test_line_classes_equal_brute_force(spark):
    rows, _ = fixture(random.Random(7))
    rows += [(100, None), (101, ""), (102, "a b c"), (103, "\n\n"), (104, " ".join(["der"] * 5000)), (105, rows[1][1]), (106, rows[1][1].upper())]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, class_id int, node string")
    got = ps.repeated_passages(docs).collect()
    ends = defaultdict(set)
    for d, t in rows:
        at = 0
        for x in (t or "").split("\n"):
            ends[d].add((at, at + len(words(x))))
            at += len(words(x))
    groups = defaultdict(list)
    for r in got:
        if (r.first_word, r.end_word) in ends[r.doc_id] and r.end_word - r.first_word >= 20:
            groups[r.class_id].append((r.doc_id, r.first_word, r.end_word))
    assert sorted(sorted(v) for v in groups.values()) == brute_lines(rows)
    per = defaultdict(list)
    for r in got:
        per[r.class_id].append(r)
    for v in per.values():
        first = min((r.doc_id, r.first_word) for r in v)
        assert sum(not r.removed for r in v) == 1 and {r.first_doc_id for r in v} == {first[0]}
    assert not {r.doc_id for r in got} & {100, 101, 102, 103}


def test_pasted_passages_are_found_and_clean_texts_are_not(spark):
    g = random.Random(3)
    vocab = [f"v{i}" for i in range(5000)]
    new = lambda n: g.choices(vocab, k=n)
    rows, passage = [], new(51)
    for i in range(60):
        w = new(100)
        if i % 3 == 0:
            k = g.randrange(100)
            w[k:k] = passage
        rows.append((i, " ".join(w)))
    got = ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i in range(60) if i % 3 == 0} and all(r.first_doc_id % 3 == 0 for r in got)


def test_cut(spark):
    t = "One two.\nthree four, five\nsix É seven. "
    assert ps.cut(t, [(0, 2)]) == "three four, five\nsix É seven. "
    assert ps.cut(t, [(2, 5)]) == "One two.\nsix É seven. "
    assert ps.cut(t, [(3, 6), (5, 8)]) == "One two.\nthree"
    assert ps.cut(t, [(1, 3)]) == "One\nfour, five\nsix É seven. "
    assert ps.cut(t, [(0, 8)]) is None


def test_dropping_keeps_first_places_and_columns(spark):
    p = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(2, f"head two\n{p}\ntail", "a", 5), (1, f"head one\n{p}", "b", 5), (3, p, "c", 5), (None, f"{p}\nx", "d", 5), (4, "clean text", "e", 5), (5, None, "f", None)],
                                 "doc_id long, text string, source string, n_chars long")
    got = {r.source: r for r in ps.drop_repeats(docs).collect()}
    assert ps.drop_repeats(docs).columns == docs.columns and set(got) == {"a", "b", "d", "e", "f"}
    assert got["b"].text == f"head one\n{p}" and got["a"].text == "head two\ntail" and got["a"].n_chars == 13 and got["d"].text == "x" and got["f"].text is None
    again = docs.unionByName(docs.where("doc_id = 1"))
    assert [r.text for r in ps.drop_repeats(again).where("doc_id = 1").collect()] == [f"head one\n{p}"] * 2
    assert ps.drop_repeats(docs.where(F.lit(False))).count() == 0


def test_unlike_lines_of_a_bucket_are_not_all_compared(spark, monkeypatch):
    """150 lines share 40 words and so their bands; those alike are found, and the others are not compared in pairs."""
    g = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    shared, rows = g.choices(vocab, k=40), []
    for i in range(75):
        own = g.choices(vocab, k=20)
        rows += [" ".join(shared + own), " ".join(shared + (own[:-1] + ["end"] if i % 3 == 0 else g.choices(vocab, k=20)))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    asked, links = [], ps.banded_links
    monkeypatch.setattr(ps, "banded_links", lambda bands, prepare, compare, *a: links(bands, prepare, lambda pairs: (asked.append(pairs.count()), compare(pairs))[1], *a))
    got = ps.line_links(ps.paragraphs(docs), docs)
    assert got.distinct().count() >= 25 and sum(asked) < 8 * len(rows)
