"""Licence scan against regular expressions and brute force over substrings."""
import random
import re

from pyspark.sql import functions as F

from robustlens.llm import licenses as lc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def base_hits(t):
    w = words(t)
    return sorted((i, label) for p, label in lc.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def test_base_columns_match_brute_force_and_labels_come_from_spans(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [None, "", "x", "CC BY", "cc by cc by-sa ALL rights  reserved", "cc\nby all rights", f"foo {notice} bar", "Released under the MIT License.",
             "the gnu general public license, version 3", "Éa cc by é", "cc", "by cc by " * 2000, "cc é by", f"{notice} " * 50, notice, notice]
    docs = spark.createDataFrame([(i, t, "s", -1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: r for r in lc.scan_licenses(docs).collect()}
    assert len(got) == len(texts) and got[1].source == "s"
    for i, t in enumerate(texts):
        hits = base_hits(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words(t)), len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == sorted({h[1] for h in hits}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[6].labels == ["apache-2.0"] and [(s.start, s.end) for s in got[6].spans if s.coverage == 1] == [(1, 9)]
    assert got[7].labels == ["mit"] and got[8].labels == ["gpl"] and len(got[13].spans) >= 50
    assert lc.scan_licenses(docs.where(F.lit(False))).count() == 0


def test_matching_statistics_equal_the_longest_substring():
    g = random.Random(5)
    strings = [[g.randrange(4) for _ in range(g.randrange(1, 30))] for _ in range(6)]
    auto = lc.Automaton(strings)
    parts = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(20):
        text = [g.randrange(5) for _ in range(60)]
        for i, (state, length) in enumerate(auto.statistics(text)):
            best = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in parts), default=0)
            assert length == best
            if length:
                want = {(s, j) for s, string in enumerate(strings) for j in range(length, len(string) + 1) if string[j - length:j] == text[i + 1 - length:i + 1]}
                assert auto.places[state] == want


def test_chains_bridge_a_changed_word_and_stop_at_wide_gaps(spark):
    template = " ".join(f"w{i}" for i in range(20))
    changed = " ".join("other" if i == 9 else f"w{i}" for i in range(20))
    apart = " ".join(f"w{i}" for i in range(8)) + " z" * 30 + " " + " ".join(f"w{i}" for i in range(8, 20))
    docs = spark.createDataFrame([(0, changed), (1, apart)], "doc_id long, text string")
    got = {r.doc_id: r for r in lc.scan_licenses(docs, templates={"t": [template]}, base={}).collect()}
    assert [(s.start, s.end, round(s.coverage, 2)) for s in got[0].spans] == [(0, 20, 0.95)]
    assert [round(s.coverage, 2) for s in got[1].spans] == [0.4, 0.6]
