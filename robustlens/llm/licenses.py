"""Licence scan: a generalised suffix automaton of licence tokens, streamed over every text.

Streaming a text through the automaton gives its matching statistics: at each word the longest stretch ending there that occurs in some
template. Maximal long stretches are chained in order into template spans; a span that covers enough of its template labels the text.
Base phrases are strings of the same automaton, found as suffixes of the current match. Only stretches of words whose neighbours are
neighbours in a template are walked; elsewhere the statistics are at most one.
"""
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

MIN_MATCH = 4          # words of a match that can start or extend a span
MAX_GAP = 16           # words between chained matches, in text and template
MIN_COVER = 0.6        # share of a template that labels a text
MAX_TOKENS = 200_000   # template words in all: the automaton goes to every worker

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and grants as published with the licences.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mit": ["Released under the MIT License", "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"],
    "gpl": ["licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["dedicated to the public domain under the Creative Commons CC0 1.0 Universal"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


class Automaton:
    """Suffix automaton of several word strings, with the places where each state's words occur."""

    def __init__(self, strings):
        self.next, self.link, self.size, self.places = [{}], [-1], [0], [set()]
        for s, string in enumerate(strings):
            last = 0
            for i, word in enumerate(string):
                last = self._extend(last, word)
                self.places[last].add((s, i + 1))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.size[v]):
            if self.link[v] > 0:
                self.places[self.link[v]] |= self.places[v]

    def _state(self, size, link, following):
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, p, word):
        """The state of p's longest string followed by `word`, cut out of a longer one where needed."""
        q = self.next[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last, word):
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def statistics(self, words):
        """(state, length of the longest match) after each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length

    def state_of(self, string):
        state = 0
        for word in string:
            state = self.next[state][word]
        return state


class Scanner:
    """What one text needs: the automaton over word numbers, and the base phrases that end in each state."""

    def __init__(self, templates, base, min_match, max_gap):
        self.min_match, self.max_gap = min_match, max_gap
        owners = [(label, s) for label, strings in templates.items() for s in strings] + [(None, s) for s in base]
        hashed = [tx.hash_words(s) for _, s in owners]
        if sum(map(len, hashed)) > MAX_TOKENS:
            raise ValueError("too many template words for one automaton")
        self.vocabulary = np.unique(np.concatenate(hashed))
        strings = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.labels, self.lengths = [o for o, _ in owners], [len(s) for s in strings]
        self.pairs = np.unique(np.array([a * len(self.vocabulary) + b for s in strings for a, b in zip(s, s[1:])], np.int64))
        self.automaton = Automaton(strings)
        at = defaultdict(list)
        for phrase, string in zip(base, strings[len(owners) - len(base):]):
            at[self.automaton.state_of(string)].append((len(string), base[phrase]))
        self.phrases = []
        for v in range(len(self.automaton.next)):
            found, u = [], v
            while u > 0:
                found += at.get(u, [])
                u = self.automaton.link[u]
            self.phrases.append(found)

    def live(self, hashes):
        """Word numbers (-1: in no template), and the [start, end) stretches that the automaton has to see."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == hashes, at, -1)
        code = ids[:-1] * len(self.vocabulary) + ids[1:]
        pos = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        joined = np.concatenate([[False], (self.pairs[pos] == code) & (ids[:-1] >= 0) & (ids[1:] >= 0), [False]]).astype(np.int8)
        turn = np.diff(joined)
        return ids, np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + 1

    def scan(self, ids, stretches):
        """Base hits [(start, label)] and template spans [(label, start, end, coverage)] of one text; words from 0."""
        hits, matches = [], defaultdict(list)
        for a, b in stretches:
            seen = list(self.automaton.statistics(ids[a:b].tolist()))
            for i, (state, length) in enumerate(seen):
                hits += [(a + i + 1 - n, label) for n, label in self.phrases[state] if n <= length]
                if length >= self.min_match and (i + 1 == len(seen) or seen[i + 1][1] <= length):
                    for s, end in self.automaton.places[state]:
                        if self.labels[s] is not None:
                            matches[s].append((int(a + i + 1 - length), int(a + i + 1), end - length, end))
        spans = []
        for s, found in matches.items():
            for start, end, cover in self._chains(sorted(found)):
                spans.append((self.labels[s], start, end, cover / self.lengths[s]))
        return hits, sorted(spans, key=lambda x: (x[1], x[2], x[0]))

    def _chains(self, found):
        open_, done = [], []
        for start, end, t_start, t_end in found:
            done += [c for c in open_ if start - c[1] > self.max_gap]
            open_ = [c for c in open_ if start - c[1] <= self.max_gap]
            fit = [c for c in open_ if c[1] < end and c[2] < t_end and t_start - c[2] <= self.max_gap]
            if fit:
                c = max(fit, key=lambda c: c[3])
                c[3] += min(t_end - max(t_start, c[2]), end - max(start, c[1]))
                c[1], c[2] = end, t_end
            else:
                open_.append([start, end, t_end, t_end - t_start])
        return [(c[0], c[1], c[3]) for c in done + open_]


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                                                     T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())])))])


def scan_licenses(docs, text="text", templates=None, base=None, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
    """One row per row of `docs`: its columns but the text (and but those added here), and

    n_words; n_base, first_word, last_word: places of base phrases, the smallest and largest start (null where none); base_labels, labels:
    sorted distinct; spans: chained template matches with their share of the template; score: 1 where a base phrase stands, else the
    largest share, at most 1. A null or empty text has no words and no labels; repeated rows each get their row.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, BASE if base is None else base, min_match, max_gap))
    kept = [c for c in docs.columns if c != text and c not in ADDED.names]

    def run(batches):
        s = scanner.value
        for batch in batches:
            out = []
            for _, begins, hashes, *_ in tx.words(batch.column(batch.num_columns - 1), unicode_lower=False):
                inner = begins[1:-1]
                ids, a, b = s.live(hashes)
                # A stretch may not run from one text into the next.
                cut = np.searchsorted(inner, a, "right"), np.searchsorted(inner, b, "left")
                parts = defaultdict(list)
                for x, y, i, j in zip(a.tolist(), b.tolist(), cut[0].tolist(), cut[1].tolist()):
                    edges = [x, *inner[i:j].tolist(), y]
                    for k, (p, q) in enumerate(zip(edges, edges[1:])):
                        if q - p > 1:
                            parts[int(np.searchsorted(begins, p, "right")) - 1].append((p, q))
                for r in range(len(begins) - 1):
                    first = int(begins[r])
                    hits, spans = s.scan(ids, parts[r]) if r in parts else ([], [])
                    spans = [{"label": x[0], "start": x[1] - first, "end": x[2] - first, "coverage": min(x[3], 1.0)} for x in spans]
                    places = [h[0] - first for h in hits]
                    found = {h[1] for h in hits}
                    out.append({"n_words": int(begins[r + 1] - first), "n_base": len(hits), "first_word": min(places, default=None),
                                "last_word": max(places, default=None), "base_labels": sorted(found),
                                "labels": sorted(found | {x["label"] for x in spans if x["coverage"] >= min_cover}),
                                "score": 1.0 if hits else max([x["coverage"] for x in spans], default=0.0), "spans": spans})
            added = pa.Table.from_pylist(out, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in added.columns]], [*kept, *ADDED.names])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(
        run, T.StructType([docs.schema[c] for c in kept] + ADDED.fields))


_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
                    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])))])
