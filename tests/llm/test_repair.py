"""Conversation repair against an exhaustive search on each conversation."""
import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from robustlens.llm import repair

SPACE = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """One conversation: uniform-cost search over (rows read, state), cheapest first, then least audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = SPACE.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if cost < 4 * len(rows) + 7:
            role = "assistant" if state == "u" else "user"
            heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], said + ((role, ""),)))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                if role[:1] and role[:1] in fits:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], said + ((role, text),)))
                new = "assistant" if state == "u" else "user"
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], said + ((new, text),)))
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest())


def conversations(seed, n=160):
    rng, rows = random.Random(seed), []
    say = ["Yes.", "No!", "Why?", "so", "", "  \n", " ok.\t", "Long. " * 50, None, " x", "é。", "\xa0"]
    for conv in [None, *range(n)]:
        role = rng.choice([["system", "user", "assistant"], ["user", "assistant"], ["user", "tool", None, "", "assistant", "System"]])
        for turn in range(rng.choice([0, 1, 2, 4, 9, 30])):
            rows.append((conv, None if rng.random() < .05 else turn + rng.choice([0, 0, 0, 3]), role[turn % len(role)] if rng.random() < .8 else rng.choice(role), rng.choice(say)))
            if rng.random() < .05:
                rows += [rows[-1]] * rng.choice([1, 5])
    return rows


def by_conv(rows, ids):
    return {c: plain([r for r in rows if r[0] == c]) for c in ids}


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], (tuple(r), want[r.conv_id])


def test_equals_search(spark):
    rows = conversations(1)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", audit int, n int").repartition(4)
    ids = {r[0] for r in rows}
    check(repair.repair(df).collect(), by_conv([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], ids))
    out = repair.repair(repair.damage(df), df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    check(out.collect(), by_conv(damaged(rows), ids))


def test_long_conversations_in_blocks(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "b", f"{t}.", ""])) for c in range(3) for t in range(700)] + [(3, 1, "user", "same.")] * 900
    want = by_conv(damaged(rows), range(4))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    check(repair.repair(repair.damage(df), df, size=16).collect(), want)
    check(repair.repair(repair.damage(df), df).collect(), want)


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).collect() == [] and repair.repair(repair.damage(none), none).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert tuple(repair.repair(repair.damage(df), df).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_suffixes_share_nodes(spark, monkeypatch):
    """A task extends each distinct suffix once."""
    calls = []
    real = repair.extend
    monkeypatch.setattr(repair, "extend", lambda letter, after: calls.append(letter) or real(letter, after))
    path, last = [repair.EMPTY], ""
    names = sorted(["uaua", "saua", "aua", "Uua", "ua"], key=lambda s: s[::-1])
    for s in names:
        back = s[::-1]
        k = next((i for i, (a, b) in enumerate(zip(back, last)) if a != b), min(len(back), len(last)))
        del path[k + 1:]
        for letter in back[k:]:
            path.append(repair.extend(letter, path[-1]))
        last = back
    assert len(calls) == len({s[i:] for s in names for i in range(len(s))})
    got = repair.automaton(spark.createDataFrame([(s,) for s in names], "signature string").repartition(2)).select(F.col("signature"), F.col("audits")[3].alias("a")).collect()
    assert {r.signature: r.a for r in got}["uaua"] == "KKKK"
