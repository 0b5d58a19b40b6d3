"""Quotation linking against a plain-Python version, and edge cases."""
import random
import re
from itertools import groupby

from pyspark.sql import functions as F

from robustlens.llm import chat as ch

QUOTE = re.compile(r"^\s{0,3}((?:>\s?)+)(.*)$")


def norm(s):
    return re.sub(r"\s+", " ", s.lower()).strip()


def lines(text):
    out = []
    for x in re.split("\r?\n", text or ""):
        m = QUOTE.match(x)
        out.append((m.group(1).count(">"), m.group(2)) if m else (0, x))
    return out


def units(text):
    ls = lines(text)
    out = {(lv, norm(b)) for lv, b in ls}
    for (lv, blank), run in groupby(ls, key=lambda x: (x[0], not x[1].strip())):
        if not blank:
            out.add((lv, norm(" ".join(b for _, b in run))))
    return {u for u in out if u[1]}


def brute(rows):
    """{(conv, turn): (answers, branch, pos)}"""
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        turns = sorted({r[1] for r in rows if r[0] == conv and r[1] is not None})
        said = {t: set().union(*[units(r[3]) for r in rows if r[:2] == (conv, t)]) for t in turns}
        taken = set()
        for i, t in enumerate(turns):
            found = [(-lv, len(u), s) for lv, u in said[t] if lv for s in [max([x for x in turns[:i] if (0, u) in said[x]], default=None)] if s is not None]
            answers = max(found)[2] if found else turns[i - 1] if i else None
            if answers is not None and answers not in taken:
                out[conv, t] = (answers, out[conv, answers][1], out[conv, answers][2] + 1)
            else:
                out[conv, t] = (answers, t, 0)
            taken.add(answers)
    return out


def test_equals_plain_python(spark):
    g = random.Random(6)
    said = ["Hello there", "I  agree", "no", "A longer remark on\nthe matter", "one\n\ntwo\nthree", "Ünïcode É"]
    rows = [(None, 1, "user", "x"), (3, None, "user", "y"), (4, 0, None, None), (4, 1, "user", ""), (4, 5, "user", ">"), (4, 1, "user", "> "), (4, 700, "user", "late"), (4, 3000, "user", "> late\n>> no\nok")]
    for c in range(5, 25):
        for t in range(g.randrange(1, 12)):
            parts = [g.choice(said) for _ in range(g.randrange(1, 3))]
            for _ in range(g.randrange(3)):
                q = g.choice(said).upper() if g.random() < 0.3 else g.choice(said)
                mark = g.choice(["> ", ">", ">> ", "> > ", " > "])
                parts.insert(g.randrange(len(parts) + 1), "\n".join(mark + x for x in q.split("\n")))
            rows.append((c, t, g.choice(["user", "assistant"]), g.choice(["\n", "\r\n", "\n\n"]).join(parts)))
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn int, role string, text string, own_text string, level int")
    got = ch.format_chat(df).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {(r.conv_id, r.turn): (r.answers, r.branch, r.pos) for r in got if r.conv_id is not None and r.turn is not None} == want
    for r in got:
        own = [b for lv, b in lines(r.text) if lv == 0]
        assert [x for x in map(str.strip, r.own_text.split("\n")) if x] == [x for x in map(str.strip, own) if x]
        assert r.n_quotes == sum(lv > 0 for lv, _ in lines(r.text)) and r.chat.startswith(f"<|{r.role or ''}|>\n") and r.level == 1
    assert any(a is not None and t - a > 1 for (_, t), (a, _, _) in want.items())


def test_no_quotes_and_empty(spark):
    df = spark.createDataFrame([(1, t, "user", f"m{t}") for t in (0, 1, 2, 5)], "conv_id long, turn long, role string, text string")
    assert sorted((r.turn, r.answers, r.branch, r.pos) for r in ch.format_chat(df).collect()) == [(0, None, 0, 0), (1, 0, 0, 1), (2, 1, 0, 2), (5, 2, 0, 3)]
    assert ch.format_chat(df.where(F.lit(False))).count() == 0


def test_oracle_sql_on_quoted_messages(spark, tmp_path):
    from compare import compare, duck, run_duck, run_spark

    from robustlens.llm.queries import ORACLES, QUERIES
    g = random.Random(8)
    said = ["Hello there", "I  agree", "no", "A longer remark on\nthe matter", "one\n\ntwo\nthree", "Ünïcode É"]
    rows = []
    for c in range(40):
        for t in range(g.randrange(1, 12)):
            parts = [g.choice(said)] + ["\n".join(g.choice(["> ", ">> "]) + x for x in g.choice(said).split("\n")) for _ in range(g.randrange(3))]
            rows.append((c, t, "user", g.choice(["\n", "\r\n", "\n\n"]).join(parts)))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    assert compare(run_spark(QUERIES["op7_quote_links"](spark, str(tmp_path))), run_duck(duck(str(tmp_path)), ORACLES["op7_quote_links"])) == []
