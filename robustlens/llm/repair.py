"""Conversation structure repair over a suffix-shared automaton.

A conversation's rows become a signature, one letter a row for its role's initial and first fault. All conversations' signatures share one automaton
minimised from the end: a node is a distinct suffix, so conversations that end alike meet in the same nodes. Once a node, for each grammar state
a row may be met in, the cheapest edits from there to the end and their best audit suffix are computed and kept; signatures are dealt to tasks
in the order of their reversed letters, where neighbours share their longest suffix, and each task holds the nodes of one path only.

Grammar: role initials have to read `(s?(ua)+)?`. Edits: K keep (0), R give the role that fits (3), D delete (4), I insert an empty message of the role
that fits (3); a truncated row that stays costs 3 more, blank and duplicate rows have to go. Among the cheapest edits the least audit in
ASCII order is taken.

Signatures are cut into blocks of bounded length, wherever tasks end, so a conversation of any length is spread over tasks; an edit sequence of a block
ends with the edit of its last row, hence none is a prefix of another and blocks compose without looking at texts again. Only the last
pass, a conversation's SHA-256, is sequential by nature: rows stream through it sorted, so its memory does not grow with the conversation
(but for the audit, which is one value of the result).
"""
import hashlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BLOCK = 256                       # rows to a block of a signature at most
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"           # fixed value: \x20 and \x09-\x0D
START, SYSTEM, USER, ASSISTANT = range(4)         # grammar states: nothing yet, after s, after u, after a
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
END = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
LEGAL = {"su", "ua", "au"}
GONE = "X"                        # signature letter of a row that has to go; other rows: s, u, a or o, a capital where truncated


def _steps():
    """For each letter and state: (cost, audit, next state) of the edits up to and with a row's own."""
    out = {}
    for letter in "suaoSUAO" + GONE:
        extra = TRUNCATED if letter.isupper() else 0
        for state in range(4):
            found, at = [], state
            for inserted in range(4):
                cost, audit = inserted * INSERT, "I" * inserted
                found.append((cost + DELETE, audit + "D", at))
                if letter != GONE:
                    if (to := KEPT.get(letter.lower(), {}).get(at)) is not None:
                        found.append((cost + KEEP + extra, audit + "K", to))
                    found.append((cost + REROLE + extra, audit + "R", NEXT[at][0]))
                at = NEXT[at][0]
            best = {}
            for cost, audit, to in sorted(found, reverse=True):
                best[to] = cost, audit, to
            out[letter, state] = list(best.values())
    return out


STEPS = _steps()


def extend(letter, after):
    """The node of a suffix with one more letter before it; a node has, by state and end state, (cost, audit) or None."""
    node = []
    for state in range(4):
        best = [None] * 4
        for cost, audit, to in STEPS[letter, state]:
            for end, rest in enumerate(after[to]):
                if rest is not None:
                    new = cost + rest[0], audit + rest[1]
                    if best[end] is None or new < best[end]:
                        best[end] = new
        node.append(best)
    return node


EMPTY = [[(0, "") if a == b else None for b in range(4)] for a in range(4)]


def damage(conversations):
    """Rows of `conversations` with planted faults, by crc32 of `conv_id:turn` mod 20: 0 drops a row, 1 empties its text, 2 takes its [.!?] out,
    3 repeats it, 4 sets its role to user. Nulls count as one space (a null turn stays null)."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(key) % 20
    rows = conversations.withColumn("__k", k).where("__k <> 0")
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("__k") == 4, "user").otherwise(role)
    times = F.when(F.col("__k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__times")).select("conv_id", "turn", "role", "text", F.explode("__times")).drop("col")


def _rows(messages):
    """Nulls filled, and the hash of the text that orders rows of one turn and role."""
    return messages.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("h", F.md5("text"))


def letters(messages):
    """(conv_id, turn, role, h, letter, n): distinct rows, how often each stands there, and the letter of the first of them; the others are duplicates."""
    spark = messages.sparkSession
    spaces = "".join(f"\\u{ord(c):04x}" for c in SPACE)
    seen = _rows(messages).withColumn("body", F.expr(f"trim(TRAILING '{spaces}' FROM text)"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    letter = F.when(F.col("body") == "", GONE).when(F.substring("body", -1, 1).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    cells = seen.withColumn("letter", letter).groupBy("conv_id", "turn", "role", "h", "letter").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(spark, cells, "cells")
    # Written before the join: a side aggregated by the join's key would keep adaptive execution from splitting a hot group.
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = materialize(spark, cells.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(F.min(place).alias("first")), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    again = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return cells.join(first, same).select("conv_id", "turn", "role", "h", F.when(again, GONE).otherwise(F.col("letter")).alias("letter"), "n")


_KEY = ["conv_id", "turn", "role", "h"]


def signature_blocks(cells, size=BLOCK):
    """(conv_id, turn, role, h, copy, signature): runs of a conversation's rows, at most `size` long, named by their first row."""
    fields = [cells.schema[c] for c in _KEY]
    schema = T.StructType([*fields, T.StructField("copy", T.LongType()), T.StructField("signature", T.StringType())])

    def run(batches):
        open_, out = None, []
        for batch in batches:
            for *key, letter, n in zip(*(c.to_pylist() for c in batch.columns)):
                copy = 0
                while copy < n:
                    if open_ and (open_[0][0] != key[0] or len(open_[2]) >= size):
                        out.append(open_)
                        open_ = None
                    open_ = open_ or (key, copy, [])
                    take = min(n - copy, size - len(open_[2]))
                    open_[2].extend([GONE if copy else letter] + [GONE] * (take - 1))
                    copy += take
            yield batched(out)
            out = []
        yield batched(out + ([open_] if open_ else []))

    types = [T_arrow(f.dataType) for f in schema]

    def batched(blocks):
        columns = [[k[i] for k, _, _ in blocks] for i in range(4)] + [[c for _, c, _ in blocks], ["".join(s) for _, _, s in blocks]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], schema.names)

    return cells.select(*_KEY, "letter", "n").repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, schema)


def T_arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


_PATHS = "signature string, costs array<long>, audits array<string>"


def automaton(signatures):
    """(signature, costs, audits) of distinct signatures: for each state before and after (16 pairs in order), null where no edits lead there."""
    def run(batches):
        path, letters_ = [EMPTY], ""           # nodes of the last signature's suffixes, shortest first
        for batch in batches:
            names, costs, audits = [], [], []
            for signature in batch.column(0).to_pylist():
                back = signature[::-1]
                shared = 0
                while shared < min(len(back), len(letters_)) and back[shared] == letters_[shared]:
                    shared += 1
                del path[shared + 1:]
                for letter in back[shared:]:
                    path.append(extend(letter, path[-1]))
                letters_ = back
                cells = [x for row in path[-1] for x in row]
                names.append(signature)
                costs.append([x and x[0] for x in cells])
                audits.append([x and x[1] for x in cells])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["signature", "costs", "audits"])

    back = F.reverse("signature")
    return signatures.repartitionByRange(back).sortWithinPartitions(back).mapInArrow(run, _PATHS)


def choices(blocks, paths):
    """Each block with, by the state before it, the state after (`to`), audit and cost to the conversation's end of the best way on: one pass over
    the blocks of each conversation from its end."""
    fields = [blocks.schema[c] for c in [*_KEY, "copy", "signature"]]
    schema = T.StructType([*fields, T.StructField("to", T.ArrayType(T.IntegerType())), T.StructField("audit", T.ArrayType(T.StringType())), T.StructField("togo", T.ArrayType(T.LongType()))])

    def run(batches):
        conv, togo = run, None
        for batch in batches:
            to, audit, costs = [], [], []
            for c, cost, text in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                if c != conv:
                    conv, togo = c, [END[s][0] for s in range(4)]
                best = [min((cost[4 * s + e] + togo[e], text[4 * s + e], e) for e in range(4) if cost[4 * s + e] is not None) for s in range(4)]
                togo = [b[0] for b in best]
                to.append([b[2] for b in best])
                audit.append([b[1] for b in best])
                costs.append(togo)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(to, pa.list_(pa.int32())), pa.array(audit, pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64()))], schema.names)

    named = blocks.join(paths.withColumnRenamed("signature", "of"), F.col("signature") == F.col("of")).select(*_KEY, "copy", "signature", "costs", "audits")
    order = [F.asc("conv_id"), *[F.desc(c) for c in [*_KEY[1:], "copy"]]]
    return named.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


class Conversation:
    """What is told of a conversation while its rows stream by."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit, self.edits, self.letters, self.at, self.read = conv, START, 0, [], "", "", 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None
        self.sha, self.first = hashlib.sha256(), True

    def block(self, signature, to, audit, togo):
        if not self.audit:
            self.cost, self.from_ = togo[START], START
        self.edits, self.letters, self.at, self.read = self.edits[self.at:] + audit[self.from_], self.letters[self.read:] + signature, 0, 0
        self.audit.append(audit[self.from_])
        self.from_ = to[self.from_]

    def say(self, role, text):
        self.sha.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode())
        self.first = False

    def insert(self):
        self.state, role = NEXT[self.state]
        self.say(role, "")

    def row(self, turn, role, text):
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        letter = self.letters[self.read]
        self.read += 1
        if letter == GONE:
            if text.strip(SPACE):
                self.duplicate += 1
            else:
                self.blank += 1
        elif letter.isupper():
            self.truncated += 1
        while self.edits[self.at] == "I":
            self.at += 1
            self.insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[:1]][self.state]
            self.say(role, text)
        elif edit == "R":
            self.state, role = NEXT[self.state]
            self.say(role, text)

    def result(self):
        end = END[self.state][1]
        for _ in end:
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit) + end, self.sha.hexdigest()


def repair(messages, conversations=None, size=BLOCK):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows count by turn, null turns first; rows of one turn by role and then by the MD5 of their text. Null roles and texts count as one space. A row's
    first fault counts: blank (white space only), duplicate (its role and text stood before), truncated (it ends in none of .!?). gaps is the
    number of turns missing between the least and the greatest; illegal counts neighbours whose initials are not su, ua or au. `conversations`
    (conv_id) may name conversations that have no rows: zeros, an empty audit and the hash of the empty string. A null conv_id is a
    conversation like others. Very long conversations and texts are streamed; repeated rows are duplicates; an empty table gives an empty one.
    Other columns are left out.
    """
    spark = messages.sparkSession
    blocks = materialize(spark, signature_blocks(letters(messages), size), "signatures")
    paths = materialize(spark, automaton(blocks.select("signature").distinct()), "automaton")
    chosen = choices(blocks, paths)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([messages.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    types = [T_arrow(f.dataType) for f in schema]

    def run(batches):
        now, out = None, []
        for batch in batches:
            for conv, turn, role, _, copy, text, signature, to, audit, togo in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv)
                if signature is None:
                    now.row(turn, role, text)
                else:
                    now.block(signature, to, audit, togo)
            yield batched(out)
            out = []
        yield batched(out + ([now.result()] if now is not None else []))

    def batched(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], schema.names)

    texts = _rows(messages).select(*_KEY, F.lit(None).cast("long").alias("copy"), "text")
    both = chosen.withColumn("text", F.lit(None).cast("string")).unionByName(texts, allowMissingColumns=True)
    # A block comes before the row it is named by; blocks of one row's copies in their order.
    both = both.select(*_KEY, "copy", "text", "signature", "to", "audit", "togo").repartition("conv_id").sortWithinPartitions(*_KEY, F.col("copy").asc_nulls_last())
    found = both.mapInArrow(run, schema)
    if conversations is None:
        return found
    ids = conversations.select(F.col("conv_id").alias("__id")).distinct()
    found = ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in longs]
    return found.select(F.col("__id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
