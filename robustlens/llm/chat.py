"""Chat formatting by quotation linking, in DataFrame operations only.

Quoted lines start with one or more '>' and stand at that level. Runs of lines of one level split at blank lines are passages. A passage, and
each of its lines, is normalised (quote marks and case removed, white space collapsed) and hashed; the same units of what other messages say
themselves are joined to them by conversation and hash. A message answers the latest earlier message that holds its longest linked unit of
the shallowest linked level, or else the message of the turn before. Branches follow: the first answer to a message continues its branch, any other
starts one.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialize

QUOTE = r"^\s{0,3}((?:>\s?)+)(.*)$"      # fixed value: quote marks at the start of a line, then what is quoted
_TURNS = 512                              # turns of a conversation looked at together when the turn before is sought


def normalised(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def with_lines(messages, text="text"):
    """Add __lines: (level, words) of every line, level 0 for a message's own; a null text is one empty line."""
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), r"\s", "")).alias("level"),
                              F.when(x.rlike(QUOTE), F.regexp_extract(x, QUOTE, 2)).otherwise(x).alias("body"))
    return messages.withColumn("__lines", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n"), line))


def own_text(lines):
    """A message without its quotes: own lines, runs of blank lines collapsed and outer ones removed."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(own, r"\n\s*\n(\s*\n)*", "\n\n"), r"^\n+|\n+$", ""))


def units(rows, keys):
    """(keys, level, unit, is_long): passages and lines of every level, normalised; empty ones are left out.

    Lines are numbered by passage: a new one begins where the level changes or a blank line stands.
    """
    state = "cast(named_struct('level', -1, 'blank', true, 'out', array()) AS struct<level: int, blank: boolean, out: array<struct<level: int, body: string>>>)"
    passages = F.expr(f"""aggregate(__lines, {state}, (acc, x) -> named_struct('level', x.level, 'blank', trim(x.body) = '', 'out',
        CASE WHEN trim(x.body) = '' THEN acc.out
             WHEN acc.blank OR acc.level <> x.level THEN array_append(acc.out, named_struct('level', x.level, 'body', x.body))
             ELSE concat(slice(acc.out, 1, size(acc.out) - 1), array(named_struct('level', x.level, 'body', concat(acc.out[size(acc.out) - 1].body, ' ', x.body)))) END)).out""")
    both = F.array_distinct(F.transform(F.concat(passages, F.col("__lines")), lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("unit"))))
    return rows.select(*keys, F.explode(both).alias("u")).select(*keys, "u.level", "u.unit").where("unit <> ''")


def links(messages):
    """(conv_id, turn, answers): the earlier turn whose own words a message quotes; only messages with a linked quote."""
    quoting = messages.where(F.exists("__lines", lambda x: x["level"] > 0)).select("conv_id").distinct()
    some = messages.join(quoting, "conv_id", "left_semi")
    all_units = units(some, ["conv_id", "turn"]).select("conv_id", "turn", "level", F.xxhash64("unit").alias("h"), F.md5(F.col("unit").cast("binary")).alias("m"),
                                                        F.length("unit").alias("n")).distinct()
    # As-of join in one ordered pass over each (conversation, unit): the latest turn before that says the unit itself.
    before = Window.partitionBy("conv_id", "h", "m").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = all_units.withColumn("source", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before)).where("level > 0 AND source IS NOT NULL")
    return linked.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "source")).alias("best"), F.count(F.lit(1)).alias("n_linked")).select(
        "conv_id", "turn", F.col("best.source").alias("answers"), "n_linked")


def turns_before(nodes):
    """(conv_id, turn, before): the greatest smaller turn, sought inside stretches of turns so that no long conversation sits in one task."""
    cut = nodes.withColumn("part", F.floor(F.col("turn") / _TURNS))
    inside = cut.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "part").orderBy("turn")))
    last = cut.groupBy("conv_id", "part").agg(F.max("turn").alias("last")).withColumn("far", F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")))
    return inside.join(last.drop("last"), ["conv_id", "part"]).select("conv_id", "turn", F.coalesce("near", "far").alias("before"))


def branches(nodes):
    """(conv_id, turn, branch, pos): first turn of a message's branch and its place there, by doubling pointers along first answers."""
    spark = nodes.sparkSession
    first = nodes.where("answers IS NOT NULL").groupBy("conv_id", "answers").agg(F.min("turn").alias("first"))
    up = nodes.join(first, ["conv_id", "answers"], "left").select(
        "conv_id", "turn", F.when(F.col("turn") == F.col("first"), F.col("answers")).otherwise(F.col("turn")).alias("branch"),
        F.when(F.col("turn") == F.col("first"), 1).otherwise(0).cast("long").alias("pos"))
    up = materialize(spark, up, "branches")
    done, active = up.where("pos = 0"), up.where("pos > 0")
    while not active.isEmpty():
        far = done.union(active).select("conv_id", F.col("turn").alias("branch"), F.col("branch").alias("b2"), F.col("pos").alias("p2"))
        new = materialize(spark, active.join(far, ["conv_id", "branch"]).select("conv_id", "turn", F.col("b2").alias("branch"), (F.col("pos") + F.col("p2")).alias("pos"), "p2"), "branches")
        done, active = done.union(new.where("p2 = 0").drop("p2")), new.where("p2 > 0").drop("p2")
    return done


def format_chat(messages, conv="conv_id", turn="turn", role="role", text="text"):
    """Every message with answers (turn it replies to), branch (first turn of its branch), pos (place there from 0), n_quotes (quoted lines),
    n_linked (quoted units found earlier), own_text (without quotes) and chat (role header and own text).

    A conversation reads by (branch, pos). Messages that share conversation and turn count as one for linking; a null conversation or turn
    leaves answers, branch and pos null; a null or empty text quotes nothing. Only a conversation's first turn answers nothing.
    Columns of the new names are replaced, others stay.
    """
    added = ["answers", "branch", "pos", "n_quotes", "n_linked", "own_text", "chat"]
    rows = messages.drop(*added)
    kept = [c for c in rows.columns]
    lined = with_lines(rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text")).where("conv_id IS NOT NULL AND turn IS NOT NULL"))
    nodes = turns_before(lined.select("conv_id", "turn").distinct())
    nodes = nodes.join(links(lined), ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("answers", "before").alias("answers"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    nodes = materialize(messages.sparkSession, nodes, "answers")
    placed = nodes.join(branches(nodes), ["conv_id", "turn"]).select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"), "answers", "branch", "pos", "n_linked")
    out = with_lines(rows, text).join(placed, (F.col(conv) == F.col("__c")) & (F.col(turn).cast("long") == F.col("__t")), "left")
    out = out.withColumn("own_text", own_text(F.col("__lines"))).withColumn("n_quotes", F.size(F.filter("__lines", lambda x: x["level"] > 0)).cast("long"))
    chat = F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("")), F.lit("|>\n"), F.col("own_text"), F.lit("\n"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "answers", "branch", "pos", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "own_text", chat.alias("chat"))
