"""One query per operator, over its whole table with production parameters, and its DuckDB text where SQL can say it."""
import os

from pyspark.sql import functions as F

from . import bytebpe, chat, decontam, language, lexical, licenses, mixing, neardup, passages, quality, repair, sample, tokencount, topk

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name="piece_bpe_32k.model"):
    """The vocabulary file; ROBUSTLENS_TOKENIZER overrides where the public package is not installed."""
    if path := os.environ.get("ROBUSTLENS_TOKENIZER"):
        return path
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_license_scan")
def op1(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_spans"))


@query("op2_benchmark_overlap")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_overlaps(docs, table(spark, sf_dir, "benchmark"), whole=True)


@query("op3_exact_topk", """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, v.id AS vec_id, CAST(list_inner_product(q.w, v.w) AS BIGINT) AS score
  FROM (SELECT id, min(w) AS w FROM v WHERE id % 100 = 0 GROUP BY id) q JOIN v ON q.id <> v.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""")
def op3(spark, sf_dir):
    rows = topk.integer_rows(table(spark, sf_dir, "embeddings"))
    return topk.search(rows.where("id % 100 = 0"), rows, 10)


@query("op4_source_mix", """
WITH RECURSIVE d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS i FROM d),
w AS (SELECT source, count(*) AS n, CAST(floor(1000 * sqrt(count(*))) AS BIGINT) AS s FROM d GROUP BY source),
a AS (SELECT source, (n + 15) // 16 AS blocks, greatest(1, s * 1000 // CAST(sum(s) OVER () AS BIGINT)) AS a, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM w),
l AS (SELECT list(a ORDER BY k) AS a, list(blocks ORDER BY k) AS blocks, CAST(count(*) AS BIGINT) AS m FROM a),
sim AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS period, blocks AS rest, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS b,
         list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS block FROM l
  UNION ALL
  SELECT slot + 1, t + 1, period, rest, b, list_transform(range(1, m + 1), lambda j: done[j] + CASE WHEN j = pick THEN 1 ELSE 0 END), pick, blocks[pick] - rest[pick] + done[pick]
  FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, m + 1), lambda j: done[j] < b[j] AND done[j] * period // b[j] <= t),
                                      lambda j: ((done[j] + 1) * period + b[j] - 1) // b[j] * 1000 + j)) % 1000 AS pick
    FROM (
      SELECT slot, t, rest, b, done, m, blocks, CAST(list_sum(b) AS BIGINT) AS period
      FROM (
        SELECT slot, CASE WHEN t = period THEN 0 ELSE t END AS t, m, blocks,
               CASE WHEN t = period THEN list_transform(range(1, m + 1), lambda j: rest[j] - b[j]) ELSE rest END AS rest,
               CASE WHEN t = period THEN list_transform(range(1, m + 1), lambda j: least(a[j], rest[j] - b[j])) ELSE b END AS b,
               CASE WHEN t = period THEN list_transform(range(1, m + 1), lambda j: CAST(0 AS BIGINT)) ELSE done END AS done
        FROM sim, l))
    WHERE period > 0))
SELECT r.doc_id, r.source, r.i // 16 AS mix_block, sim.slot AS mix_slot, r.i % 16 AS mix_pos
FROM r JOIN a ON r.source IS NOT DISTINCT FROM a.source JOIN sim ON sim.pick = a.k AND sim.block = r.i // 16 AND sim.slot >= 0
""")
def op4(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op5_quality_scores")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality.score_quality(docs.withColumn("held_out", sample.held_out()), model).select("doc_id", "held_out", "score", "predicted")


@query("op6_near_duplicates")
def op6(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query("op7_quote_links", r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS id FROM conversations),
s AS (SELECT id, conv_id, turn, string_split_regex(text, '\r?\n') AS lines FROM m),
l AS (SELECT id, conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM s),
q AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^\s{0,3}((?:>\s?)+)(.*)$', 1), '\s', '', 'g')) AS level,
         CASE WHEN regexp_matches(line, '^\s{0,3}((?:>\s?)+)(.*)$') THEN regexp_extract(line, '^\s{0,3}((?:>\s?)+)(.*)$', 2) ELSE line END AS body FROM l),
b AS (
  SELECT *, trim(body) = '' AS blank,
         CASE WHEN lag(level) OVER w IS DISTINCT FROM level OR trim(lag(body) OVER w) = '' THEN 1 ELSE 0 END AS begins FROM q WINDOW w AS (PARTITION BY id ORDER BY k)),
p AS (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY k) AS passage FROM b),
u AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS unit FROM (
    SELECT conv_id, turn, level, body FROM p UNION ALL
    SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY k) FROM p WHERE NOT blank GROUP BY id, conv_id, turn, level, passage)),
k AS (
  SELECT a.conv_id, a.turn, a.level, a.unit, max(o.turn) AS source FROM u a JOIN u o ON a.conv_id = o.conv_id AND a.unit = o.unit AND o.level = 0 AND o.turn < a.turn
  WHERE a.level > 0 AND a.unit <> '' GROUP BY ALL),
best AS (
  SELECT conv_id, turn, source, count(*) OVER (PARTITION BY conv_id, turn) AS n_linked,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, length(unit) DESC, source DESC) AS i FROM k),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m)),
n AS (SELECT t.conv_id, t.turn, coalesce(source, before) AS answers, coalesce(n_linked, 0) AS n_linked FROM t LEFT JOIN (SELECT * FROM best WHERE i = 1) x ON t.conv_id = x.conv_id AND t.turn = x.turn),
f AS (SELECT *, answers IS NOT NULL AND turn = min(turn) OVER (PARTITION BY conv_id, answers) AS goes_on FROM n),
r AS (
  SELECT conv_id, turn, turn AS branch, CAST(0 AS BIGINT) AS pos FROM f WHERE NOT goes_on
  UNION ALL SELECT f.conv_id, f.turn, r.branch, r.pos + 1 FROM r JOIN f ON f.conv_id = r.conv_id AND f.answers = r.turn AND f.goes_on),
o AS (
  SELECT id, trim(regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (level = 0), ''), '\n\s*\n(\s*\n)*', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS own_text,
         count(*) FILTER (level > 0) AS n_quotes FROM p GROUP BY id)
SELECT m.conv_id, m.turn, m.role, n.answers, r.branch, r.pos, o.n_quotes, n.n_linked, o.own_text
FROM m JOIN o USING (id) JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn
""")
def op7(spark, sf_dir):
    return chat.format_chat(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "answers", "branch", "pos", "n_quotes", "n_linked", "own_text")


@query("op8_token_counts")
def op8(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


@query("op9_repeated_passages")
def op9(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "first_doc_id", "first_word", "end_word", "class_id", "removed")


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return language.identify(docs.select("doc_id", "text", sample.held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op11_conversation_repair", r"""
WITH RECURSIVE z AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS crc),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
k AS (
  SELECT c.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT)), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 20 AS k
  FROM c, z),
m AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE k <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, left(role, 1) AS initial,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM m),
f AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
g AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins(state, stands, cost, audit, said) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
         (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:'),
         (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS said FROM g
  UNION ALL
  (WITH e AS (
     SELECT s.conv_id, f.i, ins.stands, s.cost + ins.cost AS cost, s.audit || ins.audit AS audit, s.said || ins.said AS said, f.role, f.text, f.initial, f.fault,
            CASE WHEN ins.stands = 2 THEN 'assistant' ELSE 'user' END AS fits, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS extra
     FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1 JOIN ins ON ins.state = s.state),
   a AS (
     SELECT conv_id, i, stands AS state, cost + 4 AS cost, audit || 'D' AS audit, said FROM e
     UNION ALL SELECT conv_id, i, CASE fits WHEN 'user' THEN 2 ELSE 3 END, cost + 3 + extra, audit || 'R', said || chr(10) || fits || ':' || text FROM e WHERE fault NOT IN ('blank', 'duplicate')
     UNION ALL SELECT conv_id, i, CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, cost + extra, audit || 'K', said || chr(10) || role || ':' || text FROM e
               WHERE fault NOT IN ('blank', 'duplicate') AND ((initial = 's' AND stands = 0) OR (initial = 'u' AND stands <> 2) OR (initial = 'a' AND stands = 2)))
   SELECT conv_id, i, state, min(cost), arg_min(audit, {'c': cost, 'a': audit}), arg_min(said, {'c': cost, 'a': audit}) FROM a GROUP BY conv_id, i, state)),
t AS (
  SELECT s.conv_id, g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, s.cost + ins.cost AS cost, s.audit || ins.audit AS audit, s.said || ins.said AS said
  FROM s JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.i = g.n JOIN ins ON ins.state = s.state AND (ins.stands = 3 OR (ins.stands = 0 AND ins.cost = 0))),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
""")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(rows), rows)


@query("op12_byte_bpe")
def op12(spark, sf_dir):
    import public_tokenizers
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return bytebpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)


@query("op13_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tf AS (SELECT k, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY k),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
s AS (
  SELECT i, item_id, k, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                                         * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN f USING (term) JOIN n USING (k) CROSS JOIN c GROUP BY i, item_id, k, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
""")
def op13(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
