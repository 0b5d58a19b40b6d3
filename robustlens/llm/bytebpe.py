"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A text is split by the tokenizer's pattern. Words that are tokens are their ids at once, as in the rank file's own library; every other distinct
word becomes rows (word, pos, tok), one to a byte. A recursive query joins neighbouring rows with the merge table, takes each word's minimum
rank and contracts that pair from the left, until no word has a pair left. Decoding joins ids with the vocabulary and puts their bytes
together by an ordered aggregation.

Two facts keep the recursion short and the result the same. All places of a word's minimum pair are contracted in one step (leftmost first
where they overlap): if every token of the vocabulary comes out whole when its own bytes are merged, a contraction never opens a pair of lower
rank. `Vocabulary` proves that on the ranks; one that fails is contracted at one place a step. And a word is cut where two bytes stand side by
side in no token, as no merge can cross that place.
"""
import base64
import functools
import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS, BYTES = 20_000, 3 << 16     # words, and bytes of them, in one recursive query: bounds its rows
STEPS = 48                         # steps of one recursion; what is not done then starts another, so no step's rows are kept for long
PIECES = 1 << 17                   # words of a text held at once
CACHE = 3 << 19                    # distinct words whose ids a worker remembers before it starts anew
SLICE = 1 << 21                    # bytes of texts (or of ids) handled at once; one longer text is a slice of its own
DECODE_IDS = 1 << 18               # ids in one decoding query

ENCODE = """
WITH RECURSIVE step(n, word, pos, tok, following) AS (
  SELECT CAST(0 AS INTEGER), word, pos, tok, following FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT l.word, l.pos, l.right_pos, l.after AS following, m.tok AS merged
     FROM (SELECT *, lead(pos) OVER w AS right_pos, lead(tok) OVER w AS right_tok, lead(following) OVER w AS after FROM step WINDOW w AS (ORDER BY pos)) l
     JOIN merges m ON m.left_tok = l.tok AND m.right_tok = l.right_tok WHERE l.n < {steps} AND l.following = l.right_pos),
   best AS (SELECT word, min(merged) AS merged FROM pairs GROUP BY word),
   least AS (SELECT p.* FROM pairs p JOIN best b ON p.word = b.word AND p.merged = b.merged),
   hits AS ({hits})
   SELECT CAST(s.n + 1 AS INTEGER), s.word, s.pos, coalesce(h.merged, s.tok), CASE WHEN h.pos IS NULL THEN s.following ELSE h.following END
   FROM step s SEMI JOIN best b ON s.word = b.word LEFT JOIN hits h ON s.pos = h.pos ANTI JOIN hits g ON s.pos = g.right_pos))
SELECT s.word, s.pos, s.tok, s.following, s.n FROM step s JOIN (SELECT word, max(n) AS n FROM step GROUP BY word) e ON s.word = e.word AND s.n = e.n
"""
# Which of a word's minimum pairs are contracted in a step: every other one of a run of overlapping pairs, from its left end on; or only the leftmost.
TOGETHER = """
SELECT pos, right_pos, following, merged
FROM (SELECT *, max(head) OVER (ORDER BY pos) AS begun
      FROM (SELECT *, CASE WHEN lag(right_pos) OVER (ORDER BY pos) IS NOT DISTINCT FROM pos THEN 0 ELSE i END AS head
            FROM (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM least)))
WHERE (i - begun) % 2 = 0"""
LEFTMOST = "SELECT pos, right_pos, following, merged FROM (SELECT *, min(pos) OVER (PARTITION BY word) AS leftmost FROM least) WHERE pos = leftmost"
DECODE = """
SELECT unhex(string_agg(b.hex, '' ORDER BY i.pos)) AS bytes, i.row AS row
FROM ids i JOIN vocabulary b ON i.id = b.id GROUP BY i.row ORDER BY i.row
"""


class Vocabulary:
    """Ranks, merge table and vocabulary of a rank file (`base64 rank` lines). `together` is what an earlier proof on the same file found."""

    def __init__(self, path, together=None):
        self.ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        table = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, tok = (np.array(x, np.int32) for x in zip(*table)) if table else (np.zeros(0, np.int32),) * 3
        self.merges = pa.table({"left_tok": left, "right_tok": right, "tok": tok})
        ids = sorted((r, t) for t, r in self.ranks.items())
        self.tokens = pa.table({"id": pa.array([r for r, _ in ids], pa.int32()), "hex": pa.array([t.hex() for _, t in ids])})
        self.joined = np.zeros((256, 256), bool)       # byte pairs that stand inside some token
        for t in self.ranks:
            b = np.frombuffer(t, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.connection = None
        self.together = bool(together)
        if together is None:
            whole = [t for t in self.ranks if len(t) > 1]
            self.together = all(len(x) == 1 and x[0] == self.ranks[t] for t, x in zip(whole, self.merge(whole)))

    def connect(self):
        if self.connection is None:
            import duckdb
            self.connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "384MB", "temp_directory": ""})
            for name, table in (("merges", self.merges), ("vocabulary", self.tokens)):
                self.connection.register("given", table)
                self.connection.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
                self.connection.unregister("given")
        return self.connection

    def __getstate__(self):
        return {**self.__dict__, "connection": None}

    def merge(self, words):
        """Ids of each word (bytes), by the recursive queries."""
        out = []
        for part in _blocks(words):
            data = np.frombuffer(b"".join(part), np.uint8)
            ends = np.cumsum([len(w) for w in part])
            cut = np.zeros(len(data), np.int32)
            cut[1:] = ~self.joined[data[:-1], data[1:]]
            cut[0] = 0
            cut[ends[:-1]] = 1
            at = np.arange(len(data), dtype=np.int32)
            last = np.append(cut[1:] == 1, True)
            rows = pa.table({"word": np.cumsum(cut, dtype=np.int32), "pos": at, "tok": self.byte_rank[data], "following": np.where(last, np.int32(-1), at + np.int32(1))})
            pos, tok = self._fixpoint(rows)
            bounds = np.searchsorted(pos, np.concatenate([[0], ends]))
            out += [tok[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def _fixpoint(self, rows):
        """Positions and tokens that are left of rows (word, pos, tok), in order of pos."""
        con = self.connect()
        sql = ENCODE.format(steps=STEPS, hits=TOGETHER if self.together else LEFTMOST)
        done = []
        while rows.num_rows:
            con.register("start", rows)
            got = con.sql(sql).to_arrow_table()
            con.unregister("start")
            n = got.column("n").to_numpy()
            done.append(got.filter(pa.array(n < STEPS)))
            rows = got.filter(pa.array(n >= STEPS)).select(["word", "pos", "tok", "following"])
        both = pa.concat_tables(done) if done else rows
        pos, tok = both.column("pos").to_numpy(), both.column("tok").to_numpy()
        order = np.argsort(pos)
        return pos[order], tok[order].astype(np.int32)

    def decode(self, lists):
        """Bytes of each list of ids; an id that is not in the vocabulary raises."""
        con, out = self.connect(), []
        for part in _blocks(lists, len(lists) or 1, DECODE_IDS):
            sizes = np.array([len(x) for x in part])
            flat = np.concatenate(part).astype(np.int32) if sizes.sum() else np.zeros(0, np.int32)
            con.register("ids", pa.table({"row": np.repeat(np.arange(len(part)), sizes), "pos": np.arange(len(flat)), "id": flat}))
            if con.sql("SELECT id FROM ids ANTI JOIN vocabulary USING (id) LIMIT 1").fetchall():
                raise ValueError("an id is not in the vocabulary")
            got = con.sql(DECODE).to_arrow_table()
            con.unregister("ids")
            found = [b""] * len(part)
            for i, b in zip(got.column("row").to_pylist(), got.column("bytes").to_pylist()):
                found[i] = b
            out += found
        return out


def _blocks(items, most=WORDS, size=BYTES):
    part, held = [], 0
    for x in items:
        if part and (len(part) >= most or held + len(x) > size):
            yield part
            part, held = [], 0
        part.append(x)
        held += len(x)
    if part:
        yield part


class Encoder:
    """Texts to ids: whole words first, then the worker's own memory, then the recursive query."""

    def __init__(self, vocabulary, pattern):
        import regex
        self.vocabulary, self.split, self.known = vocabulary, regex.compile(pattern), {}

    def learn(self, words):
        new = []
        for w in words:
            raw = w.encode()
            rank = self.vocabulary.ranks.get(raw)
            if rank is None:
                new.append((w, raw))
            else:
                self.known[w] = rank.to_bytes(4, sys.byteorder)
        for (w, _), ids in zip(new, self.vocabulary.merge([raw for _, raw in new])):
            self.known[w] = ids.tobytes()

    def words(self, text):
        """The words of a text, a bounded number of them at a time."""
        if len(text) <= PIECES:
            yield self.split.findall(text)
        else:
            matches = self.split.finditer(text)
            while words := [m.group() for m in itertools.islice(matches, PIECES)]:
                yield words

    def __call__(self, texts):
        """One array of ids for each text; null and empty ones have none."""
        out, held, size = [[] for _ in texts], [], 0
        for row, text in enumerate(texts):
            for words in self.words(text) if text else ():
                held.append((row, words))
                size += len(words)
                if size >= PIECES:
                    self.finish(held, out)
                    held, size = [], 0
        self.finish(held, out)
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def finish(self, held, out):
        distinct = set(itertools.chain.from_iterable(words for _, words in held))
        if len(self.known) + len(distinct) > CACHE:
            self.known = {}
        self.learn([w for w in distinct if w not in self.known])
        for row, words in held:
            out[row].append(b"".join(map(self.known.__getitem__, words)))


@functools.lru_cache(maxsize=1)
def worker_encoder(path, pattern, together):
    return Encoder(Vocabulary(path, together), pattern)


@functools.lru_cache(maxsize=1)
def worker_vocabulary(path):
    return Vocabulary(path, False)     # decoding rests on no order of contraction


def _rows(batch, size=SLICE):
    """Slices of an Arrow batch whose last column holds about `size` bytes each."""
    import pyarrow.compute as pc
    column = batch.column(batch.num_columns - 1)
    length = pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pc.multiply(pc.list_value_length(column), 4)
    total = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def _kept(docs, *gone):
    kept = [c for c in docs.columns if c not in gone]
    return kept, [docs.schema[c] for c in kept]


def _source(docs, kept, source):
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("__source"))


def _encoded(encoder, column):
    got = encoder(column.to_pylist())
    ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))


def _lists(column):
    return [np.zeros(0, np.int32) if not x.is_valid else x.values.to_numpy(zero_copy_only=True) for x in column]


def encode(docs, path, pattern, text="text", ids="ids"):
    """Add `ids`, the token ids of every row's whole text; a column of that name is replaced, all others stay.

    Null and empty texts have no ids. Repeated rows each get theirs; an empty table gives an empty one. Texts of any length are encoded whole,
    a bounded number of words at a time; a text's ids have to fit into one row. Special tokens in a text are ordinary text. `path` is the rank file, which
    every worker must be able to read; the driver reads it once to prove it.
    """
    together = Vocabulary(path).together
    kept, fields = _kept(docs, ids)
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = worker_encoder(path, pattern, together)
        for batch in batches:
            for part in _rows(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _encoded(encoder, part.columns[-1])], schema.names)

    return _source(docs, kept, text).mapInArrow(run, schema)


def decode(docs, path, ids="ids", decoded="decoded"):
    """Add `decoded`, the bytes of every row's ids (a token may hold part of a character, so they are bytes); a column of that name is replaced.

    Null and empty lists decode to no bytes; an id outside the vocabulary, or null, fails the job.
    """
    kept, fields = _kept(docs, decoded)
    schema = T.StructType([*fields, T.StructField(decoded, T.BinaryType())])

    def run(batches):
        vocabulary = worker_vocabulary(path)
        for batch in batches:
            for part in _rows(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(vocabulary.decode(_lists(part.columns[-1])), pa.binary())], schema.names)

    return _source(docs, kept, ids).mapInArrow(run, schema)


def round_trip(docs, path, pattern, text="text"):
    """n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 in place of the text.

    `encode` and `decode` on the same slices within one worker, so that the ids of a corpus, larger than its texts, are never handed on.
    """
    import hashlib
    together = Vocabulary(path).together
    kept, fields = _kept(docs, text, "n_tokens", "ids_sha256", "decoded_sha256")
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        encoder = worker_encoder(path, pattern, together)
        for batch in batches:
            for part in _rows(batch):
                lists = _lists(_encoded(encoder, part.columns[-1]))
                own = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists]
                back = [hashlib.sha256(x).hexdigest() for x in encoder.vocabulary.decode(lists)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(x) for x in lists], pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], schema.names)

    return _source(docs, kept, text).mapInArrow(run, schema)
