"""Language identification in two levels: the family first, then one-versus-one linear support vector machines inside it.

A text is the square root of its letter-trigram shares, hashed; whole texts, lower-cased. Family machines are one against the rest, those
of a family's languages one against one with votes. All are squared-hinge machines fitted on a bounded sample of labelled rows.
"""
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sample
from . import text as tx

DIMS = 2048
FIT_ROWS = 4000          # labelled rows of a fit over all languages together
UNKNOWN = "und"
LANGUAGES = 200          # more label values than this are refused
_ROWS = 128              # texts handled at once: a worker holds the batch and little beside it
_BYTES = 1 << 18

# Families of common language codes; any other code is a family of its own.
FAMILIES = {"germanic": "en de nl sv da no nb nn is af lb fy", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
            "uralic": "fi et hu", "indic": "hi ur bn mr ne pa gu", "turkic": "tr az kk uz ky", "cjk": "zh ja ko"}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def features(column):
    """Yield (first row, matrix) with a row of unit length for each text; texts without letters are all zero."""
    for first, row, offsets, data in _lowered(column):
        n = len(offsets) - 1
        out = np.zeros((n, DIMS), np.float32)
        if len(data) > 2:
            d = _LETTER[data].astype(np.uint32)
            code = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
            owner = tx.rows_of(offsets)
            good = (owner[:-2] == owner[2:]) & (code != 0x202020)
            slot = (code[good] * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
            out = np.bincount(owner[:-2][good] * DIMS + slot, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
            out = np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))
        yield first + row, out


def _lowered(column):
    """Chunks of the lower-cased column, which is lowered by runs of rows and never as a whole."""
    for first in range(0, len(column), _ROWS):
        for chunk in tx.chunks(pc.utf8_lower(column.slice(first, _ROWS).cast(pa.large_string())), _BYTES):
            yield first, *chunk


def machine(x, y, rounds=120, ridge=1e-4):
    """Weights and bias of a squared-hinge machine for y in {-1, 1}, both classes weighing the same; accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    step, t = np.float32(1 / (4 + ridge)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * -2 * y
        grad = np.append(slack @ x, slack.sum()) + ridge * v
        new = v - step * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


class Model:
    """Family machines and, for each family, its languages and their pair machines."""

    def __init__(self, x, labels):
        labels = np.asarray(labels, object)
        self.languages = sorted(set(labels))
        family = np.array([_FAMILY.get(c, c) for c in labels], object)
        self.families = sorted(set(family))
        self.members = {f: sorted(set(labels[family == f])) for f in self.families}
        self.top = [machine(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f, codes in self.members.items():
            for a, b in combinations(codes, 2):
                rows = (labels == a) | (labels == b)
                self.pairs[a, b] = machine(x[rows], np.where(labels[rows] == a, 1, -1).astype(np.float32))

    def predict(self, x):
        """Language and score in (0, 1) of each row."""
        n = len(x)
        margin = np.stack([x @ w[:-1] + w[-1] for w in self.top], 1) if self.top else np.full((n, 1), 4.0)
        best = margin.argmax(1)
        out, score = np.empty(n, object), _squash(margin[np.arange(n), best])
        for k, f in enumerate(self.families):
            rows, codes = np.flatnonzero(best == k), self.members[f]
            votes, least = np.zeros((len(rows), len(codes))), np.full((len(rows), len(codes)), 4.0)
            for (i, a), (j, b) in combinations(enumerate(codes), 2):
                w = self.pairs[a, b]
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            pick = (votes + _squash(least) / 2).argmax(1) if len(rows) else np.zeros(0, int)
            out[rows] = np.array(codes, object)[pick]
            score[rows] *= _squash(least[np.arange(len(rows)), pick])
        return out, score


def _squash(m):
    return 1 / (1 + np.exp(-3 * np.asarray(m, float)))


def fit(docs, text="text", lang="lang", fit_rows=FIT_ROWS):
    """Fit on about `fit_rows` rows in all, spread evenly over the languages, with a label and outside the held-out fold.

    Labels that are null teach nothing. Without any usable row the model is None.
    """
    rows = docs.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")
    labels = rows.select("lang").where("lang IS NOT NULL").distinct().limit(LANGUAGES + 1).count()
    if labels > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    _, rows = sample.per_group(rows, "lang", fit_rows / max(labels, 1))

    def run(batches):
        for batch in batches:
            for row, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    got = rows.select("lang", "text").mapInArrow(run, "lang string, x binary").limit(2 * fit_rows).collect()
    got = [r for r in sorted(got, key=lambda r: (r.lang, bytes(r.x))) if any(r.x)]
    if not got:
        return None
    return Model(np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), DIMS), [r.lang for r in got])


def identify(docs, model, text="text"):
    """Add lang_pred and score to every row of `docs` (columns of those names are replaced).

    A null text, one without a letter, or any text where no model could be fitted is `und` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text) if text in kept else len(kept)        # a text that stays is sent once

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(at)
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
            if model is not None:
                for row, x in features(column):
                    lang[row:row + len(x)], score[row:row + len(x)] = model.predict(x)
            lang[~letters], score[~letters] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    own = [] if text in kept else [F.col(f"`{text}`").alias("__text")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], *own).mapInArrow(run, schema)
