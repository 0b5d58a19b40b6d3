"""Quality classifier from trusted positives and unlabelled web text alone.

The fit minimises the non-negative unbiased positive-unlabelled risk  pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])  with logistic loss;
where the second part falls below zero the step climbs it again. The class prior pi comes from the same rows: a first classifier of
positives against unlabelled ranks a part kept aside, and pi is the least ratio of their shares above a cut.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sample
from . import text as tx

POSITIVES = 4000        # trusted positives of a fit
UNLABELLED = 8000       # unlabelled texts of a fit
THRESHOLD = 0.3
_ROWS = 4096
_EXTRA = 8
DIMS = 256 + _EXTRA


def features(column):
    """Yield (first row, matrix): square roots of byte shares, and how much of a text repeats itself."""
    for row, offsets, data in tx.chunks(column, most=_ROWS):
        n, size = len(offsets) - 1, np.diff(offsets)
        owner = tx.rows_of(offsets)
        share = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
        lowered, starts, ends, begins = tx.word_bounds(data, offsets)
        h, count = tx.hash_spans(lowered, starts, ends), np.diff(begins)
        of = tx.rows_of(begins)
        some = np.maximum(count, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        pair = np.zeros(len(h), np.uint64)
        pair[1:] = tx.windows(h, 2)
        with np.errstate(over="ignore"):
            salt = tx.mix(of.astype(np.uint64))
            distinct = [np.bincount(of[np.unique(k ^ salt, return_index=True)[1]], minlength=n) / some for k in (h, pair)]
        words = np.bincount(of, weights=ends - starts, minlength=n)
        upper = np.bincount(owner, weights=(data >= 65) & (data <= 90), minlength=n)
        lower = np.bincount(owner, weights=(data >= 97) & (data <= 122), minlength=n)
        extra = np.stack([np.bincount(of, weights=same, minlength=n) / some, distinct[0], distinct[1], 1 - words / np.maximum(size, 1),
                          np.minimum(words / some, 30) / 30, np.log1p(count) / 12, upper / np.maximum(upper + lower, 1), count == 0], 1)
        yield row, np.concatenate([np.sqrt(share), extra], 1).astype(np.float32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(dim, gradient, rounds, rate=0.05):
    w, m, v = (np.zeros(dim, np.float32) for _ in range(3))
    for i in range(1, rounds + 1):
        g = gradient(w).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / np.float32(1 - 0.9 ** i)) / (np.sqrt(v / np.float32(1 - 0.999 ** i)) + np.float32(1e-8))
    return w


def class_prior(positive, unlabelled, least=100):
    """Share of positives among the unlabelled, from scores: the least ratio of shares above a cut that at least `least` positives pass."""
    cuts = np.sort(positive)[::-1][min(least, len(positive)) - 1:]
    p = np.searchsorted(np.sort(positive), cuts, "left")
    u = np.searchsorted(np.sort(unlabelled), cuts, "left")
    ratio = (1 - u / len(unlabelled)) / np.maximum(1 - p / len(positive), 1e-9)
    return float(np.clip(ratio.min(), 0.02, 0.98))


def risk_parts(g_p, g_u, prior):
    """Positive part and negative part of the unbiased risk under logistic loss."""
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(g_p).mean(), loss(-g_u).mean() - prior * loss(-g_p).mean()


def minimise(x_p, x_u, prior, rounds=400, ridge=1e-4):
    """Weights (bias last) of least non-negative risk."""
    x_p, x_u = [np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1) for x in (x_p, x_u)]

    def gradient(w):
        g_p, g_u = x_p @ w, x_u @ w
        negative = _sigmoid(g_u) @ x_u / len(x_u) - prior * (_sigmoid(g_p) @ x_p) / len(x_p)
        if risk_parts(g_p, g_u, prior)[1] < 0:
            return -negative
        return prior * (-_sigmoid(-g_p) @ x_p) / len(x_p) + negative + ridge * np.append(w[:-1], 0)

    return _adam(x_p.shape[1], gradient, rounds)


class Model:
    """Linear score of standardised features."""

    def __init__(self, x_p, x_u):
        self.mean, self.scale = x_u.mean(0), np.maximum(x_u.std(0), 0.02)
        x_p, x_u = self._standard(x_p), self._standard(x_u)
        half = len(x_p) // 2, len(x_u) // 2
        first = minimise(x_p[:half[0]], x_u[:half[1]], 0.5, 150) if min(half) else None
        self.prior = class_prior(x_p[half[0]:] @ first[:-1], x_u[half[1]:] @ first[:-1]) if first is not None else 0.5
        self.weights = minimise(x_p, x_u, self.prior)

    def _standard(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def score(self, x):
        return _sigmoid(self._standard(x) @ self.weights[:-1] + self.weights[-1])


def _collect(rows, text, most):
    def run(batches):
        for batch in batches:
            for _, x in features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], ["x"])

    got = sorted(bytes(r.x) for r in rows.select(text).mapInArrow(run, "x binary").limit(2 * most).collect())
    return np.frombuffer(b"".join(got), np.float32).reshape(len(got), DIMS)[np.random.default_rng(7).permutation(len(got))]


def fit(docs, trusted, text="text", positives=POSITIVES, unlabelled=UNLABELLED):
    """Fit on about `positives` trusted rows (`trusted`: doc_id of positives) and `unlabelled` of all rows, none from the held-out fold.

    Both are samples by hashed id, so a rerun reads the same rows. Without trusted rows or texts the model is None.
    """
    trusted = trusted.select("doc_id").where("doc_id IS NOT NULL").where(~sample.held_out()).distinct()
    n = trusted.count()
    chosen = trusted.where(sample.share(min(1.0, positives / max(n, 1)))).limit(2 * positives)
    rows = docs.where(~sample.held_out()).select("doc_id", text)
    x_p = _collect(rows.join(F.broadcast(chosen), "doc_id"), text, positives)
    x_u = _collect(rows.where(sample.share(min(1.0, unlabelled / max(docs.count(), 1)))), text, unlabelled)
    return Model(x_p, x_u) if len(x_p) and len(x_u) else None


def score_quality(docs, model, text="text", threshold=THRESHOLD):
    """Add score (0 to 1) and predicted (1 from `threshold` on) to every row; empty and null texts are scored like any other.

    Without a model every score is 0.5. Columns named score or predicted are replaced; the text is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted", text)]

    def run(batches):
        model = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model is not None:
                for row, x in features(batch.column(batch.num_columns - 1)):
                    score[row:row + len(x)] = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
