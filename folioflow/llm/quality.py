"""Operator 5. Quality by co-training of two views.

One classifier sees the content of a text: its words and the shapes of its words. The other sees metadata: source, language, and measures of
length and layout. Both are logistic regressions. They start from labelled documents; in each round each one labels the pool documents that it
is surest of for the other. Each view is then calibrated (Platt) on labelled documents kept aside, a regression on both calibrated views
combines them, and every document is scored over its whole text.

Bounds, as parameters: LABELLED documents with labels and POOL without enter the fit, those of least hash of doc_id.

Defined cases: a null label is none; without labels of both kinds the score is the share of good ones (0.5 without any) for all; a null or
empty text has no words and is scored by its metadata; null source or lang is a value; repeated rows get equal scores; further columns are left
out; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import CACHED, arrow_map, column
from folioflow.llm.toxicity import arrays_of

LABELLED, POOL, ROUNDS, TEACH = 4000, 4000, 5, 0.05
WORDS, SHAPES, META = 1 << 14, 1 << 12, 1 << 10
_WORDS: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    """Capitals X, other letters x, digits 0, the rest as it is; runs count once. All characters of the word are read."""
    out = [""]
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1] != k:
            out.append(k)
    return "".join(out)


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: square roots of the shares of its words and shapes, over a common norm."""
    cache = _WORDS
    if len(cache) > CACHED:
        cache.clear()
    total: dict[int, int] = {}
    for w, n in Counter((text or "").split()).items():
        pair = cache.get(w)
        if pair is None:
            pair = cache[w] = (zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS, WORDS + zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) % SHAPES)
        for i in pair:
            total[i] = total.get(i, 0) + n
    ids = np.fromiter(total, np.int64, len(total))
    values = np.sqrt(np.fromiter(total.values(), float, len(total)))
    is_shape = ids >= WORDS
    for part in (is_shape, ~is_shape):  # each kind has norm 1
        norm = np.sqrt((values[part] ** 2).sum())
        if norm:
            values[part] /= norm
    return ids, values


def metadata(source: str | None, lang: str | None, n_chars: int | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One feature for each field's value or step: source, language, length, lines, and mean line and word length."""
    t = text or ""
    lines = t.count("\n") + 1
    words = t.count(" ") + lines
    steps = {"n": n_chars or 0, "lines": lines, "line": len(t) // lines, "word": 4 * len(t) // max(1, words), "bars": 64 * t.count("|") // max(1, words)}
    fields = [f"source={source}", f"lang={lang}"] + [f"{k}={int(v).bit_length()}" for k, v in steps.items()]
    ids = np.array(sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % META for x in fields}), dtype=np.int64)
    return ids, np.ones(len(ids))


class Sparse:
    """Rows of sparse features, for sums and gradients."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        self.size, self.n = size, len(rows)
        self.ids = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int64)
        self.values = np.concatenate([r[1] for r in rows]) if rows else np.empty(0)
        self.owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.ids] * self.values, minlength=self.n)

    def grad(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, weights=error[self.owner] * self.values, minlength=self.size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, steps: int = 80, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, at the end, the constant, by Adagrad; rows of weight 0 are left out."""
    w, seen = np.zeros(x.size + 1), np.full(x.size + 1, 1e-8)
    total = weight.sum()
    for _ in range(steps):
        error = (_sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight / total
        g = np.concatenate([x.grad(error) + ridge * w[:-1], [error.sum()]])
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and a constant that turn sums into log odds; z: rows x sums."""
    w = np.zeros(z.shape[1] + 1)
    one = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    for _ in range(50):  # Newton steps
        p = _sigmoid(one @ w)
        h = (one * (p * (1 - p))[:, None]).T @ one + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, one.T @ (p - y) + 1e-2 * w)
    return w


class Model:
    def __init__(self, base: float):
        self.base, self.views, self.scales, self.join = base, None, None, None

    def score(self, a: Sparse, b: Sparse) -> np.ndarray:
        if self.views is None:
            return np.full(a.n, self.base)
        odds = [s[0] * (x.dot(w[:-1]) + w[-1]) + s[1] for x, w, s in zip((a, b), self.views, self.scales, strict=True)]
        return _sigmoid(np.stack([*odds, np.ones(a.n)], axis=1) @ self.join)


def co_train(labelled: list, pool: list, rounds: int = ROUNDS, teach: float = TEACH) -> Model:
    """labelled: (label, content, metadata) rows; pool: (content, metadata) rows."""
    y_all = np.array([r[0] for r in labelled], dtype=float)
    model = Model(float(y_all.mean()) if len(y_all) else 0.5)
    aside = np.arange(len(y_all)) % 4 == 3
    if len(set(y_all[~aside])) < 2 or len(set(y_all[aside])) < 2:
        return model
    rows = [[[r[1 + v] for r in labelled] + [r[v] for r in pool] for v in (0, 1)]][0]
    views = [Sparse(rows[0], WORDS + SHAPES), Sparse(rows[1], META)]
    n = len(y_all)
    start = np.concatenate([np.where(aside, 0.0, 1.0), np.zeros(len(pool))])
    ys = [np.concatenate([y_all, np.zeros(len(pool))]) for _ in views]
    weights = [start.copy() for _ in views]
    for r in range(rounds + 1):
        fits = [fit_logistic(x, y, w) for x, y, w in zip(views, ys, weights, strict=True)]
        if r == rounds or not pool:
            break
        for teacher, pupil in ((0, 1), (1, 0)):
            p = _sigmoid(views[teacher].dot(fits[teacher][:-1]) + fits[teacher][-1])[n:]
            free = weights[pupil][n:] == 0
            for value, sure, share in ((1.0, p, model.base), (0.0, 1 - p, 1 - model.base)):
                k = int(len(pool) * teach * share)
                best = np.flatnonzero(free & (sure >= 0.8))
                best = best[np.argsort(-sure[best], kind="stable")][:k]
                ys[pupil][n + best] = value
                weights[pupil][n + best] = 0.5
    z = [x.dot(w[:-1])[:n][aside] + w[-1] for x, w in zip(views, fits, strict=True)]
    y = y_all[aside]
    model.views = fits
    model.scales = [_platt(k[:, None], y) for k in z]
    model.join = _platt(np.stack([s[0] * k + s[1] for s, k in zip(model.scales, z, strict=True)], axis=1), y)
    return model


def _features(part: pa.RecordBatch) -> dict:
    texts = column(part, "text")
    a = [content(t) for t in texts]
    b = [metadata(*x) for x in zip(column(part, "source"), column(part, "lang"), column(part, "n_chars"), texts, strict=True)]
    return {"a_ids": [x[0] for x in a], "a_values": [x[1] for x in a], "b_ids": [x[0] for x in b]}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> Model:
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    first = F.xxhash64("doc_id")
    marks = marks.orderBy(first, "doc_id").limit(labelled).withColumnRenamed("doc_id", "l_id")
    free = docs.where("doc_id is not null").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
    free = free.orderBy(first, "doc_id").limit(pool).distinct().select(F.col("doc_id").alias("l_id"), F.lit(-1).alias("y"))
    # at most labelled + pool pairs of numbers are broadcast
    wanted = F.broadcast(marks.select("l_id", F.col("y").cast("int").alias("y")).union(free))
    some = docs.join(wanted, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "source", "lang", "n_chars", "y")
    schema = "doc_id long, y int, a_ids array<long>, a_values array<double>, b_ids array<long>"
    found = arrow_map(some, _features, schema, ["doc_id", "y"])
    # of rows that share an id, the least features stand for all
    got = found.groupBy("doc_id", "y").agg(F.min(F.struct("a_ids", "a_values", "b_ids")).alias("least")).select("doc_id", "y", "least.*").toArrow()
    y, ids = got.column("y").to_numpy(), got.column("doc_id").to_numpy()
    parts = [arrays_of(got, c) for c in ("a_ids", "a_values", "b_ids")]
    order = sorted(range(len(y)), key=lambda k: (zlib.crc32(str(ids[k]).encode()), ids[k], parts[0][k].tobytes()))
    views = lambda k: ((parts[0][k], parts[1][k]), (parts[2][k], np.ones(len(parts[2][k]))))
    return co_train([(float(y[k] > 0), *views(k)) for k in order if y[k] >= 0], [views(k) for k in order if y[k] < 0])


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, quality (calibrated probability) and keep for each row of docs."""

    def f(part: pa.RecordBatch) -> dict:
        texts = column(part, "text")
        a = Sparse([content(t) for t in texts], WORDS + SHAPES)
        b = Sparse([metadata(*x) for x in zip(column(part, "source"), column(part, "lang"), column(part, "n_chars"), texts, strict=True)], META)
        p = model.score(a, b)
        return {"quality": p, "keep": p >= least}

    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return arrow_map(rows, f, "doc_id long, quality double, keep boolean", ["doc_id"])


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
