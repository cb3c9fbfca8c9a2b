"""Operator 7. Toxicity by cumulative-link ordinal regression over sparse words.

P(grade > k) = sigmoid(w x - theta_k): one weight for each word, shared by all thresholds, and ordered thresholds. The score of a document is
its expected grade. It is fitted on the driver on at most TRAIN_ROWS labelled documents, those of least hash of doc_id; only words that set
labelled groups apart beyond chance get a weight, so long clean texts don't add up noise, and of them at most MOST_WORDS, the clearest. Every document is then scored over its whole text.

A label above 1 is a grade. Labels of 0 and 1 say no more than toxic or not; then a toxic document's grade is 1, 2 or 3 with one, two to
three, or more different indicative words.

Defined cases: a null or empty text has no words, and the score that follows from the thresholds; null labels are left out; without labels of
two grades every score is 0 and nothing is rejected; repeated rows get equal scores, and of rows that share a labelled id one is learned from; further columns stay; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import CACHED, arrow_map, column, slices

TRAIN_ROWS = 8000
SPACE = 1 << 18
MOST_WORDS = 2000
LETTERS = re.compile(r"[^\W\d_]+")

_IDS: dict[str, int] = {}


def word_ids(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of the words (runs of letters, lower case) of a text."""
    ids = _IDS
    if len(ids) > CACHED:
        ids.clear()
    out = set()
    for w in set(LETTERS.findall((text or "").lower())):
        i = ids.get(w)
        if i is None:
            i = ids[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % SPACE
        out.add(i)
    return np.array(sorted(out), dtype=np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, features, schema: str) -> pa.Table:
    """y and features of at most so many labelled documents, on the driver. features: a function of texts, run where the texts are. Of rows
    that share an id, the least features stand for all."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("l_id"), "y")
    # at most `rows` pairs of numbers are broadcast
    some = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    found = arrow_map(some.select("doc_id", "text", F.col("y").cast("int").alias("y")), features, f"doc_id long, y int, {schema}", ["doc_id", "y"])
    return found.groupBy("doc_id", "y").agg(F.min(F.struct(*found.columns[2:])).alias("least")).select("y", "least.*").toArrow()


def arrays_of(got: pa.Table, name: str) -> list[np.ndarray]:
    """The arrays of a list column, without a Python object for each element."""
    lists = got.column(name).combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


class Ordinal:
    """Weights of the chosen words and ordered thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, cut: float):
        self.words, self.weights, self.thresholds, self.cut = words, weights, thresholds, cut

    def grades(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, by document."""
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of P(y <= k) = sigmoid(theta_k - w x) by Adagrad; thresholds are kept in order by positive gaps."""
    top = int(y.max())
    w, first, gaps = np.zeros(x.shape[1]), 0.0, np.zeros(top - 1)
    seen = [np.full(x.shape[1], 1e-6), np.full(1, 1e-6), np.full(top - 1, 1e-6)]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(steps):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        upper = np.concatenate([theta, [np.inf]])[y]
        lower = np.concatenate([[-np.inf], theta])[y]
        s = x @ w
        f_up, f_lo = sig(upper - s), np.where(np.isinf(lower), 0.0, sig(lower - s))
        f_up = np.where(np.isinf(upper), 1.0, f_up)
        p = np.maximum(f_up - f_lo, 1e-12)
        d_up, d_lo = f_up * (1 - f_up) / p, f_lo * (1 - f_lo) / p
        g_w = x.T @ (d_up - d_lo) / len(y) + ridge * w
        g_theta = np.array([-(d_up[y == k].sum()) + d_lo[y == k + 1].sum() for k in range(top)]) / len(y)
        g_first = np.array([g_theta.sum()])
        g_gaps = np.array([g_theta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)])
        for g, h in zip((g_w, g_first, g_gaps), seen, strict=True):
            h += g * g
        w -= rate * g_w / np.sqrt(seen[0])
        first -= float(rate * g_first[0] / np.sqrt(seen[1][0]))
        gaps -= rate * g_gaps / np.sqrt(seen[2])
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def telling(sets: list[np.ndarray], y: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Words whose share among positive documents is above that among the others by so many standard errors, the clearest first."""
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y == 0).sum()))
    c1, c0 = np.zeros(SPACE), np.zeros(SPACE)
    for s, k in zip(sets, y, strict=True):
        (c1 if k > 0 else c0)[s] += 1
    p = (c1 + c0) / (n1 + n0)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((z >= least) & (c1 >= 5) & (c1 / n1 >= 2 * c0 / n0))
    return good[np.argsort(-z[good], kind="stable")][:MOST_WORDS]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Ordinal:
    none = Ordinal(np.empty(0, np.int64), np.empty(0), np.full(1, 40.0), float("inf"))
    got = labelled_sample(docs, labels, label, rows, lambda part: {"ids": [word_ids(t) for t in column(part, "text")]}, "ids array<int>")
    y = got.column("y").to_numpy().astype(int)
    sets = arrays_of(got, "ids")
    # rows come in no fixed order, and sums of floats depend on it
    order = sorted(range(len(y)), key=lambda k: (y[k], sets[k].tobytes()))
    y, sets = y[order], [sets[k] for k in order]
    if not len(y) or len(set(y)) < 2 or y.min() < 0:
        return none
    words = np.sort(telling(sets, y))
    if not len(words):
        return none
    x = np.stack([np.isin(words, s) for s in sets]).astype(float)
    binary = y > 0
    if y.max() == 1:
        hits = x.sum(axis=1)
        y = np.where(binary, 1 + (hits >= 2) + (hits >= 4), 0)
        for k in (1, 2):  # grades that no document has are closed up
            while (y > k).any() and not (y == k).any():
                y[y > k] -= 1
    w, theta = fit_ordinal(x, y)
    model = Ordinal(words, w, theta, float("inf"))
    score = model.grades(x @ w).sum(axis=1)
    # the cut with the best F0.5 on the sample (a clean document lost counts more than a toxic one kept), halfway between neighbouring scores
    values = np.unique(score)
    cuts = (values[1:] + values[:-1]) / 2
    if len(cuts):
        f = [1.25 * ((score >= c) & binary).sum() / ((score >= c).sum() + 0.25 * binary.sum()) for c in cuts]
        model.cut = float(cuts[int(np.argmax(f))])
    return model


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest) and rejected for each row of docs."""
    weights = np.zeros(SPACE)
    weights[model.words] = model.weights
    small = model.words, model.weights, model.thresholds

    def f(part: pa.RecordBatch) -> dict:
        table = np.zeros(SPACE)
        table[small[0]] = small[1]
        sums = np.array([table[word_ids(t)].sum() for t in column(part, "text")])
        above = Ordinal(*small, 0).grades(sums)
        at_least = np.concatenate([np.ones((len(sums), 1)), above, np.zeros((len(sums), 1))], axis=1)
        severity = above.sum(axis=1)
        return {"severity": severity, "grade": np.argmax(at_least[:, :-1] - at_least[:, 1:], axis=1).astype(np.int32), "rejected": severity >= limit}

    limit = model.cut
    return arrow_map(docs.select("doc_id", "text"), f, "doc_id long, severity double, grade int, rejected boolean", ["doc_id"])


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are rejected."""
    model = train(docs, labels)
    table, limit = (model.words, model.weights, model.thresholds), model.cut
    names = docs.columns
    schema, order = T.StructType([*docs.schema.fields]), docs.columns

    def run(batches):
        weights = np.zeros(SPACE)
        weights[table[0]] = table[1]
        for batch in batches:
            for part in slices(batch.select(["text", *[c for c in batch.schema.names if c != "text"]])):
                sums = np.array([weights[word_ids(t)].sum() for t in column(part, "text")])
                keep = ~(Ordinal(*table, 0).grades(sums).sum(axis=1) >= limit)
                yield part.select(order).filter(pa.array(keep))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema).select(*names)
