"""Operator 9. Language of documents by a linear-chain conditional random field over words.

A word's emission is the sum of learned weights of its features: character n-grams of the word between boundary marks (so those at the marks
are its affixes), the word itself, and whether it is in the lexicon of a language (its frequent words in the training sample). Transitions
between the languages of neighbouring words are learned with them, from sentences that switch language. Forward-backward gives each word's
distribution; a document's language has the largest mean over its words, and that mean is the score.

Training takes about PER_LANGUAGE documents of each language (those of small hash), at most MOST_DOCUMENTS in all, and TRAIN_WORDS words of
each, drawn over its whole text, on the driver. Of rows that share an id and a language one is learned from. Prediction
covers all words of all documents, each of which is one chain; the chains of training are WINDOW words long.

Defined cases: a null text, or one without a letter, is `und` with score 0; without training documents every one is; a null doc_id is not held
out and not learned from; repeated rows get equal results; further columns are left out; an empty table gives no row.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import arrow_map, column, cut, lookup, mixed, seeded

PER_LANGUAGE, TRAIN_WORDS = 1200, 60
#: Documents to learn from at most, whatever the number of languages.
MOST_DOCUMENTS = 40_000
WINDOW = 64
#: Words in a batch of chains that are decoded together; a longer document is a batch of its own.
CELLS = 8192 * 64
SPACE_BITS = 17
LEXICON = 300
GRAMS = (2, 3, 4)
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_MUL = seeded(91, 8) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case."""
    return LETTERS.findall((text or "").lower())


def feature_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and where each word's begin. Every word has four at least."""
    padded = [f"\x02{w}\x03" for w in words]
    lengths = np.array([len(w) for w in padded], dtype=np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = (starts + lengths)[owner] - np.arange(len(codes))  # characters from here to the end of the word
    ids, owners = [], []
    shift = np.uint64(64 - SPACE_BITS)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((codes + np.uint64(1)) * mixed((np.arange(len(codes)) - starts[owner]).astype(np.uint64) + np.uint64(5)), starts)
        ids.append((mixed(whole + np.uint64(9)) >> shift).astype(np.int64))
        owners.append(np.arange(len(words)))
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            total = np.full(len(at), n, np.uint64)
            for k in range(n):
                total += codes[at + k] * _MUL[k]
            ids.append((mixed(total) >> shift).astype(np.int64))
            owners.append(owner[at])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return ids[order], np.concatenate([[0], np.cumsum(counts)[:-1]])


class Field:
    """The model: weights by feature and language, lexicons, transitions and starts."""

    def __init__(self, languages: list[str], lexicons: list[set[str]]):
        n = len(languages)
        self.languages, self.lexicons = languages, lexicons
        self.weights = np.zeros((1 << SPACE_BITS, n), np.float32)
        self.lexicon = np.zeros((n, n), np.float32)
        self.transitions, self.starts = np.zeros((n, n)), np.zeros(n)

    def flags(self, words: list[str]) -> np.ndarray:
        return np.array([[w in s for s in self.lexicons] for w in words], dtype=np.float32).reshape(len(words), len(self.lexicons))

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty((0, len(self.languages)))
        ids, starts = feature_ids(words)
        return np.add.reduceat(self.weights[ids], starts, axis=0).astype(float) + self.flags(words) @ self.lexicon

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distributions of each word of chains (time x chains x languages), and expected transitions; lengths: words of each chain."""
        steps, chains, n = scores.shape
        psi = np.exp(scores - scores.max(axis=2, keepdims=True))
        move = np.exp(self.transitions - self.transitions.max())
        live = np.arange(steps)[:, None] < lengths[None, :]
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        now = psi[0] * np.exp(self.starts - self.starts.max())
        alpha[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            now = (alpha[t - 1] @ move) * psi[t]
            alpha[t] = now / now.sum(axis=1, keepdims=True)
        pairs = np.zeros((n, n))
        for t in range(steps - 2, -1, -1):
            ahead = psi[t + 1] * beta[t + 1]
            now = ahead @ move.T
            now /= now.sum(axis=1, keepdims=True)
            beta[t] = np.where(live[t + 1][:, None], now, 1.0)
            both = alpha[t][live[t + 1]][:, :, None] * move[None] * ahead[live[t + 1]][:, None, :]
            if len(both):
                pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        out = alpha * beta
        return out / out.sum(axis=2, keepdims=True), pairs


def fit(samples: list[tuple[str, list[str]]], epochs: int = 4, rate: float = 0.25, seed: int = 7) -> Field | None:
    """A field for (language, words) samples, from chains of WINDOW words that switch language every few words."""
    samples = [(lang, words) for lang, words in samples if words]
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    index = {lang: k for k, lang in enumerate(languages)}
    counts: list[dict[str, int]] = [{} for _ in languages]
    for lang, words in samples:
        c = counts[index[lang]]
        for w in words:
            c[w] = c.get(w, 0) + 1
    model = Field(languages, [set(sorted(c, key=lambda w: (-c[w], w))[:LEXICON]) for c in counts])
    rng = random.Random(seed)
    n = len(languages)
    seen_w, seen_x, seen_t, seen_s = np.full_like(model.weights, 1e-4), np.full_like(model.lexicon, 1e-4), np.full((n, n), 1e-4), np.full(n, 1e-4)
    for _ in range(epochs):
        pieces = []
        for lang, words in samples:
            at = 0
            while at < len(words):
                step = rng.randint(4, 40)
                pieces.append((index[lang], words[at : at + step]))
                at += step
        rng.shuffle(pieces)
        stream = [(k, w) for k, words in pieces for w in words]
        for at in range(0, len(stream), 128 * WINDOW):
            some = stream[at : at + 128 * WINDOW]
            chains = -(-len(some) // WINDOW)
            lengths = np.array([min(WINDOW, len(some) - c * WINDOW) for c in range(chains)])
            words = [w for _, w in some]
            ids, starts = feature_ids(words)
            flags = model.flags(words)
            flat = np.add.reduceat(model.weights[ids], starts, axis=0) + flags @ model.lexicon
            scores = np.zeros((chains * WINDOW, n))
            scores[: len(some)] = flat
            scores = scores.reshape(chains, WINDOW, n).transpose(1, 0, 2)
            gold = np.array([k for k, _ in some])
            post, pairs = model.posteriors(scores, lengths)
            error = post.transpose(1, 0, 2).reshape(-1, n)[: len(some)].copy()
            error[np.arange(len(some)), gold] -= 1
            inside = np.arange(1, len(some)) % WINDOW != 0
            np.subtract.at(pairs, (gold[:-1][inside], gold[1:][inside]), 1)
            scale = 1 / len(some)
            reps = np.diff(np.concatenate([starts, [len(ids)]]))
            owner = np.repeat(np.arange(len(some)), reps)
            g_w = np.stack([np.bincount(ids, weights=error[owner, k], minlength=1 << SPACE_BITS) for k in range(n)], axis=1) * scale
            g_x = flags.T @ error * scale
            first = error[np.arange(chains) * WINDOW].sum(axis=0) * scale
            for value, g, seen in ((model.weights, g_w, seen_w), (model.lexicon, g_x, seen_x), (model.transitions, pairs * scale, seen_t), (model.starts, first, seen_s)):
                seen += g * g
                value -= (rate * g / np.sqrt(seen)).astype(value.dtype)
    return model


def learned_part(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4


def drawn_words(words: list[str]) -> list[str]:
    """TRAIN_WORDS words of a text, in order, from anywhere in it: those of least hash of their place."""
    if len(words) <= TRAIN_WORDS:
        return words
    order = mixed(np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(words)))
    return [words[k] for k in np.sort(np.argsort(order, kind="stable")[:TRAIN_WORDS])]


def train(docs: DataFrame) -> Field | None:
    from_ = docs.where(F.col("lang").isNotNull() & (learned_part(F.col("doc_id")) != 2)).select("doc_id", "lang", "text")
    share = from_.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("l"), (F.lit(float(PER_LANGUAGE)) / F.col("n")).alias("share"))
    share = cut(share)
    some = from_.join(lookup(share, share.count()), F.col("lang") == F.col("l"))
    some = some.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") * 2.0**-53 < F.col("share"))

    def f(part: pa.RecordBatch) -> dict:
        out = []
        for text in column(part, "text"):
            out.append(drawn_words(words_of(text)))
        return {"words": out}

    drawn = arrow_map(some.select("doc_id", "lang", "text"), f, "doc_id long, lang string, words array<string>", ["doc_id", "lang"])
    rows = drawn.groupBy("doc_id", "lang").agg(F.min("words").alias("words")).orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(MOST_DOCUMENTS).collect()
    return fit([(r["lang"], r["words"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["words"]))])


def label(model: Field, documents: list[list[str]]) -> list[np.ndarray]:
    """The distribution of each word of each document: words x languages."""
    index: dict[str, int] = {}
    flat = [index.setdefault(w, len(index)) for words in documents for w in words]
    if not flat:
        return [np.empty((0, len(model.languages))) for _ in documents]
    table = model.emissions(list(index))
    n = len(model.languages)
    counts = [len(words) for words in documents]
    scores = table[np.array(flat)]
    out = np.empty_like(scores)
    lengths = np.array(counts)
    at = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    k = 0
    while k < len(order):
        # whole documents of similar lengths, longest first
        steps = int(lengths[order[k]])
        held = min(max(1, CELLS // steps), int((2 * lengths[order[k:]] >= steps).sum()))
        some, begin = lengths[order[k : k + held]], at[order[k : k + held]]
        where = begin[None, :] + np.minimum(np.arange(steps)[:, None], some[None, :] - 1)
        post, _ = model.posteriors(scores[where], some)
        live = np.arange(steps)[:, None] < some[None, :]
        out[where[live]] = post[live]
        k += held
    return np.split(out, np.cumsum(counts)[:-1]) if n else []


def predict(docs: DataFrame, model: Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""

    def f(part: pa.RecordBatch) -> dict:
        documents = [words_of(t) for t in column(part, "text")]
        if model is None:
            return {"lang_pred": [UNKNOWN] * len(documents), "score": [0.0] * len(documents)}
        best, scores = [], []
        for words, post in zip(documents, label(model, documents), strict=True):
            # runs may consist of marks or number signs alone
            if any(c.isalpha() for w in words for c in w):
                mean = post.mean(axis=0)
                k = int(mean.argmax())
                best.append(model.languages[k])
                scores.append(float(min(1.0, mean[k])))
            else:
                best.append(UNKNOWN)
                scores.append(0.0)
        return {"lang_pred": best, "score": scores}

    out = arrow_map(docs.select("doc_id", "text"), f, "doc_id long, lang_pred string, score double", ["doc_id"])
    return out.select("doc_id", F.coalesce(learned_part(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def languages_of(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
