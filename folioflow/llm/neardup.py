"""Operator 10. Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set holds its distinct five-word shingles. Its signature is 50 minima, of 16 bits each, in 10 chunks of 5. Two signatures that
differ in at most 19 places have, by the pigeonhole principle, a chunk with at most one error, so the keys that leave out one place of a
chunk meet for every such pair. A pair of similarity 0.85 differs in more than 19 places with a probability of about 2e-5. Candidates are
confirmed on the whole sets. Sets that are equal count as one from the start, so exact copies cost nothing.

Defined cases: a null or empty text, or one of white space, has an empty set, is linked with nothing and kept; fewer than five words make one
shingle; rows with a null doc_id take part, and a component of such rows only has a null id; repeated rows fall in one component; further
columns, whatever their names, stay as they are; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import RANDOM_KEYS, arrow_map, column, cut, forget, fresh, lookup, mixed, of_groups, seeded, shingle_codes, words_of
from folioflow.llm.components import linked_components

WIDTH, CHUNK, CHUNKS = 5, 5, 10
#: For pairs under 0.85 the chunks are shorter, so that the same share of errors is far above what such a pair has.
CHUNK_LOW, CHUNKS_LOW = 4, 12

_A = seeded(21, 256) | np.uint64(1)
_B = seeded(22, 256)


def minima(codes: np.ndarray, hashes: int) -> np.ndarray:
    """The minimum under each hash, as 16 well-mixed bits."""
    best = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(codes), 4096):
            part = codes[k : k + 4096]
            np.minimum(best, ((part[None, :] * _A[:hashes, None] + _B[:hashes, None]) >> np.uint64(20)).min(axis=1), out=best)
    return (mixed(best) & np.uint64(0xFFFF)).astype(np.uint64)


def chunk_keys(signature: np.ndarray, chunk: int) -> np.ndarray:
    """For each chunk and each place in it, a hash of the chunk without that place."""
    m = len(signature) // chunk
    with np.errstate(over="ignore"):
        terms = mixed(signature + (np.arange(m * chunk, dtype=np.uint64) << np.uint64(20))).reshape(m, chunk)
        left_out = terms.sum(axis=1, keepdims=True, dtype=np.uint64) - terms
        return mixed(left_out + np.arange(1, m * chunk + 1, dtype=np.uint64).reshape(m, chunk) * np.uint64(0x9E3779B97F4A7C15)).ravel().astype(np.int64)


def bits_of(values: np.ndarray) -> np.ndarray:
    """One bit of each of up to 128 minima, in two signed longs."""
    bits = np.zeros(128, np.uint8)
    bits[: len(values)] = mixed(values + (np.arange(len(values), dtype=np.uint64) << np.uint64(32))) & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def shape_of(similarity: tuple[int, int]) -> tuple[int, int]:
    """Places in a chunk, and chunks."""
    return (CHUNK, CHUNKS) if similarity[0] * 100 >= 85 * similarity[1] else (CHUNK_LOW, CHUNKS_LOW)


def features(docs: DataFrame, similarity: tuple[int, int], width: int = WIDTH) -> DataFrame:
    """doc_id, th (hash of the text), n, set_key (digest of the set, null if empty) and keys for each row; cut."""
    chunk, chunks = shape_of(similarity)

    def f(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n", "set_key", "keys", "b0", "b1")}
        for text in column(part, "text"):
            codes = shingle_codes(words_of(text), width)
            if len(codes):
                values = minima(codes, chunk * chunks)
                row = (len(codes), xxhash.xxh3_128_digest(codes.tobytes()), chunk_keys(values, chunk), *bits_of(values).tolist())
            else:
                row = (0, None, None, None, None)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return cut(arrow_map(rows, f, "doc_id long, th long, n long, set_key binary, keys array<long>, b0 long, b1 long", ["doc_id", "th"]), **RANDOM_KEYS)


def _fetcher(docs: DataFrame, where: DataFrame):
    """Texts of some nodes, from one document each."""

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = cut(nodes.join(where, "node").select("node", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")))
        n = wanted.count()
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
        found = cut(rows.join(lookup(wanted, n), (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "text"))
        forget(wanted)
        # a row that is repeated in full stands for its node several times
        return found if found.count() == n else found.dropDuplicates(["node"])

    return fetch


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (85, 100), width: int = WIDTH) -> DataFrame:
    """One row for each row of docs: doc_id, th, n_shingles, component_id, kept, and root: what rows of a component share, null for empty sets."""
    feats = features(docs, similarity, width)
    classes = feats.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("keys").alias("keys"), F.first("b0").alias("b0"), F.first("b1").alias("b1"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    where = classes.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th"))
    roots = linked_components(classes.select("node", "keys", "b0", "b1"), _fetcher(docs, where), similarity, math.prod(shape_of(similarity)), lambda text: shingle_codes(words_of(text), width))
    linked = cut(classes.select("node", "least").join(roots, "node"))
    ids = linked.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("component_id"))
    named = cut(of_groups(linked.select("node", "root"), "root", ids).select(F.col("node").alias("of"), "root", "component_id"))
    # a class without links is a component of its own; null ids come last
    every = classes.select("set_key", "node", "least").join(named, F.col("node") == F.col("of"), "left")
    every = every.select(F.col("set_key").alias("c_key"), F.coalesce("root", "node").alias("root"), F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = feats.join(every, F.col("set_key") == F.col("c_key"), "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "root")


def near_duplicate_rows(docs: DataFrame, similarity: tuple[int, int] = (85, 100)) -> DataFrame:
    return near_duplicates(docs, similarity).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one document of each component, the one of least (doc_id, hash of the text). Every row whose text has no word stays, as often
    as it is there. Of rows equal in doc_id and text but not in further columns, the one of the least hash of all columns stays.
    """
    found = cut(near_duplicates(docs, similarity).where("root is not null").groupBy("root", "doc_id", "th", "kept").agg(F.count(F.lit(1)).alias("n")))
    stay = found.where("kept").groupBy("root").agg(F.min(F.struct("doc_id", "th", "n")).alias("s")).select("root", "s.*")
    go = found.join(stay.select(F.col("root").alias("s_root"), F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")), (F.col("root") == F.col("s_root")) & (F.col("th") == F.col("s_th")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left_anti")
    go, again = cut(go.select("doc_id", "th")), cut(stay.where("n > 1").select("doc_id", "th"))
    key, c_id, c_key, row, least = fresh(docs.columns, "key", "c_id", "c_key", "row", "least")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    at = lambda df: lookup(df.toDF(c_id, c_key), df.count())
    same = (F.col(key) == F.col(c_key)) & F.col("doc_id").eqNullSafe(F.col(c_id))
    out = keyed.join(at(go), same, "left_anti")
    if again.isEmpty():
        return out.select(*docs.columns)
    once = out.join(at(again), same, "left_anti").select(*docs.columns)
    hashed = F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    several = out.join(at(again), same, "left_semi").select("doc_id", key, F.struct(*docs.columns).alias(row), hashed.alias(least))
    return once.unionByName(several.groupBy("doc_id", key).agg(F.min_by(row, least).alias(row)).select(f"{row}.*"))
