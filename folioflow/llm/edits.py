"""Operator 3. Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at output place j, standing on character c, it writes c and moves on if the random bit r(j, c) is 1. The
walk of an edited text falls back in step with that of the original soon after each edit, so few edits make few differing places. The
fingerprint samples 256 output places and keeps 4 bits of a hash of the character there. The places come from record times, so texts of
unlike lengths sample the same places as often as their lengths allow; the share of equal samples, less chance, estimates the likeness of the
two embeddings. `classes` bands sampled bits of fingerprints for candidates and confirms them on the whole fingerprints: documents that reach each
other by links of a likeness of at least ALIKE are a class. A pair at that likeness shares a band with probability 0.999. The walk's random bits
repeat after PERIOD output places, which bounds their table; two texts meet the same bits in any case, as both walks read the same table.

Defined cases: a null text counts as empty; an empty text has the fingerprint of 256 zeros, and likeness 1 to another empty one; documents
follow each other by falling doc_id, null ones last, and of equal ids by the hash of their text; after the last one comes the first; one document alone
follows itself; repeated rows follow each other; further columns are left out; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from folioflow.llm.common import arrow_map, column, cut, forget, lookup, mixed, of_groups, seeded, slices
from folioflow.llm.components import linked_components

SLOTS = 256
CLASSES, PERIOD = 256, 4096
#: With fewer texts left the walks go on one by one.
FEW = 48
#: Bits of a band's key, and bands.
BAND, BANDS = 32, 32
#: Least likeness of a link.
ALIKE = 0.9


def _stays() -> np.ndarray:
    """How many places the walk writes for a character of each class that it meets at each place (modulo PERIOD)."""
    bits = (mixed(seeded(31, CLASSES * PERIOD)) & np.uint64(1)).astype(np.uint8).reshape(CLASSES, PERIOD)
    bits[:, -1] = 1
    out = np.empty((CLASSES, PERIOD), np.uint8)
    run = np.zeros(CLASSES, np.int64)
    for j in range(PERIOD - 1, -1, -1):
        run = np.where(bits[:, j] == 1, 1, run + 1)
        out[:, j] = np.minimum(run, 255)
    return out


STAYS = _stays()
_FLAT = STAYS.ravel()
_LISTS = [bytes(row) for row in STAYS]


def _records() -> list[np.ndarray]:
    """For each slot the places at which a random sequence has a new least value: after place r the next is over x with probability r / x."""
    u = (mixed(seeded(32, SLOTS * 96)) >> np.uint64(11)).astype(float).reshape(SLOTS, 96) * 2.0**-53 + 2.0**-54
    out = []
    for k in range(SLOTS):
        places, r = [1], 1
        for x in u[k]:
            r = int(r / x) + 1
            if r > 1 << 45:
                break
            places.append(r)
        out.append(np.array(places))
    return out


_RECORDS = _records()
_DEPTH = max(map(len, _RECORDS))
_PLACES = np.array([[*r, *[1 << 60] * (_DEPTH - len(r))] for r in _RECORDS])
_NIBBLES = (mixed(seeded(33, SLOTS * CLASSES)) & np.uint64(15)).astype(np.uint8).reshape(SLOTS, CLASSES)
_SLOT = np.arange(SLOTS)


def classes_of(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return (mixed(points + np.uint64(77)) & np.uint64(CLASSES - 1)).astype(np.uint8)


def walks(texts: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """For each text, of classes, the place at which the walk first writes each character, and where it ends. All walks take a step at a time."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    places = [np.empty(n + 1, np.int64) for n in lengths]
    if not len(texts):
        return places
    longest = int(lengths.max())
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # texts longer than t
    together = int(np.searchsorted(-active, -FEW, side="right")) if longest else 0
    j = np.array(starts, dtype=np.int64)[order]
    if together:
        at = np.concatenate([[0], np.cumsum(active[:together])])
        grid, written = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        for rank, k in enumerate(order[: active[0]]):
            n = min(int(lengths[k]), together)
            grid[at[:n] + rank] = texts[k][:n]
        grid *= PERIOD
        for t in range(together):
            a, b = at[t], at[t + 1]
            now = j[: b - a]
            written[a:b] = now
            now += _FLAT[grid[a:b] + (now & (PERIOD - 1))]
        for rank, k in enumerate(order[: active[0]]):
            n = min(int(lengths[k]), together)
            places[k][:n] = written[at[:n] + rank]
    for rank, k in enumerate(order):
        here, n = int(j[rank]), int(lengths[k])
        if n > together:
            rows, mask, out = _LISTS, PERIOD - 1, []
            for c in texts[k][together:].tobytes():
                out.append(here)
                here += rows[c][here & mask]
            places[k][together:n] = out
        places[k][n] = here
    return places


def fingerprint(classes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The samples of an embedding: SLOTS numbers under 16."""
    total = int(places[-1])
    if not total:
        return np.zeros(SLOTS, np.uint8)
    chosen = _PLACES[_SLOT, (_PLACES <= total).sum(axis=1) - 1] - 1
    return _NIBBLES[_SLOT, classes[np.searchsorted(places[:-1], chosen, side="right") - 1]]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples, corrected for those equal by chance."""
    return max(0.0, (float((a == b).mean()) - 1 / 16) * 16 / 15)


def as_text(samples: np.ndarray) -> str:
    return ((samples[0::2] << 4) | samples[1::2]).astype(np.uint8).tobytes().hex()


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    classes = [classes_of(t) for t in texts]
    return [fingerprint(c, p) for c, p in zip(classes, walks(classes, [0] * len(texts)), strict=True)]


def _in_order(docs: DataFrame) -> DataFrame:
    """The rows dealt out in ranges of falling doc_id and sorted, each range with the first row of the next one at its end (column peek)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = rows.select(F.col("doc_id").cast("double").alias("d")).where("d is not null")
    bounds = sorted(set(ids.approxQuantile("d", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    dealt = rows.withColumn("__d", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))).withColumn("__b", F.lit(0.0))
    if bounds:
        ranges = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="__d", outputCol="__b")
        dealt = ranges.transform(dealt.drop("__b"))
    # ranges are numbered by falling id; the rows with null ids have the last n, by hash
    part = F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * n / (1 << 32)).cast("int")
    dealt = dealt.withColumn("range", F.when(F.col("doc_id").isNull(), len(bounds) + 1 + part).otherwise(F.lit(len(bounds)) - F.col("__b").cast("int")))
    dealt = dealt.select("doc_id", "text", "h", "range")
    first = dealt.groupBy("range").agg(F.max("doc_id").alias("head")).join(dealt.groupBy("range", "doc_id").agg(F.min("h").alias("head_h")).withColumnRenamed("range", "of"), (F.col("range") == F.col("of")) & F.col("head").eqNullSafe(F.col("doc_id")))
    # a row of numbers for each range, as many as there are partitions, or twice that
    heads = sorted((r["range"], r["head"], r["head_h"]) for r in first.select("range", "head", "head_h").collect())
    before = [(r, heads[k - 1][0], head, h) for k, (r, head, h) in enumerate(heads)]
    table = docs.sparkSession.createDataFrame(before, "h_range int, previous int, head long, head_h long")
    rows = dealt.join(F.broadcast(table), F.col("range") == F.col("h_range"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h"))
    here = F.struct(F.col("range").alias("to"), F.lit(False).alias("peek"))
    there = F.struct(F.col("previous").alias("to"), F.lit(True).alias("peek"))
    rows = rows.withColumn("go", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here)))).select("doc_id", "text", "h", "go.to", "go.peek")
    return rows.repartitionById(len(bounds) + 1 + n, F.col("to")).sortWithinPartitions("peek", F.col("doc_id").desc_nulls_last(), "h").drop("h")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last half is replaced by the start of the next document."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                yield list(zip(column(part, "doc_id"), column(part, "text"), column(part, "peek"), strict=True))

    def run(batches):
        held: list = []
        for some in rows(batches):
            held += some
            if len(held) > 1:
                out, held = held, held[-1:]
                yield from _pairs(out, target)

    target = to_arrow_schema(_parse_datatype_string(_SCHEMA))
    return _in_order(docs).mapInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(held: list, schema: pa.Schema):
    """A batch of results for all rows but the last, each with the row after it."""
    first_peek = next((k for k, r in enumerate(held) if r[2]), len(held))
    held = held[: first_peek + 1]
    if len(held) < 2:
        return
    texts = [r[1] for r in held]
    classes = [classes_of(t) for t in texts]
    places = walks(classes, [0] * len(texts))
    own = [fingerprint(c, p) for c, p in zip(classes, places, strict=True)]
    kept, tails, froms, edited = [], [], [], []
    for k in range(len(held) - 1):
        half = len(classes[k]) // 2
        stay = len(classes[k]) - half
        kept.append(stay)
        tails.append(classes[k + 1][:half])
        froms.append(int(places[k][stay]))
        edited.append(texts[k][:stay] + texts[k + 1][:half])
    ends = walks(tails, froms)
    out = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    for k in range(len(held) - 1):
        stay = kept[k]
        print_ = fingerprint(np.concatenate([classes[k][:stay], tails[k]]), np.concatenate([places[k][:stay], ends[k]]))
        for name, v in zip(out, (held[k][0], len(classes[k]), hashlib.sha256(edited[k].encode("utf-8", "surrogatepass")).hexdigest(), as_text(own[k]), as_text(print_), likeness(own[k], print_), likeness(own[k], own[k + 1])), strict=True):
            out[name].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in schema], schema=schema)


_BITS = (mixed(seeded(34, BAND * BANDS)) % np.uint64(4 * SLOTS)).astype(int).reshape(BANDS, BAND)
_WEIGHTS = seeded(35, BAND)


def _bits_of(prints: list[str]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bytes.fromhex("".join(prints)), np.uint8)).reshape(len(prints), 4 * SLOTS)


def band_keys(prints: list[str]) -> np.ndarray:
    """For each fingerprint and band a hash of the sampled bits."""
    sampled = _bits_of(prints)[:, _BITS].astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed((sampled * _WEIGHTS).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _codes(text: str) -> np.ndarray:
    """A fingerprint as a set: a code of each place and what stands there, in order."""
    pairs = np.frombuffer(bytes.fromhex(text), np.uint8)
    return _SLOT.astype(np.uint64) * np.uint64(16) + np.stack([pairs >> 4, pairs & 15], axis=1).ravel().astype(np.uint64)


def classes(rows: DataFrame, alike: float = ALIKE) -> DataFrame:
    """rows (doc_id, fingerprint and more) with class_id, the least doc_id that links lead to: null if all have null ids."""
    distinct = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))

    def keys(part: pa.RecordBatch) -> dict:
        prints = column(part, "fingerprint")
        some = np.packbits(_bits_of(prints)[:, :: SLOTS // 32], axis=1).view(np.int64).reshape(-1, 2)
        return {"keys": list(band_keys(prints)), "b0": some[:, 0], "b1": some[:, 1]}

    # 128 of the bits, one of every other sample: as many differ between two fingerprints as of single bits of minima
    nodes = cut(arrow_map(distinct.select("node", "fingerprint"), keys, "node long, keys array<long>, b0 long, b1 long", ["node"]))
    least = round((alike * 15 / 16 + 1 / 16) * SLOTS)
    fetch = lambda some: cut(distinct.join(some, "node").select("node", F.col("fingerprint").alias("text")))
    roots = linked_components(nodes, fetch, (least, 2 * SLOTS - least), 128, _codes)
    forget(nodes)
    linked = cut(distinct.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("fingerprint", "least", "root"))
    ids = linked.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("class_id"))
    named = of_groups(linked.select("fingerprint", "root"), "root", ids).select("fingerprint", "class_id")
    # a fingerprint that one row has and that has no link needs no look-up: its class is the row's own id
    alone = distinct.where("copies > 1").join(linked.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "least")
    named = cut(named.union(alone).select(F.col("fingerprint").alias("p"), "class_id"))
    n = named.count()
    joined = rows.join(lookup(named, n, n * SLOTS // 16), F.col("fingerprint") == F.col("p"), "left")  # SLOTS hex digits each
    return joined.select(*rows.columns, F.when(F.col("p").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def fingerprint_classes(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """The rows of fingerprint_documents, with class_id."""
    return classes(cut(fingerprint_documents(docs)), alike)
