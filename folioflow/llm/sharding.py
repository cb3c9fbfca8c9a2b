"""Operator 8. Sharding by weighted rendezvous hashing of stable record keys. DataFrame functions only.

Each shard s draws u(key, s) in (0, 1) from a hash; the key goes to the shard with the least -ln(u) / weight. A further shard can only
win keys for itself, so it takes rows from the others and moves none among them.

Defined cases: a null key hashes as such, so all rows with null keys share a shard; a null text has 0 bytes; rows repeated in full keep a
slot each; an empty table gives no row; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups of rows within a shard that are numbered apart; the offsets are a table of shards x SLOT_GROUPS rows.
SLOT_GROUPS = 1024
#: A counted group of equal rows is spread again in runs of so many.
RUN = 1 << 16


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """-ln(u) / weight, where u comes from 53 bits of a hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.ln((bits + 0.5) * (2.0**-53)) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that wins the key; of equal scores the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights are positive, one for each shard")
    best = F.array_min(F.array(*[F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]))
    return best["shard"]


def assign(df: DataFrame, key: str, shards: int | list[float], name: str = "shard") -> DataFrame:
    """df with the shard of each row. A map: no shuffle, no state."""
    weights = [1.0] * shards if isinstance(shards, int) else shards
    return df.withColumn(name, shard_of(F.col(key), weights))


def number(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """df with gapless numbers from 0 in each shard, the same in each run.

    Equal rows are counted first, so copies are no hot group; then groups by hash are numbered apart and shifted by the sums of those before.
    """
    cols = df.columns
    n, group, start = "__n", "__group", "__start"
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n)).withColumn(group, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(SLOT_GROUPS)).cast("int"))
    sums = counted.groupBy(shard, group).agg(F.sum(n).alias("__rows"))
    before = Window.partitionBy(shard).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(shard).alias("__shard"), F.col(group).alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(shard, group).orderBy(*[F.col(c).asc_nulls_first() for c in [*order, *[c for c in cols if c not in order]]]).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn(start, F.coalesce(F.sum(n).over(within), F.lit(0)))
    # at most shards x SLOT_GROUPS offsets: bounded by the arguments
    placed = placed.join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col(group) == F.col("__of")))
    runs = placed.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col(n) - 1) / RUN).cast("long"))))
    one = F.explode(F.sequence(F.col("__run") * RUN, F.least(F.col(n), (F.col("__run") + 1) * RUN) - 1))
    return runs.withColumn("__k", one).select(*cols, (F.col("__offset") + F.col(start) + F.col("__k")).alias(name))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents by the law `key`: the shard by doc_id, the slot in it, and the shard where there is one more."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(assign(narrow, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    out = number(out, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
