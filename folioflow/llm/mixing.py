"""Operator 2. Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every row has a 60-bit hash. Sizes are summed by source and the 12 leading bits; running sums show in which bucket a source's budget ends.
Only that bucket is summed again by its next 12 bits, and the last bucket by full hash. A row is taken if its hash is below its source's
threshold: a filter, no sort of the rows. Thresholds of growing budgets are nested, so a larger mix holds the smaller one.

Defined cases: a null source is a source, last in order; a null text has size 0; rows of equal hash (repeated rows) share the words that
are left at the threshold evenly, rounded down; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import WORD_PATTERN, cut, fresh, lookup

BITS = 12
LEVELS = 2
#: No source is taken more often than this.
MOST = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """Of (source, source_size): the target of each source. All sizes are shared by weight; a share above `most` times its source's size
    stops there and the excess goes to the others, by weight, until none is above. That ends at one level t with target
    least(most x size, t x weight), found here from running sums in order of size / weight. One row for each source: small.
    """
    by_point = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_point) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("top", F.col("source_size") * float(most))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("top").over(below), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    weighed = weighed.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("top") / F.col("w"), F.struct((F.col("top") / F.col("w")).alias("at"), F.col("level").alias("t")))).over(whole)["t"]
    return weighed.select("source", "source_size", F.least(F.col("top"), F.coalesce(fits, F.lit(0.0)) * F.col("w")).alias("target"))


def mix(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """rows (uid, source, size, hash of 60 bits), cut beforehand; quota (source, source_size, target). Adds what is taken of each row."""
    null_safe = lambda a, b: a.eqNullSafe(b)
    wanted = quota.select(F.col("source").alias("q_source"), F.col("source_size"), F.col("target"), F.round("target").cast("long").alias("words"))
    wanted = wanted.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
    wanted = wanted.withColumn("left", F.col("words") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    # a row for each source, and as many in the tables of thresholds that follow: counted, broadcast if few, shuffled otherwise
    sources = quota.count()
    few = lambda df: lookup(df, sources)
    hashed = rows.withColumn("prefix", F.lit(0).cast("long"))
    edge = wanted
    for level in range(1, LEVELS + 1):
        shift = 60 - BITS * level
        inside = hashed.join(few(edge.select("q_source", F.col("prefix").alias("q_prefix"), "left")), null_safe(F.col("source"), F.col("q_source")) & (F.shiftright("hash", shift + BITS) == F.col("q_prefix")))
        edge = _edge(inside.withColumn("bucket", F.shiftright("hash", shift)), edge, few)
    inside = hashed.join(few(edge.select("q_source", F.col("prefix").alias("q_prefix"), "left")), null_safe(F.col("source"), F.col("q_source")) & (F.shiftright("hash", 60 - BITS * LEVELS) == F.col("q_prefix")))
    edge = _edge(inside.withColumn("bucket", F.col("hash")), edge, few)
    ties = rows.join(few(edge.select("q_source", F.col("prefix").alias("q_prefix"))), null_safe(F.col("source"), F.col("q_source")) & (F.col("hash") == F.col("q_prefix"))).groupBy("q_source").agg(F.count(F.lit(1)).alias("ties"))
    edge = edge.join(ties.withColumnRenamed("q_source", "t_source"), null_safe(F.col("q_source"), F.col("t_source")), "left")
    taken = rows.join(few(edge.select("q_source", F.col("source_size"), "target", "whole", "left", F.col("prefix").alias("threshold"), "ties")), null_safe(F.col("source"), F.col("q_source")))
    return taken.withColumn("share", F.when(F.col("hash") < F.col("threshold"), F.lit(2)).when(F.col("hash") == F.col("threshold"), F.lit(1)).otherwise(F.lit(0)))


def _edge(inside: DataFrame, edge: DataFrame, few) -> DataFrame:
    """For each source the bucket in which its budget ends, and what is left of the budget there."""
    sums = inside.groupBy("q_source", "bucket").agg(F.sum("size").alias("held"), F.first("left").alias("left"))
    upto = Window.partitionBy("q_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    ends = sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("held")))
    ends = ends.select(F.col("q_source").alias("e_source"), F.col("bucket").alias("e_bucket"), (F.col("left") - F.col("before")).alias("e_left"))
    # a source whose budget is all it has ends nowhere: every hash is below its threshold
    kept = edge.join(few(ends), F.col("q_source").eqNullSafe(F.col("e_source")), "left")
    return kept.select("q_source", "source_size", "target", "whole", F.coalesce("e_bucket", F.lit(-1).cast("long")).alias("prefix"), F.coalesce("e_left", F.lit(0).cast("long")).alias("left"))


def measured(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """The narrow table of a mix, cut: doc_id, source, size and a 60-bit hash of the record's key and text."""
    return cut(docs.select("doc_id", "source", (words_in(F.col("text")) if size is None else size).alias("size"), _hash(docs).alias("hash")))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    rows = measured(docs)
    quota = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    out = mix(rows, quota)
    # a document at the threshold gives just the words that are left; equal ones share them
    part = F.least(F.col("size"), (F.col("left") / F.coalesce(F.col("ties"), F.lit(1))).cast("long"))
    taken = F.col("whole") * F.col("size") + F.when(F.col("share") == 2, F.col("size")).when(F.col("share") == 1, part).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with the columns of docs. Whole documents only: the one at a
    threshold is left out, so a source is short of its target by less than one document.
    """
    rows = measured(docs)
    quota = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    at, whole, threshold, hash60, copy = fresh(docs.columns, "at", "whole", "threshold", "hash", "copy")
    limits = mix(rows, quota).groupBy("q_source").agg(F.first("whole"), F.when(F.first("threshold") < 0, F.lit(0)).otherwise(F.first("threshold")))
    limits = cut(limits.toDF(at, whole, threshold))
    joined = docs.withColumn(hash60, _hash(docs)).join(lookup(limits, limits.count()), F.col("source").eqNullSafe(F.col(at)))
    times = (F.col(whole) + F.when(F.col(hash60) < F.col(threshold), F.lit(1)).otherwise(F.lit(0))).cast("int")
    return joined.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def _hash(docs: DataFrame) -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 4)
