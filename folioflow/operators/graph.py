"""Object graphs as tables: references, inherited attributes, trees by depth, and merges with renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts in a block of renumber; shifts are summed inside blocks, then over blocks.
BLOCK = 10_000


def resolve(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (doc_id, num, gen, ...) with the value of the object each points to; null if there is none."""
    return refs.join(objects.select("doc_id", "num", "gen", "value"), ["doc_id", "num", "gen"], "left")


def renumber(documents: DataFrame) -> DataFrame:
    """documents (part, num, refs): objects of parts 0, 1, ... in one numbering. Each part is moved by the largest numbers of those before it.

    The running sum is taken in blocks of BLOCK parts, then over the blocks' totals, so no task sorts all parts.
    """
    top = documents.groupBy("part").agg(F.max("num").alias("top")).withColumn("block", F.floor(F.col("part") / BLOCK))
    before = lambda w: F.coalesce(F.sum("top").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = top.withColumn("inside", before(Window.partitionBy("block").orderBy("part")))
    # a row for each block, a ten-thousandth of the parts
    blocks = top.groupBy("block").agg(F.sum("top").alias("top")).select(F.col("block").alias("b"), before(Window.orderBy("block")).alias("outside"))
    shift = inside.join(blocks, F.col("block") == F.col("b")).select(F.col("part").alias("p"), (F.col("inside") + F.col("outside")).alias("shift"))
    rows = documents.join(shift, F.col("part") == F.col("p"))
    return rows.select("part", "num", (F.col("num") + F.col("shift")).alias("new_num"), F.transform("refs", lambda r: r + F.col("shift")).alias("refs"))


def flatten(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """nodes (doc_id, id, parent, ord, name) as a tree in preorder: path of ords, depth, and names joined by points. Nodes deeper than `depth`,
    in a cycle, or below a parent that isn't there, are left out.

    Pointers are doubled: a node knows its path from an ancestor, and takes over that of the ancestor, so a tree of depth 32 takes five joins,
    whatever the number of nodes; there is no limit on rows and no job runs before the result is asked for.
    """
    part = F.struct(F.col("ord"), F.col("name"))
    up = nodes.select("doc_id", "id", F.col("parent").alias("above"), F.array(part).alias("steps"))
    covered = 1
    while covered < depth:
        above = up.select(F.col("doc_id").alias("a_doc"), F.col("id").alias("a_id"), F.col("above").alias("a_above"), F.col("steps").alias("a_steps"))
        joined = up.join(above, (F.col("doc_id") == F.col("a_doc")) & (F.col("above") == F.col("a_id")), "left")
        found = F.col("a_id").isNotNull()
        # a parent that isn't there stays above for good, and its nodes go in the end
        up = joined.select("doc_id", "id", F.when(found, F.col("a_above")).otherwise(F.col("above")).alias("above"), F.when(found, F.concat("a_steps", "steps")).otherwise(F.col("steps")).alias("steps"))
        covered *= 2
    whole = up.where(F.col("above").isNull() & (F.size("steps") <= depth))
    return whole.select("doc_id", "id", _joined("name").alias("name"), F.transform("steps", lambda s: s["ord"]).alias("path"), F.size("steps").alias("depth"))


def _joined(field: str) -> Column:
    """The field of all steps, joined by points; null if it is null in any, as when they are joined one by one."""
    names = F.transform("steps", lambda s: s[field])
    return F.when(~F.exists(names, lambda n: n.isNull()), F.array_join(names, "."))
