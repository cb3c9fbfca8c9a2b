"""Links and connected components of sets, without collecting links.

`linked_components` takes candidate keys for each set: sets that share no key are never compared, so a caller's keys decide the recall. Groups
of equal key with two or three members are pairs at once. In a larger group the set with the most neighbours is the centre; every other whose
bits leave a link possible is compared with it on the whole sets. Members that are linked with the centre are one component and need no
comparison with each other. The others (outsiders) are compared with the members outside their own component, in blocks of bounded size: by
what both lack and have besides against the centre, a bound of their intersection that few pairs without a link pass, or by their bits if they
are far from the centre. What is left is compared on the whole sets. Work grows with the rows of a group, and with its outsiders times its
members; no step puts a group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SORTED_GROUPS, arrow_map, column, cut, forget, lookup, mixed

#: 64-bit words in the bitmap of what a set lacks, and in that of what it has besides.
WORDS = 8
#: Rows of one centre that are joined with its text in one task at most, about.
RUN = 2000
#: Outsiders of one centre in a block.
BLOCK = 512
#: One row of so many is looked at to tell which keys are frequent, which are those with at least so many rows and such a share of what was seen.
SEEN, FREQUENT, SHARE = 64, 8, 2000
#: A pair at the threshold is left out for its bits with this probability at most.
RISK = 1e-6


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): distributed union-find by contraction. root is one node of the component.

    Each round every node points to the one of least hash of itself and its neighbours, takes over what that one points to, and edges between
    different targets remain. As hashes have no part in how nodes are linked, chains get shorter by a constant factor a round (1,000 nodes in
    order of ids: about 8 rounds), and a star takes one or two. All state is cut, so a lost executor costs one round.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    steps = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        best = both.groupBy("node").agg(F.min(ranked("other")).alias("best"))
        points = cut(best.select("node", F.least("best", ranked("node"))["id"].alias("root")))
        steps.append(points)
        ra, rb = _jump(points).toDF("a", "ra"), _jump(points).toDF("b", "rb")
        rest = edges.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges, old = cut(rest), edges
        forget(old)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    forget(edges)
    roots = _jump(steps[0])
    for points in steps[1:]:
        roots = roots.join(_jump(points).toDF("at", "to"), F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = cut(roots)
    forget(*steps)
    return roots


def _jump(points: DataFrame) -> DataFrame:
    """Each node with the root of its root."""
    return points.join(points.toDF("at", "to"), F.col("root") == F.col("at")).select("node", F.col("to").alias("root"))


def most_bits(similarity: float, n: int) -> int:
    """Of n bits, one of each of n minima, a pair of this similarity differs in more than this with a probability of at most RISK."""
    p, above, k = (1 - similarity) / 2, 1.0, -1
    while above > RISK:
        k += 1
        above -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def linked_components(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], similarity: tuple[int, int], bits: int, codes_of: Callable[[str], np.ndarray]) -> DataFrame:
    """(node, root) of the nodes that have links.

    nodes: node long, keys array<long>, b0 and b1 long: one bit of each of `bits` minima; a node may stand there more than once. fetch(table with
    column node) gives node and text, once for each node, and must be done with its argument (by cut) when it returns; codes_of(text) are the sorted distinct codes of its set. similarity: numerator and
    denominator; a link has intersection * den >= num * union on the whole sets.
    """
    far = most_bits(similarity[0] / similarity[1], bits)
    postings = nodes.select("node", "b0", "b1", F.explode("keys").alias("k"))
    groups = _groups(nodes)
    stars = _stars(groups, postings, far)
    few = _small_pairs(groups, nodes).where(_differ() <= far)
    both = cut(stars.where("near").select("a", "b", "c").union(few.select("a", "b", F.lit(0).cast("long"))))
    sets = fetch(_nodes_of(both))
    tested = cut(_tested(both, sets, similarity, codes_of))
    forget(groups, both)
    roots = components(tested.where("linked").select("a", "b"))
    hidden = {f"{x}_hidden": F.col(count) - _ones(*[F.col(f"{x}{k}") for k in range(WORDS)]) for x, count in (("l", "lacks"), ("e", "besides"))}
    close = _outsider_pairs(tested.where("c > 0").withColumns(hidden | {"out": ~F.col("linked")}).drop("c", "linked"), roots, _bounded(similarity))
    apart = _outsider_pairs(stars.select("a", "b", "c0", "c1", (~F.col("near")).alias("out")), roots, _differ("x.c0", "x.c1", "y.c0", "y.c1") <= far)
    pairs = cut(close.union(apart).distinct())
    forget(stars, tested)
    wanted = cut(_nodes_of(pairs))
    texts = sets.join(lookup(wanted, wanted.count()), "node", "left_semi").unionByName(fetch(wanted.join(sets, "node", "left_anti")))
    found = cut(_tested(pairs.select("a", "b", F.lit(0).cast("long").alias("c")), texts, similarity, codes_of).where("linked").select("a", "b"))
    forget(pairs, wanted)
    if found.isEmpty():
        return roots
    # the new links between components; nodes without one are their own
    named = lambda x: roots.select(F.col("node").alias(f"{x}n"), F.col("root").alias(f"{x}r"))
    between = found.join(named("a"), F.col("a") == F.col("an"), "left").join(named("b"), F.col("b") == F.col("bn"), "left")
    over = components(between.select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))).toDF("at", "to")
    known = roots.union(over.join(roots, F.col("at") == F.col("node"), "left_anti").select("at", "at"))
    return cut(known.join(over, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root")))


def _groups(nodes: DataFrame) -> DataFrame:
    """Of each key with different nodes: k, c (rows), lo, hi (least and greatest node) and x (all nodes under XOR); cut.

    Most keys have one row, so that a grouping before the shuffle would only cost time: rows are dealt out and sorted by key. Rows of frequent
    keys are grouped where they are first, so that no task gets them all. A sample tells which these are; it has no part in the result.
    """
    facts = [F.count(F.lit(1)).alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("x")]
    rows = nodes.select("node", F.explode("keys").alias("k"))
    seen = nodes.sample(1 / SEEN, seed=1).select(F.explode("keys").alias("k"))
    total = seen.count()
    frequent = [r["k"] for r in seen.groupBy("k").count().where(F.col("count") >= max(FREQUENT, total / SHARE)).collect()]
    dealt = (rows.where(~F.col("k").isin(frequent)) if frequent else rows).repartition("k").sortWithinPartitions("k").groupBy("k").agg(*facts)
    if frequent:
        dealt = dealt.union(rows.where(F.col("k").isin(frequent)).groupBy("k").agg(*facts))
    return cut(dealt.where("lo <> hi"), SORTED_GROUPS)


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _differ(a0: str = "a0", a1: str = "a1", c0: str = "c0", c1: str = "c1") -> Column:
    """How many bits of two sets differ."""
    return F.bit_count(F.col(a0).bitwiseXOR(F.col(c0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(c1)))


def _small_pairs(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of groups of two and three, with the bits of both (a0, a1, c0, c1)."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    middle = F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(F.col("x"))
    made = F.when(F.col("c") == 2, F.array(pair("lo", "hi"))).otherwise(F.array(pair("lo", "hi"), pair("lo", middle), pair(middle, "hi")))
    pairs = cut(groups.where("c <= 3").select(F.explode(made).alias("p")).select("p.a", "p.b").where("a <> b").distinct())
    members = cut(_nodes_of(pairs))
    known = cut(nodes.join(lookup(members, members.count()), "node", "left_semi").groupBy("node").agg(F.first("b0").alias("b0"), F.first("b1").alias("b1")))
    return pairs.join(known.toDF("a", "a0", "a1"), "a").join(known.toDF("b", "c0", "c1"), "b")


def _stars(groups: DataFrame, postings: DataFrame, far: int) -> DataFrame:
    """(a, b, c, c0, c1, near): the centre of a group of more than three, a member, the size of the group, the member's bits, and whether they
    differ from the centre's in few enough; cut. The centre is the member of the most neighbours in all groups, so that groups of the same
    copies have the same centre."""
    more = groups.where("c > 3").select(F.expr("k + 0").alias("g"), "c")
    # another name for the key, so that Spark deals the groups out again and can split the postings of a large group
    shared = cut(postings.join(lookup(more, more.count()), F.col("k") == F.col("g")).select("k", "node", "c", "b0", "b1"))
    facts = cut(shared.groupBy("node").agg(F.sum("c").alias("w"), F.first("b0").alias("b0"), F.first("b1").alias("b1")))
    weighed = shared.join(facts.select(F.col("node").alias("f"), "w"), F.col("node") == F.col("f"))
    centres = cut(weighed.groupBy("k").agg(F.max_by("node", "w").alias("a")).select(F.expr("k + 0").alias("g"), "a"))
    stars = shared.join(lookup(centres, centres.count()), F.col("k") == F.col("g")).where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.max("c").alias("c"), F.first("b0").alias("c0"), F.first("b1").alias("c1"))
    out = cut(stars.join(facts.select(F.col("node").alias("f"), F.col("b0").alias("a0"), F.col("b1").alias("a1")), F.col("a") == F.col("f")).select("a", "b", "c", "c0", "c1", (_differ() <= far).alias("near")))
    forget(shared, facts, centres)
    return out


def _bitmaps(parts: list[np.ndarray], rows: list[int], n: int) -> np.ndarray:
    """For each of n rows a bitmap of the codes in the parts that belong to it, in WORDS signed longs."""
    bits = np.zeros((n, 64 * WORDS), np.uint8)
    if parts:
        places = mixed(np.concatenate(parts)) % np.uint64(64 * WORDS)
        bits[np.repeat(rows, [len(x) for x in parts]), places] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _tested(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int], codes_of: Callable[[str], np.ndarray]) -> DataFrame:
    """For each pair (a, b, c): whether it is linked, by the whole sets. If c > 0, also the sizes of both, how many members of a b lacks and how
    many it has besides, and bitmaps of both. c is about the number of rows that a stands in: its text is dealt out with salt."""
    num, den = similarity
    salts = F.greatest(F.lit(1), F.ceil(F.col("c") / RUN)).cast("int")
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("b"), salts).cast("int"))
    heads = pairs.groupBy(F.col("a").alias("h")).agg(F.max(salts).alias("m")).join(sets, F.col("h") == F.col("node")).select("h", F.col("text").alias("one"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t"))
    tails = sets.select(F.col("node").alias("n"), F.col("text").alias("two"))
    whole = salted.join(heads, (F.col("a") == F.col("h")) & (F.col("s") == F.col("t"))).join(tails, F.col("b") == F.col("n")).select("a", "b", "c", "one", "two")

    def f(part: pa.RecordBatch) -> dict:
        sizes = np.empty((part.num_rows, 3), np.int64)
        heads: dict[int, np.ndarray] = {}
        lacks, besides, rows = [], [], []
        for k, (a, c, one, two) in enumerate(zip(column(part, "a"), column(part, "c"), column(part, "one"), column(part, "two"), strict=True)):
            x = heads.get(a)
            if x is None:
                x = heads[a] = codes_of(one)
            y = codes_of(two)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            hit = x[at] == y
            sizes[k] = len(x), len(y), np.count_nonzero(hit)
            if c:
                left = np.ones(len(x), bool)
                left[at[hit]] = False
                lacks.append(x[left])
                besides.append(y[~hit])
                rows.append(k)
        n, m, common = sizes.T
        out = {"linked": common * den >= (n + m - common) * num, "an": n, "bn": m, "lacks": n - common, "besides": m - common}
        for x, parts in (("l", lacks), ("e", besides)):
            words = _bitmaps(parts, rows, part.num_rows)
            out |= {f"{x}{k}": words[:, k] for k in range(WORDS)}
        return out

    schema = "a long, b long, c long, linked boolean, an int, bn int, lacks int, besides int, " + ", ".join(f"{x}{k} long" for x in "le" for k in range(WORDS))
    return arrow_map(whole, f, schema, ["a", "b", "c"])


def _ones(*words: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(w) for w in words])


def _bounded(similarity: tuple[int, int]) -> Column:
    """Whether two rows x and y of _tested with the same a can have linked b."""
    num, den = similarity

    def at_most(bits: str, count: str) -> Column:
        one, two = ([F.col(f"{side}.{bits}{k}") for k in range(WORDS)] for side in "xy")
        # members that a bitmap doesn't tell apart may be common ones
        hidden = F.least(f"x.{bits}_hidden", f"y.{bits}_hidden")
        return F.least(_ones(*[p.bitwiseAND(q) for p, q in zip(one, two, strict=True)]) + hidden, f"x.{count}", f"y.{count}")

    # both have what the centre has and neither lacks, and what both have besides
    common = F.col("x.an") - F.col("x.lacks") - F.col("y.lacks") + at_most("l", "lacks") + at_most("e", "besides")
    # common * den >= (both sizes - common) * num, with common written once: the JVM compiles no method of over 8,000 bytes
    return common.cast("long") * (den + num) >= (F.col("x.bn") + F.col("y.bn")).cast("long") * num


def _outsider_pairs(rows: DataFrame, roots: DataFrame, able: Column) -> DataFrame:
    """Of rows (a, b, out and more) the pairs (a, b) of an outsider and another member of a group a that are in different components and `able`."""
    rooted = cut(rows.join(roots.select(F.col("node").alias("of"), "root"), F.col("b") == F.col("of"), "left").withColumn("root", F.coalesce("root", "b")).drop("of"))
    state = rooted.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if("out").alias("outs"))
    state = cut(state.where("lo <> hi and outs > 0").select(F.col("a").alias("g"), F.ceil(F.col("outs") / BLOCK).cast("int").alias("blocks")))
    rooted = rooted.join(lookup(state, state.count()), F.col("a") == F.col("g")).drop("g")
    x = rooted.where("out").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).alias("x")
    y = rooted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    once = ~F.col("y.out") | (F.col("x.b") < F.col("y.b"))
    pairs = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & once & able)
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))
