"""Groups of linked nodes: components by alternating stars, and links found in buckets, in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.tables import stored


def _star(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least node in reach of u, which may be u itself."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _step(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    # Every pair now points from the larger to the smaller node.
    small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        small.select("u", F.col("m").alias("v"))
    )
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node reachable.

    Nodes that no edge names are not listed. Each round is written to the shared scratch
    folder; rounds grow with the logarithm of the longest chain. Only a count and a checksum
    of the pairs reach the driver. An edge of a node with itself and repeated edges are
    ignored, null nodes have no edges.
    """
    now = stored(edges.where("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        seen = mark
        now = stored(_step(now), "edges")


#: In buckets of more members only some lead at a time: so many in the first round, GROWTH times as
#: many in each that follows.
TOGETHER = 16
LEADERS = 2
GROWTH = 16


def _live(members: DataFrame) -> DataFrame:
    """``members`` of keys that hold two groups or more, with ``k``, the members of each key."""
    several = members.groupBy("key").agg(
        F.count("*").alias("k"), F.min("root").alias("_low"), F.max("root").alias("_high")
    ).where("_low < _high").select("key", "k")
    return members.drop("k").join(stored(several, "several"), "key")


def linked_in_rounds(
    members: DataFrame,
    may: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verified: Callable[[DataFrame], DataFrame],
    early: Column | None = None,
    refined: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``node, root`` of every node that is linked to another one of its key; root is the least reachable.

    ``members`` has ``key, node`` and what ``may`` asks for. In each round some members of a key, its
    leaders, are held against all others of it that aren't known to be in their group: ``may`` is a
    condition on the columns of both, ``verified`` keeps the rows of a table with ``u, v`` that are
    linked. A leader is then done with. So every two members of a key that may be linked are verified
    or already in one group, while a large key of which most are alike needs a few leaders only.
    Of large keys only rows where ``early`` holds lead in the first round. What is left after it, members
    of large keys in several groups, may be given other keys by ``refined``, which must bring together
    all of them that may be linked.
    """
    own = members.columns
    members = stored(_live(members.withColumn("root", F.col("node"))), "members")
    groups, leaders = None, LEADERS
    while not members.isEmpty():
        # The members with the least hashes lead: the same ones in all keys that they share.
        share = F.pmod(F.xxhash64(F.lit("leader"), "node"), F.lit(1 << 20)) / F.lit(1 << 20)
        some = share * F.col("k") < leaders
        if groups is None and early is not None:
            some = some & early
        marked = members.withColumn("leads", (F.col("k") <= TOGETHER) | some)
        first = marked.where("leads").select("key", *(F.col(c).alias(f"_{c}") for c in (*own, "root") if c != "key"))
        apart = (F.col("root") != F.col("_root")) & (~F.col("leads") | (F.col("node") < F.col("_node")))
        pairs = marked.join(first, "key").where(apart & may(F.col, lambda c: F.col(f"_{c}")))
        mine, its = F.struct("node", "root"), F.struct(F.col("_node").alias("node"), F.col("_root").alias("root"))
        pairs = pairs.select(F.least(mine, its).alias("u"), F.greatest(mine, its).alias("v")).distinct()
        pairs = pairs.select(*(F.col(f"{c}.node").alias(c) for c in "uv"), *(F.col(f"{c}.root").alias(f"{c}_root") for c in "uv"))
        links = verified(stored(pairs, "pairs")).select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
        # Links of this round join groups: their roots are the nodes of what is left to do.
        joined = components(stored(links, "links")).select(F.col("node").alias("root"), F.col("root").alias("_to"))
        joined = stored(joined, "roots")
        to = F.coalesce("_to", "root").alias("root")
        if groups is None:
            groups = joined.select(F.col("root").alias("node"), F.col("_to").alias("root"))
        else:
            moved = groups.join(joined, "root", "left").select("node", to)
            fresh = joined.join(groups.select(F.col("node").alias("root")), "root", "left_anti")
            groups = moved.unionByName(fresh.select(F.col("root").alias("node"), F.col("_to").alias("root")))
        groups = stored(groups, "groups")
        rest = marked.where("not leads").join(joined, "root", "left").select(*own, to)
        members = stored(_live(rest), "members")
        if refined and leaders == LEADERS and not members.isEmpty():
            members = stored(_live(refined(members).select(*own, "root")), "members")
        leaders *= GROWTH
    return groups if groups is not None else members.select("node", "root")
