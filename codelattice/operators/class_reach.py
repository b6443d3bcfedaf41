"""Which classes a function can reach, by sets of bits passed against the calls.

A class (a kind of sink, a required check) is one bit of a word of 63; a
function has one row per word. Only bits that are new at a function go on to
its callers, so a level moves what the level before has found, never pairs of
an entry and all it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators.traversal import HUB_LINKS, StagedLinks
from codelattice.session import Levels, stage

WORD_BITS = 63


def numbered(keys: DataFrame) -> DataFrame:
    """Each distinct ``key`` with the word and bit that stand for it."""
    index = F.monotonically_increasing_id()
    return stage(
        keys.select("key").where(F.col("key").isNotNull()).distinct().withColumn("_i", index).select(
            "key", F.expr(f"_i div {WORD_BITS}").alias("word"),
            F.expr(f"shiftleft(1L, cast(_i % {WORD_BITS} as int))").alias("bit"),
        ),
        "class_bits",
    )


def _as_bits(rows: DataFrame, bits: DataFrame, out: str) -> DataFrame:
    return rows.select("node", "key").join(bits, "key").groupBy("node", "word").agg(F.bit_or("bit").alias(out))


def class_reach(
    calls: DataFrame, targets: DataFrame, guards: DataFrame | None = None,
    max_depth: int | None = None, hub_links: int = HUB_LINKS,
) -> DataFrame:
    """Rows (node, key, depth, open_depth): the classes a node reaches by its calls.

    ``calls`` has ``source`` and ``target``, ``targets`` (node, key) the members
    of the classes, ``guards`` (node, key) the nodes that make a call harmless for
    a class. ``depth`` is the least number of calls to a member; ``open_depth``
    that of a way on which no called node is a guard, the member itself
    included, null if every way passes one. A node's own membership counts for
    its callers only. Without ``max_depth`` the bits are passed on until no node
    gains one. Nulls are no nodes; repeated rows count once.
    """
    spark = calls.sparkSession
    bits = numbered(targets)
    own = _as_bits(targets.where(F.col("node").isNotNull()), bits, "mine")
    shut = None if guards is None else stage(_as_bits(guards.where(F.col("node").isNotNull()), bits, "shut"), "guards")

    def passed_on(rows: DataFrame) -> DataFrame:
        """What the callers of a node get: guarded bits lose their open state."""
        if shut is None:
            return rows
        return rows.join(shut, ["node", "word"], "left").withColumn(
            "open", F.col("open").bitwiseAND(F.bitwise_not(F.coalesce("shut", F.lit(0).cast("bigint"))))
        ).drop("shut")

    callers = calls.select(F.col("target").alias("source"), F.col("source").alias("target")).where(
        F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()
    links = StagedLinks(callers, "callers", hub_links)
    levels = Levels(spark, "classes")
    frontier = own.select("node", "word", F.col("mine").alias("open"), F.col("mine").alias("any"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        gained = (
            links.follow(passed_on(frontier), "node")
            .groupBy(F.col("target").alias("node"), "word")
            .agg(F.bit_or("open").alias("open"), F.bit_or("any").alias("any"))
        )
        if levels.paths:
            known = levels.all().groupBy("node", "word").agg(
                F.bit_or("open").alias("had_open"), F.bit_or("any").alias("had_any"))
            fresh = lambda new, had: F.col(new).bitwiseAND(
                F.bitwise_not(F.coalesce(had, F.lit(0).cast("bigint")))).alias(new)
            gained = gained.join(known, ["node", "word"], "left").select(
                "node", "word", fresh("open", "had_open"), fresh("any", "had_any"))
        frontier = levels.add(
            gained.where(F.col("open").bitwiseOR(F.col("any")) != 0).select(
                "node", "word", "open", "any", F.lit(depth).alias("depth"))
        )
        if levels.last_rows == 0:
            break
    links.drop()
    if not levels.paths:
        return frontier.join(bits, "word").select(
            "node", "key", F.lit(0).alias("depth"), F.lit(0).alias("open_depth")).where(F.lit(False))
    has = lambda c: F.col(c).bitwiseAND(F.col("bit")) != 0
    return (
        levels.all().join(bits, "word").where(has("open") | has("any"))
        .groupBy("node", "key").agg(
            F.min("depth").alias("depth"), F.min(F.when(has("open"), F.col("depth"))).alias("open_depth"))
    )


def hops_left(reached: DataFrame, targets: DataFrame, depth: str = "depth") -> DataFrame:
    """Rows (node, left): the least number of calls from a node to any member, 0 at members."""
    return (
        reached.where(F.col(depth).isNotNull()).select("node", F.col(depth).alias("left"))
        .unionByName(targets.select("node", F.lit(0).alias("left")))
        .groupBy("node").agg(F.min("left").alias("left"))
    )
