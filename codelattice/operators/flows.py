"""Execution flows: tracing, membership, criticality, listing and refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.numbers import capped, rounded, unit
from codelattice.functions.text import contains_any, sanitize_name
from codelattice.model import CodeGraph
from codelattice.operators.lookup import _cut
from codelattice.operators.relations import entry_points
from codelattice.operators.traversal import trace
from codelattice.session import shuffled, stage

SORTS = {"criticality": True, "depth": True, "node_count": True, "file_count": True, "name": False}


def resolvable_calls(g: CodeGraph) -> DataFrame:
    known = g.nodes.select(F.col("qualified_name").alias("target"))
    return g.edges_of("CALLS").join(shuffled(known), "target", "left_semi").select("source", "target", "line")


def trace_flows(
    g: CodeGraph, max_depth: int = S.FLOW_MAX_DEPTH, roots: DataFrame | None = None,
    decorators: bool = False,
) -> DataFrame:
    """Rows of ``trace`` for every flow with at least two nodes."""
    starts = roots if roots is not None else entry_points(g, decorators)
    calls = resolvable_calls(g)
    # An entry without a resolvable call is a one-node flow, which is dropped.
    live = starts.select(F.col("qualified_name").alias("root")).join(
        shuffled(calls.where(F.col("source") != F.col("target")).select(F.col("source").alias("root"))), "root", "left_semi"
    )
    return trace(live, calls, max_depth)


def with_positions(members: DataFrame) -> DataFrame:
    """Discovery index of each node in its flow; exact for flows of any size.

    Ranks of a root and depth follow each other inside a range of the walk (the
    upper bits of a rank), so only the ranges' sizes are summed per root, and
    no root's members meet in one task.
    """
    ranges = ["root", "depth", "range"]
    tagged = members.withColumn("range", F.shiftright("rank", 33))
    before = Window.partitionBy("root").orderBy("depth", "range").rowsBetween(Window.unboundedPreceding, -1)
    starts = tagged.groupBy(*ranges).agg(F.min("rank").alias("first"), F.count("*").alias("n")).select(
        *ranges, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return tagged.join(shuffled(starts), ranges).withColumn("position", F.col("rank") + F.col("shift")).select(
        *members.columns, "position"
    )


def node_features(g: CodeGraph, keywords: tuple[str, ...] = S.SECURITY_KEYWORDS,
                  tested_by: str = "as_read") -> DataFrame:
    """Per-node inputs of the scores, each from one pre-aggregated join."""
    known = g.nodes.select(F.col("qualified_name").alias("target"))
    external = (
        g.edges_of("CALLS").join(shuffled(known), "target", "left_anti")
        .groupBy(F.col("source").alias("qualified_name")).agg(F.count("*").alias("external_calls"))
    )
    end = "target" if tested_by == "as_read" else "source"
    tested = g.edges_of("TESTED_BY").select(F.col(end).alias("qualified_name")).distinct().withColumn(
        "tested", F.lit(1)
    )
    return (
        g.nodes.select(
            "qualified_name", "name", "file_path",
            contains_any(keywords, F.col("name"), F.col("qualified_name")).cast("int").alias("security"),
        )
        .join(shuffled(external), "qualified_name", "left")
        .join(shuffled(tested), "qualified_name", "left")
        .select(
            "qualified_name", "name", "file_path", "security",
            F.coalesce("external_calls", F.lit(0)).alias("external_calls"),
            F.coalesce("tested", F.lit(0)).alias("tested"),
        )
    )


def score_flows(g: CodeGraph, members: DataFrame, keywords: tuple[str, ...] = S.SECURITY_KEYWORDS,
                tested_by: str = "as_read") -> DataFrame:
    """One row per flow with its counts and criticality."""
    features = node_features(g, keywords, tested_by).withColumnRenamed("qualified_name", "node")
    sums = (
        members.select("root", "node", "depth").join(shuffled(features), "node")
        .groupBy("root").agg(
            F.max("depth").alias("depth"),
            F.count("*").alias("node_count"),
            F.countDistinct("file_path").alias("file_count"),
            F.sum("external_calls").alias("external_calls"),
            F.sum("security").alias("security_hits"),
            F.sum("tested").alias("tested_nodes"),
        )
    )
    n = F.col("node_count")
    spread = F.when(F.col("file_count") > 1, capped((F.col("file_count") - 1) / F.lit(4.0), 1.0)).otherwise(F.lit(0.0))
    score = (
        spread * 0.30
        + capped(F.col("external_calls") / F.lit(5.0), 1.0) * 0.20
        + capped(F.col("security_hits") / n, 1.0) * 0.25
        + (F.lit(1.0) - F.col("tested_nodes") / n) * 0.15
        + capped(F.col("depth") / F.lit(10.0), 1.0) * 0.10
    )
    named = g.nodes.select(F.col("qualified_name").alias("root"), sanitize_name(F.col("name")).alias("name"))
    return sums.where(n >= 2).join(shuffled(named), "root").select(
        F.col("root").alias("entry_point"), "name", "depth", "node_count", "file_count",
        "external_calls", "security_hits", "tested_nodes",
        rounded(unit(score)).alias("criticality"),
    )


def list_flows(flows: DataFrame, sort_by: str = "criticality", limit: int | None = 50) -> DataFrame:
    """Flows in a whitelisted order, descending except by name."""
    key = sort_by if sort_by in SORTS else "criticality"
    first = F.desc(key) if SORTS[key] else F.asc(key)
    return _cut(flows, [first, F.asc("entry_point")], limit)


def affected_flows(flows: DataFrame, members: DataFrame, g: CodeGraph, changed_files: DataFrame) -> DataFrame:
    """Flows that pass through a node of a changed file, most critical first."""
    touched = (
        g.nodes.join(changed_files.select("file_path").distinct(), "file_path", "left_semi")
        .select(F.col("qualified_name").alias("node"))
    )
    hit = members.join(shuffled(touched), "node", "left_semi").select(F.col("root").alias("entry_point")).distinct()
    return flows.join(shuffled(hit), "entry_point", "left_semi")


def flow_steps(members: DataFrame, g: CodeGraph, entry_point: str | None = None) -> DataFrame:
    """Steps of one flow, or of all, with node details and position."""
    chosen = members if entry_point is None else members.where(F.col("root") == entry_point)
    info = g.nodes.select(
        F.col("qualified_name").alias("node"), "name", "kind", "file_path", "line_start", "line_end"
    )
    return with_positions(chosen).drop("rank", "parent", "line").join(shuffled(info), "node")


def flow_counts(members: DataFrame) -> DataFrame:
    """How many flows each node takes part in."""
    return members.groupBy(F.col("node").alias("qualified_name")).agg(F.count("*").alias("flows"))


def flow_snapshots(positioned: DataFrame, g: CodeGraph) -> DataFrame:
    """Entry, up to three intermediates, and the last node unless already shown."""
    names = g.nodes.select(F.col("qualified_name").alias("node"), "name")
    size = positioned.groupBy("root").agg(F.max("position").alias("last"))
    ends = (
        positioned.where(F.col("position") <= 3).select("root", "node", "position")
        .unionByName(
            positioned.join(shuffled(size), "root").where(F.col("position") == F.col("last"))
            .select("root", "node", F.lit(-1).cast("bigint").alias("position"))
        )
    )
    picked = ends.join(shuffled(names), "node").groupBy("root").agg(
        *[F.max(F.when(F.col("position") == i, F.col("name"))).alias(f"n{i}") for i in (1, 2, 3)],
        F.max(F.when(F.col("position") == -1, F.col("name"))).alias("final"),
    ).join(shuffled(size), "root")
    middle = F.filter(
        F.when(F.col("last") >= 2, F.array("n1", "n2", "n3")).otherwise(F.array().cast("array<string>")),
        lambda x: x.isNotNull(),
    )
    shown = F.concat(F.array("root"), middle)
    return picked.select(
        F.col("root").alias("entry_point"),
        F.when(
            (F.col("last") >= 1) & ~F.array_contains(shown, F.col("final")),
            F.concat(shown, F.array("final")),
        ).otherwise(shown).alias("critical_path"),
    )


def refresh_flows(
    g: CodeGraph, members: DataFrame, changed_files: DataFrame, max_depth: int = S.FLOW_MAX_DEPTH
) -> DataFrame:
    """Members after a change, the same as those of a full walk.

    A flow is kept if its root is still an entry and it passes no node of a
    changed file, no node that is gone and no caller of a node in a changed
    file (whose call may only now be resolved). All other entries, among them
    those that the change made entries, are walked again. Flows are keyed by
    qualified name, so re-stored nodes still match.
    """
    changed = changed_files.select("file_path").distinct()
    in_changed = g.nodes.join(changed, "file_path", "left_semi").select(F.col("qualified_name").alias("node"))
    gone = members.select("node").distinct().join(
        g.nodes.select(F.col("qualified_name").alias("node")), "node", "left_anti"
    )
    callers = g.edges_of("CALLS").join(
        in_changed.withColumnRenamed("node", "target"), "target", "left_semi"
    ).select(F.col("source").alias("node"))
    touched_nodes = in_changed.unionByName(gone).unionByName(callers).distinct()
    entries = stage(entry_points(g).select("qualified_name").distinct(), "entries")
    touched = members.join(touched_nodes, "node", "left_semi").select("root").distinct()
    kept = members.join(touched, "root", "left_anti").join(
        entries.withColumnRenamed("qualified_name", "root"), "root", "left_semi"
    )
    settled = members.select("root").distinct().join(touched, "root", "left_anti")
    again = entries.join(settled.withColumnRenamed("root", "qualified_name"), "qualified_name", "left_anti")
    return kept.unionByName(trace_flows(g, max_depth, roots=again))
