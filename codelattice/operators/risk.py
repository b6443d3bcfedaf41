"""Change mapping and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.numbers import capped, rounded, unit
from codelattice.functions.text import contains_any
from codelattice.model import CodeGraph
from codelattice.session import shuffled, stage

_BLOCK = 60  # lines per mask; a mask of 60 bits fits a BIGINT


def _line_masks(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, block, mask): one bit per covered line of each 60-line block."""
    spread = spans.where(
        F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))
    ).withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col(start) / _BLOCK), F.floor(F.col(end) / _BLOCK))),
    )
    low = F.greatest(F.col(start).cast("bigint") - F.col("block") * _BLOCK, F.lit(0))
    high = F.least(F.col(end).cast("bigint") - F.col("block") * _BLOCK, F.lit(_BLOCK - 1))
    shaped = spread.withColumn("_low", low.cast("int")).withColumn("_width", (high - low + 1).cast("int"))
    return shaped.select(
        *keys, "block",
        F.expr("shiftleft(shiftleft(1L, _width) - 1L, _low)").alias("mask"),
    )


def overlapping_nodes(g: CodeGraph, ranges: DataFrame, suffix_fallback: bool = True) -> DataFrame:
    """Nodes whose lines meet a changed range of their file.

    All ranges of a 60-line block collapse into one bit mask per (file, block),
    so the joins have one row per block on that side however many ranges a file
    has. Paths unknown to the graph fall back to a path-suffix match: of the
    known paths only the ends as long as some unknown path are compared.
    """
    masks = _line_masks(ranges, ["file_path"], "start", "end")
    changed = masks.groupBy("file_path", "block").agg(F.bit_or("mask").alias("changed"))
    if suffix_fallback:
        changed = stage(changed, "changed_blocks")
        files = g.nodes.select("file_path").distinct()
        unknown = stage(changed.join(shuffled(files), "file_path", "left_anti"), "unknown_blocks")
        lengths = unknown.select(F.length(F.lower("file_path")).alias("n")).where("n > 0").distinct().collect()
        if lengths:  # no more than the longest path has characters
            changed = changed.unionByName(_moved(files, unknown, [r["n"] for r in lengths])).groupBy(
                "file_path", "block").agg(F.bit_or("changed").alias("changed"))
    spans = _line_masks(g.nodes, ["file_path", "qualified_name"], "line_start", "line_end")
    hit = (
        shuffled(spans).join(shuffled(changed), ["file_path", "block"])
        .where(F.col("mask").bitwiseAND(F.col("changed")) != 0)
        .select("qualified_name").distinct()
    )
    return g.nodes.join(shuffled(hit), "qualified_name", "left_semi")


def _moved(files: DataFrame, unknown: DataFrame, lengths: list[int]) -> DataFrame:
    """The blocks of unknown paths at every known path that ends with theirs, whatever the case."""
    low = F.lower("file_path")
    sizes = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length(low))
    ends = files.select(
        F.col("file_path").alias("full"),
        F.explode(F.transform(sizes, lambda n: F.xxhash64(F.right(low, n)))).alias("key"),
    )
    paths = unknown.select("file_path").distinct().withColumn("key", F.xxhash64(low))
    found = (
        shuffled(ends).join(shuffled(paths), "key").where(F.endswith(F.lower("full"), low)).select("full", "file_path")
    )
    return shuffled(found).join(shuffled(unknown), "file_path").select(F.col("full").alias("file_path"), "block", "changed")


def changed_nodes(g: CodeGraph, changed_files: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """By ranges when there are any, else every node of the changed files."""
    if ranges is not None and not ranges.isEmpty():
        return overlapping_nodes(g, ranges)
    return g.nodes.join(changed_files.select("file_path").distinct(), "file_path", "left_semi")


def caller_counts(g: CodeGraph) -> DataFrame:
    """Call sites per target."""
    return g.edges_of("CALLS").groupBy(F.col("target").alias("qualified_name")).agg(
        F.count("*").alias("caller_count")
    )


def change_risk(
    g: CodeGraph, changed: DataFrame, flow_counts: DataFrame, communities: DataFrame,
    keywords: tuple[str, ...] = S.SECURITY_KEYWORDS, tested_by: str = "as_read",
) -> DataFrame:
    """Risk of each changed function, test or class; five pre-aggregated inputs.

    ``communities`` maps ``qualified_name`` to ``community_id``. Each input may hold a row for every
    name of the graph, so all are shuffled.
    """
    funcs = changed.where(F.col("kind").isin("Function", "Test", "Class")).select(
        "name", "qualified_name", "kind", "file_path", "line_start", "line_end"
    )
    own = communities.select("qualified_name", F.col("community_id").alias("own"))
    other = communities.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("other"))
    focus = funcs.select(F.col("qualified_name").alias("target"))
    calls = g.edges_of("CALLS").join(shuffled(focus), "target", "left_semi").select("source", "target")
    sites = calls.groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("callers"))
    crossing = (
        calls.distinct().join(shuffled(other), "source")
        .join(shuffled(own.withColumnRenamed("qualified_name", "target")), "target")
        .where(F.col("own") != F.col("other"))
        .groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("crossing"))
    )
    end = "target" if tested_by == "as_read" else "source"
    tested = g.edges_of("TESTED_BY").select(F.col(end).alias("qualified_name")).distinct().withColumn(
        "tested", F.lit(True)
    )
    joined = (
        funcs.join(shuffled(flow_counts), "qualified_name", "left").join(shuffled(sites), "qualified_name", "left")
        .join(shuffled(crossing), "qualified_name", "left").join(shuffled(tested), "qualified_name", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = (
        capped(zero("flows") * 0.05, 0.25)
        + capped(zero("crossing") * 0.05, 0.15)
        + F.when(F.col("tested"), 0.05).otherwise(0.30)
        + F.when(contains_any(keywords, F.col("name"), F.col("qualified_name")), 0.20).otherwise(0.0)
        + capped(zero("callers") / F.lit(20.0), 0.10)
    )
    return joined.select(
        "qualified_name", "name", "kind", "file_path", zero("flows").alias("flows"),
        zero("crossing").alias("crossing"), zero("callers").alias("callers"),
        F.coalesce("tested", F.lit(False)).alias("tested"), rounded(unit(score)).alias("risk_score"),
    )


def risk_index(g: CodeGraph, keywords: tuple[str, ...] = S.RISK_INDEX_KEYWORDS) -> DataFrame:
    """Stored risk of every function, class and test (outgoing TESTED_BY counts)."""
    tested = g.edges_of("TESTED_BY").select(F.col("source").alias("qualified_name")).distinct().withColumn(
        "t", F.lit(True)
    )
    n = F.coalesce("caller_count", F.lit(0))
    security = contains_any(keywords, F.col("name"))
    score = (
        F.when(n > 10, 0.3).when(n > 3, 0.15).otherwise(0.0)
        + F.when(F.col("t"), 0.0).otherwise(0.3)
        + F.when(security, 0.4).otherwise(0.0)
    )
    return (
        g.nodes_of("Function", "Class", "Test").select("qualified_name", "name")
        .join(shuffled(caller_counts(g)), "qualified_name", "left").join(shuffled(tested), "qualified_name", "left")
        .select(
            "qualified_name", rounded(F.least(score, F.lit(1.0))).alias("risk_score"), n.alias("caller_count"),
            F.when(F.col("t"), "tested").otherwise("untested").alias("test_coverage"),
            security.alias("security_relevant"),
        )
    )


def priorities(risks: DataFrame, k: int = 10) -> DataFrame:
    return risks.orderBy(F.desc("risk_score"), "qualified_name").limit(k)


def change_summary(risks: DataFrame, gaps: DataFrame, flows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the roll-up of a change review."""
    one = risks.agg(
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("risk_score"),
        F.count("*").alias("changed_functions"),
    )
    return one.select(
        files.agg(F.count("*")).scalar().alias("changed_files"),
        "changed_functions",
        flows.agg(F.count("*")).scalar().alias("affected_flows"),
        gaps.agg(F.count("*")).scalar().alias("test_gaps"),
        "risk_score",
        risk_word(F.col("risk_score")).alias("risk"),
    )


def risk_word(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def impact_band(impact: DataFrame, edges_inside: DataFrame, changed_files: DataFrame, gaps: DataFrame) -> DataFrame:
    """Risk band and review guidance flags from the impact set."""
    n = F.col("impacted")
    counts = impact.agg(
        F.count_if(F.col("role") == "impacted").alias("impacted"),
        F.count_if(F.col("role") == "changed").alias("changed"),
    )
    inherits = edges_inside.where(F.col("kind").isin("INHERITS", "IMPLEMENTS")).agg(F.count("*")).scalar()
    return counts.select(
        "changed", "impacted",
        F.when(n > 20, "high").when(n > 5, "medium").otherwise("low").alias("risk"),
        (n > 20).alias("wide_impact"),
        (inherits > 0).alias("inheritance_touched"),
        (changed_files.agg(F.count("*")).scalar() > 3).alias("many_files"),
        gaps.agg(F.count("*")).scalar().alias("untested_functions"),
    )
