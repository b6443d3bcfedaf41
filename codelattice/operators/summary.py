"""Counts and overviews of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.numbers import rounded
from codelattice.model import CodeGraph
from codelattice.operators.lookup import SYMBOL_KINDS, _cut


def graph_stats(g: CodeGraph) -> DataFrame:
    """(metric, label, value): totals, counts by kind, languages and files."""
    kinds = lambda df, m: df.groupBy("kind").agg(F.count("*").alias("value")).select(
        F.lit(m).alias("metric"), F.col("kind").alias("label"), "value"
    )
    nodes = g.nodes.agg(
        F.count("*").alias("nodes_total"),
        F.countDistinct(F.when(F.col("language") != "", F.col("language"))).alias("languages"),
        F.count_if(F.col("kind") == "File").alias("files"),
    )
    flat = nodes.selectExpr(
        "stack(3, 'nodes_total', nodes_total, 'languages', languages, 'files', files) as (metric, value)"
    ).select("metric", F.lit("*").alias("label"), "value")
    edges = g.edges.agg(F.count("*").alias("value")).select(
        F.lit("edges_total").alias("metric"), F.lit("*").alias("label"), "value"
    )
    return kinds(g.nodes, "nodes_by_kind").unionByName(kinds(g.edges, "edges_by_kind")).unionByName(flat).unionByName(edges)


def language_counts(g: CodeGraph) -> DataFrame:
    return g.nodes_of("Function", "Method").where(F.col("language").isNotNull()).groupBy("language").agg(
        F.count("*").alias("functions")
    )


def language_share(g: CodeGraph) -> DataFrame:
    """Functions per language with the percentage of all."""
    counts = language_counts(g)
    total = counts.agg(F.sum("functions")).scalar()
    return counts.select(
        "language", "functions", rounded(F.col("functions") * 100.0 / total, 2).alias("percent")
    )


def top_files(g: CodeGraph, limit: int | None = 15) -> DataFrame:
    counts = g.nodes_of(*SYMBOL_KINDS).groupBy("file_path").agg(F.count("*").alias("symbol_count"))
    return _cut(counts, [F.desc("symbol_count"), F.asc("file_path")], limit)


def hub_functions(g: CodeGraph, limit: int | None = 10) -> DataFrame:
    counts = g.edges_of("CALLS").groupBy(F.col("target").alias("qualified_name")).agg(
        F.count("*").alias("caller_count")
    )
    return _cut(counts, [F.desc("caller_count"), F.asc("qualified_name")], limit)


def entries_by_file(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file_path").agg(F.count("*").alias("entry_points"))


def minimal_context(g: CodeGraph, communities: DataFrame, flows: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: totals, risk word, top three communities and flows."""
    from codelattice.operators.risk import risk_word

    top = lambda df, score, key, name: (
        df.orderBy(F.desc(score), key).limit(3)
        .agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(name).alias("n")))),
            lambda x: x["n"],
        ), ", ")).scalar()
    )
    return g.nodes.agg(F.count("*").alias("nodes")).select(
        "nodes", g.edges.agg(F.count("*")).scalar().alias("edges"),
        risk_word(risk.agg(F.coalesce(F.max("risk_score"), F.lit(0.0))).scalar()).alias("risk"),
        top(communities, "size", "community_id", "name").alias("communities"),
        top(flows, "criticality", "entry_point", "name").alias("flows"),
    )


def file_supergraph(g: CodeGraph, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files as nodes with symbol counts; directed cross-file edge counts."""
    rows = g.nodes if members is None else g.nodes.join(members, "qualified_name", "left")
    if members is None:
        rows = rows.withColumn("community_id", F.lit(None).cast("string"))
    seen = F.struct("line_start", "qualified_name")
    nodes = rows.where(F.col("file_path") != "").groupBy("file_path").agg(
        F.count_if(F.col("kind") != "File").alias("symbol_count"),
        F.coalesce(
            F.max_by("language", F.when(F.col("language") != "", seen)), F.lit("")
        ).alias("language"),
        F.min_by("community_id", F.when(F.col("community_id").isNotNull(), seen)).alias("community_id"),
    )
    parts = F.split("file_path", "/")
    label = F.when(F.size(parts) >= 2, F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("/"), F.element_at(parts, -1))).otherwise(F.col("file_path"))
    owner = g.nodes.select("qualified_name", "file_path")
    src = owner.toDF("source", "src_file")
    dst = owner.toDF("target", "dst_file")
    edges = (
        g.edges.select("source", "target").join(src, "source").join(dst, "target")
        .where(F.col("src_file") != F.col("dst_file"))
        .groupBy("src_file", "dst_file").agg(F.count("*").alias("weight"))
    )
    return nodes.withColumn("label", label), edges


def community_supergraph(g: CodeGraph, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities as nodes (uncategorised nodes under ``-1``); undirected edge counts."""
    full = g.nodes.select("qualified_name").join(members, "qualified_name", "left").select(
        "qualified_name", F.coalesce("community_id", F.lit("-1")).alias("community_id")
    )
    nodes = full.groupBy("community_id").agg(F.count("*").alias("member_count"))
    src = full.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("sc"))
    dst = full.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("dc"))
    edges = (
        g.edges.select("source", "target").join(src, "source").join(dst, "target")
        .where(F.col("sc") != F.col("dc"))
        .groupBy(F.least("sc", "dc").alias("community_a"), F.greatest("sc", "dc").alias("community_b"))
        .agg(F.count("*").alias("weight"))
    )
    return nodes, edges


def file_tree(g: CodeGraph, root: str = "") -> DataFrame:
    """Files below every directory of the stored paths."""
    from codelattice.functions.paths import relative_to

    rel = relative_to(F.col("file_path"), root) if root else F.col("file_path")
    parts = F.split(rel, "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    files = g.nodes.select("file_path").distinct()
    return files.select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def rank_share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentage of the group total per row."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("percent", rounded(F.col(value) * 100.0 / total, 2))
