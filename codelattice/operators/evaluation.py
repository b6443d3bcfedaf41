"""Metrics of the evaluation harness, as set aggregates per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.numbers import rounded
from codelattice.functions.text import token_estimate
from codelattice.model import CodeGraph


def precision_recall(predicted: DataFrame, actual: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Precision, recall and F1 of item sets per key; both empty counts as 1."""
    p = predicted.select(*keys, item).distinct().withColumn("p", F.lit(1))
    a = actual.select(*keys, item).distinct().withColumn("a", F.lit(1))
    sums = p.join(a, [*keys, item], "full").groupBy(*keys).agg(
        F.sum(F.coalesce("p", F.lit(0))).alias("np"), F.sum(F.coalesce("a", F.lit(0))).alias("na"),
        F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("hit"),
    )
    precision = F.when(F.col("np") > 0, F.col("hit") / F.col("np")).otherwise(0.0)
    recall = F.when(F.col("na") > 0, F.col("hit") / F.col("na")).otherwise(0.0)
    return sums.withColumn("precision", precision).withColumn("recall", recall).select(
        *keys, F.col("np").alias("predicted"), F.col("na").alias("actual"), "hit",
        rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"),
        rounded(F.when(F.col("precision") + F.col("recall") > 0,
                       F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                .otherwise(0.0)).alias("f1"),
    )


def reciprocal_rank(ranked: DataFrame, keys: list[str], position: str, is_hit: Column) -> DataFrame:
    """1 / (1-based position of the first hit), 0 without one."""
    first = ranked.groupBy(*keys).agg(F.min(F.when(is_hit, F.col(position))).alias("first"))
    return first.select(
        *keys, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank")
    )


def token_efficiency(raw: Column, graph: Column) -> tuple[Column, Column]:
    """Ratio of graph to raw tokens and the reduction in percent."""
    ratio = F.when(raw > 0, graph / raw).otherwise(0.0)
    return rounded(ratio), rounded(F.when(raw > 0, (F.lit(1.0) - graph / raw) * 100).otherwise(0.0), 2)


def token_totals(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    return texts.groupBy(*keys).agg(F.sum(token_estimate(F.col(text))).alias("tokens"))


def changed_file_truth(g: CodeGraph, changed_files: DataFrame) -> DataFrame:
    """Files one reverse CALLS or IMPORTS_FROM hop away, plus the changed ones."""
    changed = changed_files.select("file_path").distinct()
    inside = g.nodes.join(changed, "file_path", "left_semi").select(F.col("qualified_name").alias("target"))
    users = (
        g.edges_of("CALLS", "IMPORTS_FROM").join(inside, "target", "left_semi").select("source")
        .join(g.nodes.select(F.col("qualified_name").alias("source"), "file_path"), "source").select("file_path")
    )
    return users.unionByName(changed).distinct()


def flow_recall(flows: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected entry names that occur inside some flow's entry point."""
    from codelattice.operators.rules import contains_join

    found = contains_join(flows.select("entry_point"), "entry_point", expected.select("expected"), "expected")
    hit = found.select("expected").distinct().agg(F.count("*")).scalar()
    return expected.select("expected").distinct().agg(
        F.count("*").alias("expected"), F.first(hit).alias("found"),
    ).withColumn("recall", rounded(F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0)))


def report_pivot(results: DataFrame) -> DataFrame:
    """Mean reciprocal rank and latest F1 / recall per repository."""
    return results.groupBy("repo").agg(
        rounded(F.avg("reciprocal_rank")).alias("mrr"), F.max_by("f1", "seq").alias("f1"),
        F.max_by("recall", "seq").alias("recall"),
    )
