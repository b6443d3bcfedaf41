"""Connected components of an edge table by alternating star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codelattice.llm.common import staged


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table in the shared folder, and a fingerprint of their set."""
    seen = Observation()
    print_of = F.bit_xor(F.xxhash64("u", "v")).alias("x")
    rows = staged(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), print_of), "component_edges")
    return rows, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another node; component is its smallest node.

    Each round writes the edges once. The large step joins every neighbour above a node to the
    smallest node around it, the small step does so below; rounds end when no edge changes. Minima
    are combined before the shuffle, and the join back has one row per node on one side, so a node
    with very many edges is split by Spark's skew handling.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    rows, mark = _stored(pairs)
    while mark[0]:
        both = rows.select("u", "v").unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = staged(large.distinct(), "component_large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        rows, after = _stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
        if after == mark:
            break
        mark = after
    found = rows.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def merge_labels(labels, left, right):
    """Unite entries of a small label array (a root names itself) along links; all in memory of one task."""
    import numpy as np

    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
    return labels
