"""The graph value object every operator works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeGraph:
    """A directed labelled multigraph as two DataFrames.

    ``nodes`` is keyed by ``qualified_name``; an edge end is a plain string
    that may name something which is not a node.
    """

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    def nodes_of(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))
