"""One object for interactive use: every tool returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.model import CodeGraph
from codelattice.operators import communities as C
from codelattice.operators import flows as FL
from codelattice.operators import lookup as L
from codelattice.operators import refactor as RF
from codelattice.operators import relations as R
from codelattice.operators import risk as K
from codelattice.operators import search as SE
from codelattice.operators import summary as SM
from codelattice.operators import traversal as T
from codelattice.plans import pipelines as PL
from codelattice.session import stage
from codelattice.sinks.reports import export_graph
from codelattice.sinks.search_index import SearchIndex, build_graph_index, graph_index
from codelattice.sinks.store import read_graph, write_graph
from codelattice.sources.files import read_tree


class GraphTools:
    """Named questions over one graph, with its flow and community tables."""

    def __init__(self, graph: CodeGraph, root: str = "", index: SearchIndex | None = None):
        self.graph, self.root, self.index = graph, root, index

    @classmethod
    def build(cls, spark: SparkSession, root: str, path: str) -> GraphTools:
        """Read a source tree, store its graph and search index below ``path`` and open them."""
        write_graph(PL.build_from_files(read_tree(spark, root).select("file_path", "text", "language")), path)
        build_graph_index(spark, path, read_graph(spark, path).nodes)
        return cls.open(spark, path, root)

    @classmethod
    def open(cls, spark: SparkSession, path: str, root: str = "") -> GraphTools:
        return cls(read_graph(spark, path), root, graph_index(spark, path))

    @cached_property
    def flow_members(self) -> DataFrame:
        return stage(FL.trace_flows(self.graph), "flow_members")

    @cached_property
    def flows(self) -> DataFrame:
        return stage(FL.score_flows(self.graph, self.flow_members), "flows")

    @cached_property
    def members(self) -> DataFrame:
        return C.file_members(self.graph)

    def _paths(self, files: list[str]) -> DataFrame:
        return self.graph.spark.createDataFrame([(f,) for f in files], "file_path string")

    def register_views(self) -> None:
        """Plain Spark SQL over the graph: views ``nodes`` and ``edges``."""
        self.graph.nodes.createOrReplaceTempView("nodes")
        self.graph.edges.createOrReplaceTempView("edges")

    # Lookups

    def get_function(self, name: str) -> DataFrame:
        return L.best_function(self.graph, name)

    def get_callers(self, name: str, limit: int | None = 50) -> DataFrame:
        return R.callers_like(self.graph, name, limit)

    def get_callees(self, name: str, limit: int | None = 50) -> DataFrame:
        return R.callees_like(self.graph, name, limit)

    def get_file_summary(self, path: str) -> DataFrame:
        return L.file_symbols(self.graph, path)

    def get_nodes_by_file(self, path: str) -> DataFrame:
        return L.file_symbols(self.graph, path, ("File", "Class", "Function", "Type", "Test"))

    def get_edges_for_node(self, qualified_name: str) -> DataFrame:
        return L.edges_of_node(self.graph, qualified_name)

    def list_entry_points(self, limit: int | None = 100) -> DataFrame:
        return R.uncalled_functions(self.graph, limit)

    def search_nodes(self, pattern: str, limit: int | None = 20) -> DataFrame:
        """Term search on the indexed texts, else a substring match."""
        hits = SE.term_search(SE.node_documents(self.graph), pattern) if self.index is None else self.index.term_search(pattern)
        hits = hits.select(F.col("doc_id").alias("qualified_name"))
        found = L.nodes_among(self.graph, hits)
        if found.isEmpty():
            return L.search_nodes(self.graph, pattern, limit)
        return L._cut(found, [F.asc("qualified_name")], limit)

    def semantic_search_nodes(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return SE.hybrid_search(self.graph, query, kind, limit, index=self.index)

    def find_large_functions(self, min_lines: int = 50, limit: int | None = 50) -> DataFrame:
        return L.nodes_by_size(self.graph, min_lines, limit=limit)

    def query_graph(self, pattern: str, target: str) -> DataFrame:
        """One relation of one name; the name is resolved first."""
        relations: dict[str, Callable[[DataFrame], DataFrame]] = {
            "callers_of": lambda t: R.callers_of(self.graph, t),
            "callees_of": lambda t: R.callees_of(self.graph, t),
            "imports_of": lambda t: R.imports_of(self.graph, t),
            "importers_of": lambda t: R.importers_of(self.graph, t),
            "children_of": lambda t: R.children_of(self.graph, t),
            "tests_for": lambda t: R.tests_for(self.graph, t),
            "inheritors_of": lambda t: R.inheritors_of(
                self.graph, t.select(F.col("qualified_name").alias("base")).unionByName(t.select(F.col("name").alias("base")))
            ),
            "file_summary": lambda t: L.nodes_by_file(self.graph, t),
        }
        if pattern not in relations:
            raise ValueError(f"unknown pattern {pattern!r}; known: {', '.join(relations)}")
        if pattern == "callers_of" and target in S.BUILTIN_CALL_NAMES:
            return relations[pattern](self.graph.nodes.limit(0))
        found = L.resolve_target(self.graph, target, self.root)
        first = found.select("status").first()
        if first is not None and first["status"] == "ambiguous":
            return found.select("status", "qualified_name", "kind", "file_path")
        return relations[pattern](found)

    # Traversal and change review

    def get_impact_radius(self, files: list[str], max_depth: int = 2) -> DataFrame:
        return T.impact_radius(self.graph, self._paths(files), max_depth)

    def trace_path(self, start: str, goal: str, max_depth: int = 8) -> DataFrame:
        return T.call_path(self.graph, start, goal, max_depth)

    def neighborhood(self, name: str, depth: int = 1) -> DataFrame:
        return T.neighborhood(self.graph, name, depth)

    def get_flows(self, sort_by: str = "criticality", limit: int | None = 50) -> DataFrame:
        return FL.list_flows(self.flows, sort_by, limit)

    def get_flow(self, entry_point: str) -> DataFrame:
        return FL.flow_steps(self.flow_members, self.graph, entry_point)

    def get_affected_flows(self, files: list[str]) -> DataFrame:
        return FL.affected_flows(self.flows, self.flow_members, self.graph, self._paths(files))

    def detect_changes(self, files: list[str], ranges: DataFrame | None = None) -> dict[str, DataFrame]:
        return PL.review_changes(self.graph, self._paths(files), ranges, self.flows, self.flow_members, self.members)

    def get_review_context(self, files: list[str]) -> dict[str, DataFrame]:
        changed = self._paths(files)
        impact = T.impact_radius(self.graph, changed)
        inner = L.edges_among(self.graph, impact)
        gaps = R.review_test_gaps(self.graph, L.nodes_by_file(self.graph, changed), impact)
        return {"impact": impact, "edges": inner, "test_gaps": gaps, "guidance": K.impact_band(impact, inner, changed, gaps)}

    # Structure

    def get_stats(self) -> DataFrame:
        return SM.graph_stats(self.graph)

    def get_hubs(self, limit: int | None = 10) -> DataFrame:
        return SM.hub_functions(self.graph, limit)

    def list_communities(self, sort_by: str = "size", min_size: int = 0) -> DataFrame:
        return C.list_communities(C.community_table(self.graph, self.members), sort_by, min_size)

    def get_community(self, name: str) -> DataFrame:
        return C.find_community(C.community_table(self.graph, self.members), name)

    def get_architecture_overview(self) -> dict[str, DataFrame]:
        return {
            "communities": C.community_table(self.graph, self.members),
            "cross_edges": C.cross_edges(self.graph, self.members), "coupling": C.coupling(self.graph, self.members),
        }

    def find_dead_code(self, kind: str | None = None, file_pattern: str | None = None) -> DataFrame:
        return R.dead_code(self.graph, kind, file_pattern)

    def suggest_refactorings(self) -> dict[str, DataFrame]:
        return {"remove": R.dead_code(self.graph), "move": C.move_suggestions(self.graph, self.members)}

    def rename_preview(self, old: str, new: str) -> DataFrame:
        return RF.rename_preview(self.graph, old, new)

    def export(self, mode: str = "full") -> tuple[str, DataFrame, DataFrame]:
        return export_graph(self.graph, self.members, mode)
