"""Projections, filters and point lookups on nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.paths import base_name
from codelattice.functions.text import contains_text, matches_any, sanitize_name
from codelattice.model import CodeGraph

SYMBOL_KINDS = ("Function", "Method", "Class")


def node(g: CodeGraph, qualified_name: str) -> DataFrame:
    return g.nodes.where(F.col("qualified_name") == qualified_name)


def nodes_by_file(g: CodeGraph, files: DataFrame) -> DataFrame:
    """Nodes whose ``file_path`` occurs in ``files``; none for an empty list."""
    return g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi")


def nodes_by_kind(g: CodeGraph, kinds: list[str], file_pattern: str | None = None) -> DataFrame:
    found = g.nodes.where(F.col("kind").isin(*kinds)) if kinds else g.nodes.limit(0)
    if file_pattern:
        found = found.where(contains_text(F.col("file_path"), file_pattern, wildcards=True))
    return found


def nodes_by_size(
    g: CodeGraph,
    min_lines: int = 50,
    max_lines: int | None = None,
    kind: str | None = None,
    file_pattern: str | None = None,
    limit: int | None = 50,
) -> DataFrame:
    size = (F.col("line_end") - F.col("line_start") + 1).cast("bigint")
    found = g.nodes.where(F.col("line_start").isNotNull() & F.col("line_end").isNotNull())
    found = found.withColumn("line_count", size).where(F.col("line_count") >= min_lines)
    if max_lines is not None:
        found = found.where(F.col("line_count") <= max_lines)
    if kind:
        found = found.where(F.col("kind") == kind)
    if file_pattern:
        found = found.where(contains_text(F.col("file_path"), file_pattern, wildcards=True))
    return _cut(found, [F.desc("line_count"), F.asc("qualified_name")], limit)


def _cut(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Top rows under a total order; without a limit the order is left open."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def edges_by_source(g: CodeGraph, qualified_name: str) -> DataFrame:
    return g.edges.where(F.col("source") == qualified_name)


def edges_by_target(g: CodeGraph, qualified_name: str) -> DataFrame:
    return g.edges.where(F.col("target") == qualified_name)


def edges_by_bare_target(g: CodeGraph, kind: str = "CALLS") -> DataFrame:
    """Edges that still name an unqualified target."""
    return g.edges_of(kind).where(~F.col("target").contains("::"))


def edges_of_node(g: CodeGraph, qualified_name: str) -> DataFrame:
    return g.edges.where((F.col("source") == qualified_name) | (F.col("target") == qualified_name))


def _names(names: DataFrame) -> DataFrame:
    return names.select("qualified_name").distinct()


def edges_among(g: CodeGraph, names: DataFrame) -> DataFrame:
    keep = _names(names)
    return g.edges.join(keep, g.edges["source"] == keep["qualified_name"], "left_semi").join(
        _names(names).withColumnRenamed("qualified_name", "target"), "target", "left_semi"
    )


def nodes_among(g: CodeGraph, names: DataFrame) -> DataFrame:
    return g.nodes.join(_names(names), "qualified_name", "left_semi")


def subgraph(g: CodeGraph, names: DataFrame) -> CodeGraph:
    return CodeGraph(nodes_among(g, names), edges_among(g, names))


def outgoing_targets(g: CodeGraph, names: DataFrame) -> DataFrame:
    keep = _names(names).withColumnRenamed("qualified_name", "source")
    return g.edges.join(keep, "source", "left_semi").select("target")


def incoming_sources(g: CodeGraph, names: DataFrame) -> DataFrame:
    keep = _names(names).withColumnRenamed("qualified_name", "target")
    return g.edges.join(keep, "target", "left_semi").select("source")


def all_files(g: CodeGraph) -> DataFrame:
    return g.nodes_of("File").select("file_path").distinct()


def call_targets(g: CodeGraph) -> DataFrame:
    return g.edges_of("CALLS").select("target").distinct()


def files_matching(g: CodeGraph, suffix: str) -> DataFrame:
    return (
        g.nodes.where(F.lower("file_path").endswith(suffix.lower())).select("file_path").distinct()
    )


def keyword_match(query: str) -> Column:
    """Every word must occur in the name or the qualified name."""
    hit = F.lit(bool(query.split()))
    for word in query.lower().split():
        hit = hit & (
            contains_text(F.col("name"), word, wildcards=True)
            | contains_text(F.col("qualified_name"), word, wildcards=True)
        )
    return hit


def search_nodes(g: CodeGraph, query: str, limit: int | None = 20) -> DataFrame:
    return _cut(g.nodes.where(keyword_match(query)), [F.asc("qualified_name")], limit)


def list_nodes(
    g: CodeGraph, kind: str | None = None, file_path: str | None = None,
    limit: int | None = 100, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """One page in (kind, file, line) order, and the total over the predicate."""
    found = g.nodes
    if kind:
        found = found.where(F.col("kind") == kind)
    if file_path:
        found = found.where(contains_text(F.col("file_path"), file_path, wildcards=True))
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("kind", "file_path", "line_start", "qualified_name").offset(offset)
    return (page if limit is None else page.limit(limit)), total


def list_edges(
    g: CodeGraph, kind: str | None = None, limit: int | None = 100, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    found = g.edges_of(kind) if kind else g.edges
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("kind", "file_path", "line", "source", "target").offset(offset)
    return (page if limit is None else page.limit(limit)), total


def best_function(g: CodeGraph, name: str) -> DataFrame:
    """Function whose name or qualified name fits, shortest qualified name first."""
    fits = (
        (F.col("name") == name) | (F.col("qualified_name") == name)
        | contains_text(F.col("qualified_name"), name, wildcards=True)
    )
    return (
        g.nodes_of("Function", "Method").where(fits)
        .orderBy(F.length("qualified_name"), "qualified_name").limit(1)
    )


def file_symbols(g: CodeGraph, path: str, kinds: tuple[str, ...] = SYMBOL_KINDS) -> DataFrame:
    """Symbols of a file; falls back to a base-name match when the path is unknown."""
    symbols = g.nodes_of(*kinds)
    exact = symbols.where(F.col("file_path") == path)
    base = path.rsplit("/", 1)[-1]
    loose = symbols.where(contains_text(F.col("file_path"), base, wildcards=True))
    known = exact.select(F.lit(1).alias("known")).limit(1)
    fallback = loose.join(known, F.lit(True), "left_anti")
    return exact.unionByName(fallback)


def functions_by_file_name(g: CodeGraph) -> DataFrame:
    """Symbols of every file keyed by base name (the bulk file map)."""
    return g.nodes_of(*SYMBOL_KINDS).select(
        base_name(F.col("file_path")).alias("base_name"), "file_path", "kind", "name",
        "qualified_name", "line_start", "line_end",
    )


def resolve_target(g: CodeGraph, target: str, root: str = "") -> DataFrame:
    """Name resolution: exact, then under the root, then a keyword search of five.

    Returns the candidates of the first stage that has any, with ``status``
    ``ok`` for one hit and ``ambiguous`` for more; no row means not found.
    """
    joined = f"{root.rstrip('/')}/{target}" if root else target
    staged = (
        node(g, target).withColumn("stage", F.lit(1))
        .unionByName(node(g, joined).withColumn("stage", F.lit(2)))
        .unionByName(search_nodes(g, target, 5).withColumn("stage", F.lit(3)))
    )
    best = staged.agg(F.min("stage")).scalar()
    hits = staged.where(F.col("stage") == best)
    count = hits.agg(F.count("*")).scalar()
    return hits.withColumn("status", F.when(count == 1, "ok").otherwise("ambiguous"))


def flag_predicates(g: CodeGraph, decorators: bool = False) -> DataFrame:
    """Per-node predicates: entry name, decorator, test name, security word."""
    from codelattice.functions.paths import is_test_file, is_test_function
    from codelattice.functions.text import contains_any

    return g.nodes.select(
        "qualified_name",
        entry_name(F.col("name")).alias("entry_name"),
        framework_decorator(F.col("decorators")).alias("framework_decorator"),
        is_test_file(F.col("file_path")).alias("test_file"),
        is_test_function(F.col("name"), F.col("file_path")).alias("test_function"),
        contains_any(S.SECURITY_KEYWORDS, F.col("name"), F.col("qualified_name")).alias("security"),
        contains_any(S.RISK_INDEX_KEYWORDS, F.col("name")).alias("risk_index_security"),
    )


def entry_name(name: Column) -> Column:
    return matches_any(S.ENTRY_NAME_PATTERNS, name)


def framework_decorator(decorators: Column) -> Column:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in S.FRAMEWORK_DECORATOR_PATTERNS)
    return F.coalesce(F.exists(decorators, lambda d: d.rlike(pattern)), F.lit(False))


def slim(df: DataFrame) -> DataFrame:
    """Output form: names sanitised, bulky columns removed."""
    out = df.drop("extra", "decorators", "file_hash", "id")
    for name in ("name", "qualified_name", "source", "target"):
        if name in out.columns:
            out = out.withColumn(name, sanitize_name(F.col(name)))
    return out


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; Spark trims each task to ``k`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")
