"""Joins between nodes and edges: callers, callees, imports, tests, gaps.

Every relation takes a DataFrame of targets, so one plan answers one name or
all names of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.text import contains_text
from codelattice.model import CodeGraph
from codelattice.operators.lookup import _cut, entry_name, framework_decorator
from codelattice.session import shuffled


def _end(g: CodeGraph, edges: DataFrame, end: str, how: str = "inner") -> DataFrame:
    """Attach the node named by one edge end."""
    info = g.nodes.select(
        F.col("qualified_name").alias(end), F.col("name").alias("node_name"),
        F.col("kind").alias("node_kind"), F.col("file_path").alias("node_file"),
        F.col("line_start").alias("node_line"),
    )
    return edges.join(info, end, how)


def callers_like(g: CodeGraph, text: str, limit: int | None = 50) -> DataFrame:
    """Distinct callers of every target that equals or contains the text."""
    hits = g.edges_of("CALLS").where(
        (F.col("target") == text) | contains_text(F.col("target"), text, wildcards=True)
    )
    found = (
        _end(g, hits.select("source").distinct(), "source", "left")
        .select(F.col("source").alias("qualified_name"), F.col("node_file").alias("file_path"),
                F.col("node_line").alias("line_start"))
    )
    return _cut(found, [F.asc("qualified_name")], limit)


def callees_like(g: CodeGraph, text: str, limit: int | None = 50) -> DataFrame:
    hits = g.edges_of("CALLS").where(
        (F.col("source") == text) | contains_text(F.col("source"), text, wildcards=True)
    )
    found = (
        _end(g, hits.select("target").distinct(), "target", "left")
        .select(F.col("target").alias("qualified_name"), F.col("node_file").alias("file_path"),
                F.col("node_line").alias("line_start"))
    )
    return _cut(found, [F.asc("qualified_name")], limit)


def callers_of(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """Existing callers per target; bare-name calls only where no caller resolved.

    Bare built-in method names are left out, as they only produce noise.
    """
    wanted = targets.select("qualified_name", "name").distinct()
    calls = g.edges_of("CALLS").select("source", "target", F.col("line").alias("call_line"))
    known = g.nodes.select(F.col("qualified_name").alias("source"))
    alive = calls.join(known, "source", "left_semi")
    direct = wanted.join(alive, F.col("qualified_name") == F.col("target")).withColumn(
        "matched_by", F.lit("qualified")
    )
    found = direct.select("qualified_name").distinct()
    bare = (
        wanted.join(found, "qualified_name", "left_anti")
        .where(~F.col("name").isin(*S.BUILTIN_CALL_NAMES))
        .join(alive, F.col("name") == F.col("target"))
        .withColumn("matched_by", F.lit("bare"))
    )
    return direct.unionByName(bare).select("qualified_name", "source", "call_line", "matched_by")


def callees_of(g: CodeGraph, targets: DataFrame) -> DataFrame:
    wanted = targets.select(F.col("qualified_name").alias("source")).distinct()
    calls = g.edges_of("CALLS").select("source", "target", F.col("line").alias("call_line"))
    return _end(g, calls.join(wanted, "source", "left_semi"), "target").select(
        "source", "target", "call_line", "node_kind"
    )


def imports_of(g: CodeGraph, targets: DataFrame) -> DataFrame:
    wanted = targets.select(F.col("qualified_name").alias("source")).distinct()
    return g.edges_of("IMPORTS_FROM").join(wanted, "source", "left_semi").select(
        "source", F.col("target").alias("import_target"), "line"
    )


def importers_of(g: CodeGraph, files: DataFrame) -> DataFrame:
    wanted = files.select(F.col("file_path").alias("target")).distinct()
    return g.edges_of("IMPORTS_FROM").join(wanted, "target", "left_semi").select(
        F.col("target").alias("imported"), F.col("source").alias("importer"),
        F.col("file_path").alias("file"), "line",
    )


def children_of(g: CodeGraph, targets: DataFrame) -> DataFrame:
    wanted = targets.select(F.col("qualified_name").alias("source")).distinct()
    inside = g.edges_of("CONTAINS").join(wanted, "source", "left_semi")
    return _end(g, inside.select("source", "target"), "target").select(
        "source", F.col("target").alias("child"), F.col("node_kind").alias("child_kind")
    )


def inheritors_of(g: CodeGraph, bases: DataFrame) -> DataFrame:
    """Types naming a base; bases are stored unqualified."""
    wanted = bases.select(F.col("base").alias("target")).distinct()
    links = g.edges_of("INHERITS", "IMPLEMENTS").join(wanted, "target", "left_semi")
    return _end(g, links.select("source", "target"), "source").select(
        F.col("target").alias("base"), F.col("source").alias("child"), "node_kind"
    )


def tests_by_edge(g: CodeGraph, targets: DataFrame, tested_by: str = "as_read") -> DataFrame:
    """TESTED_BY partners; ``as_read`` looks at incoming edges, ``outgoing`` at the written direction."""
    links = g.edges_of("TESTED_BY").select("source", "target")
    own, other = ("target", "source") if tested_by == "as_read" else ("source", "target")
    wanted = targets.select(F.col("qualified_name").alias(own)).distinct()
    return _end(g, links.join(wanted, own, "left_semi"), other).select(
        F.col(own).alias("qualified_name"), F.col(other).alias("test")
    ).distinct()


def tests_by_name(g: CodeGraph, targets: DataFrame, prefixes: tuple[str, ...] = ("test_", "test")) -> DataFrame:
    """Test nodes whose qualified name holds ``<prefix><name>``.

    Each occurrence of a prefix in a test name yields every prefix of the text
    after it, so the substring test is an equi-join on the name.
    """
    tests = g.nodes.where("is_test").select(
        F.col("qualified_name").alias("test"), F.lower("qualified_name").alias("text")
    )
    wanted = targets.select("qualified_name", F.lower("name").alias("key")).distinct()
    parts = []
    for prefix in prefixes:
        starts = tests.select(
            "test", "text",
            F.explode(
                F.filter(
                    F.sequence(F.lit(1), F.length("text")),
                    lambda i: F.substring(F.col("text"), i, len(prefix)) == prefix,
                )
            ).alias("at"),
        )
        rest = starts.select("test", F.col("text").substr(F.col("at") + len(prefix), F.length("text")).alias("rest"))
        parts.append(
            rest.where(F.length("rest") > 0).select(
                "test",
                F.explode(
                    F.transform(F.sequence(F.lit(1), F.length("rest")), lambda n: F.substring(F.col("rest"), 1, n))
                ).alias("key"),
            )
        )
    keyed = parts[0]
    for more in parts[1:]:
        keyed = keyed.unionByName(more)
    return wanted.join(keyed.distinct(), "key").select("qualified_name", "test").distinct()


def tests_for(g: CodeGraph, targets: DataFrame, tested_by: str = "as_read") -> DataFrame:
    return tests_by_edge(g, targets, tested_by).unionByName(tests_by_name(g, targets)).distinct()


def uncalled_functions(g: CodeGraph, limit: int | None = 100) -> DataFrame:
    """Functions that no CALLS edge names, in (file, line) order."""
    called = g.edges_of("CALLS").select(F.col("target").alias("qualified_name"))
    found = g.nodes_of("Function", "Method").join(called, "qualified_name", "left_anti").select(
        "kind", "name", "qualified_name", "file_path", "line_start", "language"
    )
    return _cut(found, [F.asc("file_path"), F.asc("line_start"), F.asc("qualified_name")], limit)


def entry_points(g: CodeGraph, decorators: bool = False) -> DataFrame:
    """Functions and tests that are uncalled, decorated (optional) or named as entries."""
    called = g.edges_of("CALLS").select(F.col("target").alias("qualified_name")).distinct().withColumn(
        "called", F.lit(True)
    )
    named = entry_name(F.col("name"))
    if decorators:
        named = named | framework_decorator(F.col("decorators"))
    return (
        g.nodes_of("Function", "Test").join(shuffled(called), "qualified_name", "left")
        .where(F.col("called").isNull() | named).drop("called")
    )


def dead_code(g: CodeGraph, kind: str | None = None, file_pattern: str | None = None,
              decorators: bool = False) -> DataFrame:
    """Non-test, non-entry functions and classes nobody calls, tests or imports."""
    found = g.nodes_of(*([kind] if kind else ["Function", "Class"])).where(~F.col("is_test"))
    if file_pattern:
        found = found.where(contains_text(F.col("file_path"), file_pattern, wildcards=True))
    excluded = entry_name(F.col("name"))
    if decorators:
        excluded = excluded | framework_decorator(F.col("decorators"))
    used = g.edges_of("CALLS", "TESTED_BY", "IMPORTS_FROM").select(F.col("target").alias("qualified_name"))
    return found.where(~excluded).join(used, "qualified_name", "left_anti").select(
        "name", "qualified_name", "kind", F.col("file_path").alias("file"), F.col("line_start").alias("line")
    )


def test_gaps(g: CodeGraph, changed: DataFrame, tested_by: str = "as_read") -> DataFrame:
    """Changed symbols that are no tests and have no TESTED_BY edge."""
    end = "target" if tested_by == "as_read" else "source"
    covered = g.edges_of("TESTED_BY").select(F.col(end).alias("qualified_name"))
    return (
        changed.where(F.col("kind").isin("Function", "Test", "Class") & ~F.col("is_test"))
        .join(shuffled(covered), "qualified_name", "left_anti")
        .select("name", "qualified_name", F.col("file_path").alias("file"), "line_start", "line_end")
    )


def review_test_gaps(g: CodeGraph, changed: DataFrame, around: DataFrame) -> DataFrame:
    """Changed functions that are no source of a TESTED_BY edge inside the impact set."""
    inner = around.select("qualified_name").distinct()
    links = (
        g.edges_of("TESTED_BY").select("source", "target")
        .join(inner.withColumnRenamed("qualified_name", "source"), "source", "left_semi")
        .join(inner.withColumnRenamed("qualified_name", "target"), "target", "left_semi")
    )
    return (
        changed.where((F.col("kind") == "Function") & ~F.col("is_test"))
        .join(links.select(F.col("source").alias("qualified_name")), "qualified_name", "left_anti")
        .select("qualified_name", "file_path")
    )
