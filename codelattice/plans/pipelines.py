"""End-to-end jobs: build, update, change review, scan and hunt over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.paths import is_test_file
from codelattice.model import CodeGraph
from codelattice.operators import findings as FD
from codelattice.operators import flows as FL
from codelattice.operators import relations as R
from codelattice.operators import resolve as RS
from codelattice.operators import risk as K
from codelattice.operators.lookup import _cut
from codelattice.operators.relations import uncalled_functions
from codelattice.operators.traversal import dependent_files
from codelattice.session import stage
from codelattice.sinks.search_index import refresh_graph_index
from codelattice.sinks.store import read_graph, replace_files, replace_files_at, stored_hashes
from codelattice.sources import notebooks as NB
from codelattice.sources.code import contains_edges, extract_python, import_names, nodes_of, raw_edges
from codelattice.sources.files import files_to_parse
from codelattice.sources.line_patterns import GROUP, extract_by_lines


def graph_of_records(records: DataFrame, languages: DataFrame, files: DataFrame) -> CodeGraph:
    """Records of any reader to a resolved graph; every resolution step is a join.

    ``languages``: file_path, language; ``files``: all known paths.
    """
    # The readers run once: every later step reads the stored records.
    records = stage(records, "records", ("rec",))
    typed = records.join(languages, "file_path")
    nodes = nodes_of(typed, F.col("language"))
    edges = raw_edges(records)
    imports = edges.where(F.col("kind") == "IMPORTS_FROM").join(languages, "file_path")
    modules = RS.resolve_modules(
        imports.select("file_path", F.col("target").alias("module"), "language"), files
    ).select("file_path", "module", "resolved")
    linked = edges.join(
        modules.where(F.col("resolved").isNotNull()).withColumnRenamed("module", "target"), ["file_path", "target"], "left"
    ).select(
        "kind", "source",
        F.when(F.col("kind") == "IMPORTS_FROM", F.coalesce("resolved", "target")).otherwise(F.col("target")).alias("target"),
        "file_path", "line",
    )
    # A file-level definition wins over an import, an import over a nested definition.
    named = RS.resolve_same_file(nodes.where("top_level"), linked)
    imported = RS.resolve_imported(named, import_names(records), modules)
    # Component files stop after the file-level step.
    bound = RS.resolve_same_file(nodes.where(F.col("language") != "vue"), imported)
    tested = RS.tested_by_edges(nodes, bound, is_test_file)
    # The later definition of a qualified name is the one kept.
    rest = [c for c in nodes.columns if c not in ("qualified_name", "top_level", "container")]
    unique = nodes.groupBy("qualified_name").agg(
        F.max_by(F.struct(*rest), F.col("line_start")).alias("_r")
    ).select("qualified_name", "_r.*")
    everything = bound.unionByName(contains_edges(nodes)).unionByName(tested).distinct()
    return CodeGraph(unique, everything)


def build_from_files(files: DataFrame, known: DataFrame | None = None) -> CodeGraph:
    """(file_path, text, language) to the code graph.

    ``known`` (file_path) names files that imports may lead to besides those read, as in an update.

    Python goes through the syntax tree, notebooks through their Python and R cells, R and
    other languages through line patterns. Tables named in SQL cells become imports.
    """
    # At most one row per supported language; absent readers stay out of the plan.
    present = {r["language"] for r in files.select("language").distinct().collect()}
    export = (F.col("language") == "python") & F.col("text").startswith("# Databricks notebook source\n")
    cells = NB.exported_cells(files.where(export))
    if "notebook" in present:
        cells = cells.unionByName(NB.notebook_cells(files.where(F.col("language") == "notebook")))
    plain = files.where((F.col("language") == "python") & ~export).select("file_path", "text")
    records = extract_python(plain.unionByName(NB.joined_code(cells)))
    by_lines = NB.joined_code(cells, "r").withColumn("language", F.lit("r"))
    scripts = present & set(GROUP)
    if scripts:
        others = files.where(F.col("language").isin(*scripts) & (F.col("language") != "vue")).select(
            "file_path", "text", "language"
        )
        if "vue" in scripts:
            others = others.unionByName(NB.component_code(files.where(F.col("language") == "vue")))
        by_lines = by_lines.unionByName(others)
    records = records.unionByName(extract_by_lines(by_lines))
    # Every file has its node, also those that no reader takes.
    unread = files.where(~F.col("language").isin("python", *scripts)).select(
        F.lit("node").alias("rec"), F.lit("File").alias("kind"), F.col("file_path").alias("name"), "file_path",
        F.lit(1).alias("line_start"), F.size(F.split("text", "\r\n|\r|\n")).alias("line_end"),
    )
    records = records.unionByName(unread, allowMissingColumns=True)
    languages = files.select(
        "file_path", F.when(F.col("language") == "notebook", "python").otherwise(F.col("language")).alias("language")
    )
    paths = files.select("file_path") if known is None else files.select("file_path").unionByName(known.select("file_path")).distinct()
    g = graph_of_records(records, languages, paths)
    return CodeGraph(g.nodes, g.edges.unionByName(NB.table_lineage(cells)))


def _to_update(g: CodeGraph, hashes: DataFrame, files: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to read again, files that went): changed ones and their dependents whose hash differs."""
    around = dependent_files(g, changed).select("file_path")
    wanted = changed.select("file_path").unionByName(around).distinct()
    present = files.join(wanted, "file_path", "left_semi")
    todo = files_to_parse(present, hashes).select("file_path")
    return todo, wanted.join(files.select("file_path"), "file_path", "left_anti")


def update_from_files(g: CodeGraph, hashes: DataFrame, files: DataFrame, changed: DataFrame) -> CodeGraph:
    """Re-read changed files and their dependents whose hash differs; deleted files go.

    ``files`` is the current tree: file_path, text, language, file_hash.
    """
    todo, deleted = _to_update(g, hashes, files, changed)
    fresh = build_from_files(files.join(todo, "file_path", "left_semi"), files)
    return replace_files(g, todo.unionByName(deleted), fresh.nodes, fresh.edges)


def update_stored(spark: SparkSession, path: str, files: DataFrame, changed: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """``update_from_files`` on a stored graph: nodes, edges and hashes of the files change in one commit."""
    g, hashes = read_graph(spark, path), stored_hashes(spark, path)
    todo, deleted = _to_update(g, hashes, files, changed)
    todo = stage(todo, "files_to_read")
    read = files.join(todo, "file_path", "left_semi")
    fresh = build_from_files(read, files)
    nodes, gone = stage(fresh.nodes, "read_nodes"), stage(todo.unionByName(deleted), "replaced")
    refresh_graph_index(spark, path, gone, nodes, batch)
    return replace_files_at(spark, path, gone, nodes, fresh.edges, read.select("file_path", "file_hash"), batch)


def review_changes(
    g: CodeGraph, changed_files: DataFrame, ranges: DataFrame | None, flows: DataFrame, members: DataFrame,
    communities: DataFrame, keywords: tuple[str, ...] = S.SECURITY_KEYWORDS,
) -> dict[str, DataFrame]:
    """All tables of a change review from one set of changed nodes."""
    nodes = K.changed_nodes(g, changed_files, ranges)
    risks = K.change_risk(g, nodes, FL.flow_counts(members), communities, keywords)
    gaps = R.test_gaps(g, nodes)
    hit = FL.affected_flows(flows, members, g, changed_files)
    return {
        "changed": risks, "test_gaps": gaps, "affected_flows": hit, "priorities": K.priorities(risks),
        "summary": K.change_summary(risks, gaps, hit, changed_files),
    }


def scan(raw: DataFrame, stored: DataFrame | None, run_id) -> dict[str, DataFrame]:
    """Raw findings of one run: deduplicated, normalised and merged into the store."""
    found = FD.normalise(FD.deduplicate(raw).drop("merged"))
    if stored is None:
        fresh = FD.fold_history(found.withColumn("run_id", F.lit(run_id))).drop("runs")
        return {"findings": found, "store": fresh, "is_new": found.select("fingerprint").distinct()}
    merged = FD.upsert(stored, found.select("fingerprint", *[c for c in found.columns if c in stored.columns and c != "fingerprint"], "seq"), run_id)
    return {"findings": found, "store": merged.drop("is_new", "in_run"), "is_new": merged.where("is_new").select("fingerprint")}


def hunt_candidates(g: CodeGraph, flows: DataFrame, limit: int | None = 10) -> DataFrame:
    """Flow entries first, then uncalled functions, unique by qualified name."""
    first = flows.select(F.col("entry_point").alias("qualified_name"), F.lit(1).alias("priority"))
    second = uncalled_functions(g, None).select("qualified_name", F.lit(2).alias("priority"))
    merged = first.unionByName(second).groupBy("qualified_name").agg(F.min("priority").alias("priority"))
    return _cut(merged, [F.asc("priority"), F.asc("qualified_name")], limit)


def analyse(findings: DataFrame, ask, text_column: str = "answer") -> DataFrame:
    """Findings with a verdict struct; ``ask`` is a pandas UDF from prompt text to answer text."""
    from codelattice.functions.findings import parse_verdict

    prompt = F.concat_ws(
        "\n", F.concat(F.lit("Rule: "), "rule_id"), F.concat(F.lit("Severity: "), "severity"),
        F.concat(F.lit("Location: "), "file_path", F.lit(":"), F.col("line_start").cast("string")),
    )
    return findings.withColumn(text_column, ask(prompt)).withColumn("v", parse_verdict(F.col(text_column)))
