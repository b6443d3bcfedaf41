"""Command line: build a graph from a tree and ask it questions.

    python -m codelattice build ROOT GRAPH
    python -m codelattice ask GRAPH callers_of NAME
    python -m codelattice stats|dead-code|entry-points|flows|communities GRAPH
    python -m codelattice impact GRAPH FILE...
    python -m codelattice detect-changes GRAPH REPO [BASE]
    python -m codelattice search GRAPH QUERY
    python -m codelattice export GRAPH OUT [auto|full|community|file]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from codelattice.api import GraphTools
from codelattice.sources import files as FI
from codelattice.sources.diff import parse_unified_diff


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codelattice", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("command", choices=[
        "build", "ask", "stats", "dead-code", "entry-points", "flows", "communities", "impact", "detect-changes",
        "search", "export"])
    parser.add_argument("args", nargs="*")
    parser.add_argument("--rows", type=int, default=50)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("codelattice").getOrCreate()
    first, *rest = given.args
    if given.command == "build":
        GraphTools.build(spark, first, rest[0]).get_stats().show(given.rows, False)
        return
    tools = GraphTools.open(spark, first)
    if given.command == "export":
        mode, nodes, edges = tools.export(rest[1] if len(rest) > 1 else "full")
        nodes.write.mode("overwrite").json(f"{rest[0]}/{mode}/nodes")
        edges.write.mode("overwrite").json(f"{rest[0]}/{mode}/edges")
        return
    if given.command == "detect-changes":
        base = rest[1] if len(rest) > 1 else "HEAD~1"
        names = [r["file_path"] for r in FI.changed_files(spark, rest[0], base).collect()]
        ranges = parse_unified_diff(FI.diff_text(spark, rest[0], base)).select("file_path", "start", "end")
        review = tools.detect_changes(names, ranges)
        for part in ("summary", "priorities", "test_gaps"):
            review[part].show(given.rows, False)
        return
    answers = {
        "ask": lambda: tools.query_graph(rest[0], rest[1]),
        "stats": tools.get_stats,
        "dead-code": tools.find_dead_code,
        "entry-points": tools.list_entry_points,
        "flows": tools.get_flows,
        "communities": tools.list_communities,
        "impact": lambda: tools.get_impact_radius(rest),
        "search": lambda: tools.semantic_search_nodes(" ".join(rest)),
    }
    answers[given.command]().show(given.rows, False)


if __name__ == "__main__":
    main()
