"""Rename previews and the edits they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.model import CodeGraph
from codelattice.operators.lookup import keyword_match


def rename_target(g: CodeGraph, old_name: str) -> DataFrame:
    """Exact name first, else the first keyword hit."""
    return (
        g.nodes.where(keyword_match(old_name))
        .orderBy((F.col("name") != old_name).cast("int"), "qualified_name").limit(1)
    )


def rename_edits(g: CodeGraph, symbols: DataFrame) -> DataFrame:
    """Edit sites of renaming each symbol (one name or the whole graph).

    Definition and resolved call sites come first and are all kept; bare calls
    and imports only add places not listed before.
    """
    sym = symbols.select("qualified_name", "name", F.col("file_path").alias("file"), F.col("line_start").alias("line"))
    cols = ["qualified_name", "file", "line", "site"]
    definition = sym.withColumn("site", F.lit("definition")).select(*cols)
    by_name = g.edges.select("kind", "target", F.col("file_path").alias("file"), "line")
    own = sym.select("qualified_name", F.col("qualified_name").alias("target"))
    calls = by_name.where(F.col("kind") == "CALLS").join(own, "target").withColumn("site", F.lit("call")).select(*cols)
    bare = (
        by_name.where(F.col("kind") == "CALLS")
        .join(sym.select("qualified_name", F.col("name").alias("target")), "target")
        .select("qualified_name", "file", "line").distinct()
    )
    imports = by_name.where(F.col("kind") == "IMPORTS_FROM").join(own, "target").select(
        "qualified_name", "file", "line"
    ).distinct()
    seen = definition.unionByName(calls)
    place = ["qualified_name", "file", "line"]
    bare_new = bare.join(seen.select(*place), place, "left_anti").withColumn("site", F.lit("bare_call"))
    import_new = imports.join(
        seen.select(*place).unionByName(bare.select(*place)), place, "left_anti"
    ).withColumn("site", F.lit("import"))
    return seen.unionByName(bare_new.select(*cols)).unionByName(import_new.select(*cols))


def rename_preview(g: CodeGraph, old_name: str, new_name: str) -> DataFrame:
    return rename_edits(g, rename_target(g, old_name)).select(
        "qualified_name", "file", "line", "site", F.lit(old_name).alias("old"), F.lit(new_name).alias("new"),
        F.lit("high").alias("confidence"),
    )


def live_previews(previews: DataFrame, now, ttl_seconds: int = 600) -> DataFrame:
    """Previews younger than the time to live."""
    return previews.where(F.col("created_at") >= F.lit(now) - F.lit(ttl_seconds))


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """New text per edited file; the first occurrence on the edit's line is replaced.

    An edit whose line does not hold the name falls back to the first
    occurrence in the file. Edits of one file are folded inside its row.
    """
    per_file = edits.groupBy(F.col("file").alias("file_path")).agg(
        F.sort_array(F.collect_set(F.struct("line", "old", "new"))).alias("edits")
    )

    def on_line(lines, e):
        at = e["line"] - 1
        held = F.coalesce(F.contains(F.try_element_at(lines, e["line"]), e["old"]), F.lit(False))
        spot = F.array_position(F.transform(lines, lambda x: F.contains(x, e["old"]).cast("int")), 1) - 1
        index = F.when(held, at).otherwise(spot)
        return F.transform(
            lines,
            lambda x, i: F.when(
                i == index,
                F.concat(F.split(x, _quote(e["old"]), 2)[0], e["new"], F.coalesce(F.get(F.split(x, _quote(e["old"]), 2), F.lit(1)), F.lit(""))),
            ).otherwise(x),
        )

    done = F.aggregate("edits", F.split("text", "\n"), on_line)
    return sources.join(per_file, "file_path").select("file_path", F.array_join(done, "\n").alias("text"))


def _quote(text):
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def safe_paths(edits: DataFrame, root: str) -> DataFrame:
    """Edits that stay inside the root; a path with ``..`` never does."""
    inside = F.col("file").startswith(root.rstrip("/") + "/") | ~F.col("file").startswith("/")
    return edits.where(inside & ~F.col("file").rlike(r"(^|/)\.\.(/|$)"))
