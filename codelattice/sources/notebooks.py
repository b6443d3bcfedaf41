"""Notebook files to typed cells, code texts and table lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.schema import SQL_TABLE_PATTERN

_NOTEBOOK = (
    "metadata struct<kernelspec:struct<language:string>,language_info:struct<name:string>>, "
    "cells array<struct<cell_type:string,source:string>>"
)


def notebook_cells(files: DataFrame) -> DataFrame:
    """(file_path, cell_index, language, source) of the code cells of ``.ipynb`` texts.

    Kernels other than Python and R are skipped; a leading ``%sql``, ``%r`` or
    ``%python`` switches the cell; ``%scala``, ``%md`` and ``%sh`` drop it.
    """
    nb = F.from_json("text", _NOTEBOOK)
    kernel = F.lower(F.coalesce(nb["metadata"]["kernelspec"]["language"], nb["metadata"]["language_info"]["name"], F.lit("python")))
    rows = files.select("file_path", kernel.alias("kernel"), F.posexplode(nb["cells"]).alias("cell_index", "cell"))
    rows = rows.where(F.col("kernel").isin("python", "r") & (F.col("cell.cell_type") == "code"))
    # A source is one string or a list of lines; a list arrives as JSON text.
    listed = F.array_join(F.from_json("cell.source", "array<string>"), "")
    rows = rows.withColumn(
        "body", F.when(F.col("cell.source").startswith("["), F.coalesce(listed, F.col("cell.source"))).otherwise(F.col("cell.source"))
    ).where(F.length("body") > 0)
    first = F.trim(F.split_part(F.col("body"), F.lit("\n"), F.lit(1)))
    word = F.split_part(first, F.lit(" "), F.lit(1))
    switched = F.when(word == "%python", "python").when(word == "%sql", "sql").when(word == "%r", "r")
    language = F.coalesce(switched, F.col("kernel"))
    rest = F.when(switched.isNotNull(), F.substring_index("body", "\n", -1000000)).otherwise(F.col("body"))
    rest = F.when(switched.isNotNull(), F.regexp_replace("body", r"^[^\n]*\n?", "")).otherwise(rest)
    kept = F.when(
        language.isin("python", "r"),
        F.array_join(F.filter(F.split(rest, r"(?<=\n)"), lambda ln: ~F.ltrim(ln).rlike("^[%!]")), ""),
    ).otherwise(rest)
    return rows.where(~word.isin("%scala", "%md", "%sh")).select(
        "file_path", "cell_index", language.alias("language"), kept.alias("source")
    ).where(F.length("source") > 0)


def exported_cells(files: DataFrame) -> DataFrame:
    """Cells of ``# COMMAND ---`` separated Python exports with ``# MAGIC`` lines."""
    body = F.regexp_replace("text", r"^# Databricks notebook source\s*?\n", "")
    rows = files.select(
        "file_path", F.posexplode(F.split(body, r"(?m)^# COMMAND\s*-+\s*$\n?")).alias("cell_index", "chunk")
    ).where(F.length(F.trim(F.regexp_replace("chunk", r"\s", ""))) > 0)
    lines = F.filter(F.split("chunk", "\n"), lambda x: F.length(F.trim(x)) > 0)
    magic = F.forall(lines, lambda x: x.startswith("# MAGIC "))
    first = F.element_at(lines, 1)
    sql = magic & first.startswith("# MAGIC %sql")
    r = magic & first.startswith("# MAGIC %r") & ~sql
    skip = magic & first.rlike("^# MAGIC %(md|sh)")
    bare = F.transform(F.split("chunk", "\n"), lambda x: F.regexp_replace(x, "^# MAGIC ", ""))
    switched = F.array_join(F.filter(bare, lambda x: ~F.trim(x).startswith("%")), "\n")
    plain = F.array_join(F.filter(F.split("chunk", "\n"), lambda x: ~x.startswith("# MAGIC ")), "\n")
    return rows.where(~skip).select(
        "file_path", "cell_index", F.when(sql, "sql").when(r, "r").otherwise("python").alias("language"),
        F.when(sql | r, switched).otherwise(plain).alias("source"),
    )


def table_lineage(cells: DataFrame) -> DataFrame:
    """IMPORTS_FROM edges from a file to every table its SQL cells name (duplicates kept)."""
    names = F.regexp_extract_all("source", F.lit(SQL_TABLE_PATTERN), 1)
    return cells.where(F.col("language") == "sql").select(
        F.lit("IMPORTS_FROM").alias("kind"), F.col("file_path").alias("source"),
        F.explode(F.transform(names, lambda t: F.replace(t, F.lit("`"), F.lit("")))).alias("target"),
        "file_path", F.lit(1).alias("line"),
    )


def cell_offsets(cells: DataFrame) -> DataFrame:
    """First and last line of each cell inside its language's joined text."""
    size = F.length("source") - F.length(F.replace(F.col("source"), F.lit("\n"), F.lit("")))
    lines = size + F.when(F.col("source").endswith("\n"), 0).otherwise(1)
    before = Window.partitionBy("file_path", "language").orderBy("cell_index").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(lines + 1).over(before), F.lit(0))
    return cells.where(F.col("language").isin("python", "r")).select(
        "file_path", "language", "cell_index", (shift + 1).cast("int").alias("first_line"),
        (shift + lines).cast("int").alias("last_line"),
    )


def joined_code(cells: DataFrame, language: str = "python") -> DataFrame:
    """One text per notebook: its cells of a language in order (one file, one row)."""
    parts = cells.where(F.col("language") == language).groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("cell_index", "source"))).alias("parts")
    )
    return parts.select("file_path", F.array_join(F.transform("parts", lambda p: p["source"]), "\n").alias("text"))


def tag_cells(nodes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Nodes with the index of the first cell that holds their first line."""
    spans = offsets.select("file_path", "cell_index", F.explode(F.sequence("first_line", "last_line")).alias("line_start"))
    first = spans.groupBy("file_path", "line_start").agg(F.min("cell_index").alias("cell_index"))
    return nodes.join(first, ["file_path", "line_start"], "left")


def script_blocks(files: DataFrame) -> DataFrame:
    """``<script>`` blocks of single-file components: language, line offset, text."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?is)(<script\b[^>]*>.*?</script>)"), 1)
    rows = files.select("file_path", "text", F.posexplode(blocks).alias("block", "raw"))
    lead = F.substring(F.col("text"), F.lit(1), F.position(F.col("raw"), F.col("text")))
    opening = F.regexp_extract("raw", r"(?is)^(<script\b[^>]*>)", 1)
    typed = F.regexp_extract(opening, r"""(?i)lang\s*=\s*["']([^"']+)""", 1)
    inner = F.regexp_extract("raw", r"(?is)^<script\b[^>]*>(.*?)</script>$", 1)
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return rows.select(
        "file_path", "block", F.when(typed.isin("ts", "typescript"), "typescript").otherwise("javascript").alias("language"),
        (newlines(lead) + newlines(opening)).alias("line_offset"), inner.alias("text"),
    )


def component_code(files: DataFrame) -> DataFrame:
    """Script text of single-file components, line numbers kept by leading blank lines."""
    first = script_blocks(files).groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("line_offset", "text"))).alias("blocks")
    )
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    joined = F.aggregate(
        "blocks", F.lit(""),
        lambda acc, b: F.concat(acc, F.repeat(F.lit("\n"), (b["line_offset"] - lines(acc)).cast("int")), b["text"]),
    )
    return first.select("file_path", joined.alias("text"), F.lit("vue").alias("language"))
