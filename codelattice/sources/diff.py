"""Unified diff texts to changed line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_unified_diff(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_path, start, end) per hunk of the new side.

    A file header holds for the hunks after it; a count of zero marks one line.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    header = F.regexp_extract("line", r"^\+\+\+ b/(.+?)\r?$", 1)
    hunk = r"^@@ .+? \+(\d+)(?:,(\d+))? @@"
    marked = lines.where(F.col("line").startswith("+++ b/") | F.col("line").startswith("@@ "))
    order = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumn(
        "file_path", F.last(F.when(header != "", header), ignorenulls=True).over(order)
    ).where(F.col("line").rlike(hunk) & F.col("file_path").isNotNull())
    start = F.regexp_extract("line", hunk, 1).cast("int")
    count_text = F.regexp_extract("line", hunk, 2)
    count = F.when(count_text == "", F.lit(1)).otherwise(count_text.try_cast("int"))
    return placed.select(
        "diff_id", "file_path", start.alias("start"),
        F.when(count == 0, start).otherwise(start + count - 1).alias("end"),
    )
