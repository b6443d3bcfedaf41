"""Finding streams joined with the verdict store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.findings import fingerprint


def cached_verdicts(findings: DataFrame, stored: DataFrame) -> DataFrame:
    """Stream–static join: each arriving finding with its fresh stored verdict, if any.

    ``findings``: rule_id, file_path, line_start, current_hash.
    """
    keyed = findings.withColumn(
        "fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_start"))
    )
    known = stored.where(F.col("verdict").isNotNull()).select("fingerprint", "verdict", "file_hash")
    fresh = F.col("file_hash").isNull() | (F.col("file_hash") == "") | (F.col("file_hash") == F.col("current_hash"))
    return keyed.join(known, "fingerprint", "left").select(
        "fingerprint", "rule_id", "file_path", "line_start",
        F.when(fresh, F.col("verdict")).alias("verdict"), (F.col("verdict").isNotNull() & fresh).alias("hit"),
    )


def first_sightings(findings: DataFrame, delay: str = "30 days") -> DataFrame:
    """Findings not seen within the delay, by fingerprint, with bounded state."""
    keyed = findings.withColumn(
        "fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_start"))
    )
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])
