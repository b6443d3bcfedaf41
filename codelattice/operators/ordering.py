"""Exact ranks and rolling frames for groups that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.session import cut

GROUP_ROW_BOUND = 2_000_000


def _as_cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the fullest group; a partial-aggregate job, one row to the driver."""
    counted = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(counted["n"] or 0)


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str = "position",
    bound: int = GROUP_ROW_BOUND,
) -> DataFrame:
    """0-based row number per group, exact for groups of any size.

    Groups known to fit one task use a plain window. Otherwise the rows are
    range-partitioned on (keys, order), numbered inside each block, and shifted
    by the row counts of the group's earlier blocks, so a hot group is spread
    over many tasks.
    """
    cols = _as_cols(order)
    if largest_group(df, keys) <= bound:
        window = Window.partitionBy(*keys).orderBy(*cols)
        return df.withColumn(out, (F.row_number().over(window) - 1).cast("bigint"))
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = cut(
        df.repartitionByRange(blocks, *[F.col(k) for k in keys], *cols).withColumn(
            "_block", F.spark_partition_id()
        )
    )
    inside = Window.partitionBy("_block", *keys).orderBy(*cols)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        tagged.groupBy(*keys, "_block")
        .count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    return (
        tagged.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(shifts, [*keys, "_block"])
        .withColumn(out, (F.col("_inside") + F.col("_shift")).cast("bigint"))
        .drop("_block", "_inside", "_shift")
    )


def rolling_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    size: int,
    values: dict[str, Column],
    chunk: int = 10_000,
    bound: int = GROUP_ROW_BOUND,
) -> DataFrame:
    """Sums over the current and the ``size - 1`` preceding rows of a group.

    Ranks split every group into chunks; a chunk also receives the last rows of
    its predecessor as context, so no window covers more than one chunk.
    """
    ranked = rank_rows(df, keys, order, "_rank", bound)
    own = F.floor(F.col("_rank") / chunk)
    ahead = F.floor((F.col("_rank") + size - 1) / chunk)
    spread = ranked.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array(own, ahead)))
    )
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy("_rank").rowsBetween(-(size - 1), Window.currentRow)
    )
    for name, value in values.items():
        spread = spread.withColumn(name, F.sum(value).over(frame))
    return spread.where(F.col("_chunk") == F.col("_own")).drop("_own", "_chunk", "_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One whole row per key by an aggregate (map-side combine, no window)."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    chosen = df.groupBy(*keys).agg(
        pick(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_row")
    )
    return chosen.select(*keys, "_row.*").select(*df.columns)
