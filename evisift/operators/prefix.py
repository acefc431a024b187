"""Running totals and ranks inside groups of any size.

A window sorts each group in one task. That is the best plan for groups that fit a task, and a
bottleneck when one group owns a large share of the table. Groups above ``max_group_rows`` are
range-partitioned on (group, order), so their rows are spread over many tasks; the totals of the
parts before each part are then added to a window that runs inside the part only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.session import pin

MAX_GROUP_ROWS = 200_000


def split_large_groups(
    df: DataFrame, group: Sequence[str], max_group_rows: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """``(small groups, large groups or None, rows in large groups)``.

    ``df`` is read twice, so callers pass a pinned table. There are fewer than ``rows / max_group_rows``
    large groups; their names are written, so the planner sees that list's real size.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > max_group_rows)
    sizes = pin(sizes, "large-groups")
    rows = sizes.agg(F.sum("_rows")).first()[0]
    if not rows:
        return df, None, 0
    large = sizes.select(*group)
    return df.join(large, list(group), "left_anti"), df.join(large, list(group), "left_semi"), rows


def range_parts(
    df: DataFrame, group: Sequence[str], order: Sequence[str], rows: int, part_rows: int
) -> DataFrame:
    """Range-partition by (group, order) and freeze the partition number in column ``_part``.

    The result is written once: a partition number is only a key when it can never be recomputed.
    """
    parts = max(2, -(-rows // part_rows))
    ranged = df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    return pin(ranged, "ranges", partition_by="_part")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    max_group_rows: int = MAX_GROUP_ROWS,
    part_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add, per entry of ``totals``, the sum of its expression up to and including this row.

    ``order`` must be unique inside a group. Use ``F.lit(1)`` for a row number.
    """
    df = pin(df, "rows")
    small, large, rows = split_large_groups(df, group, max_group_rows)
    out = small.withColumns(_windowed(totals, group, order))
    if large is None:
        return out
    ranged = range_parts(large, group, order, rows, part_rows)
    part_sums = ranged.groupBy(*group, "_part").agg(
        *[F.sum(value).alias(f"_{name}") for name, value in totals.items()]
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_sums.select(
        *group, "_part",
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in totals],
    )
    inside = ranged.withColumns(_windowed(totals, [*group, "_part"], order))
    joined = inside.join(offsets, [*group, "_part"])
    shifted = joined.withColumns({name: F.col(name) + F.col(f"_{name}") for name in totals})
    return out.unionByName(shifted.select(*out.columns))


def _windowed(totals: dict[str, Column], group: Sequence[str], order: Sequence[str]) -> dict[str, Column]:
    window = (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return {name: F.sum(value).over(window) for name, value in totals.items()}
