"""Isotonic regression as a convex hull that is merged in a reduction, and its use as an interpolated curve.

Rows of one score are a point; over the running weight, the sum of labels is a path whose greatest convex minorant has
the fitted values as its slopes. A range of scores keeps the edges of its own minorant: blocks of weight, sum and score range,
whose means rise. Two neighbouring ranges merge by pooling blocks at their border while means don't rise. So ranges pool in
parallel, and neighbours merge in a tree; nothing pools on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisift.operators.prefix import MAX_GROUP_ROWS, range_parts
from evisift.session import pin

FAN_IN = 8
_BLOCKS = "_part int, lo array<double>, hi array<double>, weight array<bigint>, total array<bigint>"
Block = tuple[float, float, int, int]


def pool(blocks: Iterable[Block]) -> list[Block]:
    """Merge ``(lo, hi, weight, sum)`` blocks, ascending by score, until their means rise. Means compare as whole numbers."""
    out: list[Block] = []
    for lo, hi, weight, total in blocks:
        while out and out[-1][3] * weight >= total * out[-1][2]:
            before = out.pop()
            lo, weight, total = before[0], weight + before[2], total + before[3]
        out.append((lo, hi, weight, total))
    return out


def _as_table(part: int, blocks: list[Block]) -> pa.Table:
    lo, hi, weight, total = zip(*blocks, strict=True)
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
    lists = [pa.array([list(c)], pa.list_(kind)) for c, kind in zip((lo, hi, weight, total), kinds, strict=True)]
    return pa.Table.from_arrays([pa.array([part], pa.int32()), *lists], ["_part", "lo", "hi", "weight", "total"])


def _pool_part(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("x")
    x, weight, total = (rows[c].to_pylist() for c in ("x", "weight", "total"))
    return _as_table(rows["_part"][0].as_py(), pool(zip(x, x, weight, total, strict=True)))


def _merge_parts(rows: pa.Table) -> pa.Table:
    blocks = (
        block for row in rows.sort_by("_part").to_pylist() for block in zip(row["lo"], row["hi"], row["weight"], row["total"], strict=True)
    )
    return _as_table(rows["_part"][0].as_py() // FAN_IN, pool(blocks))


def fit_isotonic(rows: DataFrame, score: str, label: str, part_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``lo, hi, value, weight``: the fitted steps of a 0/1 label over the ranges of a score, ascending in both.

    Rows without a score or label are left out. With 0/1 labels, steps of ``n`` rows are at most about ``n ** (2/3)``, as their means
    are rising fractions; the last merge holds them in one task.
    """
    points = pin(
        rows.select(F.col(score).cast("double").alias("x"), F.col(label).cast("bigint").alias("y")).dropna().filter(~F.isnan("x"))
        # -0.0 and 0.0 are one score
        .groupBy((F.col("x") + 0.0).alias("x")).agg(F.count("*").alias("weight"), F.sum("y").alias("total")),
        "isotonic-points",
    )
    n = points.count()
    blocks = pin(range_parts(points, [], ["x"], n, part_rows).groupBy("_part").applyInArrow(_pool_part, _BLOCKS), "isotonic-hulls")
    parts = max(2, -(-n // part_rows))
    while parts > 1:
        blocks = pin(blocks.groupBy(F.expr(f"_part div {FAN_IN}")).applyInArrow(_merge_parts, _BLOCKS), "isotonic-hulls")
        parts = -(-parts // FAN_IN)
    return blocks.select(F.inline(F.arrays_zip("lo", "hi", "weight", "total"))).select(
        "lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight"
    )


def apply_isotonic(steps: DataFrame, rows: DataFrame, score: str, out: str, part_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``rows`` with the fitted value of ``score``: constant on a step, linear between steps, constant outside all of them.

    Distinct scores and the ends of steps are ordered in range parts. A score finds the ends around it inside its part or, at
    the part's borders, from one row per part. A null score has no value.
    """
    ends = steps.select(F.explode(F.array(*[F.struct(F.col(c).alias("x"), F.col("value").alias("y")) for c in ("lo", "hi")])).alias("k")).select(
        "k.x", F.struct(F.col("k.x").alias("x"), F.col("k.y").alias("y")).alias("knot")
    ).distinct()
    given = rows.select((F.col(score).cast("double") + 0.0).alias("x")).dropna().distinct()
    both = pin(ends.unionByName(given.withColumn("knot", F.lit(None).cast(dict(ends.dtypes)["knot"]))), "isotonic-scores")
    ranged = range_parts(both, [], ["x"], both.count(), part_rows)
    inside = Window.partitionBy("_part")
    order = inside.orderBy("x", F.col("knot").isNull())
    near = ranged.withColumns({
        "_below": F.last("knot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        # a knot that equals the score stands before it, so it is found by the look back
        "_above": F.first("knot", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    }).filter("knot is null")
    per_part = ranged.groupBy("_part").agg(F.max("knot").alias("_most"), F.min("knot").alias("_least"))
    # one row per part
    parts = Window.orderBy("_part")
    borders = pin(per_part.select(
        F.col("_part").alias("_p"),
        F.last("_most", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_least", ignorenulls=True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    ), "isotonic-borders")
    found = near.join(borders, F.col("_part") == F.col("_p")).withColumns({
        "_below": F.coalesce("_below", "_before"), "_above": F.coalesce("_above", "_after"),
    })
    below, above = F.col("_below"), F.col("_above")
    slope = (above["y"] - below["y"]) / (above["x"] - below["x"])
    value = F.when(below.isNull(), above["y"]).when(above.isNull() | (below["x"] == F.col("x")), below["y"]).otherwise(
        below["y"] + slope * (F.col("x") - below["x"])
    )
    curve = found.select(F.col("x").alias("_x"), value.alias(out))
    return rows.drop(out).join(curve, F.col(score).cast("double") + 0.0 == F.col("_x"), "left").drop("_x")
