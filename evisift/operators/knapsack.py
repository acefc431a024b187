"""Best possible error capture under a budget: an evaluation-only upper bound.

Cases are merged to counts per (criticality, length in tenth-minutes) before anything is gathered. A
queue has at most 5 x 2400 such classes whatever its number of cases, so the exact search below works on
a bounded table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisift.operators.routing import MICRO, micro_minutes

TENTHS = 10


def error_classes(items: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of errors per (criticality, tenth-minutes), with the group's total minutes and weight."""
    tenths = F.greatest(F.lit(1), F.bround(F.col("expected_review_minutes") * TENTHS, 0).cast("bigint"))
    per_class = items.withColumn("tenths", tenths).groupBy(*group, "criticality", "tenths").agg(
        F.count_if("error").alias("n_errors"),
        F.sum(micro_minutes(F.col("expected_review_minutes"))).alias("_minutes"),
    )
    whole = Window.partitionBy(*group)
    return per_class.select(
        *group, "criticality", "tenths", "n_errors",
        (F.sum("_minutes").over(whole) / MICRO).alias("total_minutes"),
        F.sum(F.col("criticality") * F.col("n_errors")).over(whole).alias("total_weight"),
    )


def _exact_sums(size: int, gains: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest gain for every exact total weight up to ``size``; unreachable weights are very negative."""
    best = np.full(size + 1, -(2**60), dtype=np.int64)
    best[0] = 0
    for gain, weight, count in zip(gains, weights, counts, strict=True):
        lot = 1
        while count > 0:
            take = min(lot, int(count))
            step = take * int(weight)
            if step <= size:
                best[step:] = np.maximum(best[step:], best[: size + 1 - step] + take * int(gain))
            count -= take
            lot *= 2
    return best


def best_capture(values: np.ndarray, weights: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[int, int]:
    """Exact bounded knapsack: ``(largest value, smallest weight that reaches it)``.

    Some optimum differs from the fill-by-density solution by at most ``2 * max(weight) + 2`` items in
    total. So the search only asks what to take out of that solution and what to put in instead, over
    tables whose size depends on the weights and not on the number of cases.
    """
    keep = (counts > 0) & (values > 0) & (weights <= capacity)
    values, weights, counts = values[keep], weights[keep], counts[keep]
    if len(values) == 0:
        return 0, 0
    unit = int(np.gcd.reduce(weights))
    weights, room = weights // unit, capacity // unit
    order = np.lexsort((weights, -values / weights))
    values, weights, counts = values[order], weights[order], counts[order]
    filled = np.zeros(len(values), dtype=np.int64)
    left = room
    for i, weight in enumerate(weights):
        filled[i] = min(int(counts[i]), left // int(weight))
        left -= int(filled[i]) * int(weight)
        if filled[i] < counts[i]:
            break
    reach = 2 * int(weights.max()) + 2
    limit = reach * int(weights.max())
    removable, addable = np.minimum(filled, reach), np.minimum(counts - filled, reach)
    out_size = min(int((removable * weights).sum()), limit)
    in_size = min(int((addable * weights).sum()), left + out_size)
    out_gain = _exact_sums(out_size, -values, weights, removable)
    in_gain = np.maximum.accumulate(_exact_sums(in_size, values, weights, addable))
    in_weight = np.searchsorted(in_gain, in_gain, side="left")
    taken_out = np.arange(out_size + 1)
    put_in = np.minimum(left + taken_out, in_size)
    value = out_gain + in_gain[put_in]
    weight = in_weight[put_in] - taken_out
    best = np.lexsort((weight, -value))[0]
    return (
        int((filled * values).sum() + value[best]),
        int((filled * weights).sum() + weight[best]) * unit,
    )


def knapsack_bound(items: DataFrame, group: Sequence[str], capacities: Sequence[float]) -> DataFrame:
    """Captured and residual weighted error of the best selection, per (group, capacity)."""
    keys = list(group)
    classes = error_classes(items, keys).withColumn(
        "capacity", F.explode(F.array(*[F.lit(float(c)) for c in capacities]))
    )
    fields = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    schema = ", ".join(
        [f"{k} {fields[k]}" for k in keys]
        + ["capacity double", "captured_weight double", "used_minutes double", "residual_weighted_risk double"]
    )

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        capacity = float(key[-1])
        room = max(0, round(float(part["total_minutes"].iloc[0]) * capacity * TENTHS))
        value, used = best_capture(
            part["criticality"].to_numpy(np.int64), part["tenths"].to_numpy(np.int64),
            part["n_errors"].to_numpy(np.int64), room,
        )
        total = float(part["total_weight"].iloc[0])
        return pd.DataFrame([[*key, float(value), used / TENTHS, total - value]])

    return classes.groupBy(*keys, "capacity").applyInPandas(solve, schema)


def fractional_bound(items: DataFrame, group: Sequence[str], capacities: Sequence[float]) -> DataFrame:
    """The bound when a case may be reviewed in part; never below ``knapsack_bound``."""
    keys = list(group)
    lanes = error_classes(items, keys).filter("n_errors > 0").withColumn(
        "capacity", F.explode(F.array(*[F.lit(float(c)) for c in capacities]))
    )
    dense = Window.partitionBy(*keys, "capacity").orderBy(
        (F.col("criticality") / F.col("tenths")).desc(), F.col("tenths"), F.col("criticality")
    )
    need = F.col("tenths") * F.col("n_errors")
    room = F.round(F.col("total_minutes") * F.col("capacity") * TENTHS, 0)
    before = F.sum(need).over(dense.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - need
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (room - F.col("_before")) / need))
    return lanes.withColumn("_before", before).groupBy(*keys, "capacity").agg(
        F.round(F.sum(part * F.col("criticality") * F.col("n_errors")), 6).alias("captured_weight_bound"),
        F.max("total_weight").cast("double").alias("total_weight"),
    )
