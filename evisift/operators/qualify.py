"""Policy qualification: paired bootstrap, champion/challenger decision, promotion and scenario gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.operators import draws
from evisift.operators.prefix import MAX_GROUP_ROWS, running_totals, split_large_groups
from evisift.operators.routing import (
    CRITICAL_FROM,
    MICRO,
    micro_minutes,
    policy_columns,
    policy_key,
    route,
)
from evisift.session import pin

_TOLERANCE = 1e-12
_SIDES = ("champion", "challenger")
# Rows of a group whose replicates are drawn and walked beside them in one task; a row takes some 150 bytes there.
IN_PLACE_ROWS = 2**20


_FIGURES = tuple(f"{side}_{name}" for side in _SIDES for name in ("residual_weighted_risk", "critical_error_capture"))


def _narrow(items: DataFrame, keys: Sequence[str], champion: str, challenger: str, seed: int) -> DataFrame:
    """What draws and walks need of a row: the group's label, micro-minutes, weight, flag and its place in both rankings."""
    wrong = F.coalesce("error", F.lit(False))
    ranks = [policy_key(p)[c].alias(f"{side}_{c}") for side, p in zip(_SIDES, (champion, challenger), strict=True) for c in ("sort_key", "tie")]
    return items.select(
        *keys, "case_id", F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]).alias("_label"),
        # a draw without a gold status weighs nothing: it is dropped inside the replicate
        F.when(F.col("error").isNull(), 0).otherwise(micro_minutes(F.col("expected_review_minutes"))).cast("bigint").alias("_m"),
        F.when(wrong, F.col("criticality")).otherwise(0).cast("bigint").alias("_w"),
        (wrong & (F.col("criticality") >= CRITICAL_FROM)).cast("bigint").alias("_c"), *ranks,
    )


def paired_draws(
    items: DataFrame, group: Sequence[str], champion: str, challenger: str, capacity: float,
    replicates: int, seed: int,
) -> DataFrame:
    """Champion and challenger figures per (group, rep), for groups that fit a task.

    A group's rows travel once, in narrow columns. All replicates are drawn and walked beside them: as matrices of counts in
    chunks of bounded size, or one by one with counts per cell of rows.
    """
    keys = list(group)
    narrow = _narrow(items, keys, champion, challenger, seed)
    figures = list(_FIGURES)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("case_id", "ascending")], null_placement="at_start"))
        minutes, weight, critical = (rows[c].to_numpy() for c in ("_m", "_w", "_c"))
        orders = [
            pc.sort_indices(rows, sort_keys=[(f"{s}_sort_key", "ascending"), (f"{s}_tie", "ascending")], null_placement="at_start").to_numpy()
            for s in _SIDES
        ]
        label, parts = rows["_label"][0].as_py(), []
        # a large group keeps counts per cell of rows, a small one a matrix of many replicates at once
        by_cells = len(rows) > draws.MATRIX_ROWS
        chunk = replicates if by_cells else max(1, draws.CELLS // len(rows))
        for first in range(0, replicates, chunk):
            reps = range(first, min(first + chunk, replicates))
            if by_cells:
                *sides, all_critical = draws.paired_walks(label, reps, minutes, weight, critical, orders, capacity)
                walked = list(zip(sides[::2], sides[1::2], strict=True))
            else:
                copies = draws.group_copies(label, reps, len(rows))
                available, all_critical, walked = draws.whole_minutes(copies @ minutes, capacity), copies @ critical, []
                for order in orders:
                    taken = draws.walk(copies[:, order], minutes[order], available)
                    walked.append((copies @ weight - taken @ weight[order], taken @ critical[order]))
            figure = [np.array(reps, np.int32)]
            for lost, found in walked:
                figure += [lost.astype(float), np.where(all_critical > 0, found / np.maximum(all_critical, 1), 1.0)]
            parts.append(figure)
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        named = rows.select(keys).take(pa.array(np.zeros(replicates, np.int64)))
        return pa.Table.from_arrays([*named.columns, *columns], [*keys, "rep", *figures])

    schema = ", ".join([*[f"`{k}` {dict(items.dtypes)[k]}" for k in keys], "rep int", *[f"{f} double" for f in figures]])
    # the work of a group is far larger than its bytes, so small partitions must not be joined to few tasks
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = narrow.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, schema)
    return out.withColumns({f: F.round(f, 6) for f in figures if f.endswith("capture")})


def spread_draws(
    items: DataFrame, group: Sequence[str], champion: str, challenger: str, capacity: float,
    replicates: int, seed: int, leaf_rows: int = draws.LEAF_ROWS, walked_rows: int = draws.WALKED_ROWS,
) -> DataFrame:
    """Rows of ``paired_draws`` for groups that outgrow a task: no draw travels, and no task holds more than some leaves.

    A round sums, per replicate and ranking, what is drawn of each bucket of the places ahead, block by block of leaves; the walk passes
    the buckets that fit whole and goes on inside the first that doesn't, until that is short enough for its drawn rows to meet. The
    driver holds where each walk stands, a row for every large group, replicate and ranking.
    """
    keys, one = list(group), F.lit(1).cast("bigint")
    placed = running_totals(_narrow(items, keys, champion, challenger, seed), keys, ["case_id"], {"_idx": one})
    for side in _SIDES:
        placed = running_totals(placed, keys, [f"{side}_sort_key", f"{side}_tie"], {f"_{side}": one}).drop(f"{side}_sort_key", f"{side}_tie")
    block_rows = leaf_rows * draws.BLOCK_LEAVES
    numbers = ["_m", "_w", "_c", *[f"_{side}" for side in _SIDES]]
    blocks = pin(placed.select(
        *keys, "_label", (F.col("_idx") - 1).alias("_idx"), *numbers[:3], *[(F.col(n) - 1).alias(n) for n in numbers[3:]]
    ).withColumn("_block", F.expr(f"_idx div {block_rows}")), "blocks")
    # a row without weight moves no figure, so the shortest of the others ends a walk
    matters = (F.col("_w") != 0) | (F.col("_c") != 0)
    sizes = blocks.groupBy(*keys).agg(F.count("*"), F.min(F.when(matters, F.col("_m")))).collect()
    walks = {
        tuple(row[:-2]): {(rep, side): draws.Standing(row[-2], row[-1]) for rep in range(replicates) for side in range(2)} for row in sizes
    }
    key_schema = "".join(f"`{k}` {dict(items.dtypes)[k]}, " for k in keys)
    spark = items.sparkSession

    def one_round() -> DataFrame:
        shared = spark.sparkContext.broadcast(walks)

        def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            walk, block = shared.value[tuple(k.as_py() for k in key[:-1])], key[-1].as_py()
            rows = rows.sort_by("_idx")
            found = draws.block_counts(
                rows["_label"][0].as_py(), walk, block * draws.BLOCK_LEAVES, [rows[n].to_numpy() for n in numbers], leaf_rows, walked_rows
            )
            named = rows.select(keys).take(pa.array(np.zeros(len(found), np.int64)))
            values = [pa.array([k[at] for k in found], pa.int32()) for at in range(2)]
            lists = pa.array(list(found.values()), pa.list_(pa.int64()))
            return pa.Table.from_arrays([*named.columns, *values, lists], [*keys, "rep", "side", "found"])

        def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            *name, rep, side = (k.as_py() for k in key)
            stand = shared.value[tuple(name)][rep, side].move([v.values.to_numpy() for v in rows["found"]], capacity, walked_rows)
            named = rows.select([*keys, "rep", "side"]).slice(0, 1)
            return named.append_column("stand", pa.array([stand.numbers()], pa.list_(pa.int64())))

        counted = blocks.groupBy(*keys, "_block").applyInArrow(count, f"{key_schema}rep int, side int, found array<bigint>")
        return counted.groupBy(*keys, "rep", "side").applyInArrow(settle, f"{key_schema}rep int, side int, stand array<bigint>")

    while any(stand.open for walk in walks.values() for stand in walk.values()):
        for *name, rep, side, stand in one_round().collect():
            walks[tuple(name)][rep, side] = draws.Standing(*stand)
    rows = [
        (*name, rep, *[figure for side in range(2) for figure in walk[rep, side].figures()]) for name, walk in walks.items() for rep in range(replicates)
    ]
    out = spark.createDataFrame(rows, f"{key_schema}rep int, " + ", ".join(f"{f} double" for f in _FIGURES))
    return out.withColumns({f: F.round(f, 6) for f in _FIGURES if f.endswith("capture")})


def resample(
    items: DataFrame, group: Sequence[str], replicates: int, seed: int = 19,
    max_group_rows: int = MAX_GROUP_ROWS, leaf_rows: int = draws.LEAF_ROWS,
) -> DataFrame:
    """Draw each group's rows with replacement, once per replicate: ``rep`` and ``copies``.

    Rows travel once, to the leaf of their group's tree that holds their position. The leaf finds its share of every replicate's
    draws from the path to it and hands on one packed array of counts per row, which is opened after it has left Python.
    """
    keys = list(group)
    placed = pin(
        running_totals(
            items, keys, ["case_id"], {"_idx": F.lit(1).cast("bigint")}, max_group_rows=max_group_rows
        ).withColumn("_idx", F.col("_idx") - 1),
        "placed",
    )
    sizes = pin(placed.groupBy(*keys).agg(F.count("*").alias("_size")), "sizes")
    label = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    columns = items.columns
    dealt = placed.join(sizes, keys).withColumns({"_label": label, "_leaf": F.expr(f"_idx div {leaf_rows}")})

    def run(rows: pa.Table) -> pa.Table:
        first = {c: rows[c][0].as_py() for c in ("_label", "_leaf", "_size")}
        copies = draws.leaf_copies(first["_label"], range(replicates), first["_leaf"], first["_size"], leaf_rows).astype(np.int16)
        mine = copies[:, rows["_idx"].to_numpy() - first["_leaf"] * leaf_rows]
        cuts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * replicates)
        packed = pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(mine.T).ravel()))
        return pa.Table.from_arrays([*rows.select(columns).columns, packed], [*columns, "_copies"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in items.dtypes], "_copies array<smallint>"])
    counted = dealt.groupBy(*keys, "_leaf").applyInArrow(run, schema)
    return counted.select(*columns, F.posexplode("_copies").alias("rep", "_n")).filter("_n > 0").select(
        *columns, "rep", F.col("_n").cast("bigint").alias("copies")
    )


def paired_outcomes(outcomes: DataFrame, on: Sequence[str], champion: str, challenger: str) -> DataFrame:
    """Champion and challenger rows of the same unit side by side."""
    side = lambda policy, prefix: outcomes.filter(F.col("policy") == policy).select(
        *on,
        *[
            F.col(c).alias(f"{prefix}_{c}")
            for c in ("residual_weighted_risk", "critical_error_capture", "used_minutes", "n")
        ],
    )
    return side(champion, "champion").join(side(challenger, "challenger"), list(on))


def paired_bootstrap(
    items: DataFrame, group: Sequence[str], *, champion: str, challenger: str, capacity: float,
    replicates: int = 1000, seed: int = 19, min_replicates: int = 50, **sizes: int,
) -> DataFrame:
    """Mean and 95 % interval of (challenger - champion) residual risk, per group.

    Draws are made from all cases of a group, and those without a gold status (null ``error``) are dropped inside
    each replicate. All replicates of all groups run in one job. Groups up to ``max_group_rows`` (2^20 at first) draw and walk in place;
    a larger group is drawn and walked by ``spread_draws``.
    """
    if replicates < min_replicates:
        raise ValueError(f"replicates must be at least {min_replicates}")
    keys = list(group)
    items = pin(items.select(*keys, *policy_columns((champion, challenger))), "bootstrap")
    small, large, _ = split_large_groups(items, keys, sizes.get("max_group_rows", IN_PLACE_ROWS))
    outcomes = paired_draws(small, keys, champion, challenger, capacity, replicates, seed)
    if large is not None:
        spread = spread_draws(large, keys, champion, challenger, capacity, replicates, seed)
        outcomes = outcomes.unionByName(spread.select(*outcomes.columns))
    pairs = outcomes.select(
        *keys,
        (F.col("challenger_residual_weighted_risk") - F.col("champion_residual_weighted_risk")).alias("_diff"),
        (
            F.col("challenger_critical_error_capture") + _TOLERANCE >= F.col("champion_critical_error_capture")
        ).alias("_ok"),
    )
    # one row per replicate: the exact percentile holds `replicates` numbers per group
    interval = F.percentile("_diff", F.array(F.lit(0.025), F.lit(0.975)))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("bootstrap_samples"),
        F.round(F.avg("_diff"), 6).alias("paired_difference_mean"),
        F.round(interval[0], 6).alias("ci_low"),
        F.round(interval[1], 6).alias("ci_high"),
        F.round(F.avg(F.col("_ok").cast("double")), 6).alias("bootstrap_critical_nonregression_rate"),
    )


def qualify_policy(
    cases: DataFrame, group: Sequence[str], *, champion: str, challenger: str, capacity: float,
    replicates: int = 1000, seed: int = 19, **sizes: int,
) -> DataFrame:
    """PROMOTE, REJECT or INCONCLUSIVE_KEEP_CHAMPION per group.

    Routing sees only cases with a gold status (``error`` is not null); the bootstrap draws from, and the budget
    check uses the minutes of, all cases of the group.
    """
    keys = list(group)
    cases = pin(cases, "qualify")
    labelled = cases.filter("error is not null")
    boot = paired_bootstrap(
        cases, keys, champion=champion, challenger=challenger, capacity=capacity,
        replicates=replicates, seed=seed, **sizes,
    )
    full = paired_outcomes(
        route(labelled, keys, (champion, challenger), [capacity], **sizes), keys, champion, challenger,
    )
    budget = cases.groupBy(*keys).agg(
        (F.sum(micro_minutes(F.col("expected_review_minutes"))) * F.lit(capacity) / MICRO + 1e-9).alias("_budget")
    )
    joined = full.join(budget, keys).join(boot, keys).withColumns(
        {
            "no_critical_slice_regression": F.col("challenger_critical_error_capture") + _TOLERANCE
            >= F.col("champion_critical_error_capture"),
            "budget_respected": F.col("challenger_used_minutes") <= F.col("_budget"),
        }
    )
    safe = F.col("no_critical_slice_regression") & F.col("budget_respected")
    decision = (
        F.when((F.col("ci_high") < 0) & safe, "PROMOTE")
        .when((F.col("ci_low") > 0) | ~safe, "REJECT")
        .otherwise("INCONCLUSIVE_KEEP_CHAMPION")
    )
    return joined.select(
        *keys,
        F.lit(champion).alias("champion"), F.lit(challenger).alias("challenger"),
        F.lit(capacity).alias("capacity"),
        "paired_difference_mean", "ci_low", "ci_high", decision.alias("decision"),
        "no_critical_slice_regression", "budget_respected",
        F.col("champion_residual_weighted_risk").alias("champion_residual"),
        F.col("challenger_residual_weighted_risk").alias("challenger_residual"),
        F.col("champion_critical_error_capture").alias("champion_critical_capture"),
        F.col("challenger_critical_error_capture").alias("challenger_critical_capture"),
        "bootstrap_critical_nonregression_rate",
    )


def scenario_stability(qualified: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Decision counts over scenarios and the recommended action.

    ``qualified`` has one ``qualify_policy`` row per scenario.
    """
    is_ = lambda decision: F.count_if(F.col("decision") == decision).alias(decision.lower())
    counts = qualified.groupBy(*group).agg(
        F.count("*").alias("scenarios"),
        is_("PROMOTE"), is_("REJECT"), is_("INCONCLUSIVE_KEEP_CHAMPION"),
        F.count_if(
            F.col("challenger_critical_capture") + _TOLERANCE < F.col("champion_critical_capture")
        ).alias("critical_regression_scenarios"),
        F.max("champion").alias("champion"), F.max("challenger").alias("challenger"),
    )
    regression = F.col("critical_regression_scenarios") > 0
    promote = (F.col("promote") == F.col("scenarios")) & ~regression
    return counts.withColumns(
        {
            "recommended_action": F.when(promote, "PROMOTE_CHALLENGER")
            .when((F.col("reject") > 0) | regression, "KEEP_CHAMPION")
            .otherwise("KEEP_CHAMPION_INCONCLUSIVE"),
            "selected_policy": F.when(promote, F.col("challenger")).otherwise(F.col("champion")),
        }
    )


def promotion_gate(evidence: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nine named checks as rows, each with the verdict of all nine.

    ``evidence`` has one row per comparison with ``baseline_*`` and ``candidate_*`` figures,
    ``ci95_high``, ``candidate_p95_ms`` and ``heldout_cases``.
    """
    c, b = (lambda n: F.col(f"candidate_{n}")), (lambda n: F.col(f"baseline_{n}"))
    # Check names.
    checks = {
        "heldout_residual_weighted_risk_improved": c("residual_weighted_risk") < b("residual_weighted_risk"),
        "paired_bootstrap_ci_excludes_zero": F.col("ci95_high") < 0,
        "critical_error_capture_nonregression": c("critical_error_capture") + _TOLERANCE
        >= b("critical_error_capture"),
        "false_greenlight_nonregression": c("false_greenlight_rate") <= b("false_greenlight_rate") + _TOLERANCE,
        "brier_improved": c("brier") < b("brier"),
        "pr_auc_improved": c("pr_auc") > b("pr_auc"),
        "candidate_single_case_p95_under_25ms": c("p95_ms") <= 25.0,
        "review_budget_respected": c("review_budget_respected"),
        "heldout_sample_size_at_least_500": F.col("heldout_cases") >= 500,
    }
    passed = {name: F.coalesce(check, F.lit(False)) for name, check in checks.items()}
    everything = F.lit(True)
    for check in passed.values():
        everything = everything & check
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("check"), v.alias("passed")) for n, v in passed.items()])
    )
    return evidence.select(
        *keys, rows.alias("_r"),
        F.when(everything, "PROMOTE_LEARNED_ROUTER").otherwise("KEEP_FROZEN_RULE_BASELINE").alias("decision"),
    ).select(*keys, "_r.check", "_r.passed", "decision")
