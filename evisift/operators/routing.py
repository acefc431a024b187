"""Review routing: rank cases by a policy and fill a budget of reviewer minutes.

The walk is greedy with skip: take a case if its minutes still fit, else skip it and go on. What is
left only shrinks, so once a case of m minutes is refused, every later case of m minutes or more is
refused too. A walk is therefore described completely by a few *cutoffs* (at most one per distinct
minutes value): the place in the ranking where that length stopped fitting. Finding the cutoffs is the
sequential part; everything after that is a join on a small table and a plain aggregation.

Minutes are held as integer micro-minutes, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.operators.prefix import MAX_GROUP_ROWS, range_parts, running_totals, split_large_groups
from evisift.session import pin

POLICIES = ("random", "criticality", "risk", "risk_per_minute")
RISK_COVERAGE_CAPACITIES = (0.05, 0.10, 0.20, 0.30, 0.40)
CRITICAL_FROM = 3
MICRO = 1_000_000

_CUTOFFS = "array<struct<minutes_u:bigint,sort_key:double,tie:string,taken:bigint>>"


def micro_minutes(minutes: Column) -> Column:
    return F.round(minutes * MICRO).cast("bigint")


def policy_key(policy: str, seed: int = 7, row=F.col) -> Column:
    """``struct(policy, sort_key, tie)``; ascending order of the last two is the policy's ranking.

    ``row`` maps a column name to the value: a column of the frame or a field of a packed struct. The
    random policy orders by an MD5 of seed and case id, which any engine can repeat. Any other name than
    the four policies is the name of a score column.
    """
    if policy == "risk":
        key = -row("score")
    elif policy == "risk_per_minute":
        key = -(row("score") * row("criticality") / row("expected_review_minutes"))
    elif policy == "criticality":
        key = -row("criticality").cast("double")
    elif policy == "random":
        key = F.lit(0.0)
    elif policy in ("baseline", "candidate"):
        key = -row(policy)
    else:
        raise ValueError(f"no ranking is defined for policy {policy!r}")
    tie = F.md5(F.concat(F.lit(f"{seed}|"), row("case_id"))) if policy == "random" else row("case_id")
    return F.struct(
        F.lit(policy).alias("policy"), key.cast("double").alias("sort_key"), tie.alias("tie")
    )


def policy_columns(policies: Sequence[str]) -> list[str]:
    """Columns that the rankings of ``policies`` and the outcome read."""
    scores = {"risk": ["score"], "risk_per_minute": ["score"], "criticality": [], "random": []}
    wanted = ["case_id", "criticality", "expected_review_minutes", "error"]
    for policy in policies:
        wanted += [c for c in scores.get(policy, [policy]) if c not in wanted]
    return wanted


def with_policies(items: DataFrame, policies: Sequence[str] = POLICIES, seed: int = 7) -> DataFrame:
    """One row per case and policy, in one pass, with ``minutes_u`` and ``copies``."""
    exploded = items.withColumn("_p", F.explode(F.array(*[policy_key(p, seed) for p in policies])))
    if "copies" not in items.columns:
        exploded = exploded.withColumn("copies", F.lit(1).cast("bigint"))
    return exploded.withColumn("minutes_u", micro_minutes(F.col("expected_review_minutes"))).select(
        "*", "_p.*"
    ).drop("_p")


def policy_rank(ranked: DataFrame, group: Sequence[str], **sizes: int) -> DataFrame:
    """Position of every case in its group's ranking, for groups of any size."""
    return running_totals(ranked, group, ["sort_key", "tie"], {"rank": F.lit(1).cast("bigint")}, **sizes)


# ---------------------------------------------------------------------------------------------
# cutoffs


def _fold(ordered: Column, left: Column, limit: Column, cutoffs: Column) -> Column:
    """Walk ``ordered`` and return ``struct(left, limit, cutoffs)``.

    ``limit`` is the smallest length refused so far; rows at least that long are passed over.
    """

    def step(state: Column, row: Column) -> Column:
        fits = F.when(row["copies"] * row["minutes_u"] <= state["left"], row["copies"]).otherwise(
            F.floor(state["left"] / row["minutes_u"])
        )
        taken = F.when(row["minutes_u"] >= state["limit"], F.lit(0).cast("bigint")).otherwise(fits)
        refused = (row["minutes_u"] < state["limit"]) & (fits < row["copies"])
        cut = F.struct(
            row["minutes_u"].alias("minutes_u"), row["sort_key"].alias("sort_key"),
            row["tie"].alias("tie"), fits.alias("taken"),
        )
        return F.struct(
            (state["left"] - taken * row["minutes_u"]).alias("left"),
            F.when(refused, row["minutes_u"]).otherwise(state["limit"]).alias("limit"),
            F.when(refused, F.concat(state["cutoffs"], F.array(cut))).otherwise(state["cutoffs"]).alias(
                "cutoffs"
            ),
        )

    start = F.struct(left.alias("left"), limit.alias("limit"), cutoffs.alias("cutoffs"))
    return F.aggregate(ordered, start, step)


def _no_limit() -> Column:
    return F.lit(2**63 - 1).cast("bigint")


def available_minutes(total: Column, capacity: Column) -> Column:
    """Whole micro-minutes of a share of ``total``, with 1e-9 minutes of slack.

    Both factors are decimals whose product is exact; a capacity keeps all digits that a double shows.
    """
    return F.floor(total.cast("decimal(19,0)") * capacity.cast("decimal(18,17)") + F.expr("0.001BD")).cast("bigint")


def _lanes(totals: DataFrame, capacities: Sequence[float]) -> DataFrame:
    """One row per group and capacity with its budget."""
    capacity = F.explode(F.array(*[F.lit(float(c)) for c in capacities]))
    return totals.withColumn("capacity", capacity).withColumn(
        "available_u", available_minutes(F.col("total_u"), F.col("capacity"))
    )


def _ordered() -> Column:
    return F.sort_array(F.collect_list(F.struct("sort_key", "tie", "minutes_u", "copies")))


def budget_cutoffs(
    ranked: DataFrame,
    group: Sequence[str],
    capacities: Sequence[float],
    max_group_rows: int = MAX_GROUP_ROWS,
    part_rows: int = MAX_GROUP_ROWS,
    pinned: bool = False,
) -> DataFrame:
    """Cutoffs per (group, capacity) with ``available_u`` and ``used_u`` micro-minutes.

    ``ranked`` has the group columns, ``sort_key``, ``tie``, ``minutes_u`` and ``copies``. Only these
    narrow columns are shuffled. Budgets are a share of each group's total minutes.
    """
    for capacity in capacities:
        if not 0.0 <= capacity <= 1.0:
            raise ValueError(f"capacity {capacity} is outside 0 to 1")
    narrow = ranked.select(*group, "sort_key", "tie", "minutes_u", "copies")
    if not pinned:
        narrow = pin(narrow, "ranked")
    small, large, rows = split_large_groups(narrow, group, max_group_rows)
    out = _small_group_cutoffs(small, group, capacities)
    if large is not None:
        out = out.unionByName(_large_group_cutoffs(large, group, capacities, rows, part_rows))
    return pin(out, "cutoffs")


def _small_group_cutoffs(small: DataFrame, group: Sequence[str], capacities: Sequence[float]) -> DataFrame:
    packed = small.groupBy(*group).agg(
        F.sum(F.col("minutes_u") * F.col("copies")).alias("total_u"), _ordered().alias("_ordered")
    )
    budgets = F.array(
        *[
            F.struct(F.lit(float(c)).alias("capacity"), available_minutes(F.col("total_u"), F.lit(float(c))).alias("available_u"))
            for c in capacities
        ]
    )
    walked = packed.withColumn("_budgets", budgets).select(
        *group,
        F.explode(
            F.transform(
                "_budgets",
                lambda b: F.struct(
                    b["capacity"].alias("capacity"),
                    b["available_u"].alias("available_u"),
                    _fold(
                        F.col("_ordered"), b["available_u"], _no_limit(), F.array().cast(_CUTOFFS)
                    ).alias("end"),
                ),
            )
        ).alias("_w"),
    )
    return walked.select(
        *group, "_w.capacity", "_w.available_u",
        (F.col("_w.available_u") - F.col("_w.end.left")).alias("used_u"),
        F.col("_w.end.cutoffs").alias("cutoffs"),
    )


def _large_group_cutoffs(
    large: DataFrame, group: Sequence[str], capacities: Sequence[float], rows: int, part_rows: int
) -> DataFrame:
    """Walk range parts of a large group instead of its rows.

    Minutes per part and length are summed once. Each round finds, per budget, the first part whose
    active rows do not all fit, and walks only that part. Every such part adds at least one cutoff, so
    there are at most as many rounds as distinct lengths.
    """
    ranged = range_parts(large, group, ["sort_key", "tie"], rows, part_rows)
    sums = pin(
        ranged.groupBy(*group, "_part", "minutes_u").agg(
            F.sum(F.col("minutes_u") * F.col("copies")).alias("_need")
        ),
        "part-sums",
    )
    totals = sums.groupBy(*group).agg(F.sum("_need").alias("total_u"))
    lane = [*group, "capacity"]
    state = pin(
        _lanes(totals, capacities).select(
            *lane, "available_u", F.col("available_u").alias("left"), _no_limit().alias("limit"),
            F.array().cast(_CUTOFFS).alias("cutoffs"), F.lit(-1).alias("_done"),
            F.lit(True).alias("_open"),
        ),
        "lanes",
    )
    by_part = Window.partitionBy(*lane).orderBy("_part")
    while state.filter("_open").limit(1).count():
        ahead = (
            state.filter("_open").select(*lane, "left", "limit", "_done").join(sums, list(group))
            .filter((F.col("_part") > F.col("_done")) & (F.col("minutes_u") < F.col("limit")))
            .groupBy(*lane, "_part", "left", "limit")
            .agg(F.sum("_need").alias("_need"))
            .withColumn("_upto", F.sum("_need").over(by_part))
        )
        fitting = ahead.groupBy(*lane).agg(
            F.min(F.when(F.col("_upto") > F.col("left"), F.struct("_part", "_upto", "_need"))).alias("_hit"),
            F.max("_upto").alias("_all"),
        )
        hit = fitting.filter("_hit is not null").select(
            *lane, F.col("_hit._part").alias("_part"),
            (F.col("_hit._upto") - F.col("_hit._need")).alias("_before"),
        )
        start = F.struct((F.col("left") - F.col("_before")).alias("left"), "limit", "cutoffs")
        # one row per open budget: written, so it is broadcast and prunes the parts that are read
        walk_state = pin(state.join(hit, lane).select(*lane, "_part", start.alias("_s")), "walk")
        walked = (
            ranged.join(walk_state, [*group, "_part"])
            .filter(F.col("minutes_u") < F.col("_s.limit"))
            .groupBy(*lane, "_part", "_s")
            .agg(_ordered().alias("_ordered"))
            .select(
                *lane, "_part",
                _fold(F.col("_ordered"), F.col("_s.left"), F.col("_s.limit"), F.col("_s.cutoffs")).alias("_end"),
            )
        )
        moved = state.join(walked, lane, "left").join(fitting.select(*lane, "_all"), lane, "left")
        closing = F.col("_end").isNull()
        state = pin(
            moved.select(
                *lane, "available_u",
                F.when(closing, F.col("left") - F.when(F.col("_open"), F.coalesce("_all", F.lit(0))).otherwise(0))
                .otherwise(F.col("_end.left")).alias("left"),
                F.coalesce("_end.limit", "limit").alias("limit"),
                F.coalesce("_end.cutoffs", "cutoffs").alias("cutoffs"),
                F.coalesce("_part", "_done").alias("_done"),
                (~closing).alias("_open"),
            ),
            "lanes",
        )
    return state.select(
        *lane, "available_u", (F.col("available_u") - F.col("left")).alias("used_u"), "cutoffs"
    )


def taken_copies(cutoffs: Column, minutes_u: Column, sort_key: Column, tie: Column, copies: Column) -> Column:
    """How many copies of a row the walk took, from the cutoffs of its group."""
    here = F.struct(sort_key.alias("sort_key"), tie.alias("tie"))
    place = lambda c: F.struct(c["sort_key"].alias("sort_key"), c["tie"].alias("tie"))
    applies = lambda c: (c["minutes_u"] <= minutes_u) & (place(c) <= here)
    at = F.filter(cutoffs, lambda c: applies(c))
    first = F.get(at, F.lit(0))
    return (
        F.when(F.size(at) == 0, copies)
        .when((F.size(at) == 1) & (place(first) == here) & (first["minutes_u"] == minutes_u), first["taken"])
        .otherwise(F.lit(0).cast("bigint"))
    )


def select_within_budget(ranked: DataFrame, cutoffs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every ranked row per capacity with ``taken``, the number of copies sent to review.

    The join is on the group only; ``cutoffs`` is a written table, so the planner knows whether it is
    small enough to broadcast and otherwise lets AQE split the hot groups.
    """
    joined = ranked.join(cutoffs, list(group))
    return joined.withColumn(
        "taken",
        taken_copies(*[F.col(n) for n in ("cutoffs", "minutes_u", "sort_key", "tie", "copies")]),
    ).drop("cutoffs")


# ---------------------------------------------------------------------------------------------
# outcomes


_SUMS = ("n", "reviewed_count", "_weight", "_weight_taken", "_critical", "_critical_taken", "_errors", "_errors_taken")


def _report(sums: DataFrame, group: Sequence[str]) -> DataFrame:
    """Figures from the summed counts of a walk."""
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6)).otherwise(1.0)
    unsafe = F.col("_errors") - F.col("_errors_taken")
    passed_over = F.col("n") - F.col("reviewed_count")
    return sums.select(
        *group, "capacity", "n", "reviewed_count",
        F.round(F.col("reviewed_count") / F.col("n"), 6).alias("reviewed_fraction"),
        F.round(F.col("used_u") / MICRO, 6).alias("used_minutes"),
        F.round(F.col("available_u") / MICRO, 6).alias("available_minutes"),
        (F.col("used_u") <= F.col("available_u")).alias("review_budget_respected"),
        (F.col("_weight") - F.col("_weight_taken")).cast("double").alias("residual_weighted_risk"),
        share("_weight_taken", "_weight").alias("weighted_error_capture"),
        share("_critical_taken", "_critical").alias("critical_error_capture"),
        unsafe.alias("unsafe_auto_decisions"),
        F.round(unsafe / F.greatest(F.lit(1), passed_over), 6).alias("false_greenlight_rate"),
        F.round(passed_over / F.col("n"), 6).alias("accepted_coverage"),
    )


def routing_outcome(selection: DataFrame, group: Sequence[str]) -> DataFrame:
    """Budget, residual risk and safety figures per (group, capacity) of a selection.

    ``selection`` needs ``error`` (boolean) and ``criticality`` next to the walk's columns. One
    aggregation with map-side partial sums, so it suits groups of any size.
    """
    copies, taken = F.col("copies"), F.col("taken")
    weight = F.when(F.col("error"), F.col("criticality")).otherwise(0)
    critical = (F.col("error") & (F.col("criticality") >= CRITICAL_FROM)).cast("int")
    error = F.col("error").cast("int")
    values = (
        copies, taken, copies * weight, taken * weight, copies * critical, taken * critical,
        copies * error, taken * error,
    )
    sums = selection.groupBy(*group, "capacity", "available_u", "used_u").agg(
        *[F.sum(value).alias(name) for name, value in zip(_SUMS, values, strict=True)]
    )
    return _report(sums, group)


def _outcome_of_small_groups(
    items: DataFrame, group: Sequence[str], policies: Sequence[str], capacities: Sequence[float], seed: int
) -> DataFrame:
    """Walk groups that fit a task: pack each once, then sort and walk it per policy and capacity.

    One exchange for all policies and capacities, and the outcome is summed during the walk.
    """
    big = lambda value: value.cast("bigint")
    packed = items.groupBy(*group).agg(
        F.sum(micro_minutes(F.col("expected_review_minutes"))).alias("total_u"),
        big(F.count("*")).alias("n"),
        big(F.sum(F.when(F.col("error"), F.col("criticality")).otherwise(0))).alias("_weight"),
        big(F.count_if(F.col("error") & (F.col("criticality") >= CRITICAL_FROM))).alias("_critical"),
        big(F.count_if("error")).alias("_errors"),
        F.collect_list(F.struct(*policy_columns(policies))).alias("_items"),
    )

    def ordered(policy: str) -> Column:
        def keyed(x: Column) -> Column:
            key = policy_key(policy, seed, lambda name: x[name])
            wrong = F.coalesce(x["error"], F.lit(False))
            return F.struct(
                key["sort_key"].alias("sort_key"), key["tie"].alias("tie"),
                micro_minutes(x["expected_review_minutes"]).alias("m"),
                big(F.when(wrong, x["criticality"]).otherwise(0)).alias("w"),
                big(wrong & (x["criticality"] >= CRITICAL_FROM)).alias("c"),
                big(wrong).alias("e"),
            )

        return F.sort_array(F.transform("_items", keyed))

    def walk(rows: Column, budget: Column) -> Column:
        names = ("n", "w", "c", "e")
        start = F.struct(budget.alias("left"), *[big(F.lit(0)).alias(name) for name in names])

        def step(state: Column, x: Column) -> Column:
            fits = x["m"] <= state["left"]
            add = {"n": F.lit(1), "w": x["w"], "c": x["c"], "e": x["e"]}
            after = F.struct(
                (state["left"] - x["m"]).alias("left"),
                *[big(state[name] + add[name]).alias(name) for name in names],
            )
            return F.when(fits, after).otherwise(state)

        return F.aggregate(rows, start, step)

    lanes = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("policy"), ordered(p).alias("rows"))
                for p in policies
            ]
        )
    )
    per_policy = packed.select("*", lanes.alias("_lane")).drop("_items")
    per_capacity = per_policy.withColumn(
        "capacity", F.explode(F.array(*[F.lit(float(c)) for c in capacities]))
    ).withColumn("available_u", available_minutes(F.col("total_u"), F.col("capacity")))
    walked = per_capacity.withColumn("_end", walk(F.col("_lane.rows"), F.col("available_u")))
    end = walked.select(
        *group, F.col("_lane.policy").alias("policy"), "capacity", "available_u",
        F.inline(F.array("_end")), "n", "_weight", "_critical", "_errors",
    ).toDF(
        *group, "policy", "capacity", "available_u", "left", "reviewed_count", "_weight_taken",
        "_critical_taken", "_errors_taken", "n", "_weight", "_critical", "_errors",
    )
    return _report(end.withColumn("used_u", F.col("available_u") - F.col("left")), [*group, "policy"])


def route(
    items: DataFrame, group: Sequence[str], policies: Sequence[str], capacities: Sequence[float], *,
    seed: int = 7, max_group_rows: int = MAX_GROUP_ROWS, part_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rank by every policy, fill every budget and report, per (group, policy, capacity).

    ``items`` has the group columns and ``policy_columns(policies)``. Groups up to ``max_group_rows`` are
    walked inside a task; larger ones by range parts and cutoffs.
    """
    for capacity in capacities:
        if not 0.0 <= capacity <= 1.0:
            raise ValueError(f"capacity {capacity} is outside 0 to 1")
    extra = ["copies"] if "copies" in items.columns else []
    narrow = pin(items.select(*group, *policy_columns(policies), *extra), "route")
    small, large, _ = split_large_groups(narrow, group, max_group_rows)
    if extra:  # repeated rows are walked by cutoffs, which know copies
        large, small = narrow, None
    out = None if small is None else _outcome_of_small_groups(small, group, policies, capacities, seed)
    if large is None:
        return out
    keys = [*group, "policy"]
    ranked = pin(
        with_policies(large, policies, seed).select(
            *keys, "sort_key", "tie", "minutes_u", "copies", "criticality", "error"
        ),
        "ranked",
    )
    cutoffs = budget_cutoffs(
        ranked, keys, capacities, pinned=True, max_group_rows=max_group_rows, part_rows=part_rows
    )
    spread = routing_outcome(select_within_budget(ranked, cutoffs, keys), keys)
    return spread if out is None else out.unionByName(spread)
