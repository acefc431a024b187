import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisift.operators import knapsack, qualify, routing
from evisift.operators.prefix import running_totals

SCHEMA = "queue string, case_id string, score double, criticality int, expected_review_minutes double, error boolean"
CAPACITIES = (0.0, 0.05, 0.2, 0.4, 1.0)


def items(n=1500, seed=5):
    rng = random.Random(seed)
    return [
        (f"q{i % 3 if i % 2 else 0}", f"c{i:05d}", round(rng.random(), 2), rng.randint(1, 5),
         float(rng.choice([2, 4, 6, 10, 15, 2.5])), rng.random() < 0.2)
        for i in range(n)
    ]


KEYS = {
    "risk": lambda r: (-r[2], r[1]),
    "risk_per_minute": lambda r: (-(r[2] * r[3] / r[4]), r[1]),
    "criticality": lambda r: (-r[3], r[1]),
    "random": lambda r: hashlib.md5(f"7|{r[1]}".encode()).hexdigest(),
}


def walk(rows, policy, capacity):
    left = sum(r[4] for r in rows) * capacity
    taken = []
    for r in sorted(rows, key=KEYS[policy]):
        if r[4] <= left + 1e-9:
            taken.append(r)
            left -= r[4]
    return taken


def test_route_equals_sequential_walk_in_both_forms(spark):
    data = items()
    df = spark.createDataFrame(data, SCHEMA)
    packed = routing.route(df, ["queue"], routing.POLICIES, CAPACITIES)
    ranged = routing.route(df, ["queue"], routing.POLICIES, CAPACITIES, max_group_rows=100, part_rows=90)
    got = sorted(tuple(r) for r in packed.collect())
    assert got == sorted(tuple(r) for r in ranged.select(packed.columns).collect())
    for r in packed.collect():
        rows = [x for x in data if x[0] == r["queue"]]
        taken = walk(rows, r["policy"], r["capacity"])
        weight = sum(x[3] for x in rows if x[5]) - sum(x[3] for x in taken if x[5])
        assert (r["reviewed_count"], r["residual_weighted_risk"]) == (len(taken), float(weight))
        assert r["used_minutes"] == pytest.approx(sum(x[4] for x in taken)) and r["review_budget_respected"]


def test_selected_rows(spark):
    data = items(600)
    ranked = routing.with_policies(spark.createDataFrame(data, SCHEMA), ("risk", "random"))
    group = ["queue", "policy"]
    for sizes in ({}, {"max_group_rows": 50, "part_rows": 40}):
        cutoffs = routing.budget_cutoffs(ranked, group, [0.2], **sizes)
        chosen = routing.select_within_budget(ranked, cutoffs, group).filter("taken > 0")
        got = {(r["queue"], r["policy"], r["case_id"]) for r in chosen.collect()}
        want = {
            (q, p, x[1]) for q in ("q0", "q1", "q2") for p in ("risk", "random")
            for x in walk([r for r in data if r[0] == q], p, 0.2)
        }
        assert got == want


def test_repeated_rows_are_walked_one_by_one(spark):
    rng = random.Random(9)
    data = [(*r, rng.choice([1, 1, 2, 5])) for r in items(300)]
    df = spark.createDataFrame(data, SCHEMA + ", copies bigint")
    out = routing.route(df, ["queue"], ("risk",), [0.1, 0.3], max_group_rows=40, part_rows=30)
    for r in out.collect():
        rows = [x[:6] for x in data if x[0] == r["queue"] for _ in range(x[6])]
        taken = walk(rows, "risk", r["capacity"])
        assert (r["n"], r["reviewed_count"]) == (len(rows), len(taken))


def test_many_distinct_lengths(spark):
    rng = random.Random(2)
    data = [("q", f"c{i:04d}", rng.random(), 1, rng.randint(1, 24000) / 100, False) for i in range(800)]
    df = spark.createDataFrame(data, SCHEMA)
    out = routing.route(df, ["queue"], ("risk",), [0.05, 0.5], max_group_rows=100, part_rows=60)
    for r in out.collect():
        assert r["reviewed_count"] == len(walk(data, "risk", r["capacity"]))


def test_running_totals_on_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i}", i, i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, at int, v bigint")
    small = running_totals(df, ["g"], ["at"], {"t": F.col("v"), "n": F.lit(1).cast("bigint")})
    large = running_totals(df, ["g"], ["at"], {"t": F.col("v"), "n": F.lit(1).cast("bigint")}, max_group_rows=50, part_rows=70)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_partitions_do_not_change_results(spark, partitions):
    df = spark.createDataFrame(items(400), SCHEMA)
    run = lambda: sorted(map(tuple, routing.route(df, ["queue"], ("risk", "random"), [0.2]).collect()))
    want = run()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def qualification(error_risk, ok_risk):
    return [
        ("q", f"case-{i:02d}", error_risk if i % 2 == 0 else ok_risk, 5 if i % 2 == 0 else 1, 1.0, i % 2 == 0)
        for i in range(40)
    ]


@pytest.mark.parametrize(
    ("risks", "champion", "challenger", "decision"),
    [
        ((0.9, 0.1), "random", "risk", "PROMOTE"),
        ((0.1, 0.9), "criticality", "risk", "REJECT"),
        ((0.9, 0.1), "risk", "risk_per_minute", "INCONCLUSIVE_KEEP_CHAMPION"),
    ],
)
def test_qualification(spark, risks, champion, challenger, decision):
    df = spark.createDataFrame(qualification(*risks), SCHEMA)
    row = qualify.qualify_policy(
        df, ["queue"], champion=champion, challenger=challenger, capacity=0.2, replicates=100
    ).first()
    assert row["decision"] == decision and row["budget_respected"]
    if decision.startswith("INCONCLUSIVE"):
        assert (row["ci_low"], row["ci_high"]) == (0.0, 0.0)


def test_bootstrap_of_large_groups_equals_small(spark):
    df = spark.createDataFrame(items(240), SCHEMA)
    run = lambda **sizes: sorted(map(tuple, qualify.paired_bootstrap(
        df, ["queue"], champion="risk", challenger="risk_per_minute", capacity=0.2, replicates=60, **sizes
    ).collect()))
    assert run() == run(max_group_rows=30, part_rows=2000)
    with pytest.raises(ValueError):
        run_few = qualify.paired_bootstrap(
            df, ["queue"], champion="risk", challenger="random", capacity=0.2, replicates=10
        )
        run_few.collect()


def test_scenarios(spark):
    base = {"champion": "risk", "challenger": "rpm", "champion_critical_capture": 0.5, "challenger_critical_capture": 0.5}
    rows = [("a", "PROMOTE"), ("a", "PROMOTE"), ("b", "PROMOTE"), ("b", "REJECT"), ("c", "PROMOTE"), ("c", "INCONCLUSIVE_KEEP_CHAMPION")]
    df = spark.createDataFrame([(g, d, *base.values()) for g, d in rows], ["g", "decision", *base])
    got = {r["g"]: (r["recommended_action"], r["selected_policy"]) for r in qualify.scenario_stability(df, ["g"]).collect()}
    assert got == {"a": ("PROMOTE_CHALLENGER", "rpm"), "b": ("KEEP_CHAMPION", "risk"), "c": ("KEEP_CHAMPION_INCONCLUSIVE", "risk")}


def test_best_capture_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        k = rng.randint(1, 6)
        values = [rng.randint(0, 5) for _ in range(k)]
        weights = [rng.choice([1, 2, 3, 4, 6, 7, 10, 15, 25]) for _ in range(k)]
        counts = [rng.randint(0, 25) for _ in range(k)]
        capacity = rng.randint(0, sum(w * c for w, c in zip(weights, counts)) + 3)
        table = [-1] * (capacity + 1)
        table[0] = 0
        for value, weight, count in zip(values, weights, counts):
            for _ in range(count):
                for at in range(capacity, weight - 1, -1):
                    if value and table[at - weight] >= 0:
                        table[at] = max(table[at], table[at - weight] + value)
        want = (max(table), table.index(max(table)))
        assert knapsack.best_capture(np.array(values), np.array(weights), np.array(counts), capacity) == want


def test_bounds_order(spark):
    df = spark.createDataFrame(items(400), SCHEMA)
    best = {(r["queue"], r["capacity"]): r for r in knapsack.knapsack_bound(df, ["queue"], [0.1, 0.3]).collect()}
    loose = {(r["queue"], r["capacity"]): r for r in knapsack.fractional_bound(df, ["queue"], [0.1, 0.3]).collect()}
    for r in routing.route(df, ["queue"], routing.POLICIES, [0.1, 0.3]).collect():
        key = (r["queue"], r["capacity"])
        assert best[key]["residual_weighted_risk"] <= r["residual_weighted_risk"]
        assert best[key]["captured_weight"] <= loose[key]["captured_weight_bound"] + 1e-6
