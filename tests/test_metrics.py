import math
import random

import pytest
from pyspark.sql import functions as F

from evisift.functions.stats import binomial_upper_bound
from evisift.operators import metrics


def test_binomial_bound():
    assert binomial_upper_bound(0, 60) == pytest.approx(1 - 0.05 ** (1 / 60))
    bounds = [binomial_upper_bound(e, 60) for e in range(3)]
    assert bounds == sorted(bounds) and len(set(bounds)) == 3
    assert binomial_upper_bound(0, 0) == 1.0 and binomial_upper_bound(5, 5) == 1.0
    with pytest.raises(ValueError):
        binomial_upper_bound(6, 5)
    for errors, n in ((7, 500), (50, 900)):
        p = binomial_upper_bound(errors, n)
        chance = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(errors + 1))
        assert chance == pytest.approx(0.05)


def test_probability_metrics_against_definitions(spark):
    rng = random.Random(8)
    rows = [("m", round(rng.random(), 1 if i % 2 else 3), int(rng.random() < 0.3)) for i in range(500)]
    rows += [("one", 0.4, 1), ("one", 0.7, 1)]
    df = spark.createDataFrame(rows, "m string, score double, label int")
    got = {r["m"]: r for r in metrics.probability_metrics(df, ["m"]).collect()}
    ranged = {r["m"]: r for r in metrics.probability_metrics(df, ["m"], max_group_rows=20).collect()}
    assert got == ranged
    data = [(min(1 - 1e-6, max(1e-6, s)), y) for m, s, y in rows if m == "m"]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for s in sorted({s for s, _ in data}, reverse=True):
        above = [y for t, y in data if t >= s]
        ap += (sum(above) - seen) / len(pos) * sum(above) / len(above)
        seen = sum(above)
    bins = {}
    for s, y in data:
        at = next(i for i in range(10) if s <= (i + 1) / 10 + (1e-16 if i == 9 else 0) or i == 9)
        bins.setdefault(at, []).append((s, y))
    ece = sum(abs(sum(s - y for s, y in b)) for b in bins.values()) / len(data)
    row = got["m"]
    assert row["auroc"] == pytest.approx(auroc, abs=2e-6)
    assert row["pr_auc"] == pytest.approx(ap, abs=2e-6)
    assert row["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in data) / len(data), abs=2e-6)
    assert row["log_loss"] == pytest.approx(-sum(math.log(s if y else 1 - s) for s, y in data) / len(data), abs=2e-6)
    assert row["ece_10"] == pytest.approx(ece, abs=2e-6)
    assert got["one"]["auroc"] is None


def test_classification_report(spark):
    rows = [("SATISFIED", "SATISFIED"), ("SATISFIED", "CONFLICT"), ("CONFLICT", "CONFLICT"), (None, "NOT_SATISFIED")]
    report = metrics.classification_report(spark.createDataFrame(rows, "gold_status string, status string"))
    by = {r["label"]: r for r in report.collect()}
    assert len(by) == 5 and by["CONFLICT"]["precision"] == 0.5 and by["SATISFIED"]["recall"] == 0.5
    assert by["CONFLICT"]["accuracy"] == pytest.approx(2 / 3, abs=1e-6)
    assert by["CONFLICT"]["macro_f1"] == pytest.approx(2 / 3, abs=1e-6)
    assert by["NOT_SATISFIED"]["predicted_count"] == 1 and by["NOT_SATISFIED"]["f1"] == 0.0


def test_gates(spark):
    auto = "AUTO_DECISION_ELIGIBLE"
    rows = [("a", auto, False)] * 60 + [("b", auto, False)] * 59 + [("c", auto, True)] + [("c", auto, False)] * 80
    gate = metrics.risk_gate(spark.createDataFrame(rows, "s string, automation_status string, error boolean"), ["s"])
    got = {r["s"]: (r["accepted_count"], r["error_count"], r["passed"]) for r in gate.collect()}
    assert got == {"a": (60, 0, True), "b": (59, 0, False), "c": (81, 1, False)}


def test_injected_uses_count_only_on_injection_cases(spark):
    rows = [("c1", "prompt_injection", 2), ("c2", "none", 3)]
    df = spark.createDataFrame(rows, "case_id string, mutation string, injection_uses bigint").withColumns(
        {n: F.lit(False) for n in ("error", "false_satisfied", "auto_error")}
    )
    row = metrics.stress_safety(df).first()
    assert row["prompt_injection_evidence_uses"] == 2 and not row["passed"]
