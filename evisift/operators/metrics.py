"""Quality metrics: classification, probability, risk gate, stress safety, release gate.

Everything reduces the case table once, map-side first, to a table whose size depends on the number of
labels, segments or distinct scores, and finishes there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.functions.stats import binomial_upper_95
from evisift.operators.prefix import MAX_GROUP_ROWS, running_totals
from evisift.schemas import STATUSES
from evisift.session import pin


# ---------------------------------------------------------------------------------------------
# flags and splits


def with_error_flags(results: DataFrame) -> DataFrame:
    """Keep rows with a gold status and flag errors. ``criticality >= 3`` is critical."""
    wrong = F.col("status") != F.col("gold_status")
    false_satisfied = (F.col("status") == "SATISFIED") & wrong
    return results.filter("gold_status is not null").withColumns(
        {
            "error": wrong,
            "false_satisfied": false_satisfied,
            "auto_error": wrong & (F.col("automation_status") == "AUTO_DECISION_ELIGIBLE"),
            "critical": F.col("criticality") >= 3,
            "critical_false_assurance": false_satisfied & (F.col("criticality") >= 3),
            "weighted_error": F.when(wrong, F.col("criticality")).otherwise(0).cast("double"),
        }
    )


def split_counts(cases: DataFrame, by: str = "split", label: str | None = None) -> DataFrame:
    rate = [F.round(F.avg(F.col(label).cast("double")), 6).alias("label_rate")] if label else []
    return cases.groupBy(by).agg(F.count("*").alias("n_cases"), *rate)


# ---------------------------------------------------------------------------------------------
# classification


def confusion_counts(results: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*group, "gold_status", "status").agg(F.count("*").alias("n"))


def classification_report(results: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per label: support, precision, recall, F1; and the overall figures on every row.

    Macro F1 averages over labels that occur in gold only. Predicted counts include rows without gold.
    """
    label = F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("label")
    counts = confusion_counts(results, group).select("*", label)
    known = F.col("gold_status").isNotNull()
    is_gold, is_pred = F.col("gold_status") == F.col("label"), F.col("status") == F.col("label")
    cell = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    rows = counts.groupBy(*group, "label").agg(
        cell(known & is_gold & is_pred, "tp"),
        cell(known & is_gold, "support"),
        cell(known & is_pred, "predicted"),
        cell(is_pred, "predicted_count"),
        cell(known, "n_cases"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumns({"_p": ratio("tp", "predicted"), "_r": ratio("tp", "support")})
    rows = rows.withColumn(
        "_f",
        F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
        .otherwise(0.0),
    )
    overall = rows.groupBy(*group).agg(
        F.round(
            F.coalesce(F.sum("tp") / F.when(F.max("n_cases") > 0, F.max("n_cases")), F.lit(0.0)), 6
        ).alias("accuracy"),
        F.round(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("_f"))), F.lit(0.0)), 6).alias("macro_f1"),
    )
    both = rows.join(overall, list(group)) if group else rows.crossJoin(F.broadcast(overall))  # one row
    return both.select(
        *group, "label", "n_cases", "accuracy", "macro_f1", "support",
        F.round("_p", 6).alias("precision"), F.round("_r", 6).alias("recall"), F.round("_f", 6).alias("f1"),
        "predicted_count",
    )


# ---------------------------------------------------------------------------------------------
# probabilities

_CLIP = 1e-6
# Right-closed tenths, compared as written, never multiplied.
_TENTHS = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def calibration_bucket(probability):
    """Index 0..9 of the right-closed tenth that holds the probability."""
    bucket = F.lit(0)
    for edge in _TENTHS:
        bucket = bucket + (probability > edge).cast("int")
    return bucket


def probability_metrics(
    scored: DataFrame, group: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """AUROC, average precision, Brier, log loss and 10-bin calibration error per group.

    ``scored`` has ``score`` and ``label`` (0/1). Rows are first merged into one row per distinct
    score, which is all the five figures need; ties then count as the definitions ask. AUROC is the
    Mann-Whitney statistic with mid-ranks and null when a group has one class only.
    """
    keys = list(group)
    p = F.least(F.lit(1 - _CLIP), F.greatest(F.lit(_CLIP), F.col("score"))).alias("p")
    per_score = scored.select(*keys, p, F.col("label").cast("bigint").alias("label")).groupBy(*keys, "p").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    steps = running_totals(
        per_score.withColumn("_down", -F.col("p")), keys, ["_down"],
        {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, max_group_rows=max_group_rows,
    )
    n = F.col("pos") + F.col("neg")
    # a positive beats every negative below it and half of those level with it
    wins = F.col("neg").cast("double") * (F.col("pos_above") - F.col("pos") / 2)
    precision = F.col("pos_above") / (F.col("pos_above") + F.col("neg_above"))
    binned = steps.withColumn("bucket", calibration_bucket(F.col("p"))).groupBy(*keys, "bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(n * F.col("p")).alias("sum_p"),
        F.sum(wins).alias("wins"),
        F.sum(F.col("pos") * precision).alias("ap"),
        F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p")).alias("sq"),
        F.sum(F.col("pos") * -F.log("p") + F.col("neg") * -F.log1p(-F.col("p"))).alias("ll"),
    )
    pos, neg = F.sum("pos"), F.sum("neg")
    total = pos + neg
    return binned.groupBy(*keys).agg(
        total.alias("n"),
        F.round(F.sum("wins") / F.when((pos > 0) & (neg > 0), pos.cast("double") * neg), 6).alias("auroc"),
        F.round(F.sum("ap") / F.when(pos > 0, pos), 6).alias("pr_auc"),
        F.round(F.sum("sq") / total, 6).alias("brier"),
        F.round(F.sum("ll") / total, 6).alias("log_loss"),
        F.round(F.sum(F.abs(F.col("sum_p") - F.col("pos"))) / total, 6).alias("ece_10"),
    )


# ---------------------------------------------------------------------------------------------
# gates


def risk_gate(flagged: DataFrame, segment: Sequence[str], risk_budget: float = 0.05) -> DataFrame:
    """Exact upper bound on the error rate of automatic decisions, per segment."""
    if not 0.0 < risk_budget < 1.0:
        raise ValueError(f"risk budget {risk_budget} is outside 0 to 1")
    auto = F.col("automation_status") == "AUTO_DECISION_ELIGIBLE"
    counts = flagged.groupBy(*segment).agg(
        F.count_if(auto).alias("accepted_count"), F.count_if(auto & F.col("error")).alias("error_count")
    )
    bound = binomial_upper_95("error_count", "accepted_count")
    return (
        counts.withColumn("_bound", bound)
        .withColumns(
            {
                "upper_bound": F.round("_bound", 6),
                "risk_budget": F.lit(risk_budget),
                "passed": (F.col("accepted_count") >= 60) & (F.col("_bound") <= risk_budget),
            }
        )
        .drop("_bound")
    )


def injected_evidence_uses(usable: DataFrame, injected: DataFrame) -> DataFrame:
    """Usable evidence ids that are flagged as injected, per case."""
    keys = ["case_id", "evidence_id"]
    return usable.select(*keys).intersect(injected.select(*keys)).groupBy("case_id").agg(
        F.count("*").alias("injection_uses")
    )


def stress_safety(flagged: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """Error counts and whether the segment is free of them.

    ``injection_uses`` counts only for cases whose mutation is a prompt injection.
    """
    uses = F.when(F.col("mutation") == "prompt_injection", F.coalesce("injection_uses", F.lit(0))).otherwise(0)
    sums = flagged.groupBy(*segment).agg(
        F.count("*").alias("n_cases"),
        F.count_if("error").alias("errors"),
        F.count_if("false_satisfied").alias("false_satisfied"),
        F.count_if("auto_error").alias("auto_decision_errors"),
        F.coalesce(F.sum(uses), F.lit(0)).alias("prompt_injection_evidence_uses"),
    )
    clean = F.lit(True)
    for name in ("errors", "false_satisfied", "auto_decision_errors", "prompt_injection_evidence_uses"):
        clean = clean & (F.col(name) == 0)
    return sums.withColumn("passed", clean)


def release_gate(results: DataFrame, injection_uses: DataFrame) -> DataFrame:
    """One row: every release check and the verdict.

    Metrics come from split ``test``, the risk gate from ``gate``, stress safety from ``stress``.
    """
    results = pin(results, "release")
    flagged = with_error_flags(results)
    in_split = lambda df, name: df.filter(F.col("split") == name)
    report = classification_report(in_split(results, "test")).agg(
        F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1")
    )
    test = in_split(flagged, "test").agg(
        F.count_if("auto_error").alias("auto_decision_errors"),
        F.count_if("critical_false_assurance").alias("critical_false_assurance_count"),
    )
    gate = risk_gate(in_split(flagged, "gate"), []).select(
        F.col("upper_bound").alias("gate_upper_bound"), F.col("passed").alias("risk_gate_passed")
    )
    stress = stress_safety(
        in_split(flagged, "stress").join(injection_uses, "case_id", "left")
    ).select(F.col("passed").alias("stress_safety_passed"))
    row = report.crossJoin(test).crossJoin(gate).crossJoin(stress)  # one row each
    passed = (
        (F.col("accuracy") >= 0.95) & (F.col("macro_f1") >= 0.95)
        & (F.col("auto_decision_errors") == 0) & (F.col("critical_false_assurance_count") == 0)
        & F.col("risk_gate_passed") & F.col("stress_safety_passed")
    )
    return row.withColumn("release_passed", passed)


def latency_summary(log: DataFrame, group: Sequence[str], value: str = "latency_ms") -> DataFrame:
    """Requests, p50/p95/p99 by linear interpolation, p95/p99 by nearest rank, and the maximum.

    The nearest rank is ``round-half-even((n - 1) * q)``. Values are merged to counts per distinct value
    first, so a group of any size is ranked from its value histogram.
    """
    per_value = log.groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(per_value, list(group), [value], {"_upto": F.col("_n")})
    sizes = ranked.groupBy(*group).agg(F.sum("_n").alias("requests"), F.max(value).alias("max_ms"))
    placed = ranked.join(sizes, list(group))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    rank = lambda q: F.bround((F.col("requests") - 1) * F.lit(q), 0)

    def linear(q: float):
        place = (F.col("requests") - 1) * F.lit(q)
        low = F.floor(place)
        lower, upper, part = at(low), at(F.ceil(place)), F.max(place - low)
        return F.round(lower + (upper - lower) * part, 6)

    return placed.groupBy(*group, "requests", "max_ms").agg(
        linear(0.50).alias("p50_ms"), linear(0.95).alias("p95_ms"), linear(0.99).alias("p99_ms"),
        at(rank(0.95)).alias("p95_rank_ms"), at(rank(0.99)).alias("p99_rank_ms"),
    )
