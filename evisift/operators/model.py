"""Learned risk score: group-held-out split, boosted trees, isotonic calibration, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.operators.features import FEATURES
from evisift.operators.isotonic import apply_isotonic, fit_isotonic
from evisift.operators.metrics import probability_metrics
from evisift.operators.qualify import paired_bootstrap, promotion_gate
from evisift.operators.routing import route
from evisift.session import pin

# Columns the model must never see.
LEAKAGE_COLUMNS = ("frozen_risk_score", "upstream_error", "grp", "gold_status")
PARTITION_ROWS = 2**18
LEAF_CASES = 22


def group_split(
    features: DataFrame, train: Sequence, calibration: Sequence, heldout: Sequence
) -> dict[str, DataFrame]:
    """Rows of each partition by ``grp``. Groups may not be shared and no partition may be empty."""
    parts = {"train": set(train), "calibration": set(calibration), "heldout": set(heldout)}
    if sum(len(v) for v in parts.values()) != len(set().union(*parts.values())):
        raise ValueError("a group may belong to one partition only")
    named = {name: features.filter(F.col("grp").isin(*groups)) for name, groups in parts.items()}
    for name, rows in named.items():
        if not rows.limit(1).count():
            raise ValueError(f"partition {name} is empty")
    return named


def fit_risk_model(
    train: DataFrame, *, max_iter: int = 260, seed: int = 701, partitions: int | None = None,
    features: Sequence[str] = FEATURES,
) -> PipelineModel:
    """Boosted trees on the feature columns.

    Features are counts and fractions of few rows, so many cases are alike in all of them and in the label. Such cases go in as one
    row with their number as its weight: sums, splits and trees are those of the single rows. A leaf holds 22 cases.

    Row order and layout decide split ties, so rows are hashed and sorted into a number of partitions that follows from the
    count of cases: two fits on the same cases then give the same trees. Each level of each tree is a job over all
    partitions, so small data must not be spread over many.
    """
    leaked = set(features) & set(LEAKAGE_COLUMNS)
    if leaked:
        raise ValueError(f"leakage columns in the feature list: {sorted(leaked)}")
    cases = train.count()
    columns = [*features, "label"]
    alike = pin(
        train.select(*features, F.col("upstream_error").cast("double").alias("label")).groupBy(*columns).agg(F.count("*").alias("n")), "alike"
    )
    # the candidate splits come from a sample of rows, so none may stand for many times more cases than others do
    most = max(1, 2 * cases // max(1, alike.count()))
    pieces = F.ceil(F.col("n") / most)
    rows = alike.select(*columns, "n", pieces.alias("_k"), F.explode(F.sequence(F.lit(1), pieces)).alias("_i")).select(
        *columns, "_i", (F.floor(F.col("n") / F.col("_k")) + (F.col("_i") <= F.col("n") % F.col("_k")).cast("int")).cast("double").alias("weight")
    )
    layout = partitions or max(1, -(-cases // PARTITION_ROWS))
    fixed = rows.repartition(layout, *columns).sortWithinPartitions(*columns, "_i")
    # weights are whole numbers; below twice the least number no split is possible
    least = {"minWeightFractionPerNode": (LEAF_CASES - 0.5) / cases} if cases >= 2 * LEAF_CASES else {"minInstancesPerNode": 2 * LEAF_CASES}
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", stepSize=0.055, maxIter=max_iter, maxDepth=5, seed=seed, **least,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="vector"), trees]).fit(fixed)


def raw_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).withColumn("candidate_raw", vector_to_array("probability")[1])
    return scored.drop("vector", "rawPrediction", "probability", "prediction")


def calibrated_scores(
    features: DataFrame, *, train: Sequence, calibration: Sequence, heldout: Sequence,
    max_iter: int = 260, seed: int = 701,
) -> DataFrame:
    """Held-out rows with ``baseline`` and ``candidate`` calibrated probabilities."""
    parts = group_split(pin(features, "features"), train, calibration, heldout)
    model = fit_risk_model(parts["train"], max_iter=max_iter, seed=seed)
    calibration_rows = pin(raw_scores(model, parts["calibration"]), "calibration")
    scored = pin(raw_scores(model, parts["heldout"]), "heldout")
    for score, out in (("frozen_risk_score", "baseline"), ("candidate_raw", "candidate")):
        scored = apply_isotonic(fit_isotonic(calibration_rows, score, "upstream_error"), scored, score, out)
    return scored


def prediction_export(scored: DataFrame) -> DataFrame:
    """Per-case scores, label and features, rounded for export."""
    rounded = lambda name: F.round(name, 6).alias(name)
    return scored.select(
        "case_id", "grp", "upstream_error", "frozen_risk_score",
        F.round("baseline", 6).alias("baseline_calibrated_probability"),
        F.round("candidate", 6).alias("candidate_calibrated_probability"),
        *[rounded(name) for name in FEATURES],
    )


def long_scores(scored: DataFrame) -> DataFrame:
    """One row per case and router, ready for ranking: ``router``, ``score``, ``label``, ``error``."""
    each = F.explode(
        F.array(
            *[F.struct(F.lit(r).alias("router"), F.col(r).cast("double").alias("score")) for r in ("baseline", "candidate")]
        )
    )
    return scored.select(
        "case_id", "grp", F.col("criticality").cast("int").alias("criticality"),
        "expected_review_minutes", F.col("upstream_error").alias("label"),
        (F.col("upstream_error") == 1).alias("error"), each.alias("_s"),
    ).select("*", "_s.*").drop("_s")


def compare_routers(
    scored: DataFrame, *, capacity: float = 0.20, replicates: int = 1000, seed: int = 1612,
    candidate_p95_ms: float | None = None, **sizes: int,
) -> DataFrame:
    """The promotion gate of the learned router, as (check, passed, decision) rows."""
    rows = pin(long_scores(scored), "routers")
    metrics = probability_metrics(rows, ["router"])
    routing = route(rows, ["router"], ("risk",), [capacity], **sizes).drop("policy", "n")
    sides = metrics.join(routing, "router")
    figures = ("brier", "pr_auc", "residual_weighted_risk", "critical_error_capture",
               "false_greenlight_rate", "review_budget_respected")
    pick = lambda router: sides.filter(F.col("router") == router).select(
        *[F.col(f).alias(f"{router}_{f}") for f in figures], F.col("n").alias(f"{router}_n")
    )
    boot = router_bootstrap(rows, capacity=capacity, replicates=replicates, seed=seed, **sizes)
    evidence = (
        pick("baseline").crossJoin(pick("candidate")).crossJoin(boot)  # one row each
        .withColumns(
            {
                "candidate_p95_ms": F.lit(candidate_p95_ms).cast("double"),
                "heldout_cases": F.col("candidate_n"),
                "ci95_high": F.col("ci_high"),
            }
        )
    )
    return promotion_gate(evidence)


def router_bootstrap(rows: DataFrame, *, capacity: float, replicates: int, seed: int, **sizes: int) -> DataFrame:
    """Paired bootstrap of candidate against baseline over the same draws."""
    wide = rows.groupBy("case_id", "criticality", "expected_review_minutes", "error").agg(
        F.max(F.when(F.col("router") == "baseline", F.col("score"))).alias("baseline"),
        F.max(F.when(F.col("router") == "candidate", F.col("score"))).alias("candidate"),
    ).withColumn("cohort", F.lit("heldout"))
    return paired_bootstrap(
        wide, ["cohort"], champion="baseline", challenger="candidate", capacity=capacity,
        replicates=replicates, seed=seed, min_replicates=100, **sizes,
    ).drop("cohort")


def per_group_metrics(rows: DataFrame, capacity: float = 0.20, **sizes: int) -> DataFrame:
    """Figures per group and router; each group gets its own budget."""
    keys = ["grp", "router"]
    rows = pin(rows, "per-group")
    rates = rows.groupBy(*keys).agg(F.round(F.avg("label"), 6).alias("error_rate"))
    routing = route(rows, keys, ("risk",), [capacity], **sizes).drop("policy", "n")
    return rates.join(probability_metrics(rows, keys), keys).join(routing, keys)
