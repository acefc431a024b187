import pytest
from pyspark.sql import functions as F

from evisift.operators import isotonic, model
from evisift.operators.features import FEATURES
from evisift.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return queries._model_features(spark, SF).cache()


def test_features_and_split(spark, rows):
    assert not set(FEATURES) & set(model.LEAKAGE_COLUMNS) and len(FEATURES) == 21
    with pytest.raises(ValueError):
        model.group_split(rows, [0, 1], [1], [2])
    with pytest.raises(ValueError):
        model.group_split(rows, [0], [1], [99])
    with pytest.raises(ValueError):
        model.fit_risk_model(rows, features=["frozen_risk_score"])


def test_fit_is_repeatable_and_calibration_monotone(spark, rows):
    one = model.fit_risk_model(rows, max_iter=3)
    two = model.fit_risk_model(rows.orderBy(F.rand(3)), max_iter=3)
    assert one.stages[-1].toDebugString.split("\n")[1:] == two.stages[-1].toDebugString.split("\n")[1:]
    scored = model.raw_scores(one, rows)
    steps = isotonic.fit_isotonic(scored, "candidate_raw", "upstream_error")
    out = isotonic.apply_isotonic(steps, scored, "candidate_raw", "candidate").select("candidate_raw", "candidate").collect()
    ordered = [r["candidate"] for r in sorted(out, key=lambda r: r["candidate_raw"])]
    assert ordered == sorted(ordered) and all(0.0 <= p <= 1.0 for p in ordered)


def test_partitions_of_the_fit_follow_from_the_rows(spark, rows, monkeypatch):
    """Whatever the session's shuffle partitions are: each level of each tree is a job over all partitions of the fit."""
    layouts = []
    frame = type(rows)
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: layouts.append(n) or repartition(self, n, *by))
    model.fit_risk_model(rows, max_iter=1)
    monkeypatch.setattr(model, "PARTITION_ROWS", 400)
    model.fit_risk_model(rows, max_iter=1)
    assert layouts == [1, -(-rows.count() // 400)]


def test_cases_alike_are_fitted_as_one_row(spark, rows, monkeypatch):
    """What the trees read grows with the different cases, not with all of them, and the trees stay those of the single rows."""
    fitted = []
    fit = model.Pipeline.fit
    monkeypatch.setattr(model.Pipeline, "fit", lambda self, frame: fitted.append(frame) or fit(self, frame))
    copies = rows.withColumn("case_id", F.explode(F.array(*[F.concat("case_id", F.lit(f"~{i}")) for i in range(8)])))
    model.fit_risk_model(copies, max_iter=3)
    different = copies.select(*FEATURES, "upstream_error").distinct().count()
    assert fitted[0].count() <= 2 * different < copies.count()
    assert fitted[0].agg(F.sum("weight")).first()[0] == copies.count()
    trees = model.GBTClassifier(
        featuresCol="vector", labelCol="label", stepSize=0.055, maxIter=3, maxDepth=5, minInstancesPerNode=22, seed=701
    )
    whole = model.VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    wanted = model.Pipeline(stages=[whole, trees]).fit(rows.withColumn("label", F.col("upstream_error").cast("double")))
    got = model.fit_risk_model(rows, max_iter=3)
    score = lambda fitted: model.raw_scores(fitted, rows).select("case_id", "candidate_raw")
    both = score(got).join(score(wanted).withColumnRenamed("candidate_raw", "wanted"), "case_id")
    assert both.agg(F.max(F.abs(F.col("candidate_raw") - F.col("wanted")))).first()[0] < 1e-9
