from pyspark.sql import functions as F

from evisift.operators import assess, features
from evisift.plans import queries, tables

SF = "/root/testdata/sf0.001"


def test_changed_arrays_equal_changed_rows(spark):
    """The matrix from packed facts against the same perturbations made as evidence rows and assessed as cases of their own."""
    cases, evidence = tables.cases(spark, SF), tables.evidence(spark, SF)
    results = queries.results(spark, SF).select("case_id", "status")
    each = F.explode(F.array(*[F.lit(name) for name in features.PERTURBATIONS])).alias("mutation")
    twins = cases.drop("mutation").select("*", each).withColumn("_case", F.col("case_id")).withColumn("case_id", F.concat("case_id", F.lit("~"), "mutation"))
    # the added row of a twin is named after its case, as in the packed form
    rows = assess.assess_long(twins, features.perturbed_evidence(cases, evidence), carry=["_case", "mutation"])
    want = rows.join(results.withColumnRenamed("status", "before").withColumnRenamed("case_id", "_case"), "_case").groupBy("mutation", "before", "status").count()
    got = features.perturbation_matrix(cases, evidence, results)
    assert {tuple(r) for r in want.collect()} == {(r.mutation, r.status_before, r.status_after, r.n_cases) for r in got.collect()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_case_is_summed_beside_its_scope(spark):
    """No exchange by slot and source; the spread form deals rows by them and gives the same sums."""
    cases, evidence = tables.cases(spark, SF), tables.evidence(spark, SF)
    # a missing source counts as one
    evidence = evidence.withColumn("source_hash", F.when(F.col("ord") != 2, F.col("source_hash")))
    results = queries.results(spark, SF).select("case_id", "status", "risk_score")
    packed = features.case_features(cases, evidence, results)
    spread = features.case_features(cases, evidence, results, spread=True)
    assert "REPARTITION_BY_COL" not in _plan(packed) and "REPARTITION_BY_COL" in _plan(spread)
    assert packed.exceptAll(spread).count() == 0 and spread.exceptAll(packed).count() == 0


def test_shared_arrays_are_not_made_for_every_element(spark):
    plan = _plan(queries.case_status_counts(spark, SF))
    assert "array_contains(" in plan and "array_contains(filter(" not in plan
    assert "array_position(" in plan and "array_position(transform(" not in plan


def test_gate_counts_uses_in_the_results_themselves(spark, monkeypatch):
    """The gate looks at the ids that the results call usable; it does not judge the evidence a second time by joins."""
    def judged(*_):
        raise AssertionError("evidence was judged again")

    monkeypatch.setattr(queries, "verdicts", judged)
    assert queries.release_gate(spark, SF).count() > 0
