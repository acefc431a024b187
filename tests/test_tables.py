from evisift.plans import tables


def test_evidence_is_sorted_by_number_and_dealt_by_case(spark):
    """Its sort used to begin with case ids, which all begin alike."""
    plan = tables.evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Sort [")[1].startswith("l_orderkey") and "hashpartitioning(case_id" in plan
    assert plan.count("Exchange") == 1
