from evisift.operators import validate
from evisift.plans import tables  # noqa: F401

EVIDENCE = "case_id string, evidence_id string, slot string, supersedes string"


def test_bad_boxes(spark):
    nan, inf = float("nan"), float("inf")
    boxes = [
        (nan, 0.1, 0.5, 0.9), (0.1, 0.1, inf, 0.9), (0.6, 0.1, 0.5, 0.9), (-0.1, 0.1, 0.5, 0.9), (0.1, 0.1, 1.5, 0.9),
        (0.0, 0.0, 1.0, 1.0), None,
    ]
    df = spark.createDataFrame(
        [("c", str(i), b) for i, b in enumerate(boxes)],
        "case_id string, evidence_id string, bbox struct<x1:double,y1:double,x2:double,y2:double>",
    )
    assert sorted(r["evidence_id"] for r in validate.bbox_audit(df).collect()) == ["0", "1", "2", "3", "4"]


def test_supersession(spark):
    rows = [
        ("c", "a", "s", "b"), ("c", "b", "s", "a"), ("c", "d", "s", "a"), ("c", "self", "s", "self"),
        ("c", "gone", "s", "nowhere"), ("c", "x", "t", "d"), ("other", "a", "s", None), ("other", "b", "s", "a"),
    ]
    rows += [("long", f"n{i}", "s", f"n{i + 1}" if i < 70 else None) for i in range(71)]
    rows += [("ring", f"r{i}", "s", f"r{(i + 1) % 9}") for i in range(9)]
    df = spark.createDataFrame(rows, EVIDENCE)
    refs = {(r["evidence_id"], r["rule"]) for r in validate.supersession_refs(df).collect()}
    assert refs == {("self", "self"), ("gone", "unknown_target"), ("x", "cross_slot")}
    cycles = {(r["case_id"], r["evidence_id"]) for r in validate.supersession_cycles(df).collect()}
    assert cycles == {("c", "a"), ("c", "b"), ("c", "self")} | {("ring", f"r{i}") for i in range(9)}
    assert validate.supersession_cycles(df.filter("case_id = 'long'")).count() == 0
    repeated = df.filter("evidence_id in ('a', 'b')").filter("case_id = 'c'").unionByName(df.filter("case_id = 'long'"))
    again = validate.supersession_cycles(repeated.unionByName(repeated).unionByName(repeated))
    assert sorted(r["evidence_id"] for r in again.collect()) == ["a", "b"]


def test_duplicates_alignment_and_sets(spark):
    df = spark.createDataFrame([("c", "a", "s", None)] * 2 + [("c", "b", "s", None)], EVIDENCE)
    assert [tuple(r) for r in validate.duplicate_evidence(df).collect()] == [("c", "a", 2)]
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "case_id string")
    good, bad = validate.align_cases_results(ids("a", "b", "b", "d"), ids("a", "c", "d", "d"))
    assert [r[0] for r in good.collect()] == ["a"]
    assert {(r["case_id"], r["rule"]) for r in bad.collect()} == {
        ("b", "duplicate_case"), ("b", "missing_result"), ("c", "unknown_case"), ("d", "duplicate_result"),
    }
    assert {tuple(r) for r in validate.same_id_set(ids("a", "b"), ids("b", "c")).collect()} == {("a", "left"), ("c", "right")}


def test_only_rows_on_the_cycle(spark):
    """A row that a cycle merely leads to used to be named, and every row was looked up before the first join."""
    rows = [("c", "a", "s", "b"), ("c", "b", "s", "a"), ("c", "b", "s", "x"), ("c", "x", "s", None), ("c", "y", "s", "gone")]
    out = validate.supersession_cycles(spark.createDataFrame(rows, EVIDENCE))
    assert sorted(r["evidence_id"] for r in out.collect()) == ["a", "b"]
