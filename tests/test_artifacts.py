from pyspark.sql import functions as F

from evisift.functions.paths import is_portable, is_traversal, posix_path
from evisift.operators import artifacts
from evisift.sources import sinks

SHA, OTHER = "a" * 64, "b" * 64
MANIFEST = "run_id string, path string, bytes bigint, sha256 string"


def manifest(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], MANIFEST)


def test_manifest_problems(spark):
    declared = manifest(
        spark, ("ok", 1, SHA), ("changed", 1, SHA), ("gone", 1, SHA), ("twice", 1, SHA), ("./twice", 1, SHA),
        ("../up", 1, SHA), ("nul.txt", 1, SHA), ("neg", -1, SHA), ("bad", 1, "xyz"),
    )
    actual = manifest(
        spark, ("ok", 1, SHA), ("changed", 1, OTHER), ("twice", 1, SHA), ("nul.txt", 1, SHA), ("neg", -1, SHA),
        ("bad", 1, "xyz"), ("extra", 1, SHA), ("../up", 1, SHA),
    )
    got = {(r["path"], r["problem"]) for r in artifacts.validate_manifest(declared, actual).collect()}
    assert got == {
        ("changed", "content_mismatch"), ("gone", "missing_file"), ("twice", "duplicate_path"), ("../up", "unsafe_path"),
        ("nul.txt", "unsafe_path"), ("neg", "bad_byte_count"), ("bad", "bad_hash"), ("extra", "unlisted_file"),
    }


def test_paths(spark):
    names = ["../escape.json", "..\\escape.json", "a\\b/c", "/abs", "", "a//./b", "com1.txt", "x:y", "end.", "end "]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    p = F.col("p")
    rows = df.select("p", posix_path(p).alias("path"), is_traversal(p).alias("t"), is_portable(p).alias("ok")).collect()
    assert [r["p"] for r in rows if r["t"]] == ["../escape.json", "..\\escape.json", "/abs", ""]
    assert {r["p"]: r["path"] for r in rows}["a//./b"] == "a/b" and {r["p"]: r["path"] for r in rows}["a\\b/c"] == "a/b/c"
    assert [r["p"] for r in rows if not r["ok"] and not r["t"]] == ["com1.txt", "x:y", "end.", "end "]


def test_member_audit(spark):
    rows = [
        ("z", "../escape.json", 1, 1, False, False), ("z", "..\\escape.json", 1, 1, False, False),
        ("z", "a\\b", 1, 1, False, False), ("z", "a/b", 1, 1, False, False), ("z", "e", 5, 1, True, False),
        ("z", "l", 5, 1, False, True), ("z", "zero", 5, 0, False, False), ("z", "bomb", 5000, 1, False, False),
    ]
    df = spark.createDataFrame(rows, "archive string, member string, file_size bigint, compress_size bigint, encrypted boolean, is_symlink boolean")
    got = {r["problem"]: r["n_members"] for r in artifacts.member_audit(df, max_total_bytes=100, max_members=7).collect()}
    assert got == {
        "traversal": 2, "duplicate": 2, "encrypted": 1, "symlink": 1, "zero_compressed_size": 1, "ratio": 1,
        "total_size": 8, "too_many_members": 8,
    }


def test_registry_and_diff(spark):
    schema = "artifact_id string, artifact_type string, filename string, sha256 string, bytes bigint, project_version string, training_manifest_hash string"
    entry = lambda name, sha, version="1": (name, "model", "f", sha, 1, version, None)
    known = spark.createDataFrame([entry("a", SHA), entry("b", SHA), entry("old", SHA, "0")], schema)
    new = spark.createDataFrame([entry("a", SHA), entry("b", OTHER), entry("c", SHA), entry("old", SHA, "0")], schema)
    verdicts = lambda df: {r["artifact_id"]: r["verdict"] for r in df.collect()}
    assert verdicts(artifacts.register(known, new)) == {"a": "no_op", "b": "conflict", "c": "registered", "old": "no_op"}
    assert verdicts(artifacts.verify_artifacts(new, known, "1")) == {
        "a": "ok", "b": "hash_mismatch", "c": "unregistered", "old": "version_mismatch",
    }
    diff = artifacts.snapshot_diff(
        manifest(spark, ("same", 1, SHA), ("gone", 1, SHA), ("edit", 1, SHA)),
        manifest(spark, ("same", 1, SHA), ("new", 1, SHA), ("edit", 1, OTHER)),
    )
    assert {r["path"]: r["status"] for r in diff.collect()} == {"gone": "deleted", "new": "added", "edit": "modified"}


def test_republish_and_latest(spark):
    existing = manifest(spark, ("a", 1, SHA))
    assert artifacts.republish_verdict(existing, manifest(spark, ("a", 1, SHA))).first()["verdict"] == "no_op"
    assert artifacts.republish_verdict(existing, manifest(spark, ("a", 1, OTHER))).first()["verdict"] == "conflict"
    assert artifacts.republish_verdict(existing.filter("false"), existing).first()["verdict"] == "new"
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, committed_at int")
    broken = spark.createDataFrame([("r1",)], "run_id string")
    assert artifacts.latest_valid_run(runs, broken).first()["run_id"] == "r2"
    assert artifacts.latest_valid_run(runs, runs.select("run_id")).count() == 0


def test_fingerprint_ignores_order(spark):
    rows = [(f"p{i}", i, SHA) for i in range(50)]
    digest = lambda data: artifacts.fingerprint(manifest(spark, *data)).first()["fingerprint"]
    assert digest(rows) == digest(rows[::-1]) != digest(rows[1:])


def test_hygiene(spark):
    text = "ok\ntoken = 'abcdefghijklmnop'\nAKIA" + "A" * 16 + "\nC:\\Users\\me"
    lines = artifacts.numbered_lines(spark.createDataFrame([("f", text)], "path string, text string"), ["path"])
    got = {(r["line_number"], r["pattern"]) for r in artifacts.line_findings(lines, ["path", "line_number"]).collect()}
    assert got == {(2, "generic_secret_assignment"), (3, "aws_access_key"), (4, "machine_path")}


def test_run_sink(spark, tmp_path):
    table = spark.createDataFrame([("c", 1.0)], "case_id string, risk double")
    for run in ("one", "two"):
        sinks.write_run({"results": table}, str(tmp_path), run, {"seed": 1})
    back = sinks.read_run(spark, str(tmp_path), "results")
    assert {r["run_id"] for r in back.collect()} == {"one", "two"}
    stamped = back.withColumns({"gate_status": F.lit("PASS"), "release_passed": F.lit(True)})
    assert all(r["consistent"] for r in artifacts.run_identity(stamped).collect())


def test_unlike_entries_of_one_batch_conflict(spark):
    fields = "artifact_id string, artifact_type string, filename string, sha256 string, bytes long, project_version string, training_manifest_hash string"
    entry = lambda name, sha: (name, "model", "f", sha, 1, "1", None)
    batch = spark.createDataFrame([entry("new", "a"), entry("new", "b"), entry("twice", "a"), entry("twice", "a")], fields)
    got = sorted(tuple(r) for r in artifacts.register(spark.createDataFrame([], fields), batch).collect())
    assert got == [("new", "conflict"), ("new", "conflict"), ("twice", "registered"), ("twice", "registered")]


def test_republishing_gathers_no_run_in_one_task(spark):
    schema = "run_id string, path string, bytes bigint, sha256 string"
    old = spark.createDataFrame([("a", "x", 1, "h"), ("a", "x", 1, "h"), ("b", "x", None, "h"), ("c", "x", 1, "h"), ("gone", "x", 1, "h"), (None, "x", 1, "h")], schema)
    new = spark.createDataFrame([("a", "x", 1, "h"), ("b", "x", None, "h"), ("c", "x", 1, "h"), ("c", "y", 1, "h"), ("d", "x", 1, "h"), (None, "x", 1, "h")], schema)
    out = artifacts.republish_verdict(old, new)
    assert {tuple(r) for r in out.collect()} == {("a", "conflict"), ("b", "no_op"), ("c", "conflict"), ("d", "new"), (None, "new")}
    # rows met by run_id alone in a join before
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
