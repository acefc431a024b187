import datetime as dt

from pyspark.sql import functions as F

from evisift.plans import queries, tables
from evisift.plans.queries import _as_stream, _run_stream
from evisift.streaming import intake

SF = "/root/testdata/sf0.001"


def test_streams_equal_batches(spark):
    batch = intake.intake_batch(tables.requests(spark, SF)).select("event_id", "idempotency_key", "status")
    stream = queries.intake_stream(spark, SF)
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_key_is_forgotten_after_retention(spark):
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    rows = [("key-0001", 1, at(0), "x"), ("key-0001", 2, at(5), "y"), ("key-0001", 3, at(40), "y"), ("key-0001", 4, at(41), "y")]
    df = spark.createDataFrame(rows, "idempotency_key string, event_id bigint, ts timestamp, body_hash string")
    out = _run_stream(spark, intake.intake_stream(_as_stream(spark, df, "req"), late="60 days"), "ret")
    assert {r["event_id"]: r["status"] for r in out.collect()} == {1: "new", 2: "conflict", 3: "new", 4: "replayed"}


def test_keys_of_one_bucket_are_judged_apart(spark):
    """One state serves many keys: calls into Python don't grow with the keys, and no key sees another's entry."""
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    rows = [("key-0001", 1, at(0), "x"), ("key-0002", 2, at(1), "x"), ("key-0001", 3, at(2), "x"), ("key-0002", 4, at(3), "y"),
            ("key-0001", 5, at(35), "x"), ("key-0003", 6, at(4), None), ("key-0003", 7, at(5), None)]
    df = spark.createDataFrame(rows, "idempotency_key string, event_id bigint, ts timestamp, body_hash string")
    out = _run_stream(spark, intake.intake_stream(_as_stream(spark, df, "req"), late="60 days", buckets=1), "one")
    assert {r["event_id"]: r["status"] for r in out.collect()} == {
        1: "new", 2: "new", 3: "replayed", 4: "conflict", 5: "new", 6: "new", 7: "conflict"
    }


def test_entries_outlive_a_trigger_until_the_retention_ends(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    waves = [
        [("key-0001", 1, at(0), "x"), ("key-0002", 2, at(20), "x")], [("key-0001", 3, at(21), "y")], [("key-0003", 4, at(41), "z")],
        # the first key's entry has gone with the watermark, the second's is still there
        [("key-0001", 5, at(42), "y"), ("key-0002", 6, at(43), "x")],
    ]
    seen = {}
    for number, rows in enumerate(waves):
        spark.createDataFrame(
            rows, "idempotency_key string, event_id bigint, ts timestamp, body_hash string"
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("idempotency_key string, event_id bigint, ts timestamp, body_hash string").parquet(
            f"{tmp_path}/in"
        )
        (
            intake.intake_stream(stream, late="1 hour", buckets=1).writeStream.format("parquet").trigger(availableNow=True)
            .option("checkpointLocation", f"{tmp_path}/checkpoint").start(f"{tmp_path}/out").awaitTermination()
        )
        seen = {r["event_id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert seen == {1: "new", 2: "new", 3: "conflict", 4: "new", 5: "new", 6: "replayed"}


def test_windowed_counts_as_stream(spark):
    statuses = intake.intake_batch(tables.requests(spark, SF)).select("ts", "status")
    batch = intake.status_windows(statuses)
    out = _run_stream(spark, intake.status_windows(_as_stream(spark, statuses, "st"), late="1 hour"), "win")
    closed = batch.join(out.select(F.max("window_start").alias("w")), F.col("window_start") <= F.col("w")).drop("w")
    assert out.count() > 0 and out.exceptAll(closed).count() == 0


def test_first_request_per_key(spark):
    requests = tables.requests(spark, SF).select("idempotency_key", "event_id", "ts")
    out = _run_stream(spark, intake.first_requests_stream(_as_stream(spark, requests, "first")), "first")
    assert out.count() == requests.select("idempotency_key").distinct().count()


def test_retention_and_cap(spark):
    at = lambda second: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
    df = spark.createDataFrame([("a", at(0)), ("b", at(86400 * 31)), ("c", at(86400 * 31)), ("d", at(86400 * 31))], "idempotency_key string, created_at timestamp")
    assert {r[0] for r in intake.retained(df).collect()} == {"b", "c", "d"}
    assert {r[0] for r in intake.retained(df, max_records=2).collect()} == {"c", "d"}
