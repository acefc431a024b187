"""Idempotent request intake, as streams and as their batch twins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evisift.functions.json import is_object
from evisift.operators.assess import assess_nested
from evisift.sources.cases import parse_cases

RETENTION_DAYS = 30
MAX_RECORDS = 100_000
MAX_BODY_BYTES = 1_000_000
# States of the intake stream; each holds the entries of the keys that fall to it.
KEY_BUCKETS = 1024


def admission(
    requests: DataFrame, body: str = "body", max_body_bytes: int = MAX_BODY_BYTES, fields: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``reason``, null when a request may go on: body size, key length, one JSON object, known ``fields`` only."""
    text = F.col(body)
    known = F.array(*[F.lit(f) for f in fields or ()])
    surplus = F.size(F.array_except(F.json_object_keys(text), known)) > 0 if fields is not None else F.lit(False)
    reason = (
        F.when(F.octet_length(text) > max_body_bytes, "body_too_large")
        .when(~F.length("idempotency_key").between(8, 128), "bad_key_length")
        .when(~is_object(text), "malformed_json")
        .when(surplus, "unknown_field")
    )
    return requests.withColumn("reason", reason)


def assess_stream(raw: DataFrame, column: str = "value") -> DataFrame:
    """Raw JSON cases of a stream to assessment results. Stateless; refused rows are filtered out."""
    return assess_nested(parse_cases(raw, column).filter("reason is null").select("case.*"))


# ---------------------------------------------------------------------------------------------
# replay and conflict


def intake_batch(requests: DataFrame) -> DataFrame:
    """Status of every request: the first body of a key is ``new``, equal bodies ``replayed``, others ``conflict``.

    The first body per key is an aggregation with map-side combine; requests meet it in an equi join that
    AQE may split, so a key that owns most of the log is no single task.
    """
    first = requests.groupBy("idempotency_key").agg(
        F.min(F.struct("ts", "event_id", "body_hash")).alias("_first")
    )
    status = (
        F.when(F.col("event_id") == F.col("_first.event_id"), "new")
        .when(F.col("body_hash") == F.col("_first.body_hash"), "replayed")
        .otherwise("conflict")
    )
    return requests.join(first, "idempotency_key").withColumn("status", status).drop("_first")


def intake_stream(
    requests: DataFrame, retention_days: int = RETENTION_DAYS, late: str = "1 hour", buckets: int = KEY_BUCKETS,
) -> DataFrame:
    """Stream twin of ``intake_batch``: one small entry per key, forgotten after the retention time.

    Keys are dealt to ``buckets``, whose entries are one state each: a call into Python costs far more than a row, so it serves
    many keys. Raise the number with the keys that are remembered; a checkpoint keeps the number it began with. Limit the rows per
    trigger at the source (``maxFilesPerTrigger`` and the like): a bucket's rows of one trigger are ordered together before they
    are judged. A null body hash equals no other.
    """
    keep_ms = retention_days * 86_400_000

    def decide(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {key: (body, first) for key, body, first in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            # a bucket's rows may come in several Arrow batches, in no order; a trigger bounds how many there are
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            statuses = []
            for key, body, at in zip(*[rows[c].tolist() for c in ("idempotency_key", "body_hash", "_ms")], strict=True):
                entry = known.get(key)
                if entry is None or at - entry[1] > keep_ms:
                    known[key] = (body, at)
                    statuses.append("new")
                else:
                    statuses.append("replayed" if body is not None and body == entry[0] else "conflict")
            yield rows[["idempotency_key", "event_id", "ts"]].assign(status=statuses)
        now = state.getCurrentWatermarkMs()
        kept = [(key, body, first) for key, (body, first) in known.items() if first + keep_ms >= now]
        if not kept:
            state.remove()
            return
        keys, bodies, firsts = map(list, zip(*kept, strict=True))
        state.update((keys, bodies, firsts))
        state.setTimeoutTimestamp(max(min(firsts) + keep_ms, now + 1))

    columns = requests.select(
        "idempotency_key", "event_id", "ts", "body_hash", F.unix_millis("ts").alias("_ms"),
        F.pmod(F.xxhash64("idempotency_key"), F.lit(buckets)).alias("_bucket"),
    ).withWatermark("ts", late)
    return columns.groupBy("_bucket").applyInPandasWithState(
        decide,
        outputStructType="idempotency_key string, event_id bigint, ts timestamp, status string",
        stateStructType="keys array<string>, bodies array<string>, firsts array<bigint>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )


def first_requests_stream(requests: DataFrame, late: str = "30 days") -> DataFrame:
    """Only the first request of each key within the watermark; state is dropped with it."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["idempotency_key"])


# ---------------------------------------------------------------------------------------------
# retention and monitoring


def retained(records: DataFrame, retention_days: int = RETENTION_DAYS, max_records: int = MAX_RECORDS) -> DataFrame:
    """Records young enough to keep, at most the newest ``max_records`` of them by (created_at, key).

    ``created_at`` is compared with the newest record. The cap is a sort with limit, which Spark runs as a
    per-partition top-k.
    """
    newest = records.agg(F.max("created_at").alias("_now"))
    young = records.crossJoin(F.broadcast(newest)).filter(  # one row
        F.col("created_at") >= F.col("_now") - F.make_dt_interval(F.lit(retention_days))
    ).drop("_now")
    return young.orderBy(F.col("created_at").desc(), F.col("idempotency_key").desc()).limit(max_records)


def intake_log(requests: DataFrame) -> DataFrame:
    """First accepted request of each key: the stored record."""
    return requests.groupBy("idempotency_key").agg(
        F.min(F.struct("ts", "event_id", "body_hash")).alias("_f")
    ).select("idempotency_key", F.col("_f.body_hash").alias("body_hash"), F.col("_f.ts").alias("created_at"))


def status_windows(statuses: DataFrame, every: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts of each status per time window. With ``late`` set the input may be a stream."""
    df = statuses.withWatermark("ts", late) if late else statuses
    return (
        df.groupBy(F.window("ts", every), "status").agg(F.count("*").alias("n_requests"))
        .select(F.col("window.start").alias("window_start"), "status", "n_requests")
    )
