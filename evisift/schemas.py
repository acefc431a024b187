"""Explicit table schemas and the fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Enums of the data contract.
STATUSES = ("SATISFIED", "NOT_SATISFIED", "INSUFFICIENT_EVIDENCE", "CONFLICT", "NOT_APPLICABLE")
AUTOMATION_STATUSES = ("AUTO_DECISION_ELIGIBLE", "REVIEW_REQUIRED", "BLOCKED", "PIPELINE_ERROR")
POLARITIES = ("SUPPORTS", "CONTRADICTS", "NEUTRAL")

# Limits of the data contract.
MAX_EVIDENCE_PER_CASE = 1024
MAX_TEXT_CHARS = 50_000
SHA256_PATTERN = "^[0-9a-f]{64}$"

BBOX = T.StructType([T.StructField(name, T.DoubleType()) for name in ("x1", "y1", "x2", "y2")])

EVIDENCE = T.StructType(
    [
        T.StructField("evidence_id", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("polarity", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("age_days", T.IntegerType()),
        T.StructField("approved", T.BooleanType()),
        T.StructField("supersedes", T.StringType()),
        T.StructField("checksum_valid", T.BooleanType()),
        T.StructField("provenance_valid", T.BooleanType()),
        T.StructField("prompt_injection", T.BooleanType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("bbox", BBOX),
        T.StructField("source_hash", T.StringType()),
    ]
)

EVIDENCE_LONG = T.StructType(
    [T.StructField("case_id", T.StringType()), T.StructField("ord", T.IntegerType()), *EVIDENCE.fields]
)

CASE = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("control_id", T.StringType()),
        T.StructField("required_slots", T.ArrayType(T.StringType())),
        T.StructField("target_system", T.StringType()),
        T.StructField("target_region", T.StringType()),
        T.StructField("max_age_days", T.IntegerType()),
        T.StructField("criticality", T.IntegerType()),
        T.StructField("expected_review_minutes", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
        T.StructField("gold_status", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("mutation", T.StringType()),
    ]
)

VERIFIER_RESPONSE = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("polarity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

DOCUMENT_SPEC = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("age_days", T.IntegerType()),
    ]
)
DOCUMENT_MANIFEST = T.StructType([T.StructField("documents", T.ArrayType(DOCUMENT_SPEC))])

EVIDENCE_FILE = T.StructType(
    [
        T.StructField(
            "pages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("page", T.IntegerType()),
                        T.StructField(
                            "blocks",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("text", T.StringType()),
                                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

FORM_FILE = T.StructType(
    [
        T.StructField(
            "form",
            T.ArrayType(
                T.StructType([T.StructField("linking", T.ArrayType(T.ArrayType(T.IntegerType())))])
            ),
        )
    ]
)

ARTIFACT_MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
