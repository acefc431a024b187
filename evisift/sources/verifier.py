"""Raw verifier responses to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.json import is_object, sole_value
from evisift.schemas import POLARITIES, VERIFIER_RESPONSE

# Fixed value: the only wrapper a verifier may put around its JSON object (RE2 and Java syntax).
FENCE = r"(?is)^```json\s*(\{.*\})\s*```$"


def _body(raw: Column) -> Column:
    """The answer without white space at its ends and without the wrapper."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def _form_fault(body: Column) -> Column:
    """Why the body isn't exactly one JSON object; null when it is."""
    starts = F.json_object_keys(body).isNotNull()
    return (
        F.when(is_object(body), None)
        .when(sole_value(body).isNotNull(), "not_an_object")
        .when(starts, "trailing_text")
        .otherwise("invalid_json")
    )


def parse_responses(raw: DataFrame) -> DataFrame:
    """``case_id, slot, raw`` to typed response columns and ``failure`` (null when the answer is usable)."""
    located = raw.select("case_id", "slot", _body(F.col("raw")).alias("body"))
    located = located.withColumn("failure", _form_fault(F.col("body")))
    known = F.array(*[F.lit(f.name) for f in VERIFIER_RESPONSE.fields])
    required = F.array(*[F.lit(f.name) for f in VERIFIER_RESPONSE.fields if f.name != "bbox"])
    # bbox arrives as a list of four numbers
    fields = ", ".join(
        f"{f.name} {'array<double>' if f.name == 'bbox' else f.dataType.simpleString()}"
        for f in VERIFIER_RESPONSE.fields
    )
    typed = located.withColumns(
        {"_keys": F.json_object_keys("body"), "_r": F.from_json("body", fields)}
    )
    r = F.col("_r")
    failure = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.size(F.array_except("_keys", known)) > 0, "unknown_field")
        .when(F.size(F.array_except(required, "_keys")) > 0, "missing_field")
        .when(r["page"].isNull() | (r["page"] < 1), "bad_page")
        .when(r["text"].isNull() | ~F.length(r["text"]).between(1, 50_000), "bad_text")
        .when(r["polarity"].isNull() | ~r["polarity"].isin(*POLARITIES), "bad_polarity")
        .when(r["confidence"].isNull() | ~r["confidence"].between(0.0, 1.0), "bad_confidence")
        .when(r["bbox"].isNotNull() & (F.size(r["bbox"]) != 4), "bad_bbox")
    )
    corner = lambda i: F.get(r["bbox"], F.lit(i))
    box = F.when(
        r["bbox"].isNotNull(),
        F.struct(corner(0).alias("x1"), corner(1).alias("y1"), corner(2).alias("x2"), corner(3).alias("y2")),
    )
    return typed.select(
        "case_id", "slot",
        *[(box if f.name == "bbox" else r[f.name]).alias(f.name) for f in VERIFIER_RESPONSE.fields],
        failure.alias("failure"),
    )


def failure_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("failure", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n_responses"))
