"""Case ingest from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.functions.geometry import bbox_is_valid
from evisift.functions.json import is_object, kind, once
from evisift.operators.assess import _computed_once
from evisift.operators.validate import case_rules, evidence_rules
from evisift.schemas import CASE, EVIDENCE, MAX_EVIDENCE_PER_CASE

_CASE_FIELDS = [f.name for f in CASE.fields]
_EVIDENCE_FIELDS = [f.name for f in EVIDENCE.fields]
# Defaults of optional fields; a field without one is required unless it may be null.
_CASE_DEFAULTS = {
    "max_age_days": 365, "criticality": 1, "expected_review_minutes": 5.0, "split": "test", "mutation": "none",
}
_EVIDENCE_DEFAULTS = {
    "approved": False, "checksum_valid": True, "provenance_valid": True, "prompt_injection": False, "page": 1,
}
_NULLABLE = ("gold_status", "supersedes", "bbox")
# JSON types that a field of a Spark type may have.
_KINDS = {
    T.StringType: ("STRING",), T.BooleanType: ("BOOLEAN",), T.IntegerType: ("BIGINT",), T.ArrayType: ("ARRAY",),
    T.DoubleType: ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), T.StructType: ("OBJECT",),
}


# What a variant's schema shows inside brackets, by depth; quoted names stand outside of it.
_PLAIN = r"[\w :,()]"
_FLAT = rf"{_PLAIN}*+"
_DEEP = rf"(?:{_PLAIN}++|<(?:{_PLAIN}++|<{_FLAT}>)*+>)*+"


def _sound_schema(schema: T.StructType, defaults: dict) -> str:
    """A pattern of the variant schemas whose record has every required field, no unknown one and right types throughout."""
    out = ""
    # a variant lists its fields by name
    for field in sorted(schema.fields, key=lambda f: f.name):
        inside = {T.ArrayType: f"<{_DEEP}>", T.StructType: f"<{_FLAT}>"}.get(type(field.dataType), r"(?:\(\d+,\d+\))?")
        kinds = "|".join([f"(?:{'|'.join(_KINDS[type(field.dataType)])}){inside}", *(["VOID"] if field.name in _NULLABLE else [])])
        needed = field.name not in defaults and field.name not in _NULLABLE
        # a separator before each field: the pattern is matched after the comma is put before the first one as well
        out += rf"(?:, {field.name}: (?:{kinds})){'' if needed else '?'}"
    return rf"^OBJECT<{out}>$"


def _plain_schema() -> str:
    """A pattern of the variant schemas of whole cases with right types throughout and no unknown field in any evidence row.

    A schema shows what an array's elements have in common: one type only where all that are not null have it.
    """

    def fields(schema: T.StructType, inside: dict[str, str]) -> str:
        out = ""
        for field in sorted(schema.fields, key=lambda f: f.name):
            shown = inside.get(field.name, rf"<{_FLAT}>" if isinstance(field.dataType, T.StructType) else r"(?:\(\d+,\d+\))?")
            kinds = "|".join([f"(?:{'|'.join(_KINDS[type(field.dataType)])}){shown}", *(["VOID"] if field.name in _NULLABLE else [])])
            out += rf"(?:(?:, |<){field.name}: (?:{kinds}))?"
        return out

    row = rf"OBJECT{fields(EVIDENCE, {})}>"
    return rf"^OBJECT{fields(CASE, {'required_slots': '<(?:STRING|VOID)>', 'evidence': f'<(?:VOID|{row})>'})}>$"


def _is_plain(record: Column, typed: Column) -> Column:
    """Whether a case with all fields that are not optional, in it and in its rows, has no fault in any: seen at one look."""
    present = lambda of, schema: F.lit(True) if not schema else of[schema[0]].isNotNull() & present(of, schema[1:])
    needed = lambda schema: [f.name for f in schema.fields if f.name not in _NULLABLE]
    full = present(typed, needed(CASE)) & F.forall(typed["required_slots"], lambda s: s.isNotNull()) & F.forall(
        typed["evidence"], lambda e: present(e, needed(EVIDENCE))
    )
    return F.coalesce(full & F.schema_of_variant(record).rlike(_plain_schema()), F.lit(False))


def _is_sound(record: Column, schema: T.StructType, defaults: dict) -> Column:
    shown = F.regexp_replace(F.schema_of_variant(record), "^OBJECT<", "OBJECT<, ")
    return F.coalesce(shown.rlike(_sound_schema(schema, defaults)), F.lit(False))


def _field_fault(record: Column, schema: T.StructType, defaults: dict) -> Column:
    """The first fault of a variant record's fields: ``missing_field`` or ``wrong_type``."""

    def fault(field: T.StructField) -> Column:
        def judge(found: Column) -> Column:
            kinds = [*_KINDS[type(field.dataType)], *(["VOID"] if field.name in _NULLABLE else [])]
            wrong = F.when(found.isNotNull() & ~found.isin(*kinds), "wrong_type")
            if field.name in defaults or field.name in _NULLABLE:
                return wrong
            return F.coalesce(F.when(found.isNull(), "missing_field"), wrong)

        return once(kind(record, field.name), judge)

    return F.coalesce(*[fault(field) for field in schema.fields])


def _unknown(raw: Column, known: list[str]) -> Column:
    return F.size(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in known]))) > 0


def _broken(rules: dict[str, Column]) -> Column:
    broken = F.lit(False)
    for rule in rules.values():
        broken = broken | ~F.coalesce(rule, F.lit(False))
    return broken


def _supersession_fault(evidence: Column) -> Column:
    """A link to the row itself, to no row of the case, or to another slot."""
    links = F.filter(evidence, lambda e: e["supersedes"].isNotNull())

    def bad(e: Column) -> Column:
        same = F.filter(evidence, lambda t: (t["evidence_id"] == e["supersedes"]) & (t["slot"] == e["slot"]))
        return (e["supersedes"] == e["evidence_id"]) | (F.size(same) == 0)

    return F.exists(links, bad)


def _supersession_cycle(evidence: Column) -> Column:
    """Rows left after taking away, as often as there are rows, those whose link leads to no row left."""
    ids = F.transform(F.filter(evidence, lambda e: e["supersedes"].isNotNull()), lambda e: F.struct(
        e["evidence_id"].alias("a"), e["supersedes"].alias("b")
    ))
    left = F.aggregate(ids, ids, lambda rest, _: F.filter(
        rest, lambda link: F.exists(rest, lambda other: other["a"] == link["b"])
    ))
    return F.size(left) > 0


def parse_cases(raw: DataFrame, column: str = "value") -> DataFrame:
    """Add ``case`` (typed, defaults filled) and ``reason`` (null when the row is acceptable).

    A row is refused for text beside its one JSON object, unknown fields, absent required fields, values of another
    JSON type, broken constraints of the case or of any evidence row, and bad supersession links. A default stands
    only for an absent field. Column expressions throughout, so this runs in a stream too.
    """
    text = F.col(column)
    df = raw.withColumns({
        "_case": F.from_json(text, CASE, {"mode": "PERMISSIVE"}), "_record": F.try_parse_json(text), "_whole": is_object(text),
    })
    fill = lambda record, name, default: (
        F.coalesce(record[name], F.lit(default)) if default is not None else record[name]
    )
    evidence = F.transform(
        F.col("_case.evidence"),
        lambda e: F.struct(*[fill(e, n, _EVIDENCE_DEFAULTS.get(n)).alias(n) for n in _EVIDENCE_FIELDS]),
    )
    case = F.struct(
        *[
            (evidence if n == "evidence" else fill(F.col("_case"), n, _CASE_DEFAULTS.get(n))).alias(n)
            for n in _CASE_FIELDS
        ]
    )
    # the schema of a plain case settles it at one look, that of a sound record all its fields; only others are looked at field by field
    sound = _is_sound(F.col("_record"), CASE, _CASE_DEFAULTS) & F.coalesce(F.forall(
        F.try_variant_get("_record", "$.evidence", "array<variant>"), lambda e: _is_sound(e, EVIDENCE, _EVIDENCE_DEFAULTS)
    ), F.lit(False))
    df = _computed_once(df, {"case": case, "_plain": _is_plain(F.col("_record"), F.col("_case"))})
    items = F.from_json(F.get_json_object(text, "$.evidence"), "array<string>", {"mode": "PERMISSIVE"})
    item_faults = lambda raw_items: F.transform(raw_items, lambda i: F.when(~is_object(i), "wrong_type").otherwise(
        once(F.try_parse_json(i), lambda r: _field_fault(r, EVIDENCE, _EVIDENCE_DEFAULTS))
    ))
    unknown = lambda raw_items: _unknown(text, _CASE_FIELDS) | F.exists(
        raw_items, lambda i: F.coalesce(_unknown(i, _EVIDENCE_FIELDS), F.lit(False))
    )
    slots = F.from_json(F.get_json_object(text, "$.required_slots"), "array<variant>")
    slot_fault = F.when(F.exists(slots, lambda s: F.schema_of_variant(s) != "STRING"), "wrong_type")
    field_fault = F.when(~F.col("_plain"), F.when(sound, slot_fault).otherwise(once(items, lambda found: F.coalesce(
        F.when(unknown(found), "unknown_field"), _field_fault(F.col("_record"), CASE, _CASE_DEFAULTS), slot_fault,
        F.get(F.array_compact(item_faults(found)), F.lit(0)),
    ))))
    df = _computed_once(df, {"_fault": F.when(F.col("_whole") & F.col("_record").isNotNull(), field_fault).otherwise("malformed")})
    rows = F.col("case.evidence")
    ids = F.transform(rows, lambda e: e["evidence_id"])
    at = lambda record: lambda name: record[name]
    reason = (
        F.when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(F.size(rows) > MAX_EVIDENCE_PER_CASE, "too_many_evidence_rows")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_evidence_id")
        .when(F.exists(rows, lambda e: ~F.coalesce(bbox_is_valid(e["bbox"]), F.lit(False))), "bad_bbox")
        .when(_broken(case_rules(at(F.col("case")))) | F.exists(rows, lambda e: _broken(evidence_rules(at(e)))), "constraint")
        .when(_supersession_fault(rows), "bad_supersession")
        .when(_supersession_cycle(rows), "supersession_cycle")
    )
    return df.withColumn("reason", reason).drop("_case", "_record", "_whole", "_plain", "_fault")


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: typed nested cases, and raw rows with the reason they were refused."""
    checked = parse_cases(spark.read.text(path))
    good = checked.filter("reason is null").select("case.*")
    return good, checked.filter("reason is not null").select("value", "reason")


def explode_evidence(cases: DataFrame) -> DataFrame:
    """Nested cases to the long evidence table; the position in the array becomes ``ord``."""
    return cases.select("case_id", F.posexplode("evidence").alias("_at", "_e")).select(
        "case_id", (F.col("_at") + 1).alias("ord"), "_e.*"
    )
