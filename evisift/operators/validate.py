"""Audits of cases and evidence. Each returns one row per violation; ``count_by_rule`` sums them up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.geometry import bbox_is_valid
from evisift.functions.paths import is_traversal
from evisift.schemas import (
    MAX_TEXT_CHARS,
    POLARITIES,
    SHA256_PATTERN,
    STATUSES,
)
from evisift.session import pin


Fields = Callable[[str], Column]


def _length(value: Column, most: int) -> Column:
    return F.length(value).between(1, most)


def evidence_rules(field: Fields = F.col) -> dict[str, Column]:
    """What every evidence row must satisfy; nulls fail unless the field is optional. ``field`` finds a column by name."""
    return {
        "evidence_id_length": _length(field("evidence_id"), 128),
        "slot_length": _length(field("slot"), 64),
        "text_length": _length(field("text"), MAX_TEXT_CHARS),
        "polarity_value": field("polarity").isin(*POLARITIES),
        "system_length": _length(field("system"), 128),
        "region_length": _length(field("region"), 64),
        "age_days_range": field("age_days").between(0, 100_000),
        "page_range": field("page").between(1, 100_000),
        "source_hash_pattern": field("source_hash").rlike(SHA256_PATTERN),
    }


def case_rules(field: Fields = F.col) -> dict[str, Column]:
    minutes, slots = field("expected_review_minutes"), field("required_slots")
    return {
        "case_id_length": _length(field("case_id"), 128),
        "control_id_length": _length(field("control_id"), 128),
        "required_slots_present": F.size(slots) > 0,
        "required_slots_unique": F.size(F.array_distinct(slots)) == F.size(slots),
        "target_system_length": _length(field("target_system"), 128),
        "target_region_length": _length(field("target_region"), 64),
        "max_age_days_range": field("max_age_days").between(1, 10_000),
        "criticality_range": field("criticality").between(1, 5),
        "review_minutes_range": (minutes > 0) & (minutes <= 240),
        "split_length": _length(field("split"), 32),
        "mutation_length": _length(field("mutation"), 128),
        "gold_status_value": field("gold_status").isNull() | field("gold_status").isin(*STATUSES),
    }


def document_rules(field: Fields = F.col) -> dict[str, Column]:
    """What every document of a manifest must satisfy."""
    return {
        "document_id_length": _length(field("document_id"), 128),
        "source_path_length": _length(field("source_path"), 512),
        "source_path_safe": ~is_traversal(field("source_path")),
        "sha256_pattern": field("sha256").rlike(SHA256_PATTERN),
        "document_type_length": _length(field("document_type"), 64),
        "system_present": field("system").isNotNull(),
        "region_present": field("region").isNotNull(),
        "age_days_range": field("age_days").between(0, 100_000),
    }


def field_audit(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row per (record, broken rule). A single pass: no join and no shuffle."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def count_by_rule(violations: DataFrame, by: Sequence[str] = ("rule",)) -> DataFrame:
    return violations.groupBy(*by).agg(F.count("*").alias("n_violations"))


def bbox_audit(evidence: DataFrame, keys: Sequence[str] = ("case_id", "evidence_id")) -> DataFrame:
    return evidence.filter(~bbox_is_valid(F.col("bbox"))).select(*keys)


def duplicate_evidence(evidence: DataFrame) -> DataFrame:
    return (
        evidence.groupBy("case_id", "evidence_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    )


def supersession_refs(evidence: DataFrame) -> DataFrame:
    """Links that point at themselves, at nothing in the same case, or at another slot."""
    links = evidence.filter("supersedes is not null").select("case_id", "evidence_id", "slot", "supersedes")
    targets = evidence.select(
        "case_id", F.col("evidence_id").alias("supersedes"), F.col("slot").alias("target_slot")
    )
    joined = links.join(targets, ["case_id", "supersedes"], "left")
    rule = (
        F.when(F.col("supersedes") == F.col("evidence_id"), "self")
        .when(F.col("target_slot").isNull(), "unknown_target")
        .when(F.col("target_slot") != F.col("slot"), "cross_slot")
    )
    return joined.select("case_id", "evidence_id", rule.alias("rule")).filter("rule is not null")


def supersession_cycles(evidence: DataFrame) -> DataFrame:
    """Evidence rows that lie on a supersession cycle.

    A row has at most one outgoing link; rows may repeat, and links are made distinct in every round. Pointer doubling: after k joins each surviving row points
    2^k links ahead, and rows whose chain has ended are gone. Rows still there after more links than the
    table has can only be chasing a cycle, and what they point at lies on one. An acyclic table is empty
    after log2(longest chain) joins.
    """
    # a link to no row of the case needs no look-up: nothing goes on from there, so the first join drops it
    links = hops = pin(
        evidence.filter("supersedes is not null")
        .select("case_id", "evidence_id", F.col("supersedes").alias("ahead")).distinct(),
        "hops",
    )
    # a cycle stays inside a case, so chains longer than the largest case are not needed
    longest = hops.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= longest and hops.limit(1).count():
        onward = hops.select("case_id", F.col("evidence_id").alias("ahead"), F.col("ahead").alias("_next"))
        hops = pin(
            hops.join(onward, ["case_id", "ahead"]).select(
                "case_id", "evidence_id", F.col("_next").alias("ahead")
            ).distinct(),
            "hops",
        )
        reach *= 2
    # a row on a cycle links on
    ends = hops.select("case_id", F.col("ahead").alias("evidence_id")).distinct()
    return ends.join(links, ["case_id", "evidence_id"], "left_semi")


def align_cases_results(cases: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(case ids present once on both sides, violations)``: duplicates and ids on one side only.

    Both sides are counted per id before they meet, so a repeated id never multiplies rows.
    """
    side = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    both = side(cases, "n_cases").join(side(results, "n_results"), "case_id", "full_outer").fillna(
        0, ["n_cases", "n_results"]
    )
    rules = {
        "duplicate_case": F.col("n_cases") <= 1,
        "duplicate_result": F.col("n_results") <= 1,
        "missing_result": F.col("n_results") > 0,
        "unknown_case": F.col("n_cases") > 0,
    }
    good = both.filter("n_cases = 1 and n_results = 1").select("case_id")
    return good, field_audit(both, ["case_id"], rules)


def same_id_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only; empty when the two sets are equal."""
    a, b = left.distinct(), right.distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right"))
    )
