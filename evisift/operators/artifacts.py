"""Artifact manifests, registries, run identity and corpus hygiene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.paths import is_portable, is_traversal, is_windows_invalid, posix_path
from evisift.functions.text import casefold
from evisift.schemas import SHA256_PATTERN

# Line patterns of the hygiene scan, named.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN (?:RSA|OPENSSH|EC) PRIVATE KEY-----",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "generic_secret_assignment": r"(?i)\b(?:api[_-]?key|secret|token)\s*[:=]\s*['\"][^'\"]{12,}['\"]",
}
MACHINE_PATH_PATTERN = r"/mnt/data/|[A-Za-z]:\\Users\\"

# Archive limits.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES, MAX_RATIO = 20_000, 500_000_000, 2_000_000_000, 1_000.0


# ---------------------------------------------------------------------------------------------
# manifests


def validate_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Exact-cover check of declared against actual files: one row per problem.

    Both are keyed by (run_id, path). Declared paths are merged per normalised path before the join, so a
    path that is declared many times never multiplies rows.
    """
    keys = ["run_id", "path"]
    rows = manifest.withColumn("_unsafe", is_traversal(F.col("path")) | ~is_portable(F.col("path")))
    bad_bytes = F.coalesce(F.col("bytes") < 0, F.lit(True))
    bad_hash = ~F.coalesce(F.col("sha256").rlike(SHA256_PATTERN), F.lit(False))
    declared = rows.withColumn("path", posix_path(F.col("path"))).groupBy(*keys).agg(
        F.count("*").alias("_times"),
        F.bool_or("_unsafe").alias("_unsafe"),
        F.bool_or(bad_bytes).alias("_bad_bytes"),
        F.bool_or(bad_hash).alias("_bad_hash"),
        F.min(F.struct("bytes", "sha256")).alias("_low"),
        F.max(F.struct("bytes", "sha256")).alias("_high"),
    )
    found = actual.select(*keys, F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    both = declared.join(found, keys, "full_outer")
    here, there = F.col("_times").isNotNull(), F.col("_sha").isNotNull()
    same = lambda side: (F.col(side)["bytes"] == F.col("_bytes")) & (F.col(side)["sha256"] == F.col("_sha"))
    rules = {
        "duplicate_path": here & (F.col("_times") > 1),
        "unsafe_path": here & F.col("_unsafe"),
        "bad_byte_count": here & F.col("_bad_bytes"),
        "bad_hash": here & F.col("_bad_hash"),
        "missing_file": here & ~there,
        "content_mismatch": here & there & ~F.coalesce(same("_low") & same("_high"), F.lit(False)),
        "unlisted_file": there & ~here,
    }
    return _problems(both, keys, rules)


def _problems(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    hit = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(*keys, F.explode(hit).alias("problem"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("run_id").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("total_bytes"))


def fingerprint(manifest: DataFrame, key: str = "run_id") -> DataFrame:
    """One digest per run over its (path, bytes, sha256) entries, whatever their order.

    A tree over the first hex digits of the path's MD5: sorted entry digests are hashed per six digits, those per three
    digits, those per run. A task gathers 4096 digests on the upper levels, and on the lowest one entry in 16 million.
    """
    entry = F.sha2(F.concat_ws("|", "path", F.col("bytes").cast("string"), "sha256"), 256)
    joined = lambda digests: F.sha2(F.array_join(F.sort_array(F.collect_list(digests)), ""), 256).alias("_d")
    level = manifest.select(key, F.substring(F.md5("path"), 1, 6).alias("_p"), entry.alias("_d"), F.lit(1).alias("_n"))
    level = level.groupBy(key, "_p").agg(joined("_d"), F.sum("_n").alias("_n"))
    tagged = F.concat_ws(":", "_p", "_d")
    level = level.groupBy(key, F.substring("_p", 1, 3).alias("_q")).agg(joined(tagged), F.sum("_n").alias("_n"))
    return level.groupBy(key).agg(joined(F.concat_ws(":", "_q", "_d")), F.sum("_n").alias("n_files")).select(
        key, F.col("_d").alias("fingerprint"), "n_files"
    )


def snapshot_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Files added, deleted or modified between two manifests, with both hashes."""
    side = lambda df, p: df.select("path", F.col("bytes").alias(f"_{p}_bytes"), F.col("sha256").alias(f"{p}_sha256"))
    both = side(baseline, "baseline").join(side(candidate, "candidate"), "path", "full_outer")
    status = (
        F.when(F.col("baseline_sha256").isNull(), "added")
        .when(F.col("candidate_sha256").isNull(), "deleted")
        .when(
            (F.col("baseline_sha256") != F.col("candidate_sha256"))
            | (F.col("_baseline_bytes") != F.col("_candidate_bytes")),
            "modified",
        )
    )
    return both.select("path", status.alias("status"), "baseline_sha256", "candidate_sha256").filter(
        "status is not null"
    )


def republish_verdict(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """Per staged run: ``new``, ``no_op`` (same artifacts) or ``conflict``."""
    columns = ["run_id", "path", "bytes", "sha256"]
    side = lambda df, old: df.select(*columns, F.lit(old).alias("_old"), F.lit(1 - old).alias("_new"))
    # entries meet by all their columns, so a run is never gathered in one task; partial sums then give its verdict
    entries = side(existing, 1).unionByName(side(staged, 0)).groupBy(*columns).agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    runs = entries.groupBy("run_id").agg(
        (F.sum("_old") > 0).alias("_known"), (F.sum("_new") > 0).alias("_staged"), F.bool_or(F.col("_old") != F.col("_new")).alias("_differs"),
    )
    # a run without a name is not known by it
    verdict = F.when(~F.col("_known") | F.col("run_id").isNull(), "new").when(F.col("_differs"), "conflict").otherwise("no_op")
    return runs.filter("_staged").select("run_id", verdict.alias("verdict"))


def latest_valid_run(runs: DataFrame, problems: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per ``group`` the most recently committed run, if its manifest is valid; an invalid latest run yields none."""
    latest = runs.groupBy(*group).agg(F.max_by("run_id", "committed_at").alias("run_id"))
    return latest.join(problems.select("run_id").distinct(), "run_id", "left_anti")


def run_identity(artifacts: DataFrame) -> DataFrame:
    """Per run: do all artifacts carry one version and config hash, and do gate and summary agree."""
    agrees = F.bool_and(
        F.col("gate_status").isNull() | (F.col("gate_status") == F.when(F.col("release_passed"), "PASS").otherwise("FAIL"))
    )
    return artifacts.groupBy("run_id").agg(
        F.count("*").alias("n_artifacts"),
        F.count_distinct("project_version").alias("n_versions"),
        F.count_distinct("config_hash").alias("n_config_hashes"),
        agrees.alias("gate_agrees"),
    ).withColumn(
        "consistent", (F.col("n_versions") == 1) & (F.col("n_config_hashes") == 1) & F.col("gate_agrees")
    )


# ---------------------------------------------------------------------------------------------
# registry

REGISTRY_FIELDS = (
    "artifact_type", "filename", "sha256", "bytes", "project_version", "training_manifest_hash",
)


def register(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming artifact: ``registered``, ``no_op`` or ``conflict``. Registered ids never change.

    A batch has no order, so unlike entries for one new id are all conflicts; like ones register once.
    """
    entry = F.struct(*REGISTRY_FIELDS)
    known = registry.select("artifact_id", entry.alias("_known"))
    offered = incoming.select("artifact_id", entry.alias("_new"))
    unlike = offered.distinct().groupBy("artifact_id").agg((F.count("*") > 1).alias("_unlike"))
    joined = offered.join(unlike, "artifact_id").join(known, "artifact_id", "left")
    verdict = (
        F.when(F.col("_known").isNull(), F.when(F.col("_unlike"), "conflict").otherwise("registered"))
        .when(F.col("_known").eqNullSafe(F.col("_new")), "no_op")
        .otherwise("conflict")
    )
    return joined.select("artifact_id", verdict.alias("verdict"))


def verify_artifacts(artifacts: DataFrame, registry: DataFrame, version: str) -> DataFrame:
    """Per artifact: ``ok`` or why it must not be used."""
    known = registry.select(
        "artifact_id", F.col("sha256").alias("_sha"), F.col("project_version").alias("_version"),
        F.lit(True).alias("_known"),
    )
    reason = (
        F.when(F.col("_known").isNull(), "unregistered")
        .when(~F.col("_version").eqNullSafe(F.lit(version)), "version_mismatch")
        .when(~F.col("sha256").eqNullSafe(F.col("_sha")), "hash_mismatch")
        .otherwise("ok")
    )
    return artifacts.join(known, "artifact_id", "left").select("artifact_id", reason.alias("verdict"))


# ---------------------------------------------------------------------------------------------
# documents, archives, text corpora


def document_integrity(
    specs: DataFrame, files: DataFrame, max_file_bytes: int = 25_000_000, max_total_bytes: int = 100_000_000,
    max_documents: int = 128,
) -> DataFrame:
    """Problems of manifest documents against the files: ``specs`` and ``files`` keyed by (pack_id, path).

    ``files`` has ``bytes`` and ``sha256``. Totals are per pack.
    """
    if min(max_file_bytes, max_total_bytes) < 1:
        raise ValueError("size limits start at one byte")
    ids = specs.groupBy("pack_id", "document_id").agg(F.count("*").alias("_times"))
    joined = specs.join(ids, ["pack_id", "document_id"]).join(
        files.select("pack_id", "source_path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")),
        ["pack_id", "source_path"], "left",
    )
    there = F.col("_sha").isNotNull()
    single = _problems(
        joined, ["pack_id", "document_id"],
        {
            "duplicate_document_id": F.col("_times") > 1,
            "unsafe_path": is_traversal(F.col("source_path")),
            "missing_file": ~there,
            "bad_size": there & ~F.col("_bytes").between(1, max_file_bytes),
            "checksum_mismatch": there & (F.col("_sha") != F.col("sha256")),
        },
    )
    totals = joined.groupBy("pack_id").agg(F.sum("_bytes").alias("_total"), F.count("*").alias("_documents"))
    whole = _problems(
        totals.withColumn("document_id", F.lit(None).cast("string")), ["pack_id", "document_id"],
        {
            "pack_too_large": F.col("_total") > max_total_bytes,
            "too_many_documents": F.col("_documents") > max_documents,
        },
    )
    return single.unionByName(whole)


def member_audit(
    members: DataFrame, max_members: int = MAX_MEMBERS, max_member_bytes: int = MAX_MEMBER_BYTES,
    max_total_bytes: int = MAX_TOTAL_BYTES, max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """Problems per archive of a member inventory. ``n_members`` counts the members that show a problem.

    Repeated names are found by counting per normalised name, and archive totals by a partial sum, so an
    archive that lists most of the members is never gathered.
    """
    size, packed = F.col("file_size"), F.col("compress_size")
    rules = {
        "traversal": is_traversal(F.col("member")),
        "encrypted": F.col("encrypted"),
        "symlink": F.col("is_symlink"),
        "member_size": (size < 0) | (size > max_member_bytes),
        "zero_compressed_size": (size != 0) & (packed == 0),
        "ratio": (packed != 0) & (size / F.when(packed != 0, packed) > max_ratio),
    }
    per_member = _problems(members, ["archive"], rules).groupBy("archive", "problem").agg(
        F.count("*").alias("n_members")
    )
    names = members.groupBy("archive", posix_path(F.col("member")).alias("_name")).agg(F.count("*").alias("_times"))
    repeats = names.filter("_times > 1").groupBy("archive").agg(F.sum(F.col("_times") - 1).alias("n_members"))
    totals = members.groupBy("archive").agg(F.count("*").alias("n_members"), F.sum("file_size").alias("_bytes"))
    named = lambda df, problem: df.select("archive", F.lit(problem).alias("problem"), "n_members")
    return (
        per_member.unionByName(named(repeats, "duplicate"))
        .unionByName(named(totals.filter(F.col("n_members") > max_members), "too_many_members"))
        .unionByName(named(totals.filter(F.col("_bytes") > max_total_bytes), "total_size"))
    )


def line_findings(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Secret-like and machine-path lines: one row per (line, pattern)."""
    patterns = {**SECRET_PATTERNS, "machine_path": MACHINE_PATH_PATTERN}
    rules = {name: F.col("line").rlike(pattern) for name, pattern in patterns.items()}
    return _problems(lines, keys, rules).withColumnRenamed("problem", "pattern")


# Fixed value: every line end that Unicode knows, a carriage return with its line feed as one.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def numbered_lines(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Lines of each text, counted from one."""
    return texts.select(*keys, F.posexplode(F.split(text, LINE_END)).alias("_at", "line")).select(
        *keys, (F.col("_at") + 1).alias("line_number"), "line"
    )


def case_collisions(paths: DataFrame) -> DataFrame:
    """Paths that differ only in letter case; counted, not gathered."""
    return (
        paths.select("path").distinct().groupBy(casefold(F.col("path")).alias("folded_path"))
        .agg(F.count("*").alias("n_paths")).filter("n_paths > 1")
    )


def invalid_paths(paths: DataFrame) -> DataFrame:
    return paths.filter(is_windows_invalid(F.col("path"))).select("path").distinct()
