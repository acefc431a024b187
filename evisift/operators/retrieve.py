"""Token-overlap retrieval, verifier contract and evidence construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisift.functions.text import tokens
from evisift.session import pin

# Size limits of a document and of an evidence pack.
MAX_DOCUMENT_BLOCKS, MAX_DOCUMENT_CHARS = 10_000, 5_000_000
MAX_PACK_BLOCKS, MAX_PACK_CHARS = 50_000, 20_000_000
# Blocks per place of the result that a query's rarest tokens are to propose before its floor is known.
SEED_BLOCKS = 20


def query_tokens(queries: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(one row per query and token, queries without a searchable token)``."""
    split = queries.withColumn("_tokens", tokens(F.col("query"))).withColumn("n_tokens", F.size("_tokens"))
    empty = split.filter("n_tokens = 0").drop("_tokens", "n_tokens")
    rows = split.select(*keys, "n_tokens", F.explode("_tokens").alias("token"))
    return rows, empty


def token_index(blocks: DataFrame, wanted: DataFrame, within: Sequence[str]) -> DataFrame:
    """``(*within, block_id, tokens)``: blocks with those of their tokens that any query has, in a written table.

    A block's tokens are joined with the queries' vocabulary where the block lies; one row per block travels.
    """
    vocabulary = pin(wanted.select(*within, "token").distinct(), "query-vocabulary")
    spread = blocks.select(*within, "block_id", F.explode(tokens(F.col("text"))).alias("token"))
    return pin(
        spread.join(vocabulary, [*within, "token"]).groupBy(*within, "block_id").agg(F.collect_set("token").alias("tokens")),
        "token-index",
    )


def rarest_first(wanted: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Query tokens with ``n_blocks`` that have them and their ``place`` in the query, the rarest first."""
    frequency = index.select(*[c for c in index.columns if c not in ("block_id", "tokens")], F.explode("tokens").alias("token"))
    on = frequency.columns
    counted = wanted.join(frequency.groupBy(*on).agg(F.count("*").alias("n_blocks")), on, "left").fillna(0, ["n_blocks"])
    order = Window.partitionBy(*keys).orderBy("n_blocks", "token")  # the tokens of one query
    return counted.withColumns({
        "place": F.row_number().over(order),
        "_before": F.coalesce(F.sum("n_blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })


def overlaps(index: DataFrame, placed: DataFrame, prefix: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """``(keys, block_id, overlap, n_tokens)`` for every block that holds a token of a query's ``prefix`` rows.

    A block meets a query at the first prefix token that it holds, so a pair is counted once and nothing is grouped. Blocks with
    fewer wanted tokens than the query's ``floor`` are passed over.
    """
    whole = placed.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("_query")
    )
    spread = index.select(*within, "block_id", "tokens", F.explode("tokens").alias("token"))
    met = spread.join(prefix.select(*within, *keys, "token", "place", "n_tokens", "floor"), [*within, "token"]).filter(
        F.size("tokens") >= F.col("floor")
    ).join(whole, list(keys))
    first = ~F.arrays_overlap("tokens", F.slice("_query", F.lit(1), F.col("place") - 1))
    return met.filter(first).select(
        *within, *keys, "block_id", "n_tokens", F.size(F.array_intersect("tokens", "_query")).alias("overlap")
    )


def retrieve_topk(
    blocks: DataFrame, queries: DataFrame, keys: Sequence[str], *, top_k: int = 5, within: Sequence[str] = ()
) -> DataFrame:
    """The ``top_k`` blocks per query by share of query tokens they contain.

    ``queries`` has ``keys`` and ``query``; with ``within=["pack_id"]`` a query only meets blocks of its
    own pack. Score ties rank by block id.

    Two phases over an index of the blocks' query tokens. First a query's rarest tokens, as many as have some blocks for
    each place, propose blocks; the overlap of the k-th best of them is a floor for the result. A block that reaches a
    floor of ``f`` out of ``n`` tokens lacks at most ``n - f``, so it holds one of the ``n - f + 1`` rarest: only blocks with one of those
    are counted, and the frequent tokens propose none. The result is that of a full scan.
    """
    if not 1 <= top_k <= 1000:
        raise ValueError(f"top_k is {top_k}, expected 1 to 1000")
    rows, _ = query_tokens(queries, [*keys, *within])
    wanted = pin(rows, "query-tokens")
    index = token_index(blocks, wanted, within)
    placed = pin(rarest_first(wanted, index, keys), "placed-tokens")
    floors = pin(_floors(index, placed, keys, within, top_k), "floors")
    prefix = placed.join(floors, list(keys), "left").withColumn("floor", F.coalesce("_floor", F.lit(1))).filter(
        F.col("place") <= F.col("n_tokens") - F.col("floor") + 1
    )
    best_first = Window.partitionBy(*within, *keys).orderBy(F.col("score").desc(), "block_id")
    return (
        overlaps(index, placed, pin(prefix, "prefix-tokens"), keys, within)
        .withColumn("score", F.round(F.col("overlap") / F.col("n_tokens"), 6))
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= top_k)
        .select(*within, *keys, "rank", F.col("block_id").alias("candidate_id"), "score")
    )


def _floors(index: DataFrame, placed: DataFrame, keys: Sequence[str], within: Sequence[str], top_k: int) -> DataFrame:
    """``(keys, _floor)``: the k-th best overlap among the blocks of a query's rarest tokens, for queries with as many blocks."""
    few = F.col("_before") + F.col("n_blocks") <= SEED_BLOCKS * top_k
    seeds = pin(placed.filter((F.col("_before") < top_k) | few).withColumn("floor", F.lit(1)), "seed-tokens")
    best = Window.partitionBy(*keys).orderBy(F.col("overlap").desc())
    ranked = overlaps(index, placed, seeds, keys, within).withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= top_k)
    return ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("overlap").alias("_floor")).filter(F.col("_n") == top_k).drop("_n")


def with_block_facts(candidates: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Bring text, page and source facts to the few winning blocks; the corpus is filtered, not shuffled."""
    winners = pin(candidates, "candidates")
    ids = winners.select(F.col("candidate_id").alias("block_id")).distinct()
    drop = [c for c in blocks.columns if c in candidates.columns]
    facts = blocks.drop(*drop).join(ids, "block_id", "left_semi")
    known = documents.select("document_id", "source_hash", "source_path", "system", "region", "age_days")
    return (
        winners.join(facts.withColumnRenamed("block_id", "candidate_id"), "candidate_id")
        .join(known, "document_id")
    )


def unknown_documents(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids of documents that blocks name and the manifest does not."""
    return blocks.select("document_id").distinct().join(documents, "document_id", "left_anti")


def duplicate_documents(documents: DataFrame) -> DataFrame:
    return documents.groupBy("document_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def pack_budget(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Packs and documents over their block or text limit, and documents without any parseable text.

    ``documents`` lists ``pack_id, document_id``. Packs are summed from per-document sums.
    """
    counted = blocks.groupBy("pack_id", "document_id").agg(
        F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars")
    )
    listed = documents.select("pack_id", "document_id").distinct()
    per_document = listed.join(counted, ["pack_id", "document_id"], "left").fillna(0, ["n_blocks", "n_chars"])
    per_pack = per_document.groupBy("pack_id").agg(
        F.sum("n_blocks").alias("n_blocks"), F.sum("n_chars").alias("n_chars")
    ).withColumn("document_id", F.lit(None).cast("string"))
    verdict = lambda df, scope, most_blocks, most_chars: df.select(
        F.lit(scope).alias("scope"), "pack_id", "document_id", "n_blocks", "n_chars",
        (F.col("n_blocks") > most_blocks).alias("blocks_exceeded"),
        (F.col("n_chars") > most_chars).alias("chars_exceeded"), (F.col("n_blocks") == 0).alias("no_text"),
    )
    return verdict(per_document, "document", MAX_DOCUMENT_BLOCKS, MAX_DOCUMENT_CHARS).unionByName(
        verdict(per_pack, "pack", MAX_PACK_BLOCKS, MAX_PACK_CHARS)
    )


def verify_candidates(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates with their verifier response and ``violation``: the first identity field that changed.

    A candidate without a response is a violation too, because the walk would have asked for it.
    """
    identity = ("document_id", "page", "text", "bbox")
    with_box = lambda df: df if "bbox" in df.columns else df.withColumn(
        "bbox", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    )
    answers = with_box(responses).select(
        "case_id", "slot", "candidate_id",
        *[F.col(c).alias(f"_r_{c}") for c in identity], "polarity", "confidence", F.lit(True).alias("_answered"),
    )
    joined = with_box(candidates).join(answers, ["case_id", "slot", "candidate_id"], "left")
    violation = F.when(F.col("_answered").isNull(), "missing_response")
    for name in identity:
        violation = violation.when(~F.col(name).eqNullSafe(F.col(f"_r_{name}")), f"changed_{name}")
    return joined.withColumn("violation", violation).drop("_answered", *[f"_r_{c}" for c in identity])


def first_accepted(verified: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(accepted candidate per slot, violations that the walk meets)``.

    The walk asks in rank order and stops at the first confident answer, so violations ranked after it are
    never seen. A case that meets a violation yields no evidence at all.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"confidence threshold {threshold} is outside 0 to 1")
    slot = Window.partitionBy("case_id", "slot")  # at most top_k rows
    confident = F.min(F.when(F.col("confidence") >= threshold, F.col("rank"))).over(slot)
    walked = verified.withColumn("accepted_rank", confident).filter(
        F.col("accepted_rank").isNull() | (F.col("rank") <= F.col("accepted_rank"))
    )
    violations = walked.filter("violation is not null")
    failed = violations.select("case_id").distinct()
    accepted = walked.filter(F.col("rank") == F.col("accepted_rank")).join(failed, "case_id", "left_anti")
    return accepted.drop("accepted_rank"), violations.drop("accepted_rank")


def build_evidence(accepted: DataFrame) -> DataFrame:
    """Accepted candidates as evidence rows; the position is the slot's place in ``required_slots``."""
    return accepted.select(
        "case_id",
        F.array_position("required_slots", F.col("slot")).cast("int").alias("ord"),
        F.concat_ws(":", "case_id", "slot", "candidate_id").alias("evidence_id"),
        "slot", "text", "polarity", "system", "region", "age_days",
        F.lit(False).alias("approved"),
        F.lit(None).cast("string").alias("supersedes"),
        F.lit(True).alias("checksum_valid"),
        F.lit(True).alias("provenance_valid"),
        F.lit(False).alias("prompt_injection"),
        "page", "bbox", "source_hash",
    )


def slot_query_mismatch(cases: DataFrame) -> DataFrame:
    """Cases whose ``query_slots`` are not exactly their ``required_slots``."""
    return cases.select(
        "case_id",
        F.sort_array(F.array_except("required_slots", "query_slots")).alias("without_query"),
        F.sort_array(F.array_except("query_slots", "required_slots")).alias("not_required"),
    ).filter((F.size("without_query") > 0) | (F.size("not_required") > 0))
