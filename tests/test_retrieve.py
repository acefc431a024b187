import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evisift.operators import retrieve

VOCABULARY = [f"w{k}" for k in range(40)]


def corpus(seed, n_blocks, n_queries):
    """Blocks and queries over words of very unequal frequency, in two packs."""
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(40)]
    some = lambda low, high: " ".join(rng.choices(VOCABULARY, weights, k=rng.randint(low, high)))
    blocks = [(rng.choice("pq"), f"b{k:04d}", some(0, 25)) for k in range(n_blocks)]
    queries = [(rng.choice("pq"), k, some(0, 30) + rng.choice(["", " unseen", " other unseen words", " W1 w1"])) for k in range(n_queries)]
    return blocks, queries


def full_scan(blocks, queries, top_k, packs):
    out = set()
    for pack, item, text in queries:
        wanted = set(text.lower().split())
        scored = [
            (-round(len(wanted & set(t.split())) / len(wanted), 6), b) for p, b, t in blocks
            if (not packs or p == pack) and wanted & set(t.split())
        ] if wanted else []
        out |= {(item, rank, b, -s) for rank, (s, b) in enumerate(sorted(scored)[:top_k], 1)}
    return out


@pytest.mark.parametrize(("seed", "top_k", "packs"), [(1, 5, False), (2, 1, True), (3, 3, False), (4, 40, True), (5, 1000, False)])
def test_bounded_search_equals_full_scan(spark, monkeypatch, seed, top_k, packs):
    monkeypatch.setattr(retrieve, "SEED_BLOCKS", seed)
    blocks, queries = corpus(seed, 250, 60)
    got = retrieve.retrieve_topk(
        spark.createDataFrame(blocks, "pack string, block_id string, text string"),
        spark.createDataFrame(queries, "pack string, item int, query string"), ["item"], top_k=top_k, within=["pack"] if packs else [],
    )
    assert {(r.item, r.rank, r.candidate_id, r.score) for r in got.collect()} == full_scan(blocks, queries, top_k, packs)


def test_frequent_tokens_propose_no_blocks(spark, monkeypatch):
    """A token that every block has, beside rare ones that settle the result, costs no pair."""
    counted = []
    real = retrieve.overlaps
    monkeypatch.setattr(retrieve, "overlaps", lambda *a: counted.append(real(*a)) or counted[-1])
    blocks = [(f"b{k:04d}", "the of and " + " ".join(f"r{(k + j) % 100}" for j in range(3))) for k in range(1000)]
    queries = [(k, f"the of and r{k} r{k + 1} r{k + 2}") for k in range(10)]
    got = retrieve.retrieve_topk(
        spark.createDataFrame(blocks, "block_id string, text string"), spark.createDataFrame(queries, "item int, query string"), ["item"], top_k=5,
    )
    want = defaultdict(list)
    for k, _ in queries:
        want[k] = [f"b{k + 100 * j:04d}" for j in range(5)]
    assert {(r.item, r.rank, r.candidate_id, r.score) for r in got.collect()} == {(k, j + 1, b, 1.0) for k, v in want.items() for j, b in enumerate(v)}
    assert sum(c.count() for c in counted) <= 2 * 10 * 90 < 0.2 * 10 * 1000


def test_queries_and_blocks_without_tokens(spark):
    blocks = spark.createDataFrame([("b1", ""), ("b2", None), ("b3", "?!")], "block_id string, text string")
    queries = spark.createDataFrame([(1, ""), (2, "alpha"), (3, None)], "item int, query string")
    assert retrieve.retrieve_topk(blocks, queries, ["item"]).count() == 0
    one = spark.createDataFrame([("b1", "alpha")], "block_id string, text string")
    got = retrieve.retrieve_topk(one, queries, ["item"]).select("item", "rank", "candidate_id", F.col("score")).collect()
    assert [tuple(r) for r in got] == [(2, 1, "b1", 1.0)]
    with pytest.raises(ValueError):
        retrieve.retrieve_topk(one, queries, ["item"], top_k=0)
