import random
from collections import Counter

import numpy as np
import pytest

from evisift.llm import components as cc
from evisift.llm import neardup
from prose import words


def shingles(value):
    found = (value or "").encode().lower().split()
    size = min(5, len(found))
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)} if found else set()


def brute(rows, percent):
    """Component of every row: rows are nodes, joined by links between texts and by equal ids."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            linked = both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
            if linked or rows[a][0] == rows[b][0]:
                up[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return Counter((d, len(s), least[root(k)], d == least[root(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    for base in range(8):
        text = words(base, rng.choice((12, 60, 200)))
        for _ in range(rng.choice((1, 5, 25))):
            copy = list(text)
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                copy[rng.randrange(len(copy))] = f"q{rng.randrange(10**6)}"
            rows.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in copy))
    rows += [rows[0], "\n".join(rows[0].split()), "one two", "ONE two", "one", None, "", " \t", None]
    ids = rng.sample(range(10_000), len(rows))
    out = list(zip(ids, rows, strict=True))
    return [*out, out[3], (out[5][0], "another text for an id that is there already")]


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(documents, percent):
    rows = corpus()
    got = Counter(map(tuple, neardup.near_duplicates(documents(*rows), percent).collect()))
    assert got == brute(rows, percent)


def test_small_blocks_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", 4)
    rows = corpus(4)
    assert Counter(map(tuple, neardup.near_duplicates(documents(*rows)).collect())) == brute(rows, 85)


def test_rows_without_id(documents):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (None, "only here in this one text"), (None, None), (7, "")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(documents(*rows)).collect()}
    assert got == {(None, 3): (5, False), (5, 3): (5, True), (None, 2): (None, True), (None, 0): (None, True), (7, 0): (7, True)}
    kept = neardup.keep_one(documents(*rows))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[1], rows[2], rows[3], rows[4]])


def test_one_row_of_each_group_stays(documents):
    rows = corpus()
    docs = documents(*rows)
    kept = neardup.keep_one(docs, 85)
    assert kept.columns == docs.columns
    want = {d for d, _, _, k in brute(rows, 85) if k}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty(documents):
    assert neardup.near_duplicates(documents()).count() == 0 and neardup.keep_one(documents()).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    orders = neardup._orders(4_000)
    for share in (0.5, 0.85, 0.95):
        common = rng.integers(0, 2**64, int(1000 * share), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**64, 1000 - len(common), dtype=np.uint64)]) for _ in "ab")
        equal = np.array([(neardup.registers(a, orders) == neardup.registers(b, orders)).sum()])
        true = len(common) / (2000 - len(common))
        assert abs(neardup.estimate(equal, 1000, np.array([1000]), 4_000)[0] - true) < 0.04


def test_register_is_zeros_and_mantissa():
    one = np.array([2**32], dtype=np.uint64) * np.uint64(0b1011 << 10)
    register = int(neardup.registers(one, np.array([1], dtype=np.uint32))[0])
    assert register >> 10 == 32 - 14 and register & 1023 == 0b0110000000


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 400)]
    rows = spark.createDataFrame([*path, *star, (5, 5), (7, None), (9, 8)], "u long, v long")
    got = {r.u: r.v for r in cc.components(rows, "test").collect()}
    assert got == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 400)}
