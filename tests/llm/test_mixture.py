import collections
import random

import pytest

from evisift.llm import mixture
from prose import text


def level(sizes):
    """Targets by sharing again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixture.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * share >= 2 * sizes[s]]
        if not above:
            return target | {s: weight[s] * share for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", None, "empty", ""]
    return [(k, text(k, rng.choice((3, 20, 60, 400 if k % 40 == 0 else 30))), rng.choice(names[:5] + ["a"] * 3)) for k in range(n)] + [
        (1000, None, "a"), (1001, "", "empty"), (1002, " \n", "empty"), (None, text(7, 9), "b"), (3, text(3, 20), "b"), (3, text(3, 20), "b"),
        (1003, text(8, 30), ""),
    ]


def check(rows, data):
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").encode().split())
    want, taken, largest = level(sizes), collections.Counter(), collections.Counter()
    assert len(rows) == len(data)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert r.size == 0 or r.copies in (int(r.target / r.source_size + 1e-9), int(r.target / r.source_size + 1e-9) + 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    units = collections.defaultdict(list)
    for r in rows:
        units[r.doc_id, r.source, r.size].append(r.copies)
    assert all(max(c) - min(c) <= 1 for c in units.values())
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_targets_and_totals(documents):
    data = corpus()
    rows = mixture.mix(documents(*data)).collect()
    check(rows, data)
    again = mixture.mix(documents(*reversed(data)).repartition(7)).collect()
    assert collections.Counter(rows) == collections.Counter(again)


def test_many_levels(documents, monkeypatch):
    monkeypatch.setattr(mixture, "FAN_IN", 3)
    data = [(k, "w " * (1 + k % 5), "one" if k % 3 else "two") for k in range(900)]
    check(mixture.mix(documents(*data)).collect(), data)


def test_expected_copies(documents):
    data = [(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(60)]
    docs = documents(*data).cache()
    seen = collections.Counter()
    for seed in range(12):
        for r in mixture.mix(docs, seed=1000 * seed).collect():
            seen[r.source] += r.copies / r.size * r.size
    rate = {s: t / z for s, t, z in {(r.source, r.target, r.source_size) for r in mixture.mix(docs).collect()}}
    for s, total in seen.items():
        assert total / (12 * 30) == pytest.approx(rate[s], abs=0.08)


def test_repeated_units(documents):
    """Rows without id and one row repeated are rounded row by row, not as one block; parts of the table don't matter."""
    data = [(None, "w " * 10, "a") for _ in range(300)] + [(5, "w " * 7, "b")] * 200 + [(k, "w " * (k % 9), "b") for k in range(100)]
    data += [(6, "w " * 300, "c")] * 30 + [(None, "w " * 50, None)] * 7 + [(k, text(k, 5), "c") for k in range(40)]
    for parts in (1, 6):
        rows = mixture.mix(documents(*data).repartition(parts)).collect()
        check(rows, data)
        taken = collections.Counter()
        for r in rows:
            taken[r.source] += r.taken
        targets = {r.source: r.target for r in rows}
        assert abs(taken["a"] - targets["a"]) <= 10 and abs(taken["b"] - targets["b"]) <= 9
    drawn = collections.Counter((r.doc_id, r.source) for r in mixture.draw(documents(*data).repartition(3)).collect())
    want = collections.Counter()
    for r in rows:
        want[r.doc_id, r.source] += r.copies
    assert drawn == +want


def test_clashing_names(documents):
    """Columns of documents named like the operator's own stay what they are."""
    data = documents(*corpus(4, 60)).selectExpr(
        "*", "1 as _llm_unit", "'u' as id", "'n' as n", "2 as least", "3 as extra", "4 as part", "5 as number", "6 as size", "7 as copies", "'d' as doc"
    )
    assert mixture.mix(data).count() == data.count()
    out = mixture.draw(data)
    assert out.columns == [*[c for c in data.columns if c != "copy"], "copy"]
    assert out.select("_llm_unit", "id", "n", "least", "extra", "part", "number", "size", "copies", "doc").distinct().collect() == [(1, "u", "n", 2, 3, 4, 5, 6, 7, "d")]


def test_very_long_text(documents):
    data = [(1, text(1, 200_000), "a"), (2, text(2, 30), "a"), (3, text(3, 30), "b")]
    check(mixture.mix(documents(*data)).collect(), data)


def test_draw(documents):
    data = corpus(2, 120)
    docs = documents(*data)
    taken = collections.Counter()
    for r in mixture.mix(docs).collect():
        taken[r.doc_id] += r.copies
    rows = mixture.draw(docs).collect()
    assert +taken == collections.Counter(r.doc_id for r in rows)
    assert set(docs.columns) == set(mixture.draw(docs).columns)


def test_empty_and_tiny(documents):
    assert mixture.mix(documents()).count() == 0
    assert mixture.draw(documents()).count() == 0
    assert [r.taken for r in mixture.mix(documents((1, "", "a"), (2, None, None))).collect()] == [0, 0]
