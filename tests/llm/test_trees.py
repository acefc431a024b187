import collections
import re

import numpy as np
import pytest

from evisift.llm import trees
from prose import text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(value):
    found = WORD.findall(value or "")
    windows = collections.Counter(tuple(found[i:i + 3]) for i in range(len(found) - 2))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in (value or "").split("\n") if WORD.search(line)]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return [len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in value or ""), dup, len(covered)]


CASES = [
    None, "", " \n\t ", "a", "a b a b a b", "x y z x y z x y", "línea é\nlínea é\n\n \nlínea é\r", "## $5 | <b>&", "a\x0bb\x1cc d",
    text(1, 400) + "\n" + text(1, 400), "w " * 3000,
]


@pytest.mark.parametrize("value", CASES)
def test_base_counts_equal_brute_force(value):
    assert trees.statistics(value)[0] == brute(value)


def test_rows_and_cases(spark, documents, labels):
    good = [(k, text(k, 80 + k)) for k in range(60)]
    junk = [(100 + k, " ".join(w + "!!" for w in text(200 + k, 90).upper().split())) for k in range(60)]
    odd = [(500, None), (501, ""), (None, text(3, 60)), (1, good[1][1]), (1, good[1][1])]
    docs = documents(*good, *junk, *odd)
    marks = labels(*[(k, 1, 0) for k in range(0, 60, 2)], *[(100 + k, 0, 0) for k in range(0, 60, 2)], (0, None, 0), (None, 1, 0), (0, 1, 0))
    rows = trees.quality_rules(docs, marks).collect()
    assert len(rows) == 125
    by_id = collections.defaultdict(list)
    for row in rows:
        by_id[row.doc_id].append(row)
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert not (row.base_failed and row.kept)
    assert all(by_id[k][0].kept for k in range(60)) and not any(by_id[100 + k][0].kept for k in range(60))
    assert len(by_id[1]) == 3 and len({r.probability for r in by_id[1]}) == 1
    assert by_id[500][0].base_failed and by_id[None][0].n_words == 60


def test_empty_tables(documents, labels):
    assert trees.quality_rules(documents(), labels()).count() == 0
    assert trees.quality_rules(documents((1, text(1, 60))), labels()).first().kept


def test_forest_obeys_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    y = ((x[:, 0] + 0.4 * rng.random(2000) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    forest = trees.fit_forest(x, y, [1, -1])
    grid = np.linspace(0, 1, 60)
    for fixed in (0.1, 0.5, 0.95):
        up = forest.margin(np.column_stack([grid, np.full(60, fixed)]))
        down = forest.margin(np.column_stack([np.full(60, fixed), grid]))
        assert (np.diff(up) >= -1e-9).all() and (np.diff(down) <= 1e-9).all()
    assert ((forest.probability(x) > 0.5) == (y > 0)).mean() > 0.8


def test_flat_arrays_equal_walking_each_tree():
    rng = np.random.default_rng(2)
    x = rng.random((300, 3))
    forest = trees.fit_forest(x, (x[:, 0] > x[:, 1]).astype(float), [0, 0, 0], trees=5)
    for row, margin in zip(x, forest.margin(x), strict=True):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(total - margin) < 1e-9
