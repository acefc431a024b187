from collections import Counter

import numpy as np
import pytest

from evisift.llm import decontaminate as dc
from prose import text, words

ITEMS = [(1, text(901, 20)), (2, text(902, 55)), (3, "Three short words"), (4, text(903, 20)), (5, None), (6, ""), (2, text(902, 55))]


def brute(value, item):
    """``(similarity, first word, words, windows that reach 0.8)`` of the best window, the first of equals. Windows have as many words
    as the item; a document shorter than the item is its only window."""
    have, want = (value or "").encode().lower().split(), item.encode().lower().split()
    size, words_in = min(5, len(want)), min(len(have), len(want))
    grams = lambda w: Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    wanted, scores = grams(want), []
    for at in range(len(have) - words_in + 1):
        mine = grams(have[at:at + words_in])
        scores.append(sum((mine & wanted).values()) / sum((mine | wanted).values()))
    best = max(scores, default=0)
    return best, scores.index(best) if scores else 0, words_in, sum(s >= 0.8 for s in scores)


def leaks_of(rows):
    """``(document, item, similarity, first word, words, windows)`` of every leak among ``rows``, with repeats."""
    out = Counter()
    for doc_id, value in rows:
        for item, wanted in dict(ITEMS).items():
            if wanted and (found := brute(value, wanted))[0] >= 0.8:
                out[(doc_id, item, round(found[0], 9), *found[1:])] += 1
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")


def docs():
    long_item = words(902, 55)
    changed = long_item[:3] + ["zzz"] + long_item[4:]
    far = long_item[:20] + ["zzz"] + long_item[21:40] + ["yyy"] + long_item[41:]
    return [
        (1, text(1, 300)), (2, f"{text(2, 100)} {text(901, 20).upper()}\n{text(3, 100)}"), (3, "intro " + " ".join(changed)),
        (4, "intro " + " ".join(far)), (5, "three SHORT words"), (6, None), (7, ""), (None, text(901, 20)),
        (8, text(901, 20)), (8, text(901, 20)), (9, f"{text(901, 20)} {text(902, 55)} {text(901, 20)}"),
        (10, " ".join(words(901, 20)[1:])), (11, text(5, 40_000) + " " + text(903, 20)),
    ]


def test_matches_equal_brute_force(documents, benchmark):
    rows = dc.find_leaks(documents(*docs()), benchmark).collect()
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.window_words, r.n_windows) for r in rows)
    assert got == leaks_of(docs())
    found = {key[0] for key in got}
    assert found >= {2, 3, 5, None, 8, 9, 10, 11} and not {1, 4, 6, 7} & found


def test_rows_that_stay(documents, benchmark):
    data = documents(*docs())
    kept = data.filter(dc.is_clean(data["text"], benchmark))
    assert kept.columns == data.columns
    leaks = {key[0] for key in leaks_of(docs())}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs() if d not in leaks)


def test_empty_tables(documents, benchmark, spark):
    none = spark.createDataFrame([], benchmark.schema)
    assert dc.find_leaks(documents(*docs()), none).count() == 0 and dc.find_leaks(documents(), benchmark).count() == 0
    data = documents((1, "a"))
    assert data.filter(dc.is_clean(data["text"], none)).count() == 1


def test_blocks_of_items(documents, benchmark, monkeypatch):
    whole = Counter(dc.find_leaks(documents(*docs()), benchmark).collect())
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 2)
    assert Counter(dc.find_leaks(documents(*docs()), benchmark).collect()) == whole


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, 40, dtype=np.uint64)
    tables = [dc._table(v, *block) for v, block in zip(dc._block_values(prints), dc.BLOCKS, strict=True)]
    assert sum(width for width, _ in dc.BLOCKS) == 64 and sum(radius + 1 for _, radius in dc.BLOCKS) > dc.RADIUS
    for _ in range(300):
        member = int(rng.integers(40))
        other = int(prints[member])
        for bit in rng.choice(64, rng.integers(0, dc.RADIUS + 1), replace=False):
            other ^= 1 << int(bit)
        blocks = dc._block_values(np.array([other], np.uint64))
        assert any(member in members[starts[v[0]]:starts[v[0] + 1]] for (starts, members), v in zip(tables, blocks, strict=True))


def test_index_of_many_items_is_small():
    items = [(k, [w.encode() for w in words(k, 50)]) for k in range(2000)]
    index = dc.Index(items)
    group = index.lengths[50]
    assert sum(x.nbytes for table in group.tables for x in table) < 40e6
    assert [m[:2] for m in index.matches(" ".join(w.decode() for w in items[77][1]))] == [(77, 0)]


def test_documents_shorter_than_an_item(documents, benchmark):
    """The whole document is the one window, as long as its words allow."""
    item, long_item = words(901, 20), words(902, 55)
    data = [(20, item[1:]), (21, item[:-3]), (22, item[:-4]), (23, long_item[:50]), (24, long_item[5:30]), (25, item[2:-1] + ["x"]), (26, ["three", "short"]), (27, item[:4])]
    rows = [(doc, " ".join(have)) for doc, have in data]
    table = documents(*rows)
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.window_words, r.n_windows) for r in dc.find_leaks(table, benchmark).collect())
    assert got == leaks_of(rows) and {key[0] for key in got} == {20, 21, 23}
    kept = table.filter(dc.is_clean(table["text"], benchmark)).collect()
    assert {r.doc_id for r in kept} == {22, 24, 25, 26, 27}
