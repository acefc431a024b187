from collections import Counter, defaultdict

import numpy as np
import pytest

from evisift.llm import resample
from prose import text


def corpus():
    good = [(k, text(k, 100 + k)) for k in range(120)]
    junk = [(200 + k, " ".join(w + "!!" for w in text(300 + k, 90).upper().split())) for k in range(40)]
    junk += [(300 + k, " ".join([text(400 + k, 3)] * 1 + [text(500 + k, 1)] * 90)) for k in range(40)]
    odd = [(500, None), (501, ""), (None, text(3, 60)), (1, good[1][1]), (1, good[1][1])]
    return good, junk, odd


def test_verdicts(documents, labels):
    good, junk, odd = corpus()
    docs = documents(*good, *junk, *odd)
    marks = labels(*[(k, 1, 0) for k in range(0, 120, 2)], *[(d, 0, 0) for d, _ in junk[::2]], (0, None, 0), (None, 1, 0))
    rows, verdict = resample.classify(docs, marks)
    got = rows.collect()
    assert len(got) == 205
    kept = defaultdict(set)
    for r in got:
        kept[r.doc_id].add(r.kept)
    assert sum(kept[k] == {True} for k in range(120)) >= 117
    assert not any(True in kept[d] for d, _ in junk)
    assert all(len(v) == 1 for v in kept.values())
    stays = docs.filter(verdict)
    assert stays.columns == docs.columns
    assert Counter(r.doc_id for r in stays.collect()) == Counter(r.doc_id for r in got if r.kept)
    again = resample.classify(docs.repartition(5), marks)[0].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_empty(documents, labels):
    assert resample.classify(documents(), labels())[0].count() == 0
    rows = resample.classify(documents((1, "a b"), (2, None), (3, "c")), labels())[0].collect()
    assert all(r.kept and r.log_weight == 0 for r in rows)


@pytest.mark.parametrize("values", [[1.0], [2.0] * 9, [0.1 * k for k in range(50)], [1e-300, 0.0, -1e300, 1e300, 5.0, 5.0], [1.0, np.nextafter(1, 2)] * 3])
def test_kth_greatest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").cache()
    for k in {1, 2, len(values) // 2, len(values)} - {0}:
        if k <= len(values):
            assert resample.kth_greatest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_weights_equal_brute_force(documents, labels):
    """The counts of both models, gram by gram, in one process."""
    good, junk, _ = corpus()
    docs = documents(*good, *junk)
    marks = labels(*[(k, 1, 0) for k in range(60)], *[(d, 0, 0) for d, _ in junk])
    codes, raw, target = resample._Codes(), np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for k, (_, value) in enumerate(good + junk):
        for gram in codes.grams(value):
            raw[gram] += 1
            target[gram] += k < 60
    ratio = resample.log_ratio(target, raw)
    got = {r.doc_id: r.log_weight for r in resample.classify(docs, marks)[0].collect()}
    for doc_id, value in good + junk:
        assert got[doc_id] == pytest.approx(sum(ratio[g] for g in codes.grams(value)))
