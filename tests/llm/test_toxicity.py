import zlib
from collections import defaultdict

import numpy as np

from evisift.llm import toxicity
from prose import words

BAD = ("idiot", "scum", "vrellik", "vrellos", "vrellan", "zuntara")


def corpus(n=600):
    rows, marks = [], []
    for k in range(n):
        found = words(k, 60)
        toxic = k % 5 == 2
        if toxic:
            found[10], found[30] = BAD[k % 6], BAD[(k + 3) % 6].upper() + "!"
        rows.append((k, " ".join(found)))
        if k % 4:
            marks.append((k, 1, int(toxic)))
    return rows, marks


def test_held_out_rows(documents, labels):
    rows, marks = corpus()
    odd = [(9000, None), (9001, ""), (None, "you idiot"), (7, rows[7][1]), (7, rows[7][1])]
    got = toxicity.score_toxicity(documents(*rows, *odd), labels(*marks, (1, 1, None), (None, 1, 1), (2, 1, 1))).collect()
    assert len(got) == 605
    hit = defaultdict(list)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < 9000:
            hit[r.doc_id % 5 == 2].append(r.predicted)
    assert np.mean(hit[True]) > 0.9 and np.mean(hit[False]) < 0.05
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}


def test_held_out_labels_teach_nothing(documents, labels):
    rows, marks = corpus(200)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in marks]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(documents(*rows), labels(*m)).collect()) for m in (marks, turned))
    assert a == b


def test_without_labels_and_empty(documents, labels):
    rows = [(k, " ".join(words(k, 30)) + (" you are a stupid idiot" if k % 3 == 0 else "")) for k in range(60)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(documents(*rows), labels()).collect()}
    assert min(got[k] for k in range(0, 60, 3)) > max(got[k] for k in range(1, 60, 3))
    assert toxicity.score_toxicity(documents(), labels()).count() == 0


def test_label_model_finds_rates_and_correlation(spark):
    """Counts drawn from a known model: good voters, a noisy one, and a copy of a voter, which must not count twice."""
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    rates = {0: (0.02, 0.8), 1: (0.03, 0.7), 2: (0.3, 0.3), 3: (0.02, 0.6)}
    fired = {v: np.where(y, rng.random(len(y)) < t, rng.random(len(y)) < c) for v, (c, t) in rates.items()}
    fired[4] = fired[0]
    votes = sum((f.astype(np.int64) << v) for v, f in fired.items())
    values, counts = np.unique(votes, return_counts=True)
    rows = spark.createDataFrame([(int(v), None, int(n)) for v, n in zip(values, counts, strict=True)], "votes long, known double, n long")
    model = toxicity.fit_label_model(rows)
    for v, (clean, toxic) in rates.items():
        assert abs(model.rates[0][v] - clean) < 0.06 and abs(model.rates[1][v] - toxic) < 0.12
    assert model.correlation[0, 4] > 0.8 and model.correlation[0, 3] < 0.3
    p = model.posterior(votes, np.full(len(votes), np.nan))
    assert ((p > 0.5) == y).mean() > 0.93


def plain_posterior(model, bits, known):
    """Bayes' rule over the voters one by one; a vote is damped by the votes beside it, silence by all voters."""
    odds = model.prior / (1 - model.prior)
    for v in range(toxicity.VOTERS):
        clean, toxic = model.rates[0][v], model.rates[1][v]
        if bits >> v & 1:
            beside = sum(model.correlation[u, v] for u in range(toxicity.VOTERS) if bits >> u & 1)
            odds *= (toxic / clean) ** (1 / (1 + beside))
        else:
            odds *= ((1 - toxic) / (1 - clean)) ** (1 / (1 + model.correlation[:, v].sum()))
    if known is not None:
        odds *= model.labels[1, known] / model.labels[0, known]
    return odds / (1 + odds)


def test_posteriors_reach_the_classifier(documents, labels, monkeypatch):
    """Brute force of posterior and score; the sample takes labelled rows first, and every row of it teaches its posterior."""
    rows, marks = corpus()
    training = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 5]
    sparse = training[::3]
    # some labels are wrong, which the votes can tell
    wrong = {d for d, _, t in sparse if t}
    wrong = set(sorted(wrong)[:3])
    given = [(d, q, 0 if d in wrong else t) for d, q, t in sparse]
    fits, models, real_fit, real_model = [], [], toxicity.fit_linear, toxicity.fit_label_model

    def spy_fit(found, y, size):
        fits.append((found, y, real_fit(found, y, size)))
        return fits[-1][2]

    def spy_model(patterns):
        models.append((real_model(patterns), patterns))
        return models[-1][0]

    monkeypatch.setattr(toxicity, "fit_linear", spy_fit)
    monkeypatch.setattr(toxicity, "fit_label_model", spy_model)
    got = toxicity.score_toxicity(documents(*rows), labels(*given), sample_rows=len(given) + 50).collect()
    (found, y, weights), (model, patterns) = fits[0], models[0]
    assert len(y) == len(given) + 50 and model.labels.min() > 0 and model.labels[0, 0] > 0.9
    for r in patterns.collect():
        known = None if r.known is None else int(r.known)
        got_p = model.posterior(np.array([r.votes]), np.array([np.nan if known is None else known]))[0]
        assert abs(got_p - plain_posterior(model, r.votes, known)) < 1e-9
    # no posterior is a bare label, and the wrong labels pull less than the right ones
    assert ((y > 0) & (y < 1)).all()
    scored = {r.doc_id: r.score for r in got}
    assert np.mean([scored[d] for d, _, t in marks if t]) > 0.7 and np.mean([scored[d] for d in wrong]) > 0.5
    for hits in found[:40]:
        z = sum(weights[h] for h in hits) + weights[-1]
        assert any(abs(1 / (1 + np.exp(-z)) - s) < 1e-9 for s in scored.values())
