import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from evisift.llm import hmm
from prose import text


def tokens(value):
    return (value or "").encode().lower().split() + [b" "]


def corpus():
    rows = [(k, text(k, 5 + k % 50).upper() if k % 9 == 0 else text(k, 5 + k % 50)) for k in range(150)]
    odd = [(500, None), (501, ""), (None, "word only without id"), (3, rows[3][1]), (3, rows[3][1]), (502, text(900, 9000)), (503, "same " * 400)]
    return rows + odd


@pytest.mark.parametrize("frequent", [40, 2**17])
def test_base_scores_equal_brute_force(documents, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "FREQUENT_WORDS", frequent)
    rows = corpus()
    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    c = Counter(w for d, t in rows if train(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[(d, d is not None and not train(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6))] += 1
    got = hmm.score_texts(documents(*rows)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def small_model(states=3, symbols=5):
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))))


def brute(model, text_):
    """Likelihood, and expected counts, summed over all paths of states."""
    states, total = range(len(model.start)), 0.0
    start, step, emit = np.zeros_like(model.start), np.zeros_like(model.step), np.zeros_like(model.emit)
    for path in itertools.product(states, repeat=len(text_)):
        p = model.start[path[0]] * model.emit[path[0], text_[0]]
        for a, b, s in zip(path, path[1:], text_[1:], strict=False):
            p *= model.step[a, b] * model.emit[b, s]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            step[a, b] += p
        for a, s in zip(path, text_, strict=True):
            emit[a, s] += p
    return math.log(total), start / total, step / total, emit / total


def test_recursions_equal_sums_over_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    monkeypatch.setattr(hmm, "SYMBOLS", 5)
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 8)
    model = small_model()
    texts = [np.array(t, dtype=np.uint16) for t in ([1, 2, 3, 0], [0], [4, 4, 1, 2, 3, 0], [2, 0], [1, 2, 3, 0])]
    want = [brute(model, t) for t in texts]
    assert np.allclose(hmm.log_likelihood(model, texts), [w[0] for w in want])
    for got, k in zip(hmm.expected_counts(model, texts), (1, 2, 3, 0), strict=True):
        assert np.allclose(got, sum(w[k] for w in want))


def test_rounds_over_partitions_raise_the_likelihood(documents, monkeypatch):
    rows = [(k, ("ba ne ti " if k % 2 else "xo yu wi ") * (4 + k % 7)) for k in range(200)]
    seen, real = [], hmm._round

    def spy(encoded, model):
        out = real(encoded, model)
        seen.append(out[1])
        return out

    monkeypatch.setattr(hmm, "_round", spy)
    got = hmm.score_texts(documents(*rows)).collect()
    full = seen[len(hmm.SHARES):]
    assert 2 <= len(full) <= hmm.FULL_ROUNDS and full == sorted(full) and full[-1] > seen[0] + 0.1
    held = [r for r in got if r.held_out]
    assert held and sum(r.score > r.base_score for r in held) > 0.95 * len(held)


def test_scores_are_a_distribution(documents):
    """All texts of at most one word, the unknown one included, have a total probability below one."""
    rows = [(k, w) for k, w in enumerate(["aa", "bb", "cc", "aa", "aa bb", ""] * 5)]
    got = {r.doc_id: r.score for r in hmm.score_texts(documents(*rows, (900, "aa"), (901, "bb"), (902, "cc"), (903, ""))).collect()}
    assert sum(10 ** got[k] for k in (900, 901, 902, 903)) < 1


def test_empty(documents):
    assert hmm.score_texts(documents()).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = hmm.score_texts(documents((held, "no training at all"))).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and math.isfinite(row.score)


def doubles(model, text_):
    """Expected counts of one text by both recursions, place by place in double precision."""
    alphas, scales, beta = [], [], np.ones(len(model.start))
    for t, s in enumerate(text_):
        now = (model.start if t == 0 else alphas[-1] @ model.step) * model.emit[:, s]
        scales.append(now.sum())
        alphas.append(now / now.sum())
    step, emit = np.zeros_like(model.step), np.zeros_like(model.emit)
    for t in range(len(text_) - 1, -1, -1):
        emit[:, text_[t]] += alphas[t] * beta
        if t:
            ahead = model.emit[:, text_[t]] * beta / scales[t]
            step += np.outer(alphas[t - 1], ahead) * model.step
            beta = model.step @ ahead
    return alphas[0] * beta, step, emit, np.log(scales).sum()


@pytest.mark.parametrize("tokens", [1, 500, 10**6])
def test_long_and_short_texts_go_over_their_own_tokens_only(monkeypatch, tokens):
    """A long text among short ones adds no padding; single precision holds over thousands of places."""
    monkeypatch.setattr(hmm, "STATES", 3)
    monkeypatch.setattr(hmm, "SYMBOLS", 5)
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", tokens)
    model, rng = small_model(), np.random.default_rng(4)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (3, 4000, 1, 250, 3, 249)]
    packed = list(hmm.chunks(texts, tokens))
    assert sum(len(symbols) for _, _, symbols in packed) == sum(map(len, texts))
    for numbers, cuts, symbols in packed:
        for column, i in enumerate(numbers):
            assert [symbols[cuts[t] + column] for t in range(len(texts[i]))] == texts[i].tolist()
    want = [doubles(model, t) for t in texts]
    assert np.allclose(hmm.log_likelihood(model, texts), [w[3] for w in want], rtol=1e-12)
    for got, k in zip(hmm.expected_counts(model, texts), range(4), strict=True):
        assert np.allclose(got, sum(w[k] for w in want), rtol=1e-4)


def test_a_round_over_a_share_has_its_share_of_tasks(documents, monkeypatch):
    seen, real = [], hmm._round
    monkeypatch.setattr(hmm, "_round", lambda encoded, model: seen.append((encoded.rdd.getNumPartitions(), encoded.count())) or real(encoded, model))
    rows = [(k, text(k, 20)) for k in range(640)]
    spark = documents(*rows).sparkSession
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # a task for each file
        for k in kept:
            spark.conf.set(k, "1m")
        assert hmm.score_texts(documents(*rows).repartition(32)).count() == len(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    full = seen[len(hmm.SHARES):]
    assert full and full[0][0] == 32
    for share, (tasks, texts) in zip(hmm.SHARES, seen, strict=False):
        assert tasks == 2 * share and 0 < texts < full[0][1] * share / 8
