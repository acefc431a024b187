"""Gradient-boosted trees over document statistics, for quality rules.

Trees are grown by histograms on a bounded sample of labelled documents, with monotonic constraints on chosen
statistics, and flattened into numpy node arrays that score a batch of documents level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm.words import split_words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistics of the model. The sign states the constraint: with -1 the verdict never rises as the statistic does.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 0,
    "upper_letters": 0, "bangs_per_word": -1, "digits": 0, "pipes_per_word": -1, "same_as_before": -1, "stops": 0,
}
SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 20_000


def repeated_words(ids: np.ndarray, size: int = 3) -> int:
    """Words inside a window of ``size`` words that occurs twice or more, its first occurrence included."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    keys = ids[:n]
    for k in range(1, size):
        # numbering the distinct prefixes keeps the key below rows squared, so it is exact
        keys = np.unique(keys, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[k:n + k]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the model's statistics of one whole text."""
    words, raw = split_words(text), (text or "").encode("utf-8", "surrogatepass")
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    at = np.frombuffer(raw, np.uint8)
    counts = np.bincount(at, minlength=256)
    points = len(at) - int(counts[0x80:0xC0].sum())
    spaces = int(counts[0x20] + counts[0x09:0x0E].sum())
    symbols = int(counts[list(SYMBOLS)].sum())
    lines = [line for line in raw.split(b"\n") if line.split()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    per = max(n, 1)
    same = int((ids[1:] == ids[:-1]).sum())
    return [n, points - spaces, symbols, dup, repeats], [
        float(np.log1p(n)), (points - spaces) / per, symbols / per, dup / max(len(lines), 1), repeats / per,
        len(numbers) / per, upper / max(upper + lower, 1), int(counts[33]) / per, int(counts[48:58].sum()) / max(points, 1),
        int(counts[124]) / per, same / per, int(counts[46]) / per,
    ]


@dataclass
class Forest:
    """Nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_forest(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 64, l2: float = 1.0, least_rows: int = 10,
) -> Forest:
    """Boost log loss. ``signs`` holds -1, 0 or 1 per statistic: its direction, which no split may contradict.

    A split on a constrained statistic is taken only with ordered child values, and their middle bounds all values
    deeper on either side, so each tree, and their sum, is monotonic. With no rows, or one class, every score is that
    class's smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    nodes: list[list[float]] = []
    roots: list[int] = []
    start = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
        coded = np.column_stack([np.searchsorted(edges[f], x[:, f]) for f in range(x.shape[1])])
        margin = np.full(len(y), start)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = gradient[rows], hessian[rows]
            value = float(np.clip(g.sum() / (h.sum() + l2), low, high))
            here = len(nodes)
            nodes.append([0, np.inf, here, here, rate * value])
            margin[rows] += rate * value if level == depth else 0
            best = None
            for f, sign in enumerate(signs) if level < depth and len(rows) >= 2 * least_rows else ():
                size = len(edges[f]) + 1
                gs, hs, ns = (np.bincount(coded[rows, f], w, size).cumsum()[:-1] for w in (g, h, np.ones(len(rows))))
                vl = np.clip(gs / (hs + l2), low, high)
                vr = np.clip((g.sum() - gs) / (h.sum() - hs + l2), low, high)
                gain = vl * gs - vl**2 * (hs + l2) / 2 + vr * (g.sum() - gs) - vr**2 * (h.sum() - hs + l2) / 2
                gain -= value * g.sum() - value**2 * (h.sum() + l2) / 2
                gain[(ns < least_rows) | (len(rows) - ns < least_rows) | (sign * (vr - vl) < 0)] = -np.inf
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                    cut = int(gain.argmax())
                    best = (gain[cut], f, cut, float(vl[cut]), float(vr[cut]))
            if best is None:
                margin[rows] += rate * value if level < depth else 0
                return here
            _, f, cut, vl, vr = best
            middle, sign = (vl + vr) / 2, signs[f]
            left_bounds = (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high)
            right_bounds = (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high)
            goes_left = coded[rows, f] <= cut
            a = grow(rows[goes_left], level + 1, *left_bounds)
            b = grow(rows[~goes_left], level + 1, *right_bounds)
            nodes[here] = [f, float(edges[f][cut]), a, b, 0.0]
            return here

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = y - p, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    return Forest(
        flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4],
        np.array(roots, dtype=int), depth, start,
    )


_NAMES = [*BASE, *FEATURES]
_FIELDS = ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in FEATURES])


def _stats_frame(batch: pd.DataFrame) -> pd.DataFrame:
    rows = [statistics(text) for text in batch["text"]]
    out = pd.DataFrame([a + b for a, b in rows], columns=_NAMES)
    return out.astype({name: "int64" for name in BASE} | {name: "float64" for name in FEATURES})


def labelled_statistics(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> pd.DataFrame:
    """Statistics and labels of at most ``rows`` labelled documents, chosen by a hash of their id."""
    spread = F.xxhash64(F.col("_id"), F.lit(17))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
        .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(spread, "_id").limit(rows)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _stats_frame(batch).assign(_id=batch["_id"].to_numpy(), _y=batch["_y"].to_numpy())

    # at most ``rows`` ids of 16 bytes are broadcast
    found = texts.join(F.broadcast(chosen), "_id").mapInPandas(run, f"{_FIELDS}, _id long, _y double")
    return found.orderBy(spread, "_id", *_NAMES).limit(rows).toPandas()


def quality_rules(
    documents: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
    threshold: float = 0.5,
) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``probability`` and ``kept`` for every document.

    The trees learn from at most ``sample_rows`` labelled documents; every document is scored on its whole text.
    Null and empty texts have no words and fail. Repeated rows are judged one by one, a null ``doc_id`` is kept as
    null, an id labelled twice counts by its greatest label, other columns are ignored, and without labels the verdict
    is that of the base rules alone.
    """
    sample = labelled_statistics(documents, labels, label, sample_rows)
    y = (sample["_y"].to_numpy(dtype=float) > 0).astype(float)
    forest = fit_forest(sample[list(FEATURES)].to_numpy(dtype=float), y, list(FEATURES.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = _stats_frame(batch)
            failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
            probability = forest.probability(stats[list(FEATURES)].to_numpy(dtype=float))
            yield stats[list(BASE)].assign(
                doc_id=batch["doc_id"], base_failed=failed, kept=~failed & (probability >= threshold), probability=probability
            )[["doc_id", *BASE, "base_failed", "kept", "probability"]].astype({"doc_id": "Int64"})

    counts = ", ".join(f"{c} long" for c in BASE)
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInPandas(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, probability double")
