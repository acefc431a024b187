"""Toxicity by weak supervision.

Voters are lexicons (a stated one, and words and word beginnings mined from labelled training rows, in groups of like strength) and
patterns; a known training label is one more voter, which abstains where there is none. A generative label model with a latent class
estimates how often each voter fires in either class, how pairs of voters correlate inside a class, and how often a label is
right, by expectation maximisation over counts of vote patterns. A linear classifier over lexicon hits, which scores every
document, learns from the label model's posterior of every row of its sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.words import lower_ascii
from evisift.session import pin

# The stated lexicon.
LEXICON = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "clown", "pathetic", "worthless", "disgusting",
    "imbecile", "vermin", "filth", "freak", "retard", "bastard", "bitch", "slut", "whore", "shit", "fuck", "asshole", "jerk",
)
PATTERNS = (rb"\byou(?:'re| are)\b", rb"[A-Z]{4,}\W+[A-Z]{4,}\W+[A-Z]{4,}", rb"!{2,}", rb"\bshut up\b", rb"\bhate\b")
LEXICON_VOTERS = 24
VOTERS = 1 + LEXICON_VOTERS + len(PATTERNS)
MINED_ITEMS = 4_096
PREFIX_BYTES = (4, 5)
SAMPLE_ROWS = 20_000
ROUNDS = 8
# How often labels are taken to be right at first, and for how many rows of each class that counts beside the observed ones.
LABEL_ACCURACY, LABEL_ROWS = 0.995, 1000.0
# Rows without a label that one with a label outweighs in the label model's counts, so that its classes stay those of the labels.
ANCHOR = 10.0
_COMPILED = [re.compile(p) for p in PATTERNS]
_EDGES = bytes(b for b in range(128) if not chr(b).isalnum())


def items(text: str | None) -> set[bytes]:
    """Lower-case words without marks at their edges, and the beginnings of longer ones, with a star."""
    words = {w.strip(_EDGES) for w in lower_ascii(text).split()}
    words.discard(b"")
    return words | {w[:n] + b"*" for w in words for n in PREFIX_BYTES if len(w) > n}


def _in_training(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) != 0, F.lit(False))


def mine(documents: DataFrame, labels: DataFrame, label: str, folds: int, rows: int) -> list[bytes]:
    """At most ``MINED_ITEMS`` items that tell toxic training rows, from at most ``rows`` labelled ones.

    An item stays if at most one of all items would be that one-sided by chance (Chernoff's bound on its toxic rows)."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col(label) > 0).cast("int").alias("_y")).dropna()
        .filter(_in_training(F.col("_id"), folds)).groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id", F.lit(31)), "_id").limit(rows)
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch["text"], batch["_y"], strict=True):
                for item in items(text):
                    found.setdefault(item, [0, 0])[y] += 1
        yield pd.DataFrame({
            "item": list(found), "clean": [c for c, _ in found.values()], "toxic": [t for _, t in found.values()],
        })

    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # at most ``rows`` ids are broadcast
    counts = texts.join(F.broadcast(chosen), "_id").mapInPandas(count, "item binary, clean long, toxic long")
    summed = pin(counts.groupBy("item").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-items")
    n, positive = chosen.agg(F.count("*"), F.sum("_y")).first()
    base = ((positive or 0) + 1) / (n + 2)
    kinds = summed.filter("clean + toxic >= 3").count()
    seen, share = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    odds = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    good = (seen >= 3) & (F.col("toxic") >= 4 * F.col("clean")) & (share > base) & (odds >= float(np.log(kinds + 1)))
    score = F.col("toxic") / (F.col("clean") + 1.0)
    return [bytes(r.item) for r in summed.filter(good).orderBy(score.desc(), "item").limit(MINED_ITEMS).collect()]


def hits(documents: DataFrame, mined: list[bytes]) -> DataFrame:
    """``doc_id, votes`` (a bit per voter) ``, hits`` (numbers of lexicon items and patterns) for every row."""
    number = {item: k for k, item in enumerate([*(w.encode() for w in LEXICON), *(m for m in mined if m.decode("utf-8", "replace") not in LEXICON)])}
    stated, size = len(LEXICON), len(number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = set(number)
        # mined items come in order of how well they tell, so a voter's items are alike in that
        voter = {item: 0 if n < stated else 1 + (n - stated) * LEXICON_VOTERS // (size - stated) for item, n in number.items()}
        for batch in batches:
            votes, found = [], []
            for text in batch["text"]:
                mine_ = items(text) & known
                raw = (text or "").encode("utf-8", "surrogatepass")
                fired = [k for k, pattern in enumerate(_COMPILED) if pattern.search(raw)]
                bits = 0
                for v in {voter[i] for i in mine_} | {1 + LEXICON_VOTERS + k for k in fired}:
                    bits |= 1 << v
                votes.append(bits)
                found.append(sorted([number[i] for i in mine_] + [size + k for k in fired]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "votes": np.array(votes, np.int64), "hits": found})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id long, votes long, hits array<int>")


class LabelModel:
    """Firing rates of every voter in both classes, the classes' shares, the voters' correlations inside a class, and
    ``labels[y, l]``, how often a row of class y with a label has the label l.

    A vote counts less by the votes beside it that it is correlated with, and silence by all of them."""

    def __init__(self) -> None:
        # at first every vote multiplies the odds by 12, and silence tells nothing
        self.fires, self.silent = np.full(VOTERS, np.log(12.0)), np.zeros(VOTERS)
        self.rates, self.prior = np.zeros((2, VOTERS)), 0.1
        self.correlation, self.damping = np.zeros((VOTERS, VOTERS)), np.ones(VOTERS)
        self.labels = np.array([[LABEL_ACCURACY, 1 - LABEL_ACCURACY], [1 - LABEL_ACCURACY, LABEL_ACCURACY]])

    def posterior(self, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """P(toxic) from the votes and the label, where one is known (not NaN)."""
        fired = _bits(votes)
        weight = np.where(fired, self.fires / (1 + fired @ self.correlation), self.silent / self.damping)
        says = np.log(self.labels[1] / self.labels[0])[np.nan_to_num(known).astype(int)]
        logit = np.log(self.prior / (1 - self.prior)) + weight.sum(axis=1) + np.where(np.isnan(known), 0.0, says)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    def update(self, moments: np.ndarray, labelled: np.ndarray, correlated: bool) -> None:
        """``moments[y]``: expected counts of pairs of firing voters in class y, with a last row and column for all rows;
        ``labelled[y, l]``: of rows with label l.
        While the classes are still mixed, correlation inside them means little, so it counts in later rounds only."""
        totals = moments[:, -1, -1]
        self.prior = float((totals[1] + 1) / (totals.sum() + 10))
        self.rates = (moments[:, -1, :-1] + [[0.1], [1.0]]) / (totals[:, None] + [[10.0], [4.0]])
        seen = labelled + LABEL_ROWS * self.labels
        self.labels = seen / seen.sum(axis=1, keepdims=True)
        clean, toxic = self.rates
        self.fires, self.silent = np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))
        if not correlated:
            return
        for y in (0, 1):
            p = self.rates[y]
            joint = moments[y, :-1, :-1] / max(totals[y], 1)
            spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
            correlation = (joint - np.outer(p, p)) / spread
            np.fill_diagonal(correlation, 0)
            self.correlation = np.maximum(self.correlation, np.clip(correlation, 0, 1))
        self.damping = 1 + self.correlation.sum(axis=1)


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS)) & 1


def fit_label_model(patterns: DataFrame) -> LabelModel:
    """EM over a pinned table of ``votes, known, n``; a round sums (voters + 1)**2 moments over all partitions."""
    model = LabelModel()
    for turn in range(ROUNDS):

        def moments(batches: Iterator[pd.DataFrame], now=model) -> Iterator[pd.DataFrame]:
            total, labelled = np.zeros((2, VOTERS + 1, VOTERS + 1)), np.zeros((2, 2))
            for batch in batches:
                votes = batch["votes"].to_numpy(dtype=np.int64)
                known, n = batch["known"].to_numpy(dtype=float), batch["n"].to_numpy(dtype=float)
                p = now.posterior(votes, known)
                n = n * np.where(np.isnan(known), 1.0, ANCHOR)
                x = np.column_stack([_bits(votes), np.ones(len(votes))]).astype(float)
                total[0] += x.T @ (x * (n * (1 - p))[:, None])
                total[1] += x.T @ (x * (n * p)[:, None])
                for label in (0, 1):
                    of = known == label
                    labelled[:, label] += (n[of] * (1 - p[of])).sum(), (n[of] * p[of]).sum()
            sums = np.concatenate([total.ravel(), labelled.ravel()])
            yield pd.DataFrame({"at": np.arange(len(sums)), "s": sums})

        rows = patterns.mapInPandas(moments, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
        total = np.zeros(2 * (VOTERS + 1) ** 2 + 4)
        total[rows["at"].to_numpy(dtype=int)] = rows["s"]
        after = LabelModel()
        after.update(total[:-4].reshape(2, VOTERS + 1, VOTERS + 1), total[-4:].reshape(2, 2), correlated=turn >= ROUNDS - 3)
        model = after
    return model


def fit_linear(found: list[np.ndarray], y: np.ndarray, size: int, l2: float = 1e-6, steps: int = 600) -> np.ndarray:
    """Logistic regression on soft labels over sparse 0/1 hits, by Adam; the last weight is the intercept."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    share = (y.sum() + 0.5) / (len(y) + 5)
    w[-1] = np.log(share / (1 - share))
    if not len(y):
        return w
    flat = np.concatenate([np.asarray(f, dtype=np.int64) for f in found])
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    for step in range(1, steps + 1):
        z = np.bincount(row, w[flat], len(found)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.append(np.bincount(flat, error[row], size), error.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def score_toxicity(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    Rows with ``crc32(doc_id) % folds = 0`` teach nothing. Items are mined, and the classifier is fitted, on at most
    ``sample_rows`` training rows each, labelled ones first; the label model counts all training rows. Null and empty texts hit nothing and get the
    intercept's score. A null id is neither held out nor learned from; an id labelled twice counts by its greatest label;
    repeated rows get equal scores; other columns are ignored; without labels the stated lexicon and the label model remain.
    """
    mined = mine(documents, labels, label, folds, sample_rows)
    rows = pin(hits(documents, mined), "toxicity-hits")
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col(label) > 0).cast("double").alias("known")).dropna()
    known = known.groupBy("_id").agg(F.max("known").alias("known"))
    taught = rows.filter(_in_training(F.col("doc_id"), folds)).join(known, F.col("doc_id") == F.col("_id"), "left")
    patterns = pin(taught.groupBy("votes", "known").agg(F.count("*").alias("n")), "toxicity-votes")
    model = fit_label_model(patterns)
    sample = taught.select("votes", "hits", "known").orderBy(
        F.col("known").isNull(), F.xxhash64("doc_id", F.lit(37)), "votes", "hits"
    ).limit(sample_rows).toPandas()
    y = model.posterior(sample["votes"].to_numpy(dtype=np.int64), sample["known"].to_numpy(dtype=float))
    size = len(LEXICON) + len([m for m in mined if m.decode("utf-8", "replace") not in LEXICON]) + len(PATTERNS)
    weights = fit_linear(list(sample["hits"]), y, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = np.array([weights[np.asarray(h, dtype=np.int64)].sum() for h in batch["hits"]]) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": score,
                "predicted": (score >= 0.5).astype("int32"),
            })

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    return rows.select("doc_id", "hits", held.alias("held_out")).mapInPandas(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
