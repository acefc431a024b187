"""Quality classifier by importance resampling.

Two generative models, bags of hashed n-grams, are fitted: one to the target (documents labelled good), one to the raw
corpus. A document's weight is the ratio of its likelihoods, and documents are drawn without replacement by Gumbel
top-k: each log weight gets Gumbel noise from a hash of the id, and the k greatest stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.words import mix64, split_words
from evisift.session import pin

# Hashed spaces: words and word pairs share one, pairs of word shapes have another.
WORD_BUCKETS = 2**16
SHAPE_BUCKETS = 2**12
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
SAMPLE_ROWS = 20_000
PRIOR = 100.0
THRESHOLD_BINS = 4_096
GRAMS_AT_ONCE = 1_000_000
_OTHER = bytes(range(128, 256))
_MARKS = b"#*$%&|<>!?\"'()[]{}:;,.-/\\+=@_~^`"


def _shape(word: bytes) -> int:
    """Case, last character, length and symbols of a word, as one small number."""
    letters = word.translate(None, _MARKS)
    case = 0 if letters.islower() else 1 if letters.isupper() and len(letters) > 1 else 2 if letters[:1].isupper() else 3
    last = word[-1:]
    end = b".,!?|".find(last) + 1 if last in b".,!?|" else 6 if last in b"#*$%&<>" else 7 if last.isdigit() else 0
    size = bisect_left((1, 3, 6, 10, 20), len(word))
    odd = len(word) - len(word.translate(None, b"#*$%&|<>!"))
    return ((case * 8 + end) * 6 + size) * 4 + min(odd, 3)


class _Codes(dict):
    """Word -> 54 bits of its digest above 10 bits of its shape, for as many words as fit ``limit`` entries."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word) >> 10 << 10 | _shape(word)
        return value

    def grams(self, text: str | None) -> np.ndarray:
        """Buckets of all n-grams of a whole text, repeats included."""
        words = split_words(text)
        if not words:
            return np.zeros(0, np.int64)
        if len(self) > self.limit:
            self.clear()
        coded = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        digest, shape = coded >> np.uint64(10), coded & np.uint64(1023)
        same = np.zeros(len(words), np.uint64)
        same[1:] = digest[1:] == digest[:-1]
        with np.errstate(over="ignore"):
            shape = shape * np.uint64(2) + same
            pairs = mix64(digest[:-1] * np.uint64(3) + digest[1:])
            forms = mix64(shape[:-1] * np.uint64(4096) + shape[1:])
        return np.concatenate([
            digest % np.uint64(WORD_BUCKETS), pairs % np.uint64(WORD_BUCKETS),
            WORD_BUCKETS + forms % np.uint64(SHAPE_BUCKETS), WORD_BUCKETS + mix64(shape) % np.uint64(SHAPE_BUCKETS),
        ]).astype(np.int64)


def gram_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: one sum per partition, then sums of sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, total, pending, size = _Codes(), np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                pending.append(codes.grams(text))
                size += len(pending[-1])
                if size > GRAMS_AT_ONCE:
                    total += np.bincount(np.concatenate(pending), minlength=BUCKETS)
                    pending, size = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    rows = texts.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models per bucket. The target model's prior is the raw model with ``PRIOR`` counts a bucket,
    so a bucket that the target sample is too small to judge has a ratio near one."""
    out = np.zeros(BUCKETS)
    for space in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        expected = raw[space] * (target[space].sum() / max(raw[space].sum(), 1))
        out[space] = np.log((target[space] + PRIOR) / (expected + PRIOR))
    return out


def fit(documents: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> tuple[np.ndarray, float]:
    """``(log ratio per bucket, share of good documents)``. The target is fitted on at most ``sample_rows`` labelled
    documents; the raw model counts all texts of ``documents``."""
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
        .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id", F.lit(23)), "_id").limit(sample_rows)
    )
    n, good = chosen.agg(F.count("*"), F.sum((F.col("_y") > 0).cast("long"))).first()
    # at most ``sample_rows`` ids are broadcast
    target = texts.join(F.broadcast(chosen.filter("_y > 0").select("_id")), "_id", "left_semi")
    raw = gram_counts(texts)
    ratio = log_ratio(gram_counts(target), raw) if good else np.zeros(BUCKETS)
    return ratio, ((good or 0) + 1) / (n + 1)


def log_weight(text: Column, ratio: np.ndarray, spark) -> Column:
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = _Codes()
        for texts in batches:
            yield pd.Series([float(shared.value[codes.grams(t)].sum()) for t in texts], dtype="float64")

    return weigh(text.cast("string"))


def gumbel(seed: int, *by: Column) -> Column:
    """Standard Gumbel noise that is a function of the given columns."""
    u = (F.shiftrightunsigned(F.xxhash64(*by, F.lit(seed)), 11).cast("double") + 0.5) / 2.0**53
    return -F.log(-F.log(u))


def kth_greatest(keys: DataFrame, column: str, k: int) -> float:
    """The exact k-th greatest value, by counting ever finer bins; each round brings ``THRESHOLD_BINS`` counts to the
    driver at most."""
    low, high, above = *keys.agg(F.min(column), F.max(column)).first(), 0
    while low < high:
        width = (high - low) / THRESHOLD_BINS
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(THRESHOLD_BINS - 1)) if width else F.lit(0)
        bins = (
            keys.filter(F.col(column).between(low, high)).groupBy(bin_.alias("b"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        )
        for row in sorted(bins, key=lambda r: -r["low"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if (row["low"], row["high"]) == (low, high):
            # neighbouring doubles: the greater one holds the place if enough rows have it
            return high if above + keys.filter(F.col(column) == high).count() >= k else low
        low, high = row["low"], row["high"]
    return low


def classify(
    documents: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 29,
) -> tuple[DataFrame, Column]:
    """``(scores, verdict)``: a row of scores per document, and the verdict as a column for ``documents`` itself.

    k is the expected number of good documents: the sum over all of ``min(1, share of good labels * weight)``. All rows
    whose key equals the k-th greatest stay, so repeated rows, and rows with one ``doc_id`` and weight, share a verdict. A
    text without words has weight 1. Null ids draw one noise value together. Without labels every weight is 1 and the
    first label share is 1, so all stay; an empty table gives no rows; other columns are ignored.
    """
    ratio, share = fit(documents, labels, label, sample_rows)
    spark = documents.sparkSession
    key = log_weight(F.col("text"), ratio, spark) + gumbel(seed, F.col("doc_id").cast("long"))
    rows = pin(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), log_weight(F.col("text"), ratio, spark).alias("log_weight")
        ), "resample",
    ).withColumn("key", F.col("log_weight") + gumbel(seed, F.col("doc_id")))
    n, expected = rows.agg(
        F.count("*"), F.sum(F.least(F.lit(1.0), F.lit(share) * F.exp(F.least("log_weight", F.lit(50.0)))))
    ).first()
    k = round(expected or 0)
    threshold = kth_greatest(rows, "key", k) if k else float("inf")
    return rows.withColumn("kept", F.col("key") >= threshold), key >= threshold
