"""Hidden Markov language model.

Symbols are the end of a text, the most frequent training words, and classes of all other words by their last bytes. Start,
transition and emission counts of the forward and backward recursions (Baum-Welch) are summed over the partitions of
the whole training corpus in every round. A text's score is its exact likelihood by the scaled forward recursion,
times the share of each rarer word in its class; those shares come from a join with the counts of all words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.resample import kth_greatest
from evisift.llm.words import lower_ascii
from evisift.session import pin

STATES = 8
# Words with a symbol of their own; with the end and the classes all symbols fit 16 bits.
SYMBOL_WORDS = 8_192
CLASSES = 64
SYMBOLS = 1 + SYMBOL_WORDS + CLASSES
# Words whose counts every task holds; the counts of all others come from a join.
FREQUENT_WORDS = 2**17
# Parts of 16 of the training corpus that the rounds of Baum-Welch read: the states form on growing shares, then on all texts, at
# most ``FULL_ROUNDS`` times, until the likelihood of a token rises by less than ``LEAST_RISE``.
SHARES, SLICES = (1,) * 8 + (2,) * 4 + (4, 4), 16
FULL_ROUNDS, LEAST_RISE = 3, 1e-3
# Tokens of the texts that a recursion goes over together; a longer text is one such chunk.
CHUNK_TOKENS = 800_000
COUNTER_WORDS = 300_000


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def from_counts(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        """Probabilities from expected counts; the emissions of all states together smooth each state's."""
        share = (emit.sum(axis=0) + 0.01) / (emit.sum() + 0.01 * emit.shape[1])
        start, step = start + 0.1, step + 0.1
        emit = emit + 20 * share
        return cls(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def random(cls, counts: np.ndarray) -> Model:
        """Sticky states whose emissions are the symbols' counts, each disturbed at random."""
        rng = np.random.default_rng(7)
        return cls.from_counts(
            np.ones(STATES), 40 * np.eye(STATES) + 1, (counts + 0.01) * rng.gamma(2.0, 0.5, (STATES, SYMBOLS))
        )


def chunks(texts: list[np.ndarray], tokens: int) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """``(numbers, cuts, symbols)`` of texts of like length, the longest first in each chunk.

    Symbols go by place: those at place ``t`` of all texts that reach it are ``symbols[cuts[t]:cuts[t + 1]]``, in the order of ``numbers``.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    total = np.append(0, np.cumsum(sizes))
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, total[at] + tokens, side="right")) - 1)
        mine, lengths = order[at:end], sizes[at:end]
        active = len(mine) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        cuts = np.append(0, np.cumsum(active))
        flat = np.concatenate([texts[i] for i in mine])
        place = np.arange(len(flat)) - np.repeat(total[at:end] - total[at], lengths)
        symbols = np.empty_like(flat)
        symbols[cuts[place] + np.repeat(np.arange(len(mine)), lengths)] = flat
        yield mine, cuts.tolist(), symbols
        at = end


def _forward(model: Model, cuts: list[int], symbols: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The scaled state of every token, in ``kind`` of precision, and its scale."""
    alphas = np.take(np.ascontiguousarray(model.emit.T, kind), symbols, axis=0)
    scales, step, ones = np.empty(len(symbols), kind), model.step.astype(kind), np.ones(STATES, kind)
    room, now = np.empty((cuts[1], STATES), kind), None
    for t, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
        ahead = np.matmul(now[:e - s], step, out=room[:e - s]) if t else model.start.astype(kind)
        now = alphas[s:e]
        now *= ahead
        now /= np.matmul(now, ones, out=scales[s:e])[:, None]
    return alphas, scales


def log_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each text by the scaled forward recursion."""
    out = np.zeros(len(texts))
    for numbers, cuts, symbols in chunks(texts, CHUNK_TOKENS):
        logs, total = np.log(_forward(model, cuts, symbols, np.float64)[1]), np.zeros(len(numbers))
        for s, e in zip(cuts, cuts[1:], strict=False):
            total[:e - s] += logs[s:e]
        out[numbers] = total
    return out


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions over some texts, and their log likelihood; states are kept in single precision."""
    likelihood = 0.0
    start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    by_symbol, back = np.ascontiguousarray(model.emit.T, np.float32), np.ascontiguousarray(model.step.T, np.float32)
    for _, cuts, symbols in chunks(texts, CHUNK_TOKENS):
        alphas, scales = _forward(model, cuts, symbols, np.float32)
        likelihood += float(np.log(scales).sum(dtype=float))
        np.reciprocal(scales, out=scales)
        beta, room = np.ones((2, cuts[1], STATES), np.float32)
        m = 0
        for t in range(len(cuts) - 2, -1, -1):
            s, e = cuts[t], cuts[t + 1]
            now = alphas[s:e]
            if m:
                step += model.step * (now[:m].T @ ahead)
                np.matmul(ahead, back, out=beta[:m])
            m = e - s
            if t:
                ahead = np.take(by_symbol, symbols[s:e], axis=0, out=room[:m], mode="clip")
                ahead *= beta[:m]
                ahead *= scales[s:e, None]
            now *= beta[:m]
        start += alphas[:cuts[1]].sum(axis=0)
        for k in range(STATES):
            emit[k] += np.bincount(symbols, alphas[:, k], SYMBOLS)
    return start, step, emit, likelihood


def _trains(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) != held, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` over all texts; a task hands on its counts whenever they fill its bounded table."""

    def frame(counter: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": list(counter), "n": np.fromiter(counter.values(), np.int64, len(counter))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counter.update(lower_ascii(text).split())
                if len(counter) >= COUNTER_WORDS:
                    yield frame(counter)
                    counter.clear()
        yield frame(counter)

    return texts.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """What every task holds of the training counts: totals, frequent words, class sizes."""

    tokens: int
    distinct: int
    ends: int
    frequent: list[tuple[bytes, int]]
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def symbol_counts(self) -> np.ndarray:
        """Training tokens of each symbol: the end, words with symbols of their own, classes."""
        own = [c for _, c in self.frequent[:SYMBOL_WORDS]]
        return np.concatenate([[self.ends], own, np.zeros(SYMBOL_WORDS - len(own)), self.class_tokens]).astype(float)


    @cached_property
    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the frequent words; by number (0 is the end) its symbol and the parts of both scores. A worker makes them once."""
        number = {word: k for k, (word, _) in enumerate(self.frequent, 1)}
        counts = np.array([self.ends, *(c for _, c in self.frequent)], dtype=float)
        # a number's symbol: its own up to SYMBOL_WORDS, else its class
        symbol = np.arange(len(counts))
        classes = np.array([0, *(word_class(w) for w, _ in self.frequent)])
        in_class = symbol > SYMBOL_WORDS
        symbol[in_class] = 1 + SYMBOL_WORDS + classes[in_class]
        base = np.log10((counts + 1) / (self.tokens + self.distinct + 1))
        rest = np.zeros(len(counts))
        totals = self.class_tokens + self.class_words + 1
        rest[in_class] = np.log10((counts[in_class] + 1) / totals[classes[in_class]])
        return number, symbol, base, rest


def build_lexicon(words: DataFrame, ends: int) -> Lexicon:
    """From a pinned table of ``word, c``. The driver holds at most ``FREQUENT_WORDS`` words and ``CLASSES`` rows.

    The least count of a frequent word is found first, so tasks send those words only, not a list of their own each;
    words that tie with the first one left out are left out too.
    """
    top = words
    if words.count() > FREQUENT_WORDS:
        counts = words.select(F.col("c").cast("double").alias("c"))
        top = words.filter(F.col("c") > kth_greatest(counts, "c", FREQUENT_WORDS + 1))
    frequent = sorted(((bytes(r.word), r.c) for r in top.collect()), key=lambda x: (-x[1], x[0]))
    of_class = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(CLASSES)).cast("int")
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, v in words.groupBy(of_class.alias("k")).agg(F.sum("c"), F.count("*")).collect():
        tokens[k], distinct[k] = n, v
    total, kinds = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    # words with symbols of their own are in no class
    for word, c in frequent[:SYMBOL_WORDS]:
        tokens[word_class(word)] -= c
        distinct[word_class(word)] -= 1
    return Lexicon(total, kinds, ends, frequent, tokens, distinct)


ENCODED = (
    "doc_id long, trains boolean, held_out boolean, n_tokens long, n_known long, base double, rest double, symbols binary, "
    "rare array<binary>, times array<int>"
)


class _Endings(dict):
    """Symbol of the class of words by their last two bytes, of which there are few."""

    def __missing__(self, last: bytes) -> int:
        self[last] = symbol = 1 + SYMBOL_WORDS + word_class(last)
        return symbol


def encode(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Symbols of each text, the parts of its scores that frequent words settle, and its rarer words with their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        number, symbol, base, rest = held.tables
        ending = _Endings()
        for batch in batches:
            rows = []
            for doc_id, trains, out, text in zip(
                batch["doc_id"].astype("Int64"), batch["trains"], batch["held_out"], batch["text"], strict=True
            ):
                words = lower_ascii(text).split()
                ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                ids = np.append(ids, 0)
                missing = np.flatnonzero(ids < 0)
                known = ids[ids >= 0]
                symbols = symbol[np.maximum(ids, 0)]
                unlisted = [words[at] for at in missing.tolist()]
                rare = Counter(unlisted)
                if rare:
                    symbols[missing] = [ending[word[-2:]] for word in unlisted]
                rows.append((
                    doc_id, trains, out, len(ids), len(known) - (held.ends == 0), base[known].sum(), rest[known].sum(),
                    symbols.astype("<u2").tobytes(), list(rare), list(rare.values()),
                ))
            names = [part.split()[0] for part in ENCODED.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return texts.mapInPandas(run, ENCODED)


def _symbols(batch: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(raw, "<u2") for raw in batch["symbols"]]


def train(encoded: DataFrame, counts: np.ndarray) -> Model:
    """Baum-Welch over a pinned table of ``slice, symbols``, from the training counts of all symbols; ``slice`` is below ``SLICES``."""
    model, partitions = Model.random(counts), encoded.rdd.getNumPartitions()
    for share in SHARES:
        # a task of a share goes over as many texts as one of a full round, as each walks its longest text and hands on all counts
        model = _round(encoded.filter(F.col("slice") < share).coalesce(max(1, -(-partitions * share // SLICES))), model)[0]
    before = -np.inf
    for _ in range(FULL_ROUNDS):
        model, likelihood = _round(encoded, model)
        if likelihood - before < LEAST_RISE:
            break
        before = likelihood
    return model


def _round(encoded: DataFrame, model: Model) -> tuple[Model, float]:
    """The next model, and the mean log likelihood of a token under this one; without texts the model stays."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    size = STATES * (1 + STATES + SYMBOLS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1)
        for batch in batches:
            *counts, likelihood = expected_counts(shared.value, _symbols(batch))
            total += np.concatenate([*[x.ravel() for x in counts], [likelihood]])
        used = np.flatnonzero(total)
        yield pd.DataFrame({"at": used, "s": total[used]})

    rows = encoded.select("symbols").mapInPandas(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros(size + 1)
    total[rows["at"].to_numpy(dtype=np.int64)] = rows["s"].to_numpy(dtype=float)
    start, step, emit, likelihood = np.split(total, [STATES, STATES * (1 + STATES), size])
    if not emit.any():
        return model, 0.0
    new = Model.from_counts(start, step.reshape(STATES, STATES), emit.reshape(STATES, SYMBOLS))
    return new, float(likelihood[0] / emit.sum())


def score_texts(documents: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``documents``.

    All rows but those with ``crc32(doc_id) % folds = held`` teach, repeats included. Null and empty texts are one end token.
    A null id is neither held out nor learned from. Long texts are read whole. Without training rows all counts are zero
    and the states know nothing. Other columns are ignored; an empty table gives no rows.
    """
    doc_id = F.col("doc_id").cast("long")
    texts = documents.select(
        doc_id.alias("doc_id"), _trains(doc_id, folds, held).alias("trains"),
        F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    teaching = texts.filter("trains")
    words = pin(count_words(teaching), "hmm-words")
    lexicon = build_lexicon(words, texts.select("trains").filter("trains").count())
    # the number of a row is a key once it is written
    slice_ = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SLICES)).cast("int")
    encoded = pin(encode(texts, lexicon).withColumns({"row": F.monotonically_increasing_id(), "slice": slice_}), "hmm-texts")
    model = train(encoded.filter("trains").select("slice", "symbols"), lexicon.symbol_counts)
    classes = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(CLASSES)).cast("int")
    totals = F.array(*[F.lit(float(x)) for x in lexicon.class_tokens + lexicon.class_words + 1])
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")
    )
    c = F.coalesce("c", F.lit(0))
    # the table of all words grows with the corpus, so it is never broadcast
    found = rare.join(words.hint("merge"), "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((c + 1) / float(lexicon.tokens + lexicon.distinct + 1))).alias("more_base"),
        F.sum(F.col("times") * F.log10((c + 1) / F.get(totals, classes))).alias("more_rest"),
    )
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="symbols").assign(
                forward=log_likelihood(shared.value, _symbols(batch)) / np.log(10)
            ).astype({"doc_id": "Int64"})

    columns = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rest"]
    scored = encoded.select(*columns, "symbols").mapInPandas(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rest double, forward double"
    )
    return scored.join(found.hint("merge"), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("forward") + F.col("rest") + F.coalesce("more_rest", F.lit(0.0))).alias("score"),
    )
