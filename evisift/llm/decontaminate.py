"""Benchmark decontamination by SimHash over windows as long as the benchmark items.

Every window that shares a shingle with an item of its length gets a 64-bit SimHash of its weighted shingles (windows that
share none have similarity zero, so leaving them out loses nothing). A document shorter than an item is one window as a
whole. Five blocks of bits index the items' fingerprints, each with a radius of its own. Two fingerprints that differ in more bits
than its radius in every block differ in more than ``RADIUS`` bits, so looking up each block among the values that near to an
item's block finds every fingerprint within the radius. A candidate is confirmed by its exact weighted similarity: the sum of the lesser over the sum of the greater shingle
counts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.words import lower_ascii, mix64

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# Windows of equal length with similarity 0.8 differ in 9.7 bits on average, in more than 23 with a probability of 2e-6.
# A whole document of 4 shingles against an item of 5 differs in more with 4e-4, of 5 against 6 with 2e-5, larger ones below 4e-6.
RADIUS = 23
# Bits and radius of each block; the radii, each plus one, add up to RADIUS + 1. 2,000 items of one length take 19 MB of tables.
BLOCKS = ((13, 4), (13, 4), (13, 4), (13, 4), (12, 3))
# Items are applied in lots of about so many items and bytes, which bound what is broadcast; one item is never split.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 8_000_000
STARTS_AT_ONCE = 4_096


def _near_values(width: int, radius: int) -> np.ndarray:
    """All differences of ``width`` bits with at most ``radius`` of them set."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)], np.int64)


def _block_values(prints: np.ndarray) -> list[np.ndarray]:
    """The value of each block of some fingerprints."""
    out, shift = [], 0
    for width, _ in BLOCKS:
        out.append(((prints >> np.uint64(shift)) & np.uint64(2**width - 1)).astype(np.int64))
        shift += width
    return out


def _table(values: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members near each value of a block: where the list of a value starts, and all lists in order of values."""
    near = (values[:, None] ^ _near_values(width, radius)).ravel()
    order = np.argsort(near, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(near, minlength=2**width))).astype(np.int32)
    return starts, (order // (len(near) // len(values))).astype(np.int32)


def shingle_codes(ids: np.ndarray, width: int) -> np.ndarray:
    """Digests of the windows of ``width`` word digests; 0 where a word's is 0, as it is in no item."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    code, known = np.full(n, width, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(width):
            code = mix64(code + ids[k:n + k])
            known &= ids[k:n + k] > 0
    return np.where(known, code | np.uint64(1), np.uint64(0))


def _digest(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1


def _bits(codes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each code."""
    raw = mix64(codes).astype(">u8").view(np.uint8).reshape(len(codes), 8)
    return np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64).ravel()


@dataclass
class _Length:
    """The items with one number of words."""

    items: list[int]
    prints: np.ndarray
    counts: list[Counter]
    tables: list[tuple[np.ndarray, np.ndarray]]
    holds: np.ndarray


class Index:
    """Word digests, item shingles and the multi-index of one block of items."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.digests: dict[bytes, int] = {}
        self.widths: dict[int, np.ndarray] = {}
        self.lengths: dict[int, _Length] = {}
        shingle_sets: dict[int, list[np.ndarray]] = {}
        grouped: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, words in items:
            ids = np.array([self.digests.setdefault(w, _digest(w)) for w in words], np.uint64)
            codes = shingle_codes(ids, min(SHINGLE_WORDS, len(ids)))
            grouped.setdefault(len(ids), []).append((item, codes))
            shingle_sets.setdefault(min(SHINGLE_WORDS, len(ids)), []).append(codes)
        self.widths = {width: np.unique(np.concatenate(codes)) for width, codes in shingle_sets.items()}
        for length, members in grouped.items():
            prints = np.concatenate([_fingerprints(_bits(codes).sum(axis=0, dtype=np.int64)[None]) for _, codes in members])
            tables = [_table(v, *block) for v, block in zip(_block_values(prints), BLOCKS, strict=True)]
            holds = np.isin(self.widths[min(SHINGLE_WORDS, length)], np.concatenate([codes for _, codes in members]))
            self.lengths[length] = _Length(
                [i for i, _ in members], prints, [Counter(codes.tolist()) for _, codes in members], tables, holds
            )

    def matches(self, text: str | None) -> list[tuple[int, int, int, float, int, int]]:
        """``(item, first word, words, similarity, differing bits, windows)`` of each item found in a whole text: its best
        window, the first of equals."""
        words = lower_ascii(text).split()
        ids = np.fromiter(map(self.digests.get, words, repeat(0)), np.uint64, len(words))
        found = []
        coded = {}
        for width, known in self.widths.items():
            codes = shingle_codes(ids, width)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hits = np.flatnonzero((codes > 0) & (known[at] == codes))
            coded[width] = (hits, at[hits], len(codes))
        for length, group in self.lengths.items():
            width = min(SHINGLE_WORDS, length)
            hits, which, n_codes = coded[width]
            hits = hits[group.holds[which]] if len(hits) else hits
            # a window's shingles over an item's are at least its similarity; only a short document has fewer
            if not len(hits) or n_codes < SIMILARITY * (length - width + 1):
                continue
            size = min(length, len(ids))
            inner = size - width + 1
            # windows that hold a hit, as a 0/1 mark over their first words
            marks = np.zeros(n_codes + 1, np.int64)
            np.add.at(marks, np.maximum(hits - inner + 1, 0), 1)
            np.add.at(marks, hits + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks)[: len(ids) - size + 1] > 0)
            best: dict[int, tuple[float, int, int]] = {}
            windows = Counter()
            for piece in _pieces(starts):
                first = int(piece[0])
                there = np.array([_digest(w) for w in words[first:int(piece[-1]) + size]], np.uint64)
                codes = shingle_codes(there, width)
                for start, member, bits in self._candidates(group, codes, piece, inner):
                    mine, counts = Counter(codes[start - first:start - first + inner].tolist()), group.counts[member]
                    low, high = sum((mine & counts).values()), sum((mine | counts).values())
                    if low >= SIMILARITY * high:
                        windows[member] += 1
                        key = (low / high, -start, bits)
                        best[member] = max(best.get(member, key), key)
            found += [
                (group.items[m], -start, size, score, bits, windows[m]) for m, (score, start, bits) in best.items()
            ]
        return found

    @staticmethod
    def _candidates(group: _Length, codes: np.ndarray, starts: np.ndarray, inner: int) -> Iterator[tuple[int, int, int]]:
        """Windows and items whose fingerprints are within the radius; ``codes`` begins at the first start."""
        total = np.zeros((len(codes) + 1, 64), np.int32)
        np.cumsum(_bits(codes), axis=0, out=total[1:])
        at = starts - starts[0]
        prints = _fingerprints(total[at + inner] - total[at])
        pairs = []
        for (table_starts, members), sought in zip(group.tables, _block_values(prints), strict=True):
            low, high = table_starts[sought], table_starts[sought + 1]
            rows = np.repeat(np.arange(len(sought)), high - low)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            found = members[np.repeat(low, high - low) + within]
            near = np.bitwise_count(prints[rows] ^ group.prints[found]) <= RADIUS
            pairs.append(rows[near] * len(group.items) + found[near])
        for pair in np.unique(np.concatenate(pairs)).tolist():
            row, member = divmod(pair, len(group.items))
            yield int(starts[row]), member, int(prints[row] ^ group.prints[member]).bit_count()


def _pieces(starts: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of nearby starts of bounded extent."""
    if len(starts):
        run = np.cumsum(np.diff(starts, prepend=starts[0]) > 64)
        for part in np.split(starts, np.flatnonzero(np.diff(run)) + 1):
            for at in range(0, len(part), STARTS_AT_ONCE):
                yield part[at:at + STARTS_AT_ONCE]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with words, about ``BLOCK_ITEMS`` or ``BLOCK_BYTES`` at once."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")
    ).filter("i is not null and t is not null").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for n in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n) if blocks > 1 else items
        rows = [(i, lower_ascii(t).split()) for i, t in mine.collect()]
        if rows := [row for row in rows if row[1]]:
            yield rows


class _Lot:
    """Items on their way to the tasks; a worker builds their index once."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, list[bytes]]]):
        self.number, self.shared = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def __eq__(self, other):
        return isinstance(other, _Lot) and self.number == other.number

    def __hash__(self):
        return hash(self.number)


@lru_cache(maxsize=2)
def _index(lot: _Lot) -> Index:
    return Index(lot.shared.value)


SCHEMA = (
    "doc_id long, item_id long, start_word long, window_words long, similarity double, hamming int, n_windows long"
)


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item that it holds: the best window, and how many reach the similarity.

    Letters A-Z count as lower case; an item of fewer than five words is one shingle; a document shorter than the item is its
    only window, with all its words. Null and empty texts and items match nothing; repeated documents give repeated rows,
    repeated items one, ids may be null in ``documents``; empty tables give no rows; other columns are ignored. The
    benchmark is a stated query set: it goes over all documents in blocks.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark):
        shared = _Lot(documents.sparkSession, items)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = _index(shared)
            for batch in batches:
                rows = [
                    (doc, *match) for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True)
                    for match in index.matches(text)
                ]
                names = [part.split()[0] for part in SCHEMA.split(", ")]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "hamming": "int32"})

        part = texts.mapInPandas(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], SCHEMA)


def is_clean(text: Column, benchmark: DataFrame) -> Column:
    """True for a text that holds no benchmark item."""
    clean = F.lit(True)
    for items in _blocks(benchmark):
        clean = clean & _holds_none(_Lot(benchmark.sparkSession, items))(text)
    return clean


def _holds_none(shared):
    @F.pandas_udf("boolean")
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(shared)
        for texts in batches:
            yield pd.Series([not index.matches(t) for t in texts], dtype=bool)

    return free
