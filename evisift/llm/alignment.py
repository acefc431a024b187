"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers cut one text, so the ends of their tokens in bytes are two ascending lists with the same last value. Offsets where
tokens of both end cut the text into groups. While tokens match one to one, both lists agree at a constant shift of
indices: widths of 1, 2, 4, ... ends are compared at that shift, then halved, which jumps the whole run. Where the lists
differ, the ends are followed one by one up to the next common one, which closes an irregular group and gives the new shift.
Texts are parted before spaces where tokens of both surely end. The distinct chunks of some texts that are not known yet are encoded
and walked as one text, and their links are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.llm.bpe import VocabularyFile, slices
from evisift.session import pin

# Pairs of ids whose counts every task holds; the counts of all others come from a join.
FREQUENT_PAIRS = 2**20
# Pairs that a counting task holds before it hands on its counts; rows that a task aligns or scores at once.
COUNTED_PAIRS, ALIGNED_CHARS, SCORED_ROWS = 1_000_000, 1_000_000, 1_000
# Chunks that a Python worker remembers and their characters; chunks that are encoded as one text.
KNOWN_CHUNKS, KNOWN_CHARS, CHUNKS_AT_ONCE = 400_000, 8_000_000, 256
# Patterns without a piece that holds a space behind anything but white space, and whose pieces do not depend on what is before them.
SPACE_FIRST = frozenset([public_tokenizers.PATTERN])
_BLANK, _GAP = re.compile(r"[^\S ] "), re.compile(r"(?<=\S) ")


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[bool]]:
    """``(i, j, n, whole)`` of each stretch of links: token ``i + k`` of a overlaps token ``j + k`` of b, for ``k`` below ``n``.

    ``a`` and ``b`` are strictly ascending ends with the same last value. A ``whole`` stretch is a run of one-to-one groups; the links
    of an irregular group are stretches of one link each, the first of which is marked by ``n = 1`` and the others by ``n = 0``.
    """
    at_a, at_b, size, whole, end = [], [], [], [], len(a)
    i = j = 0
    while i < end:
        if (x := a[i]) == (y := b[j]):
            n, width = 1, 1
            while (part := a[i + n:i + n + width]) and part == b[j + n:j + n + width]:
                n += len(part)
                width *= 2
            while width > 1:
                width //= 2
                part = a[i + n:i + n + width]
                if part and part == b[j + n:j + n + width]:
                    n += len(part)
            at_a.append(i)
            at_b.append(j)
            size.append(n)
            whole.append(True)
            i += n
            j += n
            continue
        at_a.append(i)
        at_b.append(j)
        size.append(1)
        whole.append(False)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            at_a.append(i)
            at_b.append(j)
            size.append(0)
            whole.append(False)
        i += 1
        j += 1
    return at_a, at_b, size, whole


def links_of(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(token of a, token of b, group)`` of every link, in order."""
    at_a, at_b, size, whole = (np.array(x, dtype=np.int64) for x in align(a, b))
    times = np.maximum(size, 1)
    within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    # every link of a run opens a group, of an irregular group the first one
    opens = np.where(np.repeat(whole, times) > 0, 1, np.repeat(size, times))
    return np.repeat(at_a, times) + within, np.repeat(at_b, times) + within, np.cumsum(opens) - 1


class PieceModel:
    """A sentence-piece model; it ``cuts`` if it never joins a space to what stands before it."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Packed ids of each non-empty text, None where their bytes are not a space and the text."""
        out = []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
            same = b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode("utf-8", "surrogatepass")
            out.append(np.array(ids, "<u4").tobytes() if same else None)
        return out


class PieceFile:
    """A sentence-piece model file, read once by the driver and sent to the tasks."""

    def __init__(self, spark: SparkSession, path: str):
        data = Path(path).read_bytes()
        self.digest = hash(data)
        self.shared = spark.sparkContext.broadcast(data)

    def __eq__(self, other):
        return isinstance(other, PieceFile) and self.digest == other.digest

    def __hash__(self):
        return self.digest

    def model(self) -> PieceModel:
        return _model(self)


@lru_cache(maxsize=2)
def _model(file: PieceFile) -> PieceModel:
    return PieceModel(file.shared.value)


class Aligner:
    """Aligns texts chunk by chunk where tokens of both sides surely end; remembers the links of a bounded number of chunks."""

    def __init__(self, a: VocabularyFile, pattern: str, b: PieceFile):
        self.a, self.b = a.codec(pattern), b.model()
        tokens = self.a.vocabulary.tokens
        self.a_bytes = np.array([len(tokens.get(k, b"")) for k in range(max(tokens) + 1)])
        self.b_bytes = np.array([len(x) for x in self.b.bytes])
        if max(len(self.a_bytes), len(self.b_bytes)) > 2**16:
            raise ValueError("ids must be below 65536")
        # an id and what follows it: another id of its side, the other side, the next group
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{k}{mark}" for k in range(most) for mark in ",|;"]
        self.cuts = self.b.cuts and pattern in SPACE_FIRST
        self._forget()

    def _forget(self) -> None:
        # numbers of chunks; by number their groups' spelling, tokens of A and of B, groups, links, first link; all links in a row
        self.known: dict[str, int] = {}
        self.chars, self.groups, self.pairs = 0, [], np.zeros(0, np.uint32)
        self.sizes = np.zeros((4, 0), np.int64)
        self.first = np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """A text parted by single spaces where neither side has a token on both sides of the place before the space."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if "" not in parts and not _BLANK.search(text):
            return parts
        body = text.rstrip()
        parts = _GAP.split(body)
        parts[-1] += text[len(body):]
        return parts

    def rows(self, texts: list[str | None]) -> list[list]:
        """Columns ``n_a, n_b, n_groups, n_links, groups, pairs, times`` over the texts."""
        there = [k for k, t in enumerate(texts) if t]
        out = [[0] * len(texts) for _ in range(4)] + [[None] * len(texts), [b""] * len(texts), [b""] * len(texts)]
        cut = [self.chunks(texts[k]) for k in there]
        self._learn(set().union(*cut))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        ends = np.cumsum([len(x) for x in cut])
        if there:
            # a chunk without tokens is spelled otherwise, and so is its text
            spelled = np.minimum.reduceat(self.sizes[0, numbers], np.append(0, ends[:-1])) > 0
            numbers = numbers[np.repeat(spelled, np.diff(ends, prepend=0))]
            places = [k for k, same in zip(there, spelled.tolist(), strict=True) if same]
            for column, values in zip(out, self._columns(numbers, np.diff(ends, prepend=0)[spelled]), strict=True):
                for k, value in zip(places, values, strict=True):
                    column[k] = value
        return out

    def _columns(self, numbers: np.ndarray, n_chunks: np.ndarray) -> tuple:
        """Sums, spellings and counted pairs of texts that have so many chunks each."""
        if not len(numbers):
            return ((),) * 7
        ends = np.cumsum(n_chunks)
        sizes = np.add.reduceat(self.sizes[:, numbers], ends - n_chunks, axis=1)
        names = list(map(self.groups.__getitem__, numbers.tolist()))
        groups = ["".join(names[s:e])[:-1] for s, e in zip((ends - n_chunks).tolist(), ends.tolist(), strict=True)]
        n_links = self.sizes[3, numbers]
        at = np.arange(n_links.sum()) + np.repeat(self.first[numbers] - np.cumsum(n_links) + n_links, n_links)
        text = np.repeat(np.arange(len(n_chunks)), sizes[3])
        codes, times = np.unique(text << 32 | self.pairs[at], return_counts=True)
        cuts = np.searchsorted(codes, np.arange(len(n_chunks) + 1) << 32).tolist()
        raw, counted = (codes & 0xFFFFFFFF).astype("<u4").tobytes(), times.astype("<u4").tobytes()
        packed = [[x[4 * s:4 * e] for s, e in zip(cuts, cuts[1:], strict=False)] for x in (raw, counted)]
        return *sizes.tolist(), groups, *packed

    def _learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > KNOWN_CHUNKS or self.chars + sum(map(len, new)) > KNOWN_CHARS:
            self._forget()
            new = chunks
        if not new:
            return
        self.chars += sum(map(len, new))
        # chunks without white space at their ends are encoded together
        plain = [c for c in new if c.strip() == c] if self.cuts else []
        lots = [[c] for c in new.difference(plain)] + [plain[k:k + CHUNKS_AT_ONCE] for k in range(0, len(plain), CHUNKS_AT_ONCE)]
        spelled, unlike, a_packed, b_packed = [], [], [], []
        while lots:
            texts, again = [" ".join(lot) for lot in lots], []
            for lot, a_ids, b_ids in zip(lots, self.a.encode([" " + t for t in texts]), self.b.encode(texts), strict=True):
                if b_ids is not None:
                    spelled += lot
                    a_packed.append(a_ids)
                    b_packed.append(b_ids)
                elif len(lot) > 1:
                    again += [[c] for c in lot]
                else:
                    unlike += lot
            lots = again
        self.known.update(zip(spelled + unlike, range(len(self.known), len(self.known) + len(new)), strict=True))
        sizes, pairs = np.zeros((4, len(new)), np.int64), self.pairs[:0]
        if spelled:
            sizes[:, :len(spelled)], groups, pairs = self._aligned(spelled, b"".join(a_packed), b"".join(b_packed))
            self.groups += groups
        self.groups += [""] * len(unlike)
        self.first = np.append(self.first, len(self.pairs) + np.cumsum(sizes[3]) - sizes[3])
        self.sizes, self.pairs = np.hstack([self.sizes, sizes]), np.append(self.pairs, pairs)

    def _aligned(self, chunks: list[str], a_packed: bytes, b_packed: bytes) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Sizes, groups and links of chunks, which are aligned as one: each ends where tokens of both sides end."""
        a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in (a_packed, b_packed))
        bytes_a, bytes_b = np.cumsum(self.a_bytes[a]), np.cumsum(self.b_bytes[b])
        cuts = np.cumsum([1 + len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        n_a, n_b = (np.diff(np.searchsorted(x, cuts, "right"), prepend=0) for x in (bytes_a, bytes_b))
        left, right, group = links_of(bytes_a.tolist(), bytes_b.tolist())
        of_a = np.repeat(np.arange(len(n_a)), n_a)
        n_links = np.bincount(of_a[left], minlength=len(n_a))
        # the group of every token, from its first link, and its place in the spelling: tokens of A, then of B, group by group
        group_a, group_b = (group[np.flatnonzero(np.diff(x, prepend=-1))] for x in (left, right))
        n_groups = int(group[-1]) + 1
        ends_a, ends_b = (np.cumsum(np.bincount(x, minlength=n_groups)) for x in (group_a, group_b))
        spelling = np.empty(len(a) + len(b), np.int64)
        marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        marks_a[ends_a - 1], marks_b[ends_b - 1] = 1, 2
        spelling[np.arange(len(a)) + np.append(0, ends_b)[group_a]] = 3 * a + marks_a
        spelling[np.arange(len(b)) + ends_a[group_b]] = 3 * b + marks_b
        names = list(map(self.names.__getitem__, spelling.tolist()))
        ends = np.append(0, np.cumsum(n_a + n_b)).tolist()
        groups = ["".join(names[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
        of_chunk = np.bincount(of_a[np.append(0, ends_a[:-1])], minlength=len(n_a))
        return np.array([n_a, n_b, of_chunk, n_links]), groups, (a[left] << 16 | b[right]).astype(np.uint32)


@lru_cache(maxsize=2)
def _aligner(a: VocabularyFile, pattern: str, b: PieceFile) -> Aligner:
    return Aligner(a, pattern, b)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def align_texts(documents: DataFrame, a: VocabularyFile, pattern: str, b: PieceFile) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` for every row of ``documents``.

    ``groups`` lists the ids of each group, ``a1,a2|b1;a3|b2,b3``. ``pairs`` packs the distinct linked pairs as 32-bit integers, the id
    of A above that of B, and ``times`` how many links each has. A is a byte-level vocabulary applied to a space and the
    text, B a sentence-piece model applied to the text, which adds the space itself. Null and empty texts and those whose
    tokens don't spell a space and the text have zeros, null groups and no pairs; long texts are read whole; ids may be
    null and may repeat; an empty table gives no rows; other columns are ignored.
    """
    names = [part.split()[0] for part in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, pattern, b)
        for batch in batches:
            for part in slices(batch, "text", ALIGNED_CHARS):
                columns = aligner.rows(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names
                )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ALIGNED)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of packed ones, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """``pair, c, best``: the links of each pair over all texts, and whether no pair with its id of B has more.

    Tasks add up the pairs of their rows and hand on their counts whenever they fill a bounded table.
    """

    def merged(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kinds, place = np.unique(np.concatenate(pairs), return_inverse=True)
        return kinds, np.bincount(place, np.concatenate(times), len(kinds)).astype(np.int64)

    def frame(kinds: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                kinds, counts = merged([kinds, _unpacked(part["pairs"])[0]], [counts, _unpacked(part["times"])[0]])
                if len(kinds) > COUNTED_PAIRS:
                    yield frame(kinds, counts)
                    kinds, counts = kinds[:0], counts[:0]
        yield frame(kinds, counts)

    counts = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("c"))
    # an id of B has at most as many pairs as A has ids
    best = F.max("c").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFF)))
    return counts.withColumn("best", F.col("c") == best)


def _with_counts(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """``row``, the columns of ``aligned`` but its pairs, ``n_best`` and ``count_sum``; both tables are pinned, ``row`` is a key.

    The most frequent pairs are held by every task, at most ``FREQUENT_PAIRS``; a row's other pairs go to a join.
    """
    top = pairs
    if pairs.count() > FREQUENT_PAIRS:
        # counts are few distinct values: the least count of a frequent pair comes from their running total
        per = pairs.groupBy("c").agg(F.count("*").alias("n"))
        above = per.withColumn("n", F.sum("n").over(Window.orderBy(F.desc("c")))).filter(F.col("n") <= FREQUENT_PAIRS)
        top = pairs.filter(F.col("c") >= F.lit(above.agg(F.min("c")).first()[0]))
    held = top.toPandas().sort_values("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(
        (held["pair"].to_numpy(np.int64), held["c"].to_numpy(np.int64), held["best"].to_numpy(bool))
    )
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                pairs, sizes = _unpacked(part["pairs"])
                times = _unpacked(part["times"])[0].astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                place = np.minimum(np.searchsorted(codes, pairs), max(len(codes) - 1, 0))
                held = codes[place] == pairs if len(codes) else np.zeros(len(pairs), bool)
                sums = np.zeros((2, part.num_rows), np.int64)
                np.add.at(sums[0], owner[held], times[held] * best[place[held]])
                np.add.at(sums[1], owner[held], times[held] * counts[place[held]])
                cuts = pa.array(np.append(0, np.cumsum(np.bincount(owner[~held], minlength=part.num_rows))).astype(np.int32))
                rare = [pa.ListArray.from_arrays(cuts, pa.array(x[~held].astype(np.int64))) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in kept), pa.array(sums[0]), pa.array(sums[1]), *rare], [*kept, "n_best", "count_sum", "rare", "times"]
                )

    columns = ", ".join(f"{c} {t}" for c, t in aligned.select(*kept).dtypes)
    scored = pin(
        aligned.select(*kept, "pairs", "times").mapInArrow(run, f"{columns}, n_best long, count_sum long, rare array<long>, times array<long>"),
        "align-scored",
    )
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        F.col("row").alias("_row"), F.col("r.rare").alias("pair"), F.col("r.times").alias("times")
    )
    # the table of all pairs grows with the corpus, so it is never broadcast
    more = rare.join(pairs.hint("merge"), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("c")).alias("_sum")
    )
    return scored.join(more.hint("merge"), F.col("row") == F.col("_row"), "left").select(
        *kept, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )


def score_alignment(documents: DataFrame, a: VocabularyFile, pattern: str, b: PieceFile) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``documents``.

    ``n_best`` counts the links whose pair has the most links of its id of B over all texts, ties included; ``count_sum`` adds
    the pair's links over all texts for each link. The digest of a text without tokens is empty. Cases are as in ``align_texts``.
    """
    aligned = align_texts(documents, a, pattern, b)
    digest = F.coalesce(F.sha2("groups", 256), F.lit(""))
    # the number of a row is a key once it is written
    aligned = pin(
        aligned.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()), "align-rows", compression="zstd"
    )
    return _with_counts(aligned, pin(count_pairs(aligned), "align-pairs")).drop("row")
