"""Byte-level BPE encoding and decoding with padded matrices.

A text is cut into pieces by a pattern. The distinct pieces of some texts that are not known yet go into buckets by length, each a
padded matrix with a piece per row. In every round each row merges its leftmost pair of least rank: hashed tables give the
ranks of pairs, the columns behind the merged pair close up, and rows without a pair that merges leave the matrix. A piece too
long for a bucket is one row by itself, folded into a matrix whose lines hold the ranks of its stretches.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
# Longest piece of a bucket, its grid of lengths, and the cells of one matrix.
BUCKET_BYTES, LENGTH_STEP, CELLS = 256, 4, 1_000_000
LINE = 512
# Pieces that a Python worker remembers, characters of text that it cuts at once.
KNOWN_PIECES, CUT_CHARS = 200_000, 1_000_000


class PairTable:
    """Ranks of pairs of ids below 2**16, hashed to short lines of slots."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        key = self._key(left, right)
        self.shift = np.uint64(64 - max(4, int(len(key)).bit_length() + 1))
        line = self._line(key)
        order = np.argsort(line, kind="stable")
        line, key, rank = line[order], key[order], rank[order]
        within = np.arange(len(line)) - np.searchsorted(line, line)
        shape = (1 << int(64 - int(self.shift)), int(within.max(initial=0)) + 1)
        self.keys, self.ranks = np.full(shape, 2**64 - 1, np.uint64), np.full(shape, NONE, np.int32)
        self.keys[line, within], self.ranks[line, within] = key, rank

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)

    def _line(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it doesn't merge."""
        key = self._key(left, right)
        line = self._line(key)
        return np.where(self.keys[line] == key[:, None], self.ranks[line], NONE).min(axis=1, initial=NONE)


class Vocabulary:
    """Tokens by id, the merges in order of rank, and whether a piece that is a token stays whole."""

    def __init__(self, tokens: dict[int, bytes], pairs: list[tuple[int, int, int, int]], whole: bool):
        left, right, rank, made = np.array(pairs, np.int64).reshape(-1, 4).T
        self.tokens, self.whole = tokens, whole
        self.id_of = {token: number for number, token in tokens.items()}
        self.single = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)], np.int32)
        if max(tokens, default=0) >= 2**16 or (self.single < 0).any():
            raise ValueError("a vocabulary needs all 256 bytes and ids below 65536")
        self.table = PairTable(left, right, rank.astype(np.int32))
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.made[rank] = made

    @classmethod
    def from_ranks(cls, data: bytes) -> Vocabulary:
        """Two neighbours merge if together they are a token; a token's rank is its id."""
        tokens = ranked_tokens(data)
        id_of = {token: number for number, token in tokens.items()}
        pairs = [
            (id_of[token[:k]], id_of[token[k:]], number, number)
            for number, token in tokens.items() for k in range(1, len(token)) if token[:k] in id_of and token[k:] in id_of
        ]
        return cls(tokens, pairs, whole=True)

    @classmethod
    def from_merges(cls, data: bytes) -> Vocabulary:
        """A JSON model with a vocabulary and an ordered list of merges, both in the printable form of bytes."""
        model, pairs = json.loads(data)["model"], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((model["vocab"][a], model["vocab"][b], rank, model["vocab"][a + b]))
        return cls(printed_tokens(data), pairs, whole=False)


def ranked_tokens(data: bytes) -> dict[int, bytes]:
    """Tokens by id from lines of a token in base 64 and its rank."""
    return {int(b): base64.b64decode(a) for a, b in (line.split() for line in data.splitlines() if line)}


def printed_tokens(data: bytes) -> dict[int, bytes]:
    """Tokens by id from a JSON model in the printable form of bytes."""
    back = {char: byte for byte, char in printable_bytes().items()}
    vocabulary = json.loads(data)["model"]["vocab"]
    return {number: bytes(map(back.get, token)) for token, number in vocabulary.items() if set(token) <= set(back)}


def printable_bytes() -> dict[int, str]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def merge_rows(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """The packed tokens of every row of a matrix of single-byte ids, which is padded on the right."""
    n, width = ids.shape
    out: list[bytes] = [b""] * n
    number, lengths = np.arange(n), lengths.copy()
    ranks = np.full((n, max(width - 1, 0)), NONE, np.int32)
    inside = np.arange(width - 1) < lengths[:, None] - 1
    ranks[inside] = vocabulary.table.find(ids[:, :-1][inside], ids[:, 1:][inside])
    while True:
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
        least = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), NONE)
        live = least < NONE
        if not live.all():
            raw, size = ids[~live].astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, (place, n_tokens) in enumerate(zip(number[~live].tolist(), lengths[~live].tolist(), strict=True)):
                out[place] = raw[k * size:k * size + 4 * n_tokens]
        if not live.any():
            return out
        if not live.all():
            ids, ranks, at, least, number, lengths = ids[live], ranks[live], at[live], least[live], number[live], lengths[live]
        row = np.arange(len(ids))
        ids[row, at] = vocabulary.made[least]
        # every row is one token shorter now
        ids = np.where(np.arange(ids.shape[1] - 1) <= at[:, None], ids[:, :-1], ids[:, 1:])
        ranks = np.where(np.arange(ranks.shape[1] - 1) <= at[:, None], ranks[:, :-1], ranks[:, 1:])
        lengths -= 1
        before = np.flatnonzero(at > 0)
        ranks[before, at[before] - 1] = vocabulary.table.find(ids[before, at[before] - 1], ids[before, at[before]])
        after = np.flatnonzero(at + 1 < lengths)
        ranks[after, at[after]] = vocabulary.table.find(ids[after, at[after]], ids[after, at[after] + 1])
        # the merged pair was the last of its row, whose rank still stands there
        last = np.flatnonzero((at + 1 >= lengths) & (at < ranks.shape[1]))
        ranks[last, at[last]] = NONE


def merge_long(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The packed tokens of one long row: ranks in lines of ``LINE``, whose least values lead to the leftmost least pair."""
    n = len(ids)
    ids, ahead, back = ids.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
    flat = np.full(-(-n // LINE) * LINE, NONE, np.int32)
    flat[:n - 1] = vocabulary.table.find(ids[:-1], ids[1:])
    lines = flat.reshape(-1, LINE)
    least, alive = lines.min(axis=1), np.ones(n, bool)
    while True:
        line = int(least.argmin())
        rank = least[line]
        if rank == NONE:
            return ids[alive].astype("<u4").tobytes()
        here = line * LINE + int(lines[line].argmin())
        gone = int(ahead[here])
        ids[here], alive[gone], flat[gone] = vocabulary.made[rank], False, NONE
        beyond, before = int(ahead[gone]), int(back[here])
        ahead[here] = beyond
        if beyond < n:
            back[beyond] = here
        left, right = [ids[here]] if beyond < n else [], [ids[beyond]] if beyond < n else []
        if before >= 0:
            left, right = [ids[before], *left], [ids[here], *right]
        found = vocabulary.table.find(np.array(left, np.int32), np.array(right, np.int32)).tolist()
        flat[here] = found.pop() if beyond < n else NONE
        if before >= 0:
            flat[before] = found.pop()
        for touched in {here // LINE, gone // LINE, max(before, 0) // LINE}:
            least[touched] = lines[touched].min()


def merge_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The packed token ids of each non-empty piece."""
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        if vocabulary.whole and piece in vocabulary.id_of:
            out[k] = vocabulary.id_of[piece].to_bytes(4, "little")
        elif len(piece) > BUCKET_BYTES:
            out[k] = merge_long(vocabulary.single[np.frombuffer(piece, np.uint8)], vocabulary)
        else:
            buckets.setdefault(-(-len(piece) // LENGTH_STEP) * LENGTH_STEP, []).append(k)
    for width, members in buckets.items():
        for at in range(0, len(members), CELLS // width):
            mine = members[at:at + CELLS // width]
            raw = b"".join(pieces[k].ljust(width, b"\0") for k in mine)
            ids = vocabulary.single[np.frombuffer(raw, np.uint8).reshape(len(mine), width)]
            lengths = np.array([len(pieces[k]) for k in mine])
            for k, tokens in zip(mine, merge_rows(ids, lengths, vocabulary), strict=True):
                out[k] = tokens
    return out


class Codec:
    """Encodes texts and decodes ids; remembers the tokens of a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text in lists of bounded extent; the pattern leaves no character out."""
        at, size = 0, CUT_CHARS
        while at < len(text):
            found = self.pattern.findall(text, at, at + size)
            if at + size < len(text):
                # the end of the stretch can change its last piece
                if len(found) < 3:
                    size *= 2
                    continue
                del found[-2:]
            yield found
            at, size = at + sum(map(len, found)), CUT_CHARS

    def _learn(self, lists: list[list[str]]) -> None:
        new = set().union(*lists)
        if len(self.known) + len(new - self.known.keys()) > KNOWN_PIECES:
            self.known.clear()
        new = list(new - self.known.keys())
        packed = merge_pieces([piece.encode("utf-8", "surrogatepass") for piece in new], self.vocabulary)
        self.known.update(zip(new, packed, strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text in order, packed as little-endian unsigned 32-bit integers; null is an empty text."""
        waiting, chars = [], 0
        for text in texts:
            text = text or ""
            if len(text) > CUT_CHARS:
                yield from self._packed(waiting)
                waiting, chars, parts = [], 0, []
                for found in self._cut(text):
                    self._learn([found])
                    parts.append(b"".join(map(self.known.__getitem__, found)))
                yield b"".join(parts)
                continue
            waiting.append(self.pattern.findall(text))
            chars += len(text)
            if chars > CUT_CHARS:
                yield from self._packed(waiting)
                waiting, chars = [], 0
        yield from self._packed(waiting)

    def _packed(self, lists: list[list[str]]) -> Iterator[bytes]:
        if lists:
            self._learn(lists)
        for found in lists:
            yield b"".join(map(self.known.__getitem__, found))

    def decode(self, ids: bytes | None) -> bytes | None:
        return spell(self.vocabulary.tokens, ids)


def spell(tokens: dict[int, bytes], ids: bytes | None) -> bytes | None:
    """The bytes of packed ids."""
    return None if ids is None else b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class VocabularyFile:
    """A vocabulary file, read once by the driver and sent to the tasks; a worker builds its tables once."""

    def __init__(self, spark: SparkSession, path: str):
        data = Path(path).read_bytes()
        self.kind = "merges" if path.endswith(".json") else "ranks"
        self.digest = hashlib.sha256(data).hexdigest()
        self.shared = spark.sparkContext.broadcast(data)

    def __getstate__(self):
        return {"kind": self.kind, "digest": self.digest, "shared": self.shared}

    def __eq__(self, other):
        return isinstance(other, VocabularyFile) and (self.kind, self.digest) == (other.kind, other.digest)

    def __hash__(self):
        return hash((self.kind, self.digest))

    def codec(self, pattern: str) -> Codec:
        return _codec(self, pattern)

    def tokens(self) -> dict[int, bytes]:
        return _tokens(self)


@lru_cache(maxsize=2)
def _codec(file: VocabularyFile, pattern: str) -> Codec:
    make = Vocabulary.from_merges if file.kind == "merges" else Vocabulary.from_ranks
    return Codec(make(file.shared.value), pattern)


@lru_cache(maxsize=2)
def _tokens(file: VocabularyFile) -> dict[int, bytes]:
    return (printed_tokens if file.kind == "merges" else ranked_tokens)(file.shared.value)


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose values in ``column`` have about ``size`` bytes together, one row at least."""
    ends = np.cumsum([len(value or "") + 1 for value in batch[column].to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield batch.slice(at, end - at)
        at = end


def _mapped(data: DataFrame, column: str, out: str, kind: str, values) -> DataFrame:
    """``data`` with ``column`` replaced by a new binary column ``out`` as the last one."""
    kept = [c for c in data.columns if c not in (column, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, CUT_CHARS):
                made = pa.array(list(values(part[column].to_pylist())), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), made], [*kept, out])

    typed = data.select(*kept, F.col(column).cast(kind).alias(column))
    return typed.mapInArrow(run, typed.select(*kept, F.lit(None).cast("binary").alias(out)).schema)


def encode_texts(data: DataFrame, file: VocabularyFile, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``data`` with the column ``text`` replaced by its token ids: little-endian unsigned 32-bit integers, packed.

    Null and empty texts have no tokens; texts of any length are read whole; strings of special tokens are ordinary text. All
    other columns stay, but one named ``out``; rows may repeat; an empty table gives no rows.
    """
    return _mapped(data, text, out, "string", lambda texts: file.codec(pattern).encode(texts))


def decode_ids(data: DataFrame, file: VocabularyFile, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``data`` with packed ``ids`` replaced by the bytes that they stand for; null stays null, an unknown id is an error."""
    return _mapped(data, ids, out, "binary", lambda packed: (spell(file.tokens(), x) for x in packed))
