"""Vector code compression: product quantisation in integers, with adaptive distance bounds.

Vectors become integers and are cut into parts; each part position has a codebook, which rounds of assignment and averaging
improve. Between rounds every part keeps its ``b`` closest entries in order, a lower bound on the distance to each of them
but the first, and one outer bound on the distance to all others. When entries move, bounds shrink by the way they moved. A
part whose distance to its entry lies below all its bounds keeps the entry; where it lies below the outer bound only, the ``b``
entries are measured; else all are. Whatever a bound doesn't settle is settled by exact integer distances, so codes
are those of a full search. After each round ``b`` shrinks to the deepest place that any part had to look at, and grows
where too many parts had to look at all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.session import discard, pin, scratch_path, store

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FIRST_TRACKED, LEAST_TRACKED = 4, 2
# Share of parts that look at all entries above which one entry more is tracked.
FULL_SHARE = 0.05
# Bounds are floating point: what lies nearer together than this is measured.
SLACK = 1e-6


@dataclass(frozen=True)
class Shape:
    parts: int
    width: int
    kind: str

    def integers(self, packed: pa.Array) -> np.ndarray:
        """``(rows, parts, width)`` of packed vectors."""
        return _joined(packed, self.kind).reshape(len(packed), self.parts, self.width).astype(np.int64)


def _joined(packed: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind)


def pack_bounds(near: np.ndarray, low: np.ndarray, outer: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Entries as bytes; bounds as single-precision numbers that are never above the given ones."""
    wide = np.concatenate([low, outer[:, :, None]], axis=2)
    single = wide.astype("<f4")
    single = np.where(single.astype(float) > wide, np.nextafter(single, np.float32(-np.inf)), single).astype("<f4")
    return _packed(near.astype(np.uint8)), _packed(single)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def unpack_bounds(near: pa.Array, bounds: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tracked = _joined(near, "u1").reshape(len(near), parts, -1).astype(np.int64)
    wide = _joined(bounds, "<f4").reshape(len(near), parts, -1).astype(float)
    return tracked, wide[:, :, :-1], wide[:, :, -1]


def _ordered(distance: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Order of each row by distance, then by entry."""
    return np.lexsort((entries, distance), axis=1)


def measure_all(x: np.ndarray, book: np.ndarray, tracked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``near, low, outer, squared distance`` of parts ``x`` (rows, width) from all entries of one codebook."""
    distance = np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)
    order = np.argsort(distance, axis=1, kind="stable")
    ranked = np.take_along_axis(distance, order, axis=1)
    outer = np.sqrt(ranked[:, tracked]) if len(book) > tracked else np.full(len(x), np.inf)
    return order[:, :tracked], np.sqrt(ranked[:, 1:tracked]), outer, ranked[:, 0]


@dataclass
class Work:
    """What a round had to look at: per part the deepest place among its bounds, and whether it measured all entries."""

    deepest: np.ndarray
    full: np.ndarray


def reassign(
    x: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, book: np.ndarray, moved: np.ndarray, tracked: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Work]:
    """``measure_all`` after the entries moved by ``moved``, with as few measurements as the bounds allow.

    ``near`` may hold more entries than are to be ``tracked`` from now on; the bounds of the others join the outer bound.
    """
    if near.shape[1] > tracked:
        outer = np.minimum(outer, low[:, tracked - 1:].min(axis=1))
        near, low = near[:, :tracked], low[:, :tracked - 1]
    near, low = near.copy(), low - moved[near[:, 1:]] * (1 + SLACK)
    outer = outer - moved.max(initial=0.0) * (1 + SLACK)
    best = ((x - book[near[:, 0]]) ** 2).sum(axis=1)
    reach = np.sqrt(best) * (1 + SLACK) + SLACK
    work = Work(1 + (low <= reach[:, None]).sum(axis=1), np.zeros(len(x), bool))
    rows = np.flatnonzero((work.deepest > 1) | (reach >= outer))
    if len(rows):
        distance = ((x[rows, None] - book[near[rows]]) ** 2).sum(axis=2)
        order = _ordered(distance, near[rows])
        ranked = np.take_along_axis(distance, order, axis=1)
        near[rows] = np.take_along_axis(near[rows], order, axis=1)
        low[rows], best[rows] = np.sqrt(ranked[:, 1:]), ranked[:, 0]
        # an entry that isn't tracked could be as near
        rows = rows[np.sqrt(ranked[:, 0]) * (1 + SLACK) + SLACK >= outer[rows]]
    wider = min(tracked, len(book)) > near.shape[1]
    if wider:
        rows = np.arange(len(x))
    else:
        work.full[rows] = True
    if len(rows):
        found = measure_all(x[rows], book, tracked)
        if wider:
            near, low, outer, best = found
        else:
            near[rows], low[rows], outer[rows], best[rows] = found
    return near, low, outer, best, work


def prepare(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that count, with ``_v`` as doubles: those whose vector is there and has only finite components."""
    finite = F.forall("_v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return embeddings.withColumn("_v", F.col(vector).cast("array<double>")).filter(F.col("_v").isNotNull() & finite)


STATE = "vec_id long, label {label}, ints binary, near binary, bounds binary, deepest int, full int, error long"


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """``(vec_id, label, code, error)`` of every row that counts, the codebooks ``(parts, entries, width)``, and what each round
    had to look at.

    ``embeddings`` has ``vec_id, embedding, label``. Rows whose vector is null or holds null or non-finite components are
    dropped; ids and labels may be null and may repeat. ``code`` is a byte per part. Codebooks start as the parts of the rows with
    the least ids (null ids last, then by vector), fewer where there are fewer rows. Vectors of unequal length, of a length that the
    parts don't divide, or with components too large for exact 64-bit distances are refused with an error; an empty table gives
    no rows and empty codebooks; other columns are ignored.
    """
    spark = embeddings.sparkSession
    counted = prepare(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")).select("vec_id", "label", "_v")
    label = dict(counted.dtypes)["label"]
    rows, least, most, peak = counted.agg(
        F.count("*"), F.min(F.size("_v")), F.max(F.size("_v")), F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    ).first()
    if not rows:
        return spark.createDataFrame([], f"vec_id long, label {label}, code binary, error long"), np.zeros((parts, 0, 0), np.int64), []
    if least != most or most % parts:
        raise ValueError(f"vectors of {least} to {most} components cannot be cut into {parts} equal parts")
    bound = int(np.floor(peak * scale)) + 1
    if most * (2 * bound) ** 2 >= 2**62:
        raise ValueError(f"components up to {peak} are too large for exact distances")
    kind = "<i2" if bound < 2**15 else "<i4"
    shape = Shape(parts, most // parts, kind)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = np.floor(batch["_v"].flatten().to_numpy() * scale).astype(kind).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], _packed(ints)], ["vec_id", "label", "ints"])

    packed = counted.mapInArrow(whole, f"vec_id long, label {label}, ints binary")
    first = counted.orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    books = np.stack([np.floor(np.array(r[0]) * scale).astype(np.int64).reshape(parts, -1) for r in first], axis=1)
    tracked, moved, path, state, log = FIRST_TRACKED, None, None, packed, []
    for number in range(rounds + 1):
        last, path = path, scratch_path(spark, f"codes-{number}")
        state = store(_assigned(state, shape, books, moved, tracked, label), path)
        if last:
            # the table before has no reader any more
            discard(spark, last)
        seen = state.agg(F.max("deepest").alias("deepest"), F.sum("full").alias("full")).first()
        log.append({"tracked": tracked, "deepest": seen.deepest, "full": seen.full, "parts": rows * parts})
        if number:
            tracked = max(LEAST_TRACKED, min(tracked, seen.deepest)) if seen.full <= FULL_SHARE * rows * parts else tracked + 1
        if number < rounds:
            new = _averaged(state, shape, books)
            moved, books = np.sqrt(((new - books) ** 2).sum(axis=2)), new
    # the nearest entry of each part; as many bytes per part as entries are tracked
    nearest = F.concat(*[F.expr(f"substring(near, octet_length(near) div {parts} * {p} + 1, 1)") for p in range(parts)])
    return state.select("vec_id", "label", nearest.alias("code"), "error"), books, log


def _assigned(state: DataFrame, shape: Shape, books: np.ndarray, moved: np.ndarray | None, tracked: int, label: str) -> DataFrame:
    """The next table: every part at its nearest entry of ``books``."""
    shared = state.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = shape.integers(batch["ints"])
            if moved is not None:
                before = unpack_bounds(batch["near"], batch["bounds"], shape.parts)
            found, works = [], []
            for p in range(shape.parts):
                if moved is None:
                    near, low, outer, best = measure_all(x[:, p], books[p], tracked)
                    work = Work(np.full(len(x), near.shape[1]), np.zeros(len(x), bool))
                else:
                    near, low, outer, best, work = reassign(x[:, p], *(y[:, p] for y in before), books[p], moved[p], tracked)
                found.append((near, low, outer, best))
                works.append(work)
            near, low, outer, best = (np.stack(y, axis=1) for y in zip(*found, strict=True))
            entries, bounds = pack_bounds(near, low, outer)
            columns = {
                "vec_id": batch["vec_id"], "label": batch["label"], "ints": batch["ints"], "near": entries, "bounds": bounds,
                "deepest": pa.array(np.max([w.deepest for w in works], axis=0).astype(np.int32)),
                "full": pa.array(np.sum([w.full for w in works], axis=0).astype(np.int32)), "error": pa.array(best.sum(axis=1)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return state.mapInArrow(run, STATE.format(label=label))


def _averaged(state: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The floor of the mean of each entry's parts; entries without parts stay. Tasks add up, the driver gets a row per component."""
    slots = books.shape[0] * books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slots, shape.width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = shape.integers(batch["ints"])
                first = _joined(batch["near"], "u1").reshape(batch.num_rows, shape.parts, -1)[:, :, 0]
                slot = first + np.arange(shape.parts) * books.shape[1]
                np.add.at(total, slot.ravel(), np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], axis=2).reshape(-1, shape.width + 1))
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["slot", "sums"]
        )

    summed = state.select("ints", "near").mapInArrow(run, "slot int, sums array<long>").select(
        "slot", F.posexplode("sums").alias("at", "s")
    ).groupBy("slot", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = [[0] * (shape.width + 1) for _ in range(slots)]
    for slot, at, s in summed.collect():
        total[slot][at] = int(s)
    new = books.reshape(slots, shape.width).copy()
    for slot, (*sums, n) in enumerate(total):
        if n:
            new[slot] = [s // n for s in sums]
    return new.reshape(books.shape)


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over all rows of a row's label; null labels are one label.

    The sums are a row per label: the planner broadcasts them while that table is small, else it joins by label.
    """
    sums = pin(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
