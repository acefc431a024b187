import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm import codebooks, oracles, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, near int, label_error long"


def rows(seed, n, width=16, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    v = centres[rng.integers(0, 9, n)] + rng.normal(scale=spread, size=(n, width))
    return [(k * 3 % n, [float(np.float32(x)) for x in v[k]], int(k % 5), "c", 1, 2) for k in range(n)]


def brute(table, parts=8, entries=16, rounds=6):
    """The contract by full search, in Python integers."""
    kept = [(r[0], [math.floor(4096 * x) for x in r[1]], r[2]) for r in table if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for x in cut:
                of[nearest(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else c for e, c in enumerate(books[p])]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = Counter()
    for (_, _, label), near in zip(kept, found, strict=True):
        errors[label] += sum(d for d, _ in near)
    digest = codebooks.digest(np.array(books))
    return Counter(
        (vec_id, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), errors[label], digest)
        for (vec_id, _, label), near in zip(kept, found, strict=True)
    )


def query(spark, table, folder):
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return Counter(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in queries.op12_vector_codes(spark, str(folder)).collect())


NAN, INF = float("nan"), float("inf")
ODD = [
    (900, None, 1, "c", 1, 2), (901, [None] + [0.5] * 15, 1, "c", 1, 2), (902, [NAN] * 16, 1, "c", 1, 2), (903, [INF] + [0.0] * 15, 1, "c", 1, 2),
    (904, [-INF] * 16, None, "c", 1, 2), (-1, [-0.00001] * 16, None, "c", 1, 2), (None, [0.25] * 16, None, "c", 1, 2), (None, [0.25] * 16, 3, "c", 1, 2),
    (7, [0.0] * 16, 2, "c", 1, 2), (7, [0.0] * 16, 2, "c", 1, 2), (2**62 + 1, [9.0] * 16, 2, "c", 1, 2),
]


@pytest.mark.parametrize("table", [rows(1, 300) + ODD, rows(2, 5) + ODD, [*rows(3, 1)], rows(4, 120, spread=0.0), rows(5, 200, width=8, spread=2.0)])
def test_query_equals_brute_force(spark, table, tmp_path):
    assert query(spark, table, tmp_path) == brute(table)


def test_sql_equals_query(spark, tmp_path):
    table = [r for r in rows(6, 150) + ODD if r[0] is not None]
    got = query(spark, table, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = con.execute(oracles.ORACLES["op12_vector_codes"])
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(dict(zip(names, r, strict=True))[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in cursor.fetchall())
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(2, 6), st.integers(1, 40))
def test_bounds_never_change_the_nearest(seed, entries, tracked, step):
    """Over several moves of the entries, bounds give the same entry and distance as a full search, ties included."""
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-20, 20, (60, 3)), rng.integers(-20, 20, (entries, 3))
    near, low, outer, best = codebooks.measure_all(x, book, tracked)
    for turn in range(5):
        new = book + rng.integers(-step, step + 1, book.shape) * (rng.random(len(book)) < 0.5)[:, None]
        moved = np.sqrt(((new - book) ** 2).sum(axis=1).astype(float))
        book, tracked = new, max(2, tracked + [0, -1, 1, 0, -1][turn])
        packed = codebooks.pack_bounds(near[:, None], low[:, None], outer[:, None])
        near, low, outer = (y[:, 0] for y in codebooks.unpack_bounds(*packed, 1))
        near, low, outer, best, _ = codebooks.reassign(x, near, low, outer, book, moved, tracked)
        full = codebooks.measure_all(x, book, tracked)
        assert (near[:, 0] == full[0][:, 0]).all() and (best == full[3]).all()


def test_bounds_save_work_and_adapt(spark):
    table = spark.createDataFrame(rows(8, 2000, spread=0.05), SCHEMA)
    _, _, log = codebooks.compress(table)
    assert len(log) == 7 and all(r["parts"] == 16_000 for r in log)
    assert sum(r["full"] for r in log[1:]) < 0.3 * 6 * 16_000
    assert len({r["tracked"] for r in log}) > 1


def test_empty_and_refused_tables(spark, tmp_path):
    nothing, books, log = codebooks.compress(spark.createDataFrame([(1, None, 1, "c", 1, 2)], SCHEMA))
    assert nothing.columns == ["vec_id", "label", "code", "error"] and nothing.count() == 0 and books.shape == (8, 0, 0) and not log
    assert not query(spark, [(1, None, 1, "c", 1, 2)], tmp_path)
    for bad in ([1.0] * 12, [1e30] * 16):
        with pytest.raises(ValueError):
            codebooks.compress(spark.createDataFrame([(1, bad, 1, "c", 1, 2)], SCHEMA))
    with pytest.raises(ValueError):
        codebooks.compress(spark.createDataFrame([(1, [1.0] * 16, 1, "c", 1, 2), (2, [1.0] * 8, 1, "c", 1, 2)], SCHEMA))
