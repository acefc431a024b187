import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.regression import IsotonicRegression

from evisift.operators import isotonic


def sequential(points):
    """Pool adjacent violators over (score, label) rows one after the other: value of every distinct score."""
    merged = {}
    for x, y in sorted(points):
        w, s = merged.get(x, (0, 0))
        merged[x] = (w + 1, s + y)
    blocks = []
    for x, (w, s) in sorted(merged.items()):
        blocks.append([[x], w, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            xs, w, s = blocks.pop()
            blocks[-1] = [blocks[-1][0] + xs, blocks[-1][1] + w, blocks[-1][2] + s]
    return [(xs[0], xs[-1], s / w, w) for xs, w, s in blocks]


def interpolated(steps, x):
    knots = [(e, v) for lo, hi, v, _ in steps for e in (lo, hi)]
    below = [k for k in knots if k[0] <= x]
    above = [k for k in knots if k[0] >= x]
    if not below or not above:
        return (below or above)[-1 if below else 0][1]
    (x0, y0), (x1, y1) = below[-1], above[0]
    return y0 if x0 in (x, x1) else y0 + (y1 - y0) / (x1 - x0) * (x - x0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 1)), min_size=1, max_size=80), st.integers(1, 6))
def test_merged_hulls_equal_sequential_pooling(points, parts):
    """However the scores are cut into ranges, and in whatever tree these merge."""
    merged = {}
    for x, y in points:
        w, s = merged.get(x, (0, 0))
        merged[x] = (w + 1, s + y)
    blocks = [(float(x), float(x), *ws) for x, ws in sorted(merged.items())]
    size = -(-len(blocks) // parts)
    hulls = [isotonic.pool(blocks[at:at + size]) for at in range(0, len(blocks), size)]
    while len(hulls) > 1:
        hulls = [isotonic.pool(sum(hulls[at:at + 2], [])) for at in range(0, len(hulls), 2)]
    assert [(lo, hi, s / w, w) for lo, hi, w, s in hulls[0]] == sequential(points)


@pytest.mark.parametrize("part_rows", [7, 40, 100_000])
def test_steps_and_curve(spark, part_rows):
    rng = random.Random(part_rows)
    points = [(round(rng.random(), 2), int(rng.random() < 0.2)) for _ in range(150)] + [(round(rng.random(), 2), 1) for _ in range(60)]
    df = spark.createDataFrame([*points, (None, 1), (0.5, None), (float("nan"), 0)], "x double, y int")
    steps = isotonic.fit_isotonic(df, "x", "y", part_rows=part_rows)
    want = sequential(points)
    assert sorted(map(tuple, steps.collect())) == want
    asked = [round(rng.uniform(-0.5, 1.5), 3) for _ in range(200)] + [0.0, -0.0, want[0][1], want[-1][0]]
    rows = spark.createDataFrame([(k, x, "old") for k, x in enumerate(asked)] + [(999, None, "old")], "k int, s double, p string")
    out = {r.k: r.p for r in isotonic.apply_isotonic(steps, rows, "s", "p", part_rows=part_rows).collect()}
    assert len(out) == len(asked) + 1 and out.pop(999) is None
    for k, x in enumerate(asked):
        assert out[k] == pytest.approx(interpolated(want, x), abs=1e-12)


def test_equals_library(spark):
    rng = random.Random(3)
    points = [(x, int(rng.random() < x)) for x in (rng.random() for _ in range(300))]
    df = spark.createDataFrame(points, "feature double, label int")
    steps = isotonic.fit_isotonic(df, "feature", "label", part_rows=50)
    asked = spark.createDataFrame([(rng.uniform(-0.1, 1.1),) for _ in range(100)], "feature double")
    library = IsotonicRegression(featuresCol="feature").fit(df.selectExpr("feature", "double(label) label")).transform(asked)
    want = {r.feature: r.prediction for r in library.collect()}
    for r in isotonic.apply_isotonic(steps, asked, "feature", "mine").collect():
        assert r.mine == pytest.approx(want[r.feature], abs=1e-9)
