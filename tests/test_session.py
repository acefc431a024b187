from pathlib import Path

from evisift.plans import queries
from evisift.session import discard, pin, release_pins, scratch_path, store

SF = "/root/testdata/sf0.001"


def folder_of(spark):
    return Path(scratch_path(spark, "x").removeprefix("file:")).parent


def test_pins_are_released(spark, tmp_path):
    """All that a query leaves behind lies in one folder, which goes once the result is written."""
    result = queries.registry()["retrieve_topk"](spark, SF)
    result.write.parquet(f"{tmp_path}/out")
    stream = queries.registry()["intake_stream"](spark, SF)
    n = stream.count()
    assert any(folder_of(spark).iterdir())
    release_pins(spark)
    assert not folder_of(spark).exists()
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0 and n > 0
    # and pins work again afterwards
    assert pin(spark.range(3), "again").count() == 3


def test_single_tables_are_discarded(spark):
    path = scratch_path(spark, "one")
    kept = pin(spark.range(2), "kept")
    assert store(spark.range(5), path).count() == 5
    discard(spark, path)
    assert not Path(path.removeprefix("file:")).exists() and kept.count() == 2
