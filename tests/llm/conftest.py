import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, copy string, node string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, source]) rows, with further columns whose names the operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), True, 0.5, "x", "y") for r in rows]
        return spark.createDataFrame(full, TEXTS)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")

    return make


@pytest.fixture
def benchmark_folder(spark, labels, tmp_path):
    labels((3, 1, 0)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "five words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)
