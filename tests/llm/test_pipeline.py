import corpus_pipeline
from evisift.llm import decontaminate, neardup, oracles, queries
from prose import text

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        seen.append(docs.count())
        if name == "near_dedup":
            assert neardup.near_duplicates(docs, 80).filter("not kept").isEmpty()
        if name == "decontamination":
            assert decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] <= seen[2] and seen[4] == seen[3]
    assert corpus_pipeline.run(spark, SF).count() == seen[5]


def test_stages_on_odd_rows(spark, documents, labels, benchmark_folder):
    docs = documents((1, None), (2, ""), (None, text(1, 90)), (3, text(2, 90)), (3, text(2, 90)), (4, text(3, 90), None))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, benchmark_folder)
    assert {r.doc_id for r in docs.collect()} <= {1, 2, 3, 4, None}
    none = documents()
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, benchmark_folder)
    assert none.count() == 0


def test_one_query_of_each_operator():
    names = queries.registry()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(oracles.ORACLES) <= set(names)
