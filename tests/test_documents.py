import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evisift.operators import retrieve
from evisift.operators.assess import assess_long
from evisift.plans import queries
from evisift.sources import documents, verifier

BLOCKS = [
    ("pack", "doc", "doc:p1:b0", 1, "The control design was approved."),
    ("pack", "doc", "doc:p1:b1", 1, "Implementation of logging is enabled."),
    ("pack", "doc", "doc:p2:b0", 2, "Operating effectiveness was tested."),
]
SLOTS = ["design", "implementation", "operating"]


def tables(spark):
    blocks = spark.createDataFrame(BLOCKS, "pack_id string, document_id string, block_id string, page int, text string")
    docs = spark.createDataFrame(
        [("doc", "d.txt", "ab" * 32, "payments", "north", 12)],
        "document_id string, source_path string, source_hash string, system string, region string, age_days int",
    )
    queries = spark.createDataFrame(
        [("case", "pack", "design", "control design"), ("case", "pack", "implementation", "logging implementation"),
         ("case", "pack", "operating", "operating tested")],
        "case_id string, pack_id string, slot string, query string",
    )
    return blocks, docs, queries


def candidates(spark):
    blocks, docs, queries = tables(spark)
    found = retrieve.retrieve_topk(blocks, queries, ["case_id", "slot"], top_k=2, within=["pack_id"])
    return retrieve.with_block_facts(found, blocks, docs)


def answers(found, **changes):
    base = {"page": F.col("page"), "text": F.col("text"), "polarity": F.lit("SUPPORTS"), "confidence": F.lit(0.95)}
    base.update(changes)
    return found.select("case_id", "slot", "candidate_id", "document_id", *[v.alias(k) for k, v in base.items()])


def test_three_blocks_satisfy_a_case(spark):
    found = candidates(spark)
    accepted, violations = retrieve.first_accepted(retrieve.verify_candidates(found, answers(found)))
    assert violations.count() == 0
    slots = F.array(*[F.lit(s) for s in SLOTS])
    evidence = retrieve.build_evidence(accepted.withColumn("required_slots", slots))
    cases = spark.range(1).select(
        F.lit("case").alias("case_id"), slots.alias("required_slots"), F.lit("payments").alias("target_system"),
        F.lit("north").alias("target_region"), F.lit(365).alias("max_age_days"),
    )
    row = assess_long(cases, evidence).first()
    assert row["status"] == "SATISFIED" and row["usable_evidence_ids"] == [
        "case:design:doc:p1:b0", "case:implementation:doc:p1:b1", "case:operating:doc:p2:b0",
    ]


def test_changed_identity_fails_the_case(spark):
    found = candidates(spark)
    moved = answers(found, page=F.when(F.col("slot") == "design", F.col("page") + 1).otherwise(F.col("page")))
    accepted, violations = retrieve.first_accepted(retrieve.verify_candidates(found, moved))
    assert accepted.count() == 0 and {r["violation"] for r in violations.collect()} == {"changed_page"}


def test_violations_after_the_accepted_candidate_are_not_seen(spark):
    rows = [("c", "s", 1, "a", "d", 1, "t"), ("c", "s", 2, "b", "d", 1, "t")]
    found = spark.createDataFrame(rows, "case_id string, slot string, rank int, candidate_id string, document_id string, page int, text string")
    late = answers(found, text=F.when(F.col("rank") == 2, "other").otherwise("t"))
    accepted, violations = retrieve.first_accepted(retrieve.verify_candidates(found, late))
    assert [r["candidate_id"] for r in accepted.collect()] == ["a"] and violations.count() == 0
    unsure = answers(found, confidence=F.when(F.col("rank") == 1, 0.5).otherwise(0.9))
    accepted, _ = retrieve.first_accepted(retrieve.verify_candidates(found, unsure))
    assert [r["candidate_id"] for r in accepted.collect()] == ["b"]


def test_retrieval_arguments_and_ties(spark):
    blocks, docs, queries = tables(spark)
    with pytest.raises(ValueError):
        retrieve.retrieve_topk(blocks, queries, ["slot"], top_k=0)
    _, empty = retrieve.query_tokens(spark.createDataFrame([("x", "---")], "slot string, query string"), ["slot"])
    assert [r["slot"] for r in empty.collect()] == ["x"]
    word = spark.createDataFrame([("q", "was")], "slot string, query string")
    got = retrieve.retrieve_topk(blocks, word, ["slot"], top_k=1).collect()
    assert [(r["rank"], r["candidate_id"], r["score"]) for r in got] == [(1, "doc:p1:b0", 1.0)]
    assert retrieve.unknown_documents(blocks, docs.filter("false")).count() == 1


def test_verifier_payloads(spark):
    good = {"candidate_id": "c", "document_id": "d", "page": 1, "text": "t", "polarity": "SUPPORTS", "confidence": 0.9}
    body = json.dumps(good)
    raws = {
        body: None, f"```json\n{body}\n```": None, json.dumps({**good, "bbox": [0.1, 0.1, 0.2, 0.2]}): None,
        body + " trailing": "trailing_text", body + body: "trailing_text", "[1]": "not_an_object",
        "no json": "invalid_json", json.dumps({**good, "x": 1}): "unknown_field",
        json.dumps({**good, "confidence": 1.5}): "bad_confidence", json.dumps({**good, "page": 0}): "bad_page",
    }
    df = spark.createDataFrame([("c", str(i), r) for i, r in enumerate(raws)], "case_id string, slot string, raw string")
    got = {int(r["slot"]): r["failure"] for r in verifier.parse_responses(df).collect()}
    assert [got[i] for i in range(len(raws))] == list(raws.values())


def test_json_blocks_keep_the_raw_index(spark):
    doc = {"pages": [{"page": 2, "blocks": [{"text": " a  b "}, {"text": "  "}, {"text": "c", "bbox": [0.1, 0.2, 0.3, 0.4]}]}]}
    files = spark.createDataFrame(
        [("d", json.dumps(doc)), ("bad", "{"), ("nopages", "{}"), ("zero", json.dumps({"pages": [{"page": 0, "blocks": []}]}))],
        "document_id string, raw string",
    )
    blocks, rejects = documents.json_blocks(files)
    got = {r["block_id"]: (r["text"], r["bbox"] and r["bbox"]["x2"]) for r in blocks.collect()}
    assert got == {"d:p2:b0": ("a b", None), "d:p2:b2": ("c", 0.3)}
    assert {(r["document_id"], r["reason"]) for r in rejects.collect()} == {
        ("bad", "malformed"), ("nopages", "no_pages"), ("zero", "bad_page"),
    }


def test_form_profile_and_pairs(spark, tmp_path):
    folder = tmp_path / "data" / "annotations"
    folder.mkdir(parents=True)
    (folder / "one.json").write_text(json.dumps({"form": [{"linking": [[1, 2]]}, {"linking": []}]}))
    fork = tmp_path / "__MACOSX" / "annotations"
    fork.mkdir(parents=True)
    (fork / "x.json").write_text(json.dumps({"form": [{"linking": []}]}))
    assert tuple(documents.profile_forms(spark, str(tmp_path)).first()) == (1, 2, 1)
    rows = lambda *splits: spark.createDataFrame([(s,) for s in splits], "split string")
    got = {r["split"]: r["matches"] for r in documents.profile_pairs(rows("a", "a", "b"), rows("a", "a", "c")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_manifest_hashes_and_shards(spark, tmp_path, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("hello")
    hashes = {r["path"]: r for r in documents.file_hashes(spark, str(tmp_path / "docs")).collect()}
    assert hashes["a.txt"]["bytes"] == 5
    assert hashes["a.txt"]["sha256"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    monkeypatch.setattr(documents, "ROW_FILE_BYTES", 3)
    assert documents.file_hashes(spark, str(tmp_path / "docs")).first() == hashes["a.txt"]
    manifest = tmp_path / "m.json"
    spec = {"document_id": "a", "source_path": "a.txt", "sha256": hashes["a.txt"]["sha256"], "document_type": "text",
            "system": "s", "region": "r", "age_days": 1}
    manifest.write_text(json.dumps({"documents": [spec]}))
    good, rejects = documents.load_manifests(spark, str(manifest))
    assert good.first()["source_path"] == "a.txt" and rejects.isEmpty()
    (tmp_path / "bad").mkdir()
    short = {k: v for k, v in spec.items() if k != "region"}
    for name, body in {
        "malformed": json.dumps({"documents": [spec]}) + " x", "unknown_field": json.dumps({"documents": [spec], "more": 1}),
        "bad_document_count": json.dumps({"documents": []}), "bad_document_fields": json.dumps({"documents": [short]}),
        "constraint": json.dumps({"documents": [{**spec, "source_path": "../a"}]}),
        "duplicate_document_id": json.dumps({"documents": [spec, spec]}), "manifest_too_large": "{}" + " " * 1_000_000,
    }.items():
        (tmp_path / "bad" / f"{name}.json").write_text(body)
    good, rejects = documents.load_manifests(spark, str(tmp_path / "bad"))
    assert good.isEmpty()
    rows = rejects.collect()
    assert len(rows) == 7 and all(r["pack_id"].endswith(f"/{r['reason']}.json") for r in rows)
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "shards"))
    row = documents.shard_summary(documents.profile_shards(spark, str(tmp_path / "shards"))).first()
    assert tuple(row) == (1, 7, 1)


def test_shards_of_several_part_files(spark, tmp_path):
    folder = tmp_path / "shards"
    spark.range(7).repartition(3).write.parquet(str(folder / "a.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(folder / "sub" / "b.parquet"))
    spark.range(2).select("id", "id").toDF("x", "y").coalesce(1).write.parquet(str(folder / "c"))
    shards = documents.profile_shards(spark, str(folder))
    got = {r["shard"]: (r["rows"], r["columns"]) for r in shards.collect()}
    loose = next(name for name in got if name.startswith("part-"))
    assert got == {"a.parquet": (7, "id"), "b.parquet": (5, "id"), loose: (2, "x,y")}
    assert tuple(documents.shard_summary(shards).first()) == (3, 14, 2)


@pytest.mark.parametrize(("block", "reason"), [
    ({"text": "a", "bbox": [0, 0, 1, 1]}, None), ({"text": "a", "bbox": [0, 0, 1]}, "bad_bbox"), ({"text": "a", "bbox": [0.5, 0, 0.2, 1]}, "bad_bbox"),
    ({"text": "a", "bbox": [0, 0, 2, 1]}, "bad_bbox"), ({"text": " ", "bbox": [3]}, None), ({"text": "x" * 50_001}, "text_too_long"), ({"text": "x" * 50_000}, None),
])
def test_block_schema(spark, block, reason):
    raw = json.dumps({"pages": [{"page": 1, "blocks": [{"text": "fine"}, block]}]})
    _, rejects = documents.json_blocks(spark.createDataFrame([("d", raw)], "document_id string, raw string"))
    assert [r["reason"] for r in rejects.collect()] == ([reason] if reason else [])


def test_a_long_line_leaves_its_document_among_the_json_blocks(spark, tmp_path):
    """The SQL knows no longest line, so the query refuses none; the contract's limit stands in the operator."""
    text = "first\n" + "x" * 50_001 + "\n\nlast"
    spark.createDataFrame([(7, text), (8, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["block_id"]: r["digest"] for r in queries.json_blocks(spark, str(tmp_path)).collect()}
    lines = {"doc-7:p1:b0": "first", "doc-7:p1:b1": "x" * 50_001, "doc-7:p1:b3": "last", "doc-8:p1:b0": "short"}
    assert got == {block: hashlib.md5(line.encode()).hexdigest() for block, line in lines.items()}


def test_pretty_printed_manifest_is_read_whole(spark, tmp_path):
    import json

    entry = {
        "document_id": "d1", "source_path": "docs/a.txt", "sha256": "0" * 64, "document_type": "text", "system": "s", "region": "r", "age_days": 3,
    }
    (tmp_path / "m.json").write_text(json.dumps({"documents": [entry, {**entry, "document_id": "d2"}]}, indent=2))
    good, bad = documents.load_manifests(spark, str(tmp_path))
    assert {r.document_id for r in good.collect()} == {"d1", "d2"} and bad.count() == 0
    assert documents.read_texts(spark, str(tmp_path)).count() == 1


def test_streaming_is_left_to_known_stores():
    assert documents._streams("/data") and documents._streams("file:///data") and documents._streams("hdfs://host/data")
    assert not documents._streams("s3a://bucket/x") and not documents._streams("abfss://c@a/x") and not documents._streams("viewfs://store/x")
