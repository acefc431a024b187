import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evisift.llm import bpe, queries
from prose import text

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MERGES = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as data:
        return bpe.Codec(bpe.Vocabulary.from_ranks(data.read()), PATTERN)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    return [
        None, "", " ", "a", "  two  spaces \n\n end ", "a" * 1000, "ab" * 700, "=" * 5000, " " * 700 + "x", "\n" * 300, "日本語" * 500,
        "".join(rng.choice("abcde") for _ in range(6000)), "it's 'REALLY' they'll <|endoftext|> x", "é" * 300, "\x00\x1c\x85 \U0001f600",
        text(1, 3000), text(1, 3000), "ß" * 257, "w" * 256, "w" * 255,
    ]


def unpack(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_equal_library(codec, library, odd):
    for value, packed in zip(odd, codec.encode(odd), strict=True):
        assert unpack(packed) == library.encode_ordinary(value or "")
        assert codec.decode(packed) == (value or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80) | st.text("ab \n'1", max_size=600))
def test_any_text_equals_library(codec, library, value):
    (packed,) = codec.encode([value])
    assert unpack(packed) == library.encode_ordinary(value)
    assert codec.decode(packed).decode() == value


def test_merge_file_equals_library(odd):
    with open(MERGES, "rb") as data:
        codec = bpe.Codec(bpe.Vocabulary.from_merges(data.read()), PATTERN)
    library = Tokenizer.from_file(MERGES)
    library.encode_special_tokens = True
    for value, packed in zip(odd, codec.encode(odd), strict=True):
        assert unpack(packed) == library.encode(value or "", add_special_tokens=False).ids


def test_small_stretches_and_cache(codec, library, odd, monkeypatch):
    monkeypatch.setattr(bpe, "CUT_CHARS", 50)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 20)
    monkeypatch.setattr(bpe, "CELLS", 300)
    assert [unpack(p) for p in codec.encode(odd)] == [library.encode_ordinary(value or "") for value in odd]


def test_pair_table_finds_what_it_holds():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 2**16, (5000, 2)), axis=0)
    half = len(pairs) // 2
    table = bpe.PairTable(*pairs[:half].T, np.arange(half, dtype=np.int32))
    assert table.find(*pairs[:half].T).tolist() == list(range(half))
    assert (table.find(*pairs[half:].T) == bpe.NONE).all()
    empty = bpe.PairTable(*np.zeros((2, 0), np.int64), np.zeros(0, np.int32))
    assert empty.find(np.array([1]), np.array([2])).tolist() == [bpe.NONE]


def test_query_equals_library(spark, documents, library, odd, tmp_path):
    rows = [*enumerate(odd), (3, "a repeated id"), (3, "a repeated id"), (None, "no id")]
    documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_bpe_codec(spark, str(tmp_path))
    want = Counter()
    for doc_id, value in rows:
        ids = library.encode_ordinary(value or "")
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((value or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_columns_stay_and_empty_table(spark, documents):
    file = bpe.VocabularyFile(spark, RANKS)
    data = documents((1, "one two"), (2, None)).withColumn("ids", F.lit("theirs"))
    out = bpe.encode_texts(data, file, PATTERN)
    assert out.columns == [*[c for c in data.columns if c not in ("text", "ids")], "ids"]
    assert {r.doc_id: len(r.ids) for r in out.collect()} == {1: 8, 2: 0}
    back = bpe.decode_ids(bpe.encode_texts(data, file, PATTERN, out="packed"), file, "packed", "text")
    assert back.columns == [*[c for c in data.columns if c != "text"], "text"]
    assert {(r.doc_id, bytes(r.text), r.ids) for r in back.collect()} == {(1, b"one two", "theirs"), (2, b"", "theirs")}
    assert bpe.decode_ids(data.select("doc_id", F.lit(None).cast("binary").alias("ids")), file).filter("bytes is null").count() == 2
    assert bpe.decode_ids(bpe.encode_texts(data.limit(0), file, PATTERN), file).count() == 0
