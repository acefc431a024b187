import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evisift.llm import alignment, bpe, queries
from prose import text

MERGES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
ODD = [
    None, "", " ", "   ", "a", " leading", "trailing  ", "two  spaces   here ", "a\n\nb\tc ", "▁ looks like a space", "日本語 テキスト 😀", "é" * 300,
    "<s> </s> <|endoftext|> <unk>", "x" * 500, " " * 200, "nul \x00 here", "it's they'll", text(2, 2000), text(3, 40), text(3, 40), "​﻿­ ok",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(MERGES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain(libraries, value):
    """Ids of both libraries and the ends of their tokens in bytes, None where the bytes aren't a space and the text."""
    if not value:
        return None
    a, b = libraries
    back = {c: k for k, c in bpe.printable_bytes().items()}
    a_ids, b_ids = a.encode(" " + value, add_special_tokens=False).ids, b.encode(value)
    a_bytes = [bytes(back[c] for c in a.id_to_token(k)) for k in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in b_ids)]
    if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + value).encode()}:
        return None
    return a_ids, b_ids, np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()


def brute_links(a_ends, b_ends):
    """All pairs of tokens whose byte ranges overlap."""
    spans = [list(zip([0, *ends[:-1]], ends, strict=True)) for ends in (a_ends, b_ends)]
    return [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]


def brute_groups(a_ends, b_ends):
    out, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        k, m = a_ends.index(cut) + 1, b_ends.index(cut) + 1
        out.append((i, k, j, m))
        i, j = k, m
    return out


def brute(libraries, table):
    found = [(doc_id, plain(libraries, value)) for doc_id, value in table]
    links = {k: [(p[0][i], p[1][j]) for i, j in brute_links(*p[2:])] for k, (_, p) in enumerate(found) if p}
    counts = Counter(pair for pairs in links.values() for pair in pairs)
    best = defaultdict(int)
    for (_, b), c in counts.items():
        best[b] = max(best[b], c)
    rows = Counter()
    for k, (doc_id, p) in enumerate(found):
        if not p:
            rows[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        groups = brute_groups(*p[2:])
        named = ";".join(",".join(map(str, p[0][i:k])) + "|" + ",".join(map(str, p[1][j:m])) for i, k, j, m in groups)
        rows[
            doc_id, len(p[0]), len(p[1]), len(groups), len(links[k]), sum(counts[x] == best[x[1]] for x in links[k]), sum(counts[x] for x in links[k]),
            hashlib.sha256(named.encode()).hexdigest(),
        ] += 1
    return rows


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9)), max_size=60))
def test_walk_equals_brute_force(parts):
    a, b, at = [], [], 0
    for kind, n in parts:
        for _ in range(n):
            at += 1
            if kind != 1:
                a.append(at)
            if kind != 2:
                b.append(at)
    at += 1
    a.append(at)
    b.append(at)
    left, right, group = alignment.links_of(a, b)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == brute_links(a, b)
    spans = {}
    for i, j, g in zip(left.tolist(), right.tolist(), group.tolist(), strict=True):
        spans[g] = (min(spans[g][0], i), i + 1, min(spans[g][2], j), j + 1) if g in spans else (i, i + 1, j, j + 1)
    assert list(spans.values()) == brute_groups(a, b)


@pytest.mark.parametrize("frequent", [None, 100, 0])
def test_query_equals_brute_force(spark, documents, libraries, tmp_path, monkeypatch, frequent):
    """With few frequent pairs held by tasks, the others come from the join."""
    if frequent is not None:
        monkeypatch.setattr(alignment, "FREQUENT_PAIRS", frequent)
    table = [*enumerate(ODD), (None, text(5, 30)), (3, "a repeated id"), (3, "a repeated id")]
    documents(*table).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_token_alignment(spark, str(tmp_path))
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(libraries, table)


def test_small_slices_give_the_same(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_CHUNKS", 5)
    a = alignment.Aligner(bpe.VocabularyFile(spark, MERGES), PATTERN, alignment.PieceFile(spark, PIECES))
    for value, row in zip(ODD, zip(*a.rows(ODD), strict=True), strict=True):
        p = plain(libraries, value)
        assert row[:2] == ((len(p[0]), len(p[1])) if p else (0, 0))
    model = alignment.PieceModel(alignment.PieceFile(spark, PIECES).shared.value)
    for value, packed in zip(ODD[2:], model.encode(ODD[2:]), strict=True):
        if plain(libraries, value):
            assert np.frombuffer(packed, "<u4").tolist() == libraries[1].encode(value)
        else:
            assert packed is None


@settings(max_examples=100, deadline=None)
@given(value=st.text(min_size=1, max_size=60) | st.text("ab \n▁é", min_size=1, max_size=60))
def test_piece_model_equals_library(spark, libraries, value):
    model = alignment._model(alignment.PieceFile(spark, PIECES))
    (packed,) = model.encode([value])
    p = plain(libraries, value)
    assert (packed is None) == (p is None) and (p is None or np.frombuffer(packed, "<u4").tolist() == p[1])


def test_real_outputs_and_empty_table(spark, documents):
    files = bpe.VocabularyFile(spark, MERGES), PATTERN, alignment.PieceFile(spark, PIECES)
    data = documents((1, "hello there"), (2, None)).withColumn("pairs", F.lit(0)).withColumn("groups", F.lit(0))
    rows = {r.doc_id: r for r in alignment.align_texts(data, *files).collect()}
    assert rows[1].groups.count(";") == rows[1].n_groups - 1 and rows[2].groups is None
    assert sum(np.frombuffer(rows[1].times, "<u4")) == rows[1].n_links == rows[1].n_a + rows[1].n_b - rows[1].n_groups
    assert alignment.score_alignment(data.limit(0), *files).count() == 0


def test_chunks_are_encoded_and_aligned_once(spark, libraries, monkeypatch):
    a = alignment.Aligner(bpe.VocabularyFile(spark, MERGES), PATTERN, alignment.PieceFile(spark, PIECES))
    seen, walked, encode, walk = [], [], bpe.Codec.encode, alignment.links_of
    monkeypatch.setattr(bpe.Codec, "encode", lambda self, texts: encode(self, [seen.append(len(t)) or t for t in texts]))
    monkeypatch.setattr(alignment, "links_of", lambda x, y: walked.append(len(x)) or walk(x, y))
    value = text(8, 300)
    once, many = a.rows([value]), a.rows([f"{value} {value}", None, value] * 40)
    assert sum(seen) <= len(value) + 1 and sum(walked) <= once[0][0]
    assert many[0] == [2 * once[0][0], 0, once[0][0]] * 40 and many[4][0] == f"{once[4][0]};{once[4][0]}"


WHITE = "ab.'sé1&, \n\t\r\x0b\x1c\x1f\x85\xa0  　▁ﬁ"


@pytest.mark.parametrize("pattern", [PATTERN, f"{PATTERN}|(?!)"])
def test_rows_equal_libraries_for_any_white_space(spark, libraries, pattern):
    """Texts meet in one slice, with chunks that are spelled otherwise among them; other patterns see whole texts."""
    a = alignment.Aligner(bpe.VocabularyFile(spark, MERGES), pattern, alignment.PieceFile(spark, PIECES))
    assert a.cuts == (pattern == PATTERN)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(WHITE, min_size=1, max_size=30), min_size=1, max_size=6))
    def equal(values):
        for value, row in zip(values, zip(*a.rows(values), strict=True), strict=True):
            p = plain(libraries, value)
            groups = brute_groups(*p[2:]) if p else []
            named = ";".join(",".join(map(str, p[0][i:k])) + "|" + ",".join(map(str, p[1][j:m])) for i, k, j, m in groups) if p else None
            assert row[:5] == ((len(p[0]), len(p[1]), len(groups), len(brute_links(*p[2:])), named) if p else (0, 0, 0, 0, None))
            pairs = Counter(p[0][i] << 16 | p[1][j] for i, j in brute_links(*p[2:])) if p else {}
            assert dict(zip(*(np.frombuffer(x, "<u4").tolist() for x in row[5:]), strict=True)) == pairs

    equal()
