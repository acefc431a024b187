"""Near-duplicates by HyperMinHash sketches over word shingles.

A register keeps the minimum of one random order of a document's shingles as its count of leading zeros and the ten
bits after the leading one. Bands of registers propose documents, which form candidate clusters. Inside a cluster the
collision-corrected estimate from the registers drops pairs far below the threshold; the others are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.llm.components import components
from evisift.llm.words import WordHashes, lower_ascii, shingles
from evisift.session import pin

SHINGLE_WORDS = 5
MANTISSA_BITS = 10
# 36 bands of 7 registers: two documents with a similarity of 0.85 share none with a probability of 9e-7, of 0.8 with 2e-4
# (there 48 bands of 6 registers are used: 5e-7).
BANDS = {0.85: (36, 7), 0.8: (48, 6)}
# The estimate's distance below the threshold, in standard deviations, at which a pair is given up.
SLACK = 5.0
BLOCK_DOCUMENTS = 512
BLOCK_SHINGLES = 2_000_000


@dataclass(frozen=True)
class Rule:
    """Link two documents with ``100 * intersection >= percent * union``."""

    percent: int
    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def rule(percent: int) -> Rule:
    return Rule(percent, *BANDS[percent / 100])


def _orders(count: int) -> np.ndarray:
    return (np.random.default_rng(20240) .integers(0, 2**31, count).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(shingles(hashes, SHINGLE_WORDS))


def registers(distinct: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty set: leading zeros above, mantissa bits below."""
    values = (distinct >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(len(orders), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(values), 256):
        np.minimum(least, (values[at:at + 256] * orders).min(axis=0), out=least)
    # frexp gives the place of the leading one exactly for 32-bit integers
    place = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    wide = least.astype(np.int64) << (32 - place)
    mantissa = (wide >> (31 - MANTISSA_BITS)) & (2**MANTISSA_BITS - 1)
    return (((32 - place) << MANTISSA_BITS) | mantissa).astype(np.uint16)


def estimate(equal: np.ndarray, n: int, sizes: np.ndarray, count: int) -> np.ndarray:
    """Similarity from the number of equal registers, less the expected number of accidental ones.

    Minima of sets of n and m shingles fall in one register value by accident with a probability of about
    ``c * 2**-bits * nm / (n + m)**2``; c = 0.72 is the mean width of a value's range relative to its place.
    """
    accident = 0.72 * 2.0**-MANTISSA_BITS * n * sizes / (n + sizes) ** 2.0
    return np.maximum(equal / count - accident, 0) / (1 - accident)


def band_keys(regs: np.ndarray, by: Rule) -> list[int]:
    raw, width = regs.tobytes(), 2 * by.rows
    return [xxhash.xxh3_64_intdigest(raw[k * width:(k + 1) * width], seed=k) - 2**63 for k in range(by.bands)]


def sketch(documents: DataFrame, by: Rule) -> DataFrame:
    """``doc_id, n_shingles, n_words_key, bands`` of every row; rows without words have null key and bands."""
    orders = _orders(by.registers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch["text"]:
                words = lower_ascii(text).split()
                if not words:
                    sizes.append(0)
                    keys.append(None)
                    bands.append(None)
                    continue
                distinct = shingle_set(known.of(words))
                sizes.append(len(distinct))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bands.append(band_keys(registers(distinct, orders), by))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": np.array(sizes, dtype=np.int64), "key": keys, "bands": bands,
            })

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id long, n_shingles long, key binary, bands array<long>")


def _linked(ids: list[int], sides: list[int], sets: list[np.ndarray], by: Rule, orders: np.ndarray, pair: tuple[int, int]):
    """A spanning forest of the confirmed links among documents of one block, or between two blocks."""
    regs = np.array([registers(s, orders) for s in sets])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    side = np.array(sides)
    limit = by.percent / 100
    least = limit - SLACK * (limit * (1 - limit) / by.registers) ** 0.5
    roots, out = np.arange(len(ids)), []
    # larger sets first: their neighbours join early and are then passed over
    for a in range(len(ids)):
        near = np.arange(a + 1, len(ids))
        if pair[0] != pair[1]:
            near = near[side[near] != side[a]]
        small, big = np.minimum(sizes[near], sizes[a]), np.maximum(sizes[near], sizes[a])
        near = near[(100 * small >= by.percent * big) & (roots[near] != roots[a])]
        if not len(near):
            continue
        equal = (regs[near] == regs[a]).sum(axis=1)
        for b in near[estimate(equal, int(sizes[a]), sizes[near], by.registers) >= least]:
            if roots[a] == roots[b]:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= by.percent * (sizes[a] + sizes[b] - common):
                out.append((ids[a], ids[b]))
                roots[roots == roots[b]] = roots[a]
    return out


def confirm(texts: DataFrame, by: Rule) -> DataFrame:
    """Confirmed links ``(u, v)``. ``texts`` has ``node, text, cluster, blocks``: each cluster is dealt to its blocks, and
    every pair of blocks is one unit of work, so no task holds more than two blocks."""
    orders = _orders(by.registers)
    block = F.pmod(F.xxhash64("node", "text", F.lit(5)), F.col("blocks")).cast("int")
    dealt = texts.withColumn("side", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    ).select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, now, ids, sides, sets = WordHashes(), None, [], [], []
        for batch in batches:
            links = []
            for cluster, i, j, node, side, text in batch.itertuples(index=False, name=None):
                if (cluster, i, j) != now:
                    if now:
                        links += _linked(ids, sides, sets, by, orders, now[1:])
                    now, ids, sides, sets = (cluster, i, j), [], [], []
                ids.append(node)
                sides.append(side)
                sets.append(shingle_set(known.of(lower_ascii(text).split())))
            yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")
        if now:
            yield pd.DataFrame(_linked(ids, sides, sets, by, orders, now[1:]), columns=["u", "v"], dtype="int64")

    return (
        dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInPandas(run, "u long, v long")
    )


def keep_one(documents: DataFrame, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates: that of its least ``doc_id``.

    Of rows with one ``doc_id`` the one with the least digest of its text stays. Rows without an id stay once per sequence of
    words, and only if no row with an id has the same words. Rows without words link with nothing.
    """
    found = near_duplicates(documents, percent)
    ids = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_llm_id")).agg(F.count("*").alias("_llm_n"))
    joined = documents.join(ids.hint("merge"), documents["doc_id"].cast("long") == ids["_llm_id"])
    order = Window.partitionBy("_llm_id").orderBy(F.xxhash64("text"), "text")
    several = joined.filter("_llm_n > 1").withColumn("_llm_row", F.row_number().over(order)).filter("_llm_row = 1")
    columns = documents.columns
    out = joined.filter("_llm_n = 1").select(*columns).unionByName(several.select(*columns))
    lost = documents.filter("doc_id is null").withColumn("_llm_key", _word_key(F.col("text").cast("string")))
    known = documents.filter("doc_id is not null").select(_word_key(F.col("text").cast("string")).alias("_llm_key"))
    if lost.isEmpty():
        return out
    empty = lost.filter("_llm_key is null")
    single = lost.filter("_llm_key is not null").join(known, "_llm_key", "left_anti").dropDuplicates(["_llm_key"])
    return out.unionByName(empty.select(*columns)).unionByName(single.select(*columns))


def _word_key(text: Column) -> Column:
    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        words = [lower_ascii(t).split() for t in texts]
        return pd.Series([xxhash.xxh3_128_hexdigest(b" ".join(w)) if w else None for w in words], dtype=object)

    return key(text)


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents``.

    Ids are nodes: rows with one ``doc_id`` are one document, linked through any of their texts. Rows without words
    link with nothing. A row without ``doc_id`` takes the component of rows with its words, null where there is none,
    and is kept only in that case. Repeated rows are all kept or all dropped; other columns are ignored.
    """
    by = rule(percent)
    rows = pin(sketch(documents, by), "neardup-rows")
    named = rows.filter("key is not null and doc_id is not null")
    classes = pin(
        named.groupBy("key").agg(
            F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")
        ), "neardup-classes",
    )
    in_bucket = classes.select("node", F.explode("bands").alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top")
    proposed = in_bucket.join(shared, "bucket").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    clusters = components(proposed, "neardup-candidates")
    members = clusters.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(
        clusters.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct()
    )
    members = pin(members.join(classes.groupBy("node").agg(F.sum("n").alias("n")), "node"), "neardup-members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).select(
        "cluster",
        F.greatest(F.ceil(F.col("rows") / BLOCK_DOCUMENTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).alias("blocks"),
    )
    placed = members.join(sizes, "cluster").select("node", "cluster", "blocks")
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    # the clustered documents grow with the corpus, so they are never broadcast
    texts = texts.join(placed.hint("merge"), "node").groupBy("node", F.xxhash64("text").alias("_digest")).agg(
        *[F.any_value(c).alias(c) for c in ("text", "cluster", "blocks")]
    )
    links = confirm(texts, by).unionByName(
        named.join(classes.select("key", "node"), "key").filter("doc_id <> node")
        .select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    )
    found = components(links, "neardup-links").select(F.col("u").alias("_at"), F.col("v").alias("_least"))
    # only rows without id look up their words
    lost = rows.filter("doc_id is null").join(classes.select("key", "node"), "key", "left")
    out = rows.filter("doc_id is not null").withColumn("_at", F.col("doc_id")).unionByName(
        lost.withColumnRenamed("node", "_at").select(*rows.columns, "_at")
    )
    component = F.coalesce("_least", "_at")
    return out.join(found, "_at", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )
