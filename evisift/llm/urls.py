"""URL rules in a memory-mapped sorted array of 64-bit digests.

A rule is a host and a path beginning: it fits that host and all its subdomains. Its key, ``host + path``, is stored as
an xxhash digest in a sorted array beside the full strings. A url gives one key per (host suffix, length of a rule's
path); all keys of a batch are sought with one vectorised binary search, and a hit counts only if the stored string is
the sought one, so colliding digests do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.session import scratch_root

# Rules per block; a longer list is applied block by block, so no worker maps more than this.
BLOCK_RULES = 1_000_000
SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """One block: counts, sorted digests, offsets into the strings, the strings (key, host length, verdict)."""
    entries = sorted((digest(host + path), f"{host + path}\n{len(host)}\n{verdict}") for host, path, verdict in rules)
    blobs = [text.encode("utf-8", "surrogatepass") for _, text in entries]
    offsets = np.cumsum([0, *map(len, blobs)], dtype=np.uint64)
    lengths = np.unique(np.array([len(path) for _, path, _ in rules], dtype=np.uint64))
    head = np.array([len(entries), len(lengths)], dtype=np.uint64)
    digests = np.array([d for d, _ in entries], dtype=np.uint64)
    return b"".join([head.tobytes(), lengths.tobytes(), digests.tobytes(), offsets.tobytes(), *blobs])


class DigestArray:
    """A packed block, read through a memory map."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, k = (int(x) for x in raw[:16].view(np.uint64))
        at = 16 + 8 * k
        self.path_lengths = [int(x) for x in raw[16:at].view(np.uint64)]
        self.digests = raw[at:at + 8 * n].view(np.uint64)
        self.offsets = raw[at + 8 * n:at + 16 * n + 8].view(np.uint64)
        self.strings = raw[at + 16 * n + 8:]

    def entry(self, at: int) -> tuple[str, int, str]:
        start, end = int(self.offsets[at]), int(self.offsets[at + 1])
        key, host, verdict = self.strings[start:end].tobytes().decode("utf-8", "surrogatepass").rsplit("\n", 2)
        return key, int(host), verdict

    def find(self, keys: list[str], hosts: list[int]) -> list[str | None]:
        """The verdict stored for each key whose rule has a host of the given length."""
        sought = np.fromiter((digest(key) for key in keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, sought)
        found: list[str | None] = [None] * len(keys)
        inside = np.minimum(first, max(len(self.digests) - 1, 0))
        for at in np.flatnonzero(self.digests[inside] == sought) if len(self.digests) else ():
            here = int(first[at])
            while here < len(self.digests) and self.digests[here] == sought[at]:
                key, host, verdict = self.entry(here)
                if key == keys[at] and host == hosts[at]:
                    found[at] = verdict
                    break
                here += 1
        return found


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``; a null url or one without ``://`` has neither."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


@dataclass
class _Block:
    """A packed block that Spark ships to every executor's work folder."""

    name: str


def _ship(spark: SparkSession, packed: bytes) -> _Block:
    name = f"digests-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/evisift/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return _Block(name)


def _blocks(rules: DataFrame) -> Iterator[list[tuple[str, str, str]]]:
    """Distinct rules, at most about ``BLOCK_RULES`` at once; of rules with one host and path the least verdict holds."""
    kept = rules.select(
        F.col("rule_host").alias("h"), F.col("rule_path").alias("p"), F.col("rule_verdict").alias("v")
    ).dropna().groupBy("h", "p").agg(F.min("v").alias("v"))
    blocks = -(-kept.count() // BLOCK_RULES)
    for n in range(blocks):
        mine = kept.filter(F.pmod(F.xxhash64("h", "p"), F.lit(blocks)) == n) if blocks > 1 else kept
        yield [tuple(row) for row in mine.collect()]


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", carry: str = "page_id") -> DataFrame:
    """``carry, host, path, rule, verdict`` for every row of ``pages``; ``rule`` is null where none fits.

    The longest key wins, and of keys equally long the one with the longer host. A url in no rule gets
    ``default``. Null and malformed urls have empty parts and get ``default``; an empty list judges all so. Repeated
    pages stay repeated, other columns are ignored. ``rules`` has columns ``rule_host, rule_path, rule_verdict``;
    rows with a null are no rules.
    """
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select(F.col(carry).alias(carry), host.alias("host"), path.alias("path")).withColumns(
        {"_key": F.lit(None).cast("string"), "_host": F.lit(0), "_verdict": F.lit(None).cast("string")}
    )
    kind = urls.schema[carry].dataType.simpleString()
    schema = f"`{carry}` {kind}, host string, path string, _key string, _host int, _verdict string"
    for block in _blocks(rules):
        urls = urls.mapInPandas(_prober(_ship(pages.sparkSession, pack(block)).name), schema)
    return urls.select(
        carry, "host", "path", F.col("_key").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict")
    )


def _prober(name: str):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            rows, keys, lengths = [], [], []
            for row, (host, path) in enumerate(zip(batch["host"], batch["path"], strict=True)):
                labels = host.split(".")
                for n in range(len(labels)) if host else ():
                    suffix = ".".join(labels[n:])
                    for size in array.path_lengths:
                        if size <= len(path):
                            rows.append(row)
                            keys.append(suffix + path[:size])
                            lengths.append(len(suffix))
            best = list(zip(batch["_key"], batch["_host"], batch["_verdict"], strict=True))
            for row, key, length, verdict in zip(rows, keys, lengths, array.find(keys, lengths), strict=True):
                old = best[row]
                if verdict is not None and (old[2] is None or (len(key), length) > (len(old[0]), old[1])):
                    best[row] = (key, length, verdict)
            out = batch.copy()
            out["_key"], out["_host"], out["_verdict"] = (
                (list(x) for x in zip(*best, strict=True)) if best else ([], [], [])
            )
            yield out.astype({"_host": "int32"})

    return probe
