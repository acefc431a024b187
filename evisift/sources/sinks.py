"""Run artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift import __version__


def config_hash(config: dict) -> Column:
    """SHA-256 of the configuration as JSON with sorted keys."""
    import json

    return F.sha2(F.lit(json.dumps(config, sort_keys=True)), 256)


def write_run(tables: dict[str, DataFrame], folder: str, run_id: str, config: dict, fmt: str = "parquet") -> None:
    """Write each table under ``folder/<name>/run_id=<run_id>``; every row names run, version and config.

    A run that exists already is not overwritten: Spark's default error mode refuses it.
    """
    for name, table in tables.items():
        stamped = table.withColumns(
            {"project_version": F.lit(__version__), "config_hash": config_hash(config)}
        )
        stamped.write.format(fmt).save(f"{folder.rstrip('/')}/{name}/run_id={run_id}")


def read_run(spark, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """All runs of one table, partitioned by ``run_id``."""
    return spark.read.format(fmt).load(f"{folder.rstrip('/')}/{name}")
