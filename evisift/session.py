"""Session helpers: recommended settings, the shared scratch folder and table pinning."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. AQE splits skewed join partitions, turns joins with a
# measured small side into broadcast joins and coalesces small shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

def build_session(master: str | None = None, app: str = "evisift", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for pinned tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session whose executors are threads of this process gets a new folder and keeps
    it in that setting; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table of this application."""
    return f"{_pin_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release_pins(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must be written before."""
    discard(spark, _pin_folder(spark))


def _pin_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/evisift/{spark.sparkContext.applicationId}"


def store(df: DataFrame, path: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to ``path`` and read it back with its schema."""
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives executor loss, stops several branches from recomputing the
    same upstream, and gives the planner a measured size, so it broadcasts the table only when it
    really is below ``spark.sql.autoBroadcastJoinThreshold``. With ``partition_by`` a later join on that
    column reads only the partitions it meets.
    """
    return store(df, scratch_path(df.sparkSession, name), partition_by, compression)
