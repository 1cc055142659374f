"""Spark session and cluster-level helpers shared by every plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for a broadcast side.  A side is broadcast only after its size in bytes has been
# measured below this bound (see ``broadcast_if_small``); otherwise the join stays a
# shuffle join and AQE decides at runtime.
BROADCAST_MAX_BYTES = 64 << 20


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "palimpsest") -> SparkSession:
    """Session with AQE, skew-join handling and Arrow enabled; the UI stays off."""
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Python kernels are CPU-heavy on few bytes: do not let AQE merge their input into a couple of
        # partitions (only matters for small data; large shuffles are far above this size)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir`` (a shared folder); only when it is unset,
    as in local tests, fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="palimpsest-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet under the shared checkpoint folder and read back: whoever reads it next reads the columns
    it needs, compressed, and computes nothing again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Measured size of a DataFrame's values: 8 bytes a number, the bytes of strings and binaries, the JSON text
    of nested values.  One aggregate row; partial sums on the executors."""
    def width(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.octet_length(c)
        if kind.startswith(("array", "map", "struct")):
            return F.octet_length(F.to_json(F.struct(c)))
        return F.lit(8)
    row = F.lit(16)
    for name, kind in df.dtypes:
        row = row + F.coalesce(width(name, kind), F.lit(0))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a measured size bound; larger sides stay shuffle joins."""
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
