"""Shared storage, checked broadcasts and input guards of the operators in this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow (at most three 8-byte columns) table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rackmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rackmill/{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and survives lost executors, and the shuffle files
    of the writing job go when it ends. The path is added to `made`, for drop()."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, made: list[str]) -> None:
    """Deletes what materialize() wrote; nothing that is read later may depend on it."""
    jvm = spark.sparkContext._jvm
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most `limit` rows; otherwise Spark shuffles both sides. df is cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
