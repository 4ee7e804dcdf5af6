"""Tables that several branches of a plan read, written once to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str, by: str | None = None, parts: int = 1) -> DataFrame:
    """df written below spark.checkpoint.dir (in local mode a temporary folder where that is unset) and read again, so that what made it runs once.

    With `by`, in `parts` buckets of that column, so that later joins and aggregations by it and other columns need no exchange. Each task
    writes a file for every bucket it has rows of: one where df comes from repartition(parts, by)."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rackmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/rackmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # only the catalog knows buckets; the files stay when the table is dropped, and so does the plan that reads them
    view = f"rackmill_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, by).saveAsTable(view)
    out = spark.table(view)
    spark.sql(f"drop table {view}")
    return out
