"""Sinks: nested JSON, text and HTML reports, vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One object a row; null fields vanish."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def json_column(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(out))


def texts(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def vectors(df: DataFrame, path: str) -> None:
    """Partitioned by normalised vendor, so that a query for one vendor reads one folder."""
    from ..functions.text import alnum

    df.withColumn("vendor", alnum(F.col("vendor"))).write.mode("overwrite").partitionBy("vendor").parquet(path)


def replaced_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file written beside its target and then renamed over it: readers see the old file or the new one, and a crash in between leaves the old one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(own, jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE), _no_options(spark))
    try:
        out.write(text.encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    files.rename(own, target, options)


def _no_options(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$CreateOpts")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.createParent()
    return options


def with_sentinels(df: DataFrame, sentinels: dict[str, str]) -> DataFrame:
    """Nulls as the words a report shows."""
    return df.fillna(sentinels)


def data_uri(df: DataFrame, content: str = "content", out: str = "uri", mime: str = "image/jpeg") -> DataFrame:
    return df.withColumn(out, F.concat(F.lit(f"data:{mime};base64,"), F.base64(content)))
