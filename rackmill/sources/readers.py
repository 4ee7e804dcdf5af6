"""Sources: listings, dimensions, pages and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def any_case(extensions: Sequence[str]) -> str:
    """A glob for files with one of the extensions, whatever their letter case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


IMAGE_GLOB = any_case(("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff"))
VIDEO_GLOB = any_case(("mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "m4v"))


def files(spark: SparkSession, folder: str, glob: str = IMAGE_GLOB, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of the files. Without content no byte is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(folder)
    return df if content else df.drop("content")


def first_video(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder, VIDEO_GLOB, recursive=False).orderBy("path").limit(1)


def first_readable(spark: SparkSession, paths: Sequence[str], header: bool = True) -> DataFrame | None:
    """The first CSV of the candidates that exists."""
    for p in paths:
        try:
            return spark.read.option("header", header).csv(p)
        except AnalysisException:
            continue
    return None


def discovered(df: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns whose name holds a word, else by position: wanted is (new name, word)."""
    out = []
    for k, (name, word) in enumerate(wanted):
        own = next((c for c in df.columns if word in c.lower()), df.columns[min(k, len(df.columns) - 1)])
        out.append(F.col(f"`{own}`").alias(name))
    return df.select(out)


def aliases(lines: DataFrame, column: str = "value") -> DataFrame:
    """canonical, alias from ragged comma-separated rows without a header; the first cell is canonical and its own alias."""
    cells = F.filter(F.transform(F.split(column, ","), lambda c: F.trim(c)), lambda c: c != "")
    return lines.select(F.get(cells, F.lit(0)).alias("canonical"), F.explode(cells).alias("alias")).distinct()


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole JSON files; a corrupt one has a null value."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value", F.try_parse_json("value").alias("parsed"))


def html_reports(spark: SparkSession, folder: str) -> DataFrame:
    """name and html, as UTF-8 or else Latin-1."""
    raw = files(spark, folder, any_case(("html",)), recursive=False, content=True)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), text.alias("html"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Reference vectors, one folder for each vendor; a filter on vendor reads its folder only."""
    return spark.read.parquet(path)


def still_valid(cache: DataFrame, listing: DataFrame) -> bool:
    """A feature cache may be used while any of its paths still exists."""
    return not cache.select("path").join(listing.select("path"), "path", "left_semi").isEmpty()
