"""A store of site tables, clustered by chromosome and position, with the bounds of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SITE

#: Files that a query names one by one; a region that needs more is most of the store, which is then read as a whole.
MOST_FILES = 1000
_BOUNDS = "_bounds"  # hidden from readers of the folder


def write_site_store(rows: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """``rows`` (``chromo, pos`` and more) as Parquet files that are ranges of sites, about ``rows_per_file`` each, and a table of their bounds.

    Files are dealt out by range, so neighbouring sites are in one file and the files of a region are
    few; a file may span chromosomes, which then have bounds of their own. Rows of one site stay together. Null chromosomes and positions
    come first and are in the store, but in no region. Without rows there are no bounds.
    """
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // rows_per_file))
    rows.repartitionByRange(n, *SITE).sortWithinPartitions(*SITE).write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file"), "chromo")
    found.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/{_BOUNDS}")  # a row per file and chromosome


def file_bounds(spark: SparkSession, path: str) -> DataFrame:
    """``file, chromo, low, high, rows`` of a store."""
    return spark.read.schema("file string, chromo string, low long, high long, rows long").parquet(f"{path}/{_BOUNDS}")


def read_region(spark: SparkSession, path: str, chromo: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The rows of a store with ``start <= pos <= end`` on a chromosome; no bound where one is None.

    Only files whose bounds meet the region are opened, and in them Parquet's own statistics leave out
    row groups. A region that no file meets has no rows.
    """
    schema = spark.read.parquet(path).schema
    hits = file_bounds(spark, path).filter(F.col("chromo") == chromo)
    region = F.col("chromo") == chromo
    if start is not None:
        hits, region = hits.filter(F.col("high") >= start), region & (F.col("pos") >= start)
    if end is not None:
        hits, region = hits.filter(F.col("low") <= end), region & (F.col("pos") <= end)
    files = [r["file"] for r in hits.select("file").distinct().limit(MOST_FILES + 1).collect()]
    if not files:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema)
    return (read.parquet(*[f"{path}/{f}" for f in sorted(files)]) if len(files) <= MOST_FILES else read.parquet(path)).filter(region)
