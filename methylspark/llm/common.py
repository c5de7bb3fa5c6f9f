"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..staging import scratch_dir, scratch_path, staged, unstage

__all__ = ["gathered", "join_by_size", "scratch_dir", "scratch_path", "staged", "table", "unit_hash", "unstage"]

#: A key with more than this share of all rows is joined by a broadcast.
HOT_SHARE = 1 / 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered(df: DataFrame, label: str) -> Iterator[Row]:
    """The rows of ``df`` at the driver, a part of its written files at a time.

    ``toLocalIterator`` runs a job for each partition one after the other, empty ones too. So all partitions are written in one job first,
    and what is read back has as many as its bytes call for.
    """
    found = staged(df, label)
    yield from found.toLocalIterator()
    unstage(found)


def unit_hash(*cols, bits: int = 52):
    """A number in [0, 1) from the MD5 of the columns, the same in every engine."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long") / F.lit(float(1 << bits))


def join_by_size(rows: DataFrame, names: DataFrame, on: list[str], size: str, total: int, how: str) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``names``, of which each key ``on`` is one row and ``size`` says how many rows have it.

    Keys of more than ``HOT_SHARE`` of the ``total``, which the sizes add up to at most, are fewer than its inverse: they are
    broadcast, so that the rows of one key don't meet in a task. All others are shuffled.
    """
    hot = names.filter(F.col(size) > total * HOT_SHARE)
    rest = names.filter(F.col(size) <= total * HOT_SHARE)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return cold.unionByName(rows.join(F.broadcast(hot), on))
