"""Statistics in windows around sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import statistic
from ..schema import SITE
from .neighbors import knn_neighbors


def cell_means(lengths: list[int]) -> list[Column]:
    """``mean_<length>`` for rows of ``knn_neighbors`` with ``value``: the cell's mean in each window.

    It is over the site itself (rounded half to even) and those of its k + k neighbours that are at most
    half the length away; null where there is none.
    """
    near = F.arrays_zip(F.col("state").alias("s"), F.col("dist").alias("d"))
    pairs = F.filter(F.concat(near, F.array(F.struct(F.bround(F.col("value")).alias("s"), F.lit(0.0).alias("d")))), lambda x: x["s"].isNotNull())

    def mean(wlen: int) -> Column:
        inside = F.filter(pairs, lambda x: x["d"] <= wlen // 2)
        return F.try_divide(F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["s"]), F.size(inside))

    return [mean(n).alias(f"mean_{n}") for n in lengths]


def stats_of_means(names: list[str], length: int) -> dict[str, Column]:
    """Statistics over cells of ``mean_<length>``, by name; null where no cell observes anything."""
    v = F.col(f"mean_{length}")
    return {n: F.when(F.count(v) > 0, statistic(n)(v)) for n in names}


def window_stats(targets: DataFrame, profiles: DataFrame, names: list[str], lengths: list[int], k: int = 25) -> DataFrame:
    """``chromo, pos, wlen`` and statistics over cells of each cell's mean in the window (``cell_means``).

    All lengths come from one pass over the neighbours, and from one aggregation.
    """
    near = knn_neighbors(targets, profiles, k, own=True).select(*SITE, *cell_means(lengths))
    one = lambda n: F.struct(F.lit(n).alias("wlen"), *[c.alias(m) for m, c in stats_of_means(names, n).items()]).alias(f"__{n}")
    wide = near.groupBy(*SITE).agg(*[one(n) for n in lengths])
    return wide.select(*SITE, F.inline(F.array(*[F.col(f"__{n}") for n in lengths])))


def range_window_stats(targets: DataFrame, profiles: DataFrame, names: list[str], wlen: int) -> DataFrame:
    """Like ``window_stats``, over all observed sites in the window and not just k + k.

    Windows are cut at bins of ``wlen`` bases; observed sites are copied to the bins that
    their windows reach, so no task holds a whole chromosome.
    """
    half = wlen // 2
    seen = profiles.filter("value IS NOT NULL").select(*SITE, "cell", "value")
    rows = targets.select(*SITE, "cell").distinct().withColumn("__t", F.lit(True)).join(seen, [*SITE, "cell"], "full")
    size = max(wlen, 1 << 12)
    at = lambda p: F.floor(p / size)
    pos = F.col("pos")
    bins = F.when(F.col("value").isNull(), F.array(at(pos))).otherwise(F.array_distinct(F.array(at(pos - half), at(pos), at(pos + half))))
    spread = rows.withColumn("__own", at(pos)).withColumn("__bin", F.explode(bins))
    w = Window.partitionBy("chromo", "cell", "__bin").orderBy("pos").rangeBetween(-half, half)
    means = spread.withColumn("mean", F.avg("value").over(w)).filter("__t AND __bin = __own")
    return means.groupBy(*SITE).agg(*[F.when(F.count("mean") > 0, statistic(n)(F.col("mean"))).alias(n) for n in names])
