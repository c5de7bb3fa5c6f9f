"""Running aggregates and first rows in two levels.

A window over a whole chromosome puts it in one task. Here rows are first cut into bins of
the order column; a window runs within each bin, another over one row per bin, and the
sum of both is what a single window would give. No task holds more than a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Least number of parts that the rows of a group are dealt into before the first of each part meet.
PARTS = 64

HOW = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
FIRST = Window.unboundedPreceding


def running(df: DataFrame, by: list[str], order: list[str], bin: Column, columns: dict[str, tuple], before: bool = False, reverse: bool = False) -> DataFrame:
    """``df`` with, for each name, the aggregate of all rows up to this one in the order.

    ``columns`` maps names to (one of sum, max, min, count; value), or to (how, value, True) for
    the rows from this one on; all come from one pass. ``bin`` must rise with the first
    order column. ``before`` leaves the row itself out; ``reverse`` turns the order around.
    Rows that tie in ``order`` are taken in any order.
    """
    rows = df.withColumn("__bin", bin)
    spec = {n: (how, v, bool(onward and onward[0]) != reverse) for n, (how, v, *onward) in columns.items()}
    turned = lambda onward, *cs: [F.col(c).desc() if onward else F.col(c).asc() for c in cs]  # noqa: E731  a frame that grows from the far end, as one that shrinks is slow
    inner = lambda onward: Window.partitionBy(*by, "__bin").orderBy(*turned(onward, *order)).rowsBetween(FIRST, -int(before))
    outer = lambda onward: Window.partitionBy(*by).orderBy(*turned(onward, "__bin")).rowsBetween(FIRST, -1)
    bins = rows.groupBy(*by, "__bin").agg(*[HOW[how](v).alias(f"__t_{n}") for n, (how, v, _) in spec.items()])
    carry = lambda how, n, onward: (F.sum if how in ("sum", "count") else HOW[how])(F.col(f"__t_{n}")).over(outer(onward))
    bins = bins.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__bin").alias("__b_bin"), *[carry(how, n, onward).alias(f"__c_{n}") for n, (how, _, onward) in spec.items()])
    local = rows.select("*", *[HOW[how](v).over(inner(onward)).alias(f"__l_{n}") for n, (how, v, onward) in spec.items()])
    on = [local[c].eqNullSafe(bins[f"__b_{c}"]) for c in by] + [local["__bin"].eqNullSafe(bins["__b_bin"])]
    met = local.join(bins, on)

    def both(how: str, n: str) -> Column:
        a, b = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if how in ("sum", "count"):
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.greatest(a, b) if how == "max" else F.least(a, b)

    return met.select(*df.columns, *[both(how, n).alias(n) for n, (how, _, _) in spec.items()])


def equi_depth(df: DataFrame, by: list[str], order: str, label: str = "scores") -> DataFrame:
    """``df`` with a bin ``__b`` for ``running`` that holds about as many rows as any other, whatever the values of ``order``.

    Spark samples the splitters from group and value together, so that large groups are cut into
    many bins and small ones share one; rows that tie are in one bin, so aggregate them before. Bins rise with ``order``
    within a group (null and NaN where Spark sorts them). The rows are written once: the bins of a second reading could differ.
    """
    dealt = df.repartitionByRange(*by, order).withColumn("__b", F.spark_partition_id().cast("long"))
    return staged(dealt, label)


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int, keys: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``__rank``: the first ``n`` rows of each group in the order, ranked from 1.

    Rows are dealt out by a hash of ``keys`` into as many parts as there are shuffle partitions, and of each part the
    first ``n`` go on, so that a group's last task sees at most ``parts * n`` rows.
    """
    parts = parts or max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    part = Window.partitionBy(*by, "__part").orderBy(*order)
    few = dealt.withColumn("__rank", F.row_number().over(part)).filter(F.col("__rank") <= n).drop("__part", "__rank")
    return few.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= n)
