"""Statistics of a group of values as aggregate columns; missing values (null) don't count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPS

#: Upper edges of the variance classes: three equal bins of (-EPS, 0.25], closed on the right.
EDGES = [-EPS + (0.25 + EPS) * i / 3 for i in (1, 2)]


def mode(v: Column) -> Column:
    """The mean rounded half to even."""
    return F.bround(F.avg(v)).cast("int")


def cat_var(v: Column) -> Column:
    var = F.var_pop(v)
    return F.when(var <= EDGES[0], 0).when(var <= EDGES[1], 1).when(var.isNotNull(), 2)


def cat2_var(v: Column) -> Column:
    return F.when(cat_var(v) == 0, 0).when(cat_var(v) > 0, 1)


def entropy(v: Column) -> Column:
    """Binary entropy (natural logarithm) of the mean."""
    p = F.when(F.avg(v).isNotNull(), F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.avg(v))))
    return -(p * F.ln(p) + (1 - p) * F.ln(1 - p))


STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "mode": mode,
    "var": F.var_pop,
    "cat_var": cat_var,
    "cat2_var": cat2_var,
    "entropy": entropy,
    "diff": lambda v: (F.min(v) != F.max(v)).cast("int"),
    "cov": lambda v: F.count(v).cast("int"),
}


def statistic(name: str) -> Callable[[Column], Column]:
    """The statistic of a name in any case, or an error that lists them."""
    try:
        return STATISTICS[name.lower()]
    except KeyError:
        raise ValueError(f"no statistic {name!r}; there are {', '.join(STATISTICS)}") from None
