"""Functions of arrays: window slices, DNA codes, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LETTERS, MAX_DIST


def center_slice(a: Column, delta: int, odd: bool) -> Column:
    """The ``2 * delta + 1`` (odd windows) or ``2 * delta`` (even) middle elements."""
    start = F.floor(F.size(a) / 2).cast("int") - delta + 1
    return F.slice(a, start, F.lit(2 * delta + odd))


def window_columns(a: Column, size: int, odd: bool) -> list[Column]:
    """The elements as columns named by their offset; the centre of an odd window is ``[0]``."""
    half = size // 2
    offsets = [i - half if odd or i < half else i - half + 1 for i in range(size)]
    return [F.element_at(a, i + 1).alias("[0]" if o == 0 else f"{o:+d}") for i, o in enumerate(offsets)]


def encode_dna(s: Column) -> Column:
    """Letters to codes (position in ``LETTERS``; N is 4); other letters give null."""
    return F.transform(F.split(F.translate(F.upper(s), LETTERS + "N", "01234"), ""), lambda x: x.try_cast("tinyint"))


def decode_dna(codes: Column) -> Column:
    letters = F.array(*[F.lit(x) for x in LETTERS + "N"])
    return F.array_join(F.transform(codes, lambda x: F.get(letters, x.cast("int"))), "")


def onehot_dna(codes: Column) -> Column:
    """Four numbers for each code, all zero for N and null."""
    return F.transform(codes, lambda x: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce((x == i).cast("tinyint"), F.lit(0).cast("tinyint"))))


def onehot_argmax(rows: Column) -> Column:
    """Codes of one-hot rows; a row without a one has code 4."""
    def code(r: Column) -> Column:
        at = F.array_position(r, F.lit(1).cast("tinyint"))
        return F.when(at > 0, at - 1).otherwise(4).cast("tinyint")

    return F.transform(rows, code)


def onehot_class(label: Column, n: int = 3) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((label == i).cast("int"), F.lit(0)))


def normalized_states(state: Column) -> Column:
    return F.transform(state, lambda x: F.coalesce(x, F.lit(0.5)))


def normalized_distances(dist: Column, cap: int = MAX_DIST) -> Column:
    return F.transform(dist, lambda d: F.coalesce(F.least(d.cast("double"), F.lit(float(cap))) / cap, F.lit(1.0)))


def linear_weights(n: Column, start: float = 0.1) -> Column:
    """Weights that rise evenly from ``start`` to 1 in the centre, and fall again."""
    half = F.ceil(n / 2).cast("int")
    step = F.when(half > 1, F.lit(1 - start) / (half - 1)).otherwise(0.0)
    rise = F.lit(1.0) if start == 1 else F.lit(start)

    def weight(i: Column) -> Column:
        k = F.least(i, n - 1 - i)  # from the nearer end
        return F.when(k == half - 1, F.when(half > 1, 1.0).otherwise(rise)).otherwise(rise + step * k)

    return F.transform(F.sequence(F.lit(0), n - 1), weight)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


AGGREGATES = ("mean", "wmean", "max")


def aggregate_window(a: Column, how: str) -> Column:
    """One number for an array: ``mean``, ``wmean`` (by ``linear_weights``) or ``max``."""
    a = F.transform(a, lambda x: x.cast("double"))
    if how == "mean":
        return F.try_divide(_sum(a), F.size(a))
    if how == "wmean":
        w = linear_weights(F.size(a))
        return F.try_divide(_sum(F.zip_with(a, w, lambda x, y: x * y)), _sum(w))
    if how == "max":
        return F.array_max(a)
    raise ValueError(f"no aggregate {how!r}; there are {', '.join(AGGREGATES)}")
