"""Names and constants that the modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The smallest amount, the cap of distances, the letters in order of their codes.
EPS = 1e-7
MAX_DIST = 25_000
LETTERS = "ATGC"

SITE = ["chromo", "pos"]
#: Width of the position bins of two-level windows, in bases.
BIN = 1 << 10


def need(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
