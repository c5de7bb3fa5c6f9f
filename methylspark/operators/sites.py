"""Target sites, the grid of sites and cells, and statistics over cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import statistic
from ..schema import BIN, SITE, need
from ..staging import staged
from .running import first_rows, running

MAX_CELLS = 100_000


def union_positions(*profiles: DataFrame) -> DataFrame:
    """Every different site of the profiles, in order."""
    return reduce(DataFrame.union, [need(p, *SITE).select(*SITE) for p in profiles]).distinct().orderBy(*SITE)


def cell_names(profiles: DataFrame) -> list[str]:
    """The cells; they become columns or array elements, so their number is bounded."""
    names = sorted(r.cell for r in profiles.select("cell").distinct().limit(MAX_CELLS + 1).collect())
    if len(names) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    return names


def map_to_positions(sites: DataFrame, profiles: DataFrame, cells: list[str] | None = None) -> DataFrame:
    """``chromo, pos, cell, value`` for every site and cell; null where not observed, other source rows dropped."""
    cells = cell_names(profiles) if cells is None else cells
    grid = sites.select(*SITE, F.explode(F.array(*[F.lit(c) for c in cells])).alias("cell"))
    return grid.join(profiles.select(*SITE, "cell", "value"), [*SITE, "cell"], "left")


def wide(grid: DataFrame, cells: list[str]) -> DataFrame:
    """One column per cell."""
    return grid.groupBy(*SITE).agg(*[F.max(F.when(F.col("cell") == c, F.col("value"))).alias(c) for c in cells])


def keep_target_rows(profiles: DataFrame, sites: DataFrame) -> DataFrame:
    return profiles.join(sites.select(*SITE), SITE, "left_semi")


def unobserved_sites(sites: DataFrame, profiles: DataFrame, cells: list[str] | None = None) -> DataFrame:
    """Sites and cells without an observation."""
    cells = cell_names(profiles) if cells is None else cells
    grid = sites.select(*SITE, F.explode(F.array(*[F.lit(c) for c in cells])).alias("cell"))
    return grid.join(profiles.filter("value IS NOT NULL"), [*SITE, "cell"], "left_anti")


def coverage_filter(profiles: DataFrame, min_cells: int = 1) -> DataFrame:
    """Sites that at least so many cells observe, with their number."""
    return profiles.groupBy(*SITE).agg(F.count("value").alias("cov")).filter(F.col("cov") >= min_cells)


def duplicate_sites(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("cell", *SITE).agg(F.count("*").alias("n")).filter("n > 1")


def gated(names: list[str], min_cells: int = 3) -> dict[str, Column]:
    """Statistics of ``value`` over cells, by name; null where fewer than ``min_cells`` observe it."""
    v = F.col("value")
    return {n: F.when(F.count(v) >= min_cells, statistic(n)(v)) for n in names}


def site_stats(profiles: DataFrame, names: list[str], min_cells: int = 3, by: list[str] = SITE) -> DataFrame:
    """Statistics over the cells of each site, null where fewer than ``min_cells`` observe it."""
    return profiles.groupBy(*by).agg(*[c.alias(n) for n, c in gated(names, min_cells).items()])


def output_stats(outputs: DataFrame) -> DataFrame:
    """``output, nb_tot, nb_obs, frac_obs, mean, var`` from long ``output, value``."""
    v = F.col("value")
    return outputs.groupBy("output").agg(
        F.count("*").alias("nb_tot"), F.count(v).alias("nb_obs"), (F.count(v) / F.count("*")).alias("frac_obs"), F.avg(v).alias("mean"), F.var_pop(v).alias("var")
    )


def stats_long(stats: DataFrame) -> DataFrame:
    """``output, metric, value``, best covered outputs first."""
    names = [c for c in stats.columns if c != "output"]
    doubles = stats.select("output", *[F.col(c).cast("double").alias(c) for c in names])
    cov = doubles.withColumn("__cov", F.col("frac_obs"))
    return cov.unpivot(["output", "__cov"], names, "metric", "value").orderBy(F.desc("__cov"), "output", "metric").drop("__cov")


def filter_chromos(df: DataFrame, chromos: list[str]) -> DataFrame:
    """Rows of these chromosomes; an error if there are none."""
    out = df.filter(F.col("chromo").isin(*chromos))
    if out.isEmpty():
        raise ValueError(f"no rows of chromosomes {', '.join(chromos)}")
    return out


def region_query(df: DataFrame, chromo: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of one chromosome from ``start`` to ``end``, both included; 0 is a position like any other."""
    keep = F.col("chromo") == chromo
    if start is not None:
        keep &= F.col("pos") >= start
    if end is not None:
        keep &= F.col("pos") <= end
    return df.filter(keep)


def select_outputs(df: DataFrame, patterns: list[str], n: int | None = None) -> DataFrame:
    """Different output names that match any pattern, in order, at most ``n``."""
    match = reduce(lambda a, b: a | b, [F.col("output").rlike(p) for p in patterns])
    out = df.filter(match).select("output").distinct().orderBy("output")
    return out if n is None else out.limit(n)


def split_by_chromo(df: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """``df`` with ``part``: the name of the first list that holds the chromosome, else null."""
    part: Column = F.lit(None).cast("string")
    for name, chromos in reversed(parts.items()):
        part = F.when(F.col("chromo").isin(*chromos), name).otherwise(part)
    return df.withColumn("part", part)


def sort_sites(df: DataFrame) -> DataFrame:
    return df.orderBy(*SITE)


def first_n_sites(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*SITE).limit(n)


def shuffle_key(keys: list[str], seed: int = 0) -> Column:
    """What rows are shuffled and sampled by: the MD5 of seed and keys, which every engine has."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_per_chromo(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each chromosome, those of smallest hash of seed and site.

    Rows are counted first, and of a chromosome of many rows only those below a hash that about ``n`` of
    them lie under are moved and ranked. Should that be too few anywhere, those chromosomes are ranked
    in full, so the rows are the same in any case.
    """
    key = shuffle_key(SITE, seed)
    order = [key, *[F.col(c) for c in SITE]]
    counts = staged(df.groupBy("chromo").agg(F.count("*").alias("__n")), "chromo-counts")
    share = (n + 6 * n**0.5 + 10) / F.col("__n")  # six deviations more than needed
    cut = counts.select(F.col("chromo").alias("__c"), "__n", F.least(share, F.lit(1.0)).alias("__share"))
    unit = F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))  # rises with the hash
    few = df.join(cut, F.col("chromo").eqNullSafe(F.col("__c"))).filter(unit <= F.col("__share"))
    few = staged(few.select(*df.columns), "sampled")
    kept = few.groupBy(F.col("chromo").alias("__c")).agg(F.count("*").alias("__kept"))
    short = counts.join(kept, F.col("chromo").eqNullSafe(F.col("__c")), "left").filter(F.coalesce("__kept", F.lit(0)) < F.least(F.lit(n), F.col("__n"))).select(F.col("chromo").alias("__c"))
    out = first_rows(few, ["chromo"], order, n, SITE).drop("__rank")
    if short.isEmpty():
        return out
    same = F.col("chromo").eqNullSafe(F.col("__c"))
    again = first_rows(df.join(short, same, "left_semi"), ["chromo"], order, n, SITE).drop("__rank")
    return out.join(short, same, "left_anti").unionByName(again)


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 0, n: int | None = None) -> DataFrame:
    """Rows in the order of a hash of seed and keys; at most ``n``."""
    out = df.orderBy(shuffle_key(keys, seed), *keys)
    return out if n is None else out.limit(n)


def assign_chunks(sites: DataFrame, chunk_size: int = 32_768) -> DataFrame:
    """``sites`` with ``chunk`` and the rows ``[start, end)`` of it within the chromosome."""
    bin = F.floor(F.col("pos") / BIN)
    n = running(sites, ["chromo"], ["pos"], bin, {"__n": ("count", F.lit(1))})
    totals = sites.groupBy("chromo").agg(F.count("*").alias("__all"))
    chunk = F.floor((F.col("__n") - 1) / chunk_size).cast("long")
    return n.join(totals, "chromo").select(
        *sites.columns, chunk.alias("chunk"), (chunk * chunk_size).alias("start"), F.least((chunk + 1) * chunk_size, F.col("__all")).alias("end")
    )


def concat_tables(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def validate_values(profiles: DataFrame) -> DataFrame:
    """Rows whose value is not in [0, 1] (null is not observed and fine)."""
    return profiles.filter("value < 0 OR value > 1 OR isnan(value)")


def infer_binary(profiles: DataFrame) -> DataFrame:
    """``cell, is_binary``: whether all values of a cell are 0 or 1."""
    v = F.col("value")
    return profiles.groupBy("cell").agg(F.bool_and(F.coalesce((v == 0) | (v == 1), F.lit(True))).alias("is_binary"))


