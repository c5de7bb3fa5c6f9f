"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: the share that it should have of the mixture
over the share that it has. A document's number of copies is a Poisson number of that
mean, found by inverting the distribution at a number hashed from seed and id; it is the
same in every run and on every layout. Documents are exploded by their number of copies
and dealt out by a hash of seed, id and copy, which shuffles the whole corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unit_hash

#: Distribution functions of more bytes than this together are joined by a shuffle and not by a broadcast.
MAX_BROADCAST_BYTES = 32 << 20
#: Up to this rate a distribution function is tabulated from 0, beyond it from where it is no longer 0 in doubles.
WHOLE_RATE = 4096


def repetition_rates(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
) -> DataFrame:
    """``source, chars, rate``: how often a document of each source appears on average.

    ``weights`` gives the shares by name (they are normalised; sources not named get
    none, and that none of the names occurs is an error). Without it a source's weight is its number of characters to the power
    ``temperature``. The mixture has ``epochs`` times the characters of the corpus. A
    source without characters that has a weight, or where no weights are given, keeps each document ``epochs`` times on average.
    No rows in, no rows out.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(given[F.col("source")], F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    totals = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    share = F.try_divide(F.col("weight"), F.col("all_weight")) * F.col("all_chars")
    empty = F.lit(1.0) if weights is None else F.when(F.col("weight") > 0, 1.0).otherwise(0.0)
    rate = F.when(F.col("chars") == 0, empty).otherwise(F.try_divide(share, F.col("chars")))
    if weights is not None:
        rate = F.when(F.col("all_weight") > 0, rate).otherwise(F.raise_error(F.lit("no source has a weight")).cast("double"))
    return sizes.join(F.broadcast(totals)).select("source", "chars", (rate * F.lit(epochs)).alias("rate"))


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """``source, first, cdf``: the distribution function at ``first``, ``first`` + 1, ... up to where it is 1 in doubles.

    Terms are computed by their logarithms, so that large rates do not underflow. ``first``
    is 0 up to a rate of ``WHOLE_RATE``; beyond it the table begins 12 standard deviations below the
    rate, so its length grows with the root of the rate only.
    """
    rate = F.col("rate")
    top = F.ceil(rate + 12 * F.sqrt("rate") + 30).cast("long")
    first = F.when(rate > WHOLE_RATE, F.floor(rate - 12 * F.sqrt("rate"))).otherwise(0).cast("long")
    k = rates.filter("rate > 0").select("source", "rate", first.alias("first"), F.explode(F.sequence(first, top)).alias("k"))
    w = Window.partitionBy("source").orderBy("k")
    n = F.col("first").cast("double")
    stirling = n * F.ln(n) - n + F.ln(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)  # ln n!
    begin = F.when(F.col("first") > 0, stirling).otherwise(0.0)
    step = F.when(F.col("k") == F.col("first"), begin).otherwise(F.ln(F.greatest("k", F.lit(1)).cast("double")))
    logs = k.withColumn("ln_fact", F.sum(step).over(w))
    p = F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("ln_fact"))
    cdf = logs.withColumn("cdf", F.sum(p).over(w))
    return cdf.groupBy("source").agg(F.min("first").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf"))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``copy`` (from 1) and ``shuffle_key``, in shuffled order.

    ``rates`` has ``source, rate``; documents of a source that it lacks, or of rate
    zero, get no copy. Null sources are a source. Rows that repeat an id draw the same
    number; the null id draws one too. Columns of ``docs`` called ``copy`` or
    ``shuffle_key`` are replaced. Rows of equal source are never brought together, so a
    hot source needs no care. Texts are copied whole, however long. No rows in, no rows out.
    """
    cdf = staged(poisson_cdf(rates), "poisson").select(F.col("source").alias("__source"), F.col("first").alias("__first"), F.col("cdf").alias("__cdf"))
    same = F.col(source_col).eqNullSafe(F.col("__source"))
    size = cdf.agg(F.sum(8 * F.size("__cdf") + 64 + F.coalesce(F.octet_length("__source"), F.lit(0)))).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        met = docs.join(F.broadcast(cdf), same)
    else:  # salted, so that a hot source is dealt over many tasks
        salts = 64
        spread = cdf.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = docs.withColumn("__dealt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
        met = met.join(spread, same & (F.col("__dealt") == F.col("__salt"))).drop("__dealt", "__salt")
    u = unit_hash(F.lit(str(seed)), F.col(id_col))
    n = (F.col("__first") + F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).cast("int")
    met = met.withColumn("__u", u).withColumn("__n", n).filter("__n > 0").drop("__cdf", "__first", "__source", "__u")
    out = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return out.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """``replicate`` at the rates of ``repetition_rates`` (``targets`` are its options)."""
    return replicate(docs, repetition_rates(docs, text_col, source_col, **targets), seed, id_col, source_col)
