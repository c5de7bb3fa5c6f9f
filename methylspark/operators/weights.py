"""Weights of classes, samples and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import class_count
from ..schema import EPS


def class_weights(labels: DataFrame) -> DataFrame:
    """``output, class, weight``: 1 / (frequency + EPS), scaled to a sum of 1 per output.

    From long ``output, value``; null labels don't count, continuous outputs have no
    weights, a class that does not occur has frequency 0.
    """
    n = class_count(F.col("output"))
    seen = labels.filter("value IS NOT NULL").withColumn("class", F.col("value").cast("int"))
    counts = seen.groupBy("output", "class").agg(F.count("*").alias("n"))
    outputs = counts.groupBy("output").agg(F.sum("n").alias("all")).filter(n.isNotNull())
    every = outputs.select("output", "all", F.explode(F.sequence(F.lit(0), n - 1)).alias("class"))
    raw = every.join(counts, ["output", "class"], "left").withColumn("raw", 1 / (F.coalesce("n", F.lit(0)) / F.col("all") + EPS))
    return raw.select("output", "class", (F.col("raw") / F.sum("raw").over(Window.partitionBy("output"))).alias("weight"))


def sample_weights(labels: DataFrame, weights: DataFrame, unobserved: float = EPS) -> DataFrame:
    """``labels`` with ``weight``: that of their class, 1 where the output has none, almost 0 for null labels."""
    # a row for each output and class
    w = weights.select(F.col("output").alias("__o"), F.col("class").alias("__c"), "weight")
    met = labels.join(F.broadcast(w), (F.col("output") == F.col("__o")) & (F.col("value").cast("int") == F.col("__c")), "left")
    return met.select(*labels.columns, F.when(F.col("value").isNull(), unobserved).otherwise(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def output_weights(outputs: DataFrame, patterns: list[str]) -> DataFrame:
    """``output, weight`` from ``regex=weight`` patterns.

    A pattern must match from the start of the name; of several the last one counts;
    without any the weight is 1.
    """
    weight = F.lit(1.0)
    for p in patterns:
        regex, sep, value = (x.strip() for x in p.partition("="))
        if not sep:
            raise ValueError(f"not a weight pattern: {p!r}")
        weight = F.when(F.col("output").rlike(f"^(?:{regex})"), float(value)).otherwise(weight)
    return outputs.select("output").distinct().select("output", weight.alias("weight"))
