"""Chromosome and output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "/"
#: Site statistics that are two classes.
TWO_CLASS = ("diff", "mode", "cat2_var")


def format_chromo(c: Column) -> Column:
    """Upper case, without a leading ``CHR``."""
    return F.regexp_replace(F.upper(c), "^CHR", "")


def output_group(output: Column) -> Column:
    return F.split(output, SEP)[0]


def output_leaf(output: Column) -> Column:
    return F.element_at(F.split(output, SEP), -1)


def is_binary(output: Column) -> Column:
    return (output_group(output) == "cpg") | output_leaf(output).isin(*TWO_CLASS)


def metric_family(output: Column) -> Column:
    """Which metrics an output gets; null for names that have none."""
    group, leaf = output_group(output), output_leaf(output)
    return (
        F.when(leaf == "cat_var", "categorical")
        .when(group == "cpg", "classification")
        .when(group == "bulk", "regression+classification")
        .when(leaf.isin(*TWO_CLASS), "classification")
        .when(leaf == "mean", "regression+classification+kendall")
        .when(leaf == "var", "regression+kendall")
    )


def known_family(output: Column) -> Column:
    """``metric_family``; a name that has none is an error when it is met."""
    return F.coalesce(metric_family(output), F.raise_error(F.concat(F.lit("no metrics are known for output "), F.coalesce(output, F.lit("null")))))


def loss(output: Column) -> Column:
    group, leaf = output_group(output), output_leaf(output)
    return (
        F.when((group == "bulk") | leaf.isin("mean", "var"), "mean_squared_error")
        .when(leaf == "cat_var", "categorical_crossentropy")
        .otherwise("binary_crossentropy")
    )


def class_count(output: Column) -> Column:
    """Number of classes, null for continuous outputs."""
    return F.when(is_binary(output), 2).when(output_leaf(output) == "cat_var", 3)
