"""Evaluation of predictions: metrics, ranks, curves and reports.

Predictions are long: ``chromo, pos, output, y, z`` with the label ``y`` (null where not
observed) and the prediction ``z``. All functions take the key columns of a group as
``by``, by default the output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_binary, known_family, metric_family
from ..schema import SITE
from ..staging import staged
from .intervals import tracks_of_sites
from .running import equi_depth, first_rows, running

CLASSIFICATION = ("auc", "acc", "tpr", "tnr", "f1", "mcc")
REGRESSION = ("mse", "mad", "cor")
#: Columns of one-hot labels and class scores, for outputs that are categories.
CLASSES = ("y_classes", "z_classes")


#: Column of predictions that stand for several alike: how many.
TIMES = "__times"


def _times(preds: DataFrame) -> Column:
    return F.col(TIMES) if TIMES in preds.columns else F.lit(1)


def _sum_if(condition: Column, n: Column) -> Column:
    return F.sum(F.when(condition, n).otherwise(0))


def counted(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """A row for each different label and score of a group, with how often it occurs: all that metrics and curves need.

    Where scores are all different that is as many rows as there are predictions.
    """
    values = [c for c in ("y", "z", *CLASSES) if c in preds.columns]
    return preds.groupBy(*dict.fromkeys([*by, "output"]), *values).agg(F.sum(_times(preds)).alias(TIMES))


def observed(preds: DataFrame) -> DataFrame:
    return preds.filter("y IS NOT NULL AND z IS NOT NULL")


def _counts() -> dict[str, Column]:
    y, z = F.bround("y"), F.bround("z")
    return {
        "tp": F.count_if((y == 1) & (z == 1)), "tn": F.count_if((y == 0) & (z == 0)),
        "fp": F.count_if((y == 0) & (z == 1)), "fn": F.count_if((y == 1) & (z == 0)),
    }


def contingency(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """``tp, tn, fp, fn`` of labels and predictions rounded half to even."""
    return observed(preds).groupBy(*by).agg(*[c.alias(n) for n, c in _counts().items()])


def rates(counts: DataFrame) -> DataFrame:
    """The metrics of the four counts.

    Undefined rates are null, but tpr, f1 and mcc are 0 as is usual.
    """
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns({
        "acc": F.try_divide(tp + tn, tp + tn + fp + fn), "tpr": zero(F.try_divide(tp, tp + fn)), "tnr": F.try_divide(tn, tn + fp),
        "prec": F.try_divide(tp, tp + fp), "fpr": F.try_divide(fp, fp + tn), "fnr": F.try_divide(fn, fn + tp),
        "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)), "mcc": zero(F.try_divide(tp * tn - fp * fn, root)),
    })


def classification(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    return rates(contingency(preds, by))


def regression(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """``mse, rmse, mad, cor`` of the values as they are; ``cor`` is null where one side does not vary."""
    d = F.col("y") - F.col("z")
    return observed(preds).groupBy(*by).agg(
        F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mad"), F.nanvl(F.corr("y", "z"), F.lit(None).cast("double")).alias("cor")
    )


def _scores(preds: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and different score: ``z, pos, neg``."""
    y = F.bround("y")
    n = _times(preds)
    return observed(preds).groupBy(*by, "z").agg(_sum_if(y == 1, n).alias("pos"), _sum_if(y == 0, n).alias("neg"))


def _ranked(scores: DataFrame, by: list[str], score: str, high: str, low: str, sums: dict[str, Column] = {}) -> DataFrame:
    """``by``, ``pairs`` and the ``sums``: how many pairs of a ``high`` and a ``low`` there are with the high one at the larger score, ties half.

    Scores, one row each, are summed up within bins of equal depth, then bins within groups; ``scores`` is
    read once, and no task holds more than a bin or a row per bin.
    """
    scores = equi_depth(scores, by, score)
    within = Window.partitionBy(*by, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    rows = scores.withColumn("__below", F.coalesce(F.sum(low).over(within), F.lit(0)))
    pairs = F.sum(F.col(high) * (F.col("__below") + F.col(low) / 2.0))
    more = [name for name in sums if name not in ("__high", "__low")]
    bins = rows.groupBy(*by, "__b").agg(pairs.alias("__pairs"), F.sum(high).alias("__high"), F.sum(low).alias("__low"), *[sums[n].alias(n) for n in more])
    before = F.coalesce(F.sum("__low").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("__pairs", F.col("__pairs") + F.col("__high") * before)
    again = [(F.min if n.startswith("min_") else F.max if n.startswith("max_") else F.sum)(n).alias(n) for n in more]
    return bins.groupBy(*by).agg(F.sum("__pairs").alias("pairs"), F.sum("__high").alias("high"), F.sum("__low").alias("low"), *again)


def auc(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """Area under the ROC curve, ties counted half; null if one class only. Labels are rounded, scores not."""
    ranked = _ranked(_scores(preds, by), by, "z", "pos", "neg")
    return ranked.select(*by, F.try_divide("pairs", F.col("high").cast("double") * F.col("low")).alias("auc"))


def kendall(preds: DataFrame, by: list[str] = ["output"], most: int | None = None, seed: int = 0, keys: list[str] = SITE) -> DataFrame:
    """Kendall's tau-b of all rows of each group; null if undefined, and for a group of one row.

    With ``most`` only so many rows of each group count, those of smallest hash.

    Different labels are numbered in order. Two rows of different label numbers differ in
    exactly one highest bit; at each bit, the pairs of rows that agree above it are those of
    a ROC curve, so discordant pairs are counted by as many passes of ``auc`` as the
    numbers have bits, all at once.
    """
    rows = observed(preds)
    if most is not None:
        rows = first_rows(rows, by, [F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), *[F.col(k) for k in keys]], most, keys)
    cells = rows.groupBy(*by, "y", "z").agg(F.sum(_times(rows)).alias("n"))
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    n = F.col("n").cast("double")
    ties = lambda c, name: cells.groupBy(*by, c).agg(F.sum(n).alias("n")).groupBy(*by).agg(pairs(F.col("n")).alias(name))
    total = cells.groupBy(*by).agg((F.sum(n) * (F.sum(n) - 1) / 2).alias("__all"), pairs(n).alias("__both"))
    # numbers of the labels
    labels = cells.select(*by, "y").distinct()
    labels = equi_depth(labels, by, "y", "labels")
    numbered = running(labels, by, ["y"], F.col("__b"), {"__r": ("count", F.lit(1))})
    numbered = numbered.select(*[F.col(c).alias(f"__n_{c}") for c in (*by, "y")], (F.col("__r") - 1).alias("__r"))
    same = [F.col(c).eqNullSafe(F.col(f"__n_{c}")) for c in by] + [F.col("y") == F.col("__n_y")]
    met = cells.join(numbered, reduce(lambda a, b: a & b, same)).select(*by, "z", "n", "__r")
    # a row for each bit of the group's largest number: what stands above it, and the bit
    bit = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("__top") + 1.0)).cast("int"))).alias("__bit")
    largest = numbered.groupBy(*[F.col(f"__n_{c}").alias(f"__m_{c}") for c in by]).agg(F.max("__r").alias("__top"))
    up_to = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in by])
    bits = met.join(largest, up_to).select(*by, "z", "n", "__r", bit)
    bits = bits.withColumn("__above", F.expr("shiftright(__r, __bit + 1)")).withColumn("__one", F.expr("shiftright(__r, __bit) & 1"))
    group = [*by, "__bit", "__above"]
    scores = bits.groupBy(*group, "z").agg(F.sum(F.when(F.col("__one") == 0, F.col("n")).otherwise(0)).alias("zero"), F.sum(F.when(F.col("__one") == 1, F.col("n")).otherwise(0)).alias("one"))
    # pairs with the smaller label at the larger score, ties half; and those ties
    ranked = _ranked(scores, group, "z", "zero", "one", {"tied": F.sum(F.col("zero").cast("double") * F.col("one"))})
    against = ranked.groupBy(*by).agg(F.sum(F.col("pairs") - F.col("tied") / 2).alias("__against"))
    out = total
    for more in (ties("y", "__ty"), ties("z", "__tz"), against):
        out = _on_keys(out, more, by, "left")
    a, ty, tz = F.col("__all"), F.col("__ty"), F.col("__tz")
    top = a - ty - tz + F.col("__both") - 2 * F.coalesce("__against", F.lit(0.0))
    return out.select(*by, F.try_divide(top, F.sqrt(a - ty) * F.sqrt(a - tz)).alias("kendall"))


def _categories(preds: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``cat_acc, n`` by group, and the AUC of each class against all others by group and ``class``.

    Rows whose label is null or all zero don't count.
    """
    rows = preds.filter(F.exists("y", lambda x: x > 0))
    first = lambda a: F.array_position(F.col(a), F.array_max(a))
    n, own = _times(rows), [c for c in (TIMES,) if c in rows.columns]
    met = first("y") == first("z")
    acc = rows.groupBy(*by).agg((F.sum(met.cast("double") * n) / F.sum(F.when(met.isNotNull(), n))).alias("cat_acc"), F.sum(n).alias("n"))
    each = rows.select(*by, *own, F.posexplode(F.arrays_zip(F.col("y").alias("y"), F.col("z").alias("z"))).alias("class", "__p"))
    each = each.select(*by, *own, "class", F.col("__p.y").cast("double").alias("y"), F.col("__p.z").cast("double").alias("z"))
    return acc, auc(each, [*by, "class"])


def categorical(preds: DataFrame, by: list[str] = ["output"], classes: int | None = None) -> DataFrame:
    """``cat_acc``, ``n`` and ``auc_0``, ``auc_1``, ... from one-hot labels ``y`` and class scores ``z``.

    There are as many areas as ``classes``, if that isn't given as the longest label has places. Rows whose label is
    null or all zero don't count.
    """
    if classes is None:
        classes = preds.select(F.max(F.size("y"))).first()[0] or 0
    acc, areas = _categories(preds, by)
    named = areas.withColumn("class", F.concat(F.lit("auc_"), "class"))
    wide = named.groupBy(*by).pivot("class", [f"auc_{i}" for i in range(classes)]).agg(F.first("auc"))
    return _on_keys(acc, wide, by)


def _on_keys(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joined by the columns ``by``, where null equals null."""
    right = right.select(*[F.col(c).alias(f"__k_{c}") for c in by], *[c for c in right.columns if c not in by])
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]), how).drop(*[f"__k_{c}" for c in by])


def summary(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """``by``, ``n``, the four counts, and all metrics of ``classification``, ``regression`` and ``auc`` from one aggregation of the predictions."""
    y, z = F.bround("y"), F.bround("z")
    d, times = F.col("y") - F.col("z"), _times(preds)
    rows = observed(preds).groupBy(*by, "z").agg(
        _sum_if(y == 1, times).alias("pos"), _sum_if(y == 0, times).alias("neg"), F.sum(times).alias("n"), F.sum(d * d * times).alias("dd"), F.sum(F.abs(d) * times).alias("ad"),
        F.sum(F.col("y") * times).alias("sy"), F.sum(F.col("y") * F.col("y") * times).alias("syy"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    )
    own, count = F.col("z"), F.col("n")
    sums = {c: F.sum(c) for c in ("n", "dd", "ad", "sy", "syy")} | {"min_y": F.min("min_y"), "max_y": F.max("max_y"), "min_z": F.min("z"), "max_z": F.max("z")}
    sums |= {"sz": F.sum(own * count), "szz": F.sum(own * own * count), "syz": F.sum(own * F.col("sy"))}
    sums |= {name: F.sum(F.when(z == hit, F.col(kind)).otherwise(0)) for name, kind, hit in (("tp", "pos", 1), ("fn", "pos", 0), ("fp", "neg", 1), ("tn", "neg", 0))}
    s = rates(_ranked(rows, by, "z", "pos", "neg", sums))
    n = F.col("n").cast("double")
    spread = lambda a, b, ab: F.col(ab) / n - F.col(a) / n * (F.col(b) / n)
    varies = (F.col("min_y") < F.col("max_y")) & (F.col("min_z") < F.col("max_z"))
    cor = F.when(varies, spread("sy", "sz", "syz") / (F.sqrt(spread("sy", "sy", "syy")) * F.sqrt(spread("sz", "sz", "szz"))))
    return s.select(
        *by, n.alias("n"), "tp", "tn", "fp", "fn", "acc", "tpr", "tnr", "prec", "fpr", "fnr", "f1", "mcc", (F.col("dd") / n).alias("mse"), F.sqrt(F.col("dd") / n).alias("rmse"),
        (F.col("ad") / n).alias("mad"), cor.alias("cor"), F.try_divide("pairs", F.col("high").cast("double") * F.col("low")).alias("auc"),
    )


#: Metrics that callers have added, by name: aggregates of the label and the prediction.
METRICS: dict[str, Callable[[Column, Column], Column]] = {}
#: Metrics of ``summary``, and Kendall's tau.
KNOWN = ("auc", "acc", "tpr", "tnr", "prec", "fpr", "fnr", "f1", "mcc", "mse", "rmse", "mad", "cor", "kendall", "n")
#: Other names of metrics.
ALIASES = {"mae": "mad", "sensitivity": "tpr", "specificity": "tnr", "precision": "prec"}


def register_metric(name: str, of: Callable[[Column, Column], Column]) -> None:
    """Adds a metric: ``of`` makes an aggregate column of the columns of observed labels and predictions. Names of known metrics can't be taken."""
    if (name := name.lower()) in KNOWN or name in ALIASES:
        raise ValueError(f"{name!r} is a known metric")
    METRICS[name] = of


def metric_names(names: list[str]) -> list[str]:
    """The names in lower case, other names replaced, or an error that lists all there are."""
    found = [ALIASES.get(n.lower(), n.lower()) for n in names]
    if unknown := [n for n in found if n not in KNOWN and n not in METRICS]:
        raise ValueError(f"no metric {', '.join(unknown)}; there are {', '.join((*KNOWN, *METRICS))}")
    return list(dict.fromkeys(found))


def evaluate_metrics(preds: DataFrame, metrics: list[str], by: list[str] = ["output"]) -> DataFrame:
    """``by, metric, value``: the metrics of these names for every group, whatever its output is called. A caller's own are those of ``register_metric``."""
    names = metric_names(metrics)
    own, counted = [n for n in names if n in METRICS], [n for n in names if n in KNOWN and n != "kendall"]
    parts = []
    if counted:
        parts.append(summary(preds, by).unpivot(by, counted, "metric", "value"))
    if own:
        wide = observed(preds).groupBy(*by).agg(*[METRICS[n](F.col("y"), F.col("z")).cast("double").alias(n) for n in own])
        parts.append(wide.unpivot(by, own, "metric", "value"))
    if "kendall" in names:
        parts.append(kendall(preds, by).select(*by, F.lit("kendall").alias("metric"), F.col("kendall").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def evaluate_outputs(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """``by, metric, value``: the metrics that the output's name calls for, and ``n``.

    Outputs that are categories (``cat_var``) get ``cat_acc`` and the AUC of each class; their labels and
    scores are arrays in the columns ``y_classes`` and ``z_classes``, which other outputs leave null. A name
    that calls for nothing, or a category without those columns, is an error.
    """
    preds = staged(counted(preds, by), "score-counts")  # several aggregations read it
    family = known_family(F.col("output"))
    names = [*CLASSIFICATION, *REGRESSION, "n"]
    long = summary(preds.filter(family != "categorical"), by).unpivot(by, names, "metric", "value")
    fits = (
        (F.col("metric") == "n")
        | (F.col("metric").isin(*CLASSIFICATION) & family.contains("classification"))
        | (F.col("metric").isin(*REGRESSION) & family.contains("regression"))
    )
    ranked = preds.filter(family.contains("kendall"))
    taus = kendall(ranked, by).select(*by, F.lit("kendall").alias("metric"), F.col("kendall").alias("value"))
    out = long.filter(fits).unionByName(taus)
    hits = preds.filter(metric_family(F.col("output")) == "categorical")
    if not set(CLASSES) <= set(preds.columns):
        missing = F.raise_error(F.concat(F.lit("y_classes and z_classes are needed for "), "output")).cast("double")
        return out.unionByName(hits.select(*by, F.lit("n").alias("metric"), missing.alias("value")))
    acc, areas = _categories(hits.select(*by, TIMES, *[F.col(c).alias(n) for c, n in zip(CLASSES, "yz")]), by)
    both = acc.withColumn("n", F.col("n").cast("double")).unpivot(by, ["cat_acc", "n"], "metric", "value")
    return out.unionByName(both).unionByName(areas.select(*by, F.concat(F.lit("auc_"), "class").alias("metric"), F.col("auc").alias("value")))


def unstack_report(report: DataFrame, index: list[str], metrics: list[str]) -> DataFrame:
    """One column per metric, best first: by auc, or by mse, or by acc."""
    wide = report.groupBy(*index).pivot("metric", metrics).agg(F.avg("value"))
    for name, best in (("auc", F.desc), ("mse", F.asc), ("acc", F.desc)):
        if name in metrics:
            return wide.orderBy(best(name), *index)
    return wide.orderBy(*index)


def chunked_evaluation(preds: DataFrame, block: Column, by: list[str] = ["output"]) -> DataFrame:
    """``by, metric, value``: all metrics of ``evaluate_outputs`` for each block of rows, then their mean over the blocks in which they are defined."""
    return evaluate_outputs(preds.withColumn("__block", block), [*by, "__block"]).groupBy(*by, "metric").agg(F.avg("value").alias("value"))


def _cumulated(preds: DataFrame, by: list[str]) -> DataFrame:
    rows = equi_depth(_scores(preds.filter(is_binary(F.col("output"))), by), by, "z")
    out = running(rows, by, ["z"], F.col("__b"), {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, reverse=True)
    totals = rows.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return out.join(totals, by)


def roc_curve(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """``x`` (false positive rate), ``y`` (true positive rate), ``thr`` for every score, and the start (0, 0)."""
    c = _cumulated(preds, by)
    points = c.select(*by, F.try_divide("fp", "all_neg").alias("x"), F.try_divide("tp", "all_pos").alias("y"), F.col("z").alias("thr"))
    starts = c.select(*by).distinct().select(*by, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("thr"))
    return points.unionByName(starts)


def pr_curve(preds: DataFrame, by: list[str] = ["output"]) -> DataFrame:
    """``x`` (precision), ``y`` (recall), ``thr`` for every score."""
    c = _cumulated(preds, by)
    return c.select(*by, F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("x"), F.try_divide("tp", "all_pos").alias("y"), F.col("z").alias("thr"))


CURVES: dict[str, Callable[..., DataFrame]] = {"roc": roc_curve, "pr": pr_curve}


def curve(name: str) -> Callable[..., DataFrame]:
    """The curve of a name in any case, or an error that lists them; callers may add their own to ``CURVES``."""
    try:
        return CURVES[name.lower()]
    except KeyError:
        raise ValueError(f"no curve {name!r}; there are {', '.join(CURVES)}") from None


def thin_curve(curve: DataFrame, n: int, by: list[str] = ["output"]) -> DataFrame:
    """At most ``n`` points of each curve, evenly spaced along falling thresholds, ends included."""
    t = F.coalesce(-F.col("thr"), F.lit(float("-inf")))
    rows = equi_depth(curve.withColumn("__t", t), by, "__t", "curve")
    rows = running(rows, by, ["__t"], F.col("__b"), {"__i": ("count", F.lit(1))})
    totals = curve.groupBy(*by).agg(F.count("*").alias("__n"))
    rows = rows.join(totals, by)
    # the k-th of n even steps falls on index floor(k * (N - 1) / (n - 1))
    i, last = F.col("__i") - 1, F.col("__n") - 1
    k = F.ceil(i * (n - 1) / last)
    hit = (F.floor(k * last / (n - 1)) == i) & (k <= n - 1)
    return rows.filter((F.col("__n") <= n) | hit).select(*curve.columns)


def curve_filter(curves: DataFrame, min_precision: float = 0.5) -> DataFrame:
    """All ROC points, and PR points of a precision above the limit."""
    return curves.filter((F.col("curve") == "roc") | (F.col("x") > min_precision))


def annotated(preds: DataFrame, intervals: DataFrame, min_sites: int = 100) -> DataFrame:
    """``preds`` with ``anno``: once as ``global``, and once for each track whose intervals hold the site.

    Tracks with fewer than ``min_sites`` different sites are left out.
    """
    held = tracks_of_sites(preds.select(*SITE).distinct(), intervals)
    flags = held.select(*SITE, F.explode("tracks").alias("anno"))
    enough = flags.groupBy("anno").agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_sites).select("anno")
    local = preds.join(flags.join(enough, "anno"), SITE)
    return preds.withColumn("anno", F.lit("global")).unionByName(local)


def annotated_counts(preds: DataFrame, intervals: DataFrame, min_sites: int = 100) -> DataFrame:
    """The rows of ``annotated``, ``counted`` by annotation and output: what a site's tracks repeat is never written."""
    values = [c for c in ("y", "z", *CLASSES) if c in preds.columns]
    rows = staged(preds.select(*SITE, "output", *values), "predictions")
    held = staged(tracks_of_sites(rows.select(*SITE).distinct(), intervals), "tracks")
    enough = held.select(F.explode("tracks").alias("anno")).groupBy("anno").agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_sites).select("anno")
    local = rows.join(held, SITE).select("output", *values, F.explode("tracks").alias("anno"))
    keys = ["anno", "output"]
    return counted(rows.withColumn("anno", F.lit("global")), keys).unionByName(counted(local, keys).join(enough, "anno", "left_semi"))


def evaluate_by_annotation(preds: DataFrame, intervals: DataFrame, min_sites: int = 100, metrics: list[str] | None = None) -> DataFrame:
    """``anno, output, metric, value``: what the outputs' names call for, or the ``metrics`` named (``evaluate_metrics``).

    Predictions are written once, before they are annotated; a caller's own metrics read them annotated.
    """
    rows = preds.select(*SITE, "output", "y", "z", *[c for c in CLASSES if c in preds.columns])
    if metrics is not None:
        metrics = metric_names(metrics)  # a wrong name is an error before anything runs
    keys = ["anno", "output"]
    if metrics is None:
        return evaluate_outputs(annotated_counts(rows, intervals, min_sites), keys)
    return evaluate_metrics(staged(annotated(rows, intervals, min_sites), "annotated"), metrics, keys)


def compare_models(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean over outputs of each metric, a row per annotation and model, best AUC first."""
    wide = metrics.groupBy("anno", "model").pivot("metric", names).agg(F.avg("value"))
    return wide.orderBy(F.desc("auc"), "anno", "model")


def rank_by_auc(metrics: DataFrame, what: str) -> DataFrame:
    """``what`` (model or anno), its mean AUC and rank from 1."""
    means = metrics.filter("metric = 'auc'").groupBy(what).agg(F.avg("value").alias("auc"))
    return means.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("auc"))))  # as many rows as models or tracks


def metric_distribution(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Smallest, quartiles and largest value over outputs."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    five = metrics.groupBy(*by).agg(q.alias("__q"))
    return five.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def align_predictions(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """``chromo, pos, output, y, z``: labels (``value``) and predictions (``z``) of the same site and output."""
    return preds.join(labels.select(*SITE, "output", F.col("value").alias("y")), [*SITE, "output"], "left").select(*SITE, "output", "y", "z")


def impute(preds: DataFrame) -> DataFrame:
    """``preds`` with ``value``: the label where observed, else the prediction."""
    return preds.withColumn("value", F.coalesce("y", "z"))
