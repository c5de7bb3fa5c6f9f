"""Activations of sequence filters, motifs and mutation effects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import AGGREGATES, aggregate_window, center_slice
from ..schema import EPS, LETTERS, SITE
from .running import equi_depth, running

#: Weights are shipped to every task; a model's first layer is far smaller than this.
MAX_WEIGHTS = 4_000_000


def filter_arrays(weights: DataFrame, bias: DataFrame | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Filter ids, weights [filter, offset, letter] and biases of ``filter, offset, nt, weight`` and ``filter, bias``."""
    pdf = weights.select("filter", "offset", "nt", "weight").limit(MAX_WEIGHTS + 1).toPandas()
    if len(pdf) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} filter weights")
    ids = sorted(pdf["filter"].unique())
    w = np.zeros((len(ids), int(pdf["offset"].max()) + 1, 4))
    w[[ids.index(f) for f in pdf["filter"]], pdf["offset"], [LETTERS.index(c) for c in pdf["nt"]]] = pdf["weight"]
    b = np.zeros(len(ids))
    if bias is not None:
        known = {r["filter"]: r["bias"] for r in bias.collect()}  # a row per filter
        b = np.array([known.get(f, 0.0) for f in ids])
    return [int(f) for f in ids], w, b


def _act(seqs: list[str], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Activations [window, position, filter]: the filter centred on each letter, zero beyond the ends, rectified."""
    points = np.frombuffer("".join(seqs).upper().encode("utf-32-le"), np.uint32).reshape(len(seqs), -1)
    hot = (points[:, :, None] == np.array([ord(c) for c in LETTERS], np.uint32)).astype(np.float64)
    n = w.shape[1]
    left = (n - 1) // 2
    hot = np.pad(hot, ((0, 0), (left, n - 1 - left), (0, 0)))
    view = np.lib.stride_tricks.sliding_window_view(hot, n, axis=1)  # window, position, letter, offset
    return np.maximum(np.einsum("wpcn,fnc->wpf", view, w, optimize=True) + b, 0)


def _rounded(act: np.ndarray, digits: int | None) -> np.ndarray:
    return act if digits is None else np.round(act, digits)


#: Windows that are scanned together, and different activations of a filter that a task adds up before it hands them on.
COUNT_WINDOWS, COUNT_VALUES = 512, 1 << 17


def activation_counts(windows: DataFrame, weights: DataFrame, bias: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """``filter, act, n``: how often each positive activation occurs in all windows (of equal length).

    All that histograms, thresholds and statistics need of ``scan_filters``, but a row for each different value. Tasks
    add up their own values, as many at a time as ``COUNT_VALUES`` for a filter.
    """
    ids, w, b = filter_arrays(weights, bias)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]
        sizes = np.zeros(len(ids), np.int64)

        def merged(k: int) -> tuple[np.ndarray, np.ndarray]:
            values, at = np.unique(np.concatenate([v for v, _ in held[k]]), return_inverse=True)
            n = np.zeros(len(values), np.int64)
            np.add.at(n, at, np.concatenate([c for _, c in held[k]]))
            return values, n

        def rows(k: int, values: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"filter": np.full(len(values), ids[k], np.int32), "act": values, "n": n})

        for pdf in batches:
            seqs = list(pdf["seq"])
            for s in range(0, len(seqs), COUNT_WINDOWS):
                act = _rounded(_act(seqs[s : s + COUNT_WINDOWS], w, b), digits)
                for k in range(len(ids)):
                    own = act[:, :, k]
                    held[k].append(np.unique(own[own > 0], return_counts=True))
                    sizes[k] += len(held[k][-1][0])
                    if sizes[k] > COUNT_VALUES:
                        values, n = merged(k)
                        if len(values) > COUNT_VALUES // 2:
                            yield rows(k, values, n)
                            values, n = values[:0], n[:0]
                        held[k], sizes[k] = [(values, n)], len(values)
        for k in range(len(ids)):
            if held[k]:
                yield rows(k, *merged(k))

    counted = windows.select("seq").mapInPandas(run, "filter int, act double, n long")
    return counted.groupBy("filter", "act").agg(F.sum("n").alias("n"))


def _times(acts: DataFrame) -> Column:
    """How often a row of activations counts: ``n`` of ``activation_counts``, once in ``scan_filters``."""
    return F.col("n") if "n" in acts.columns else F.lit(1)


def scan_filters(windows: DataFrame, weights: DataFrame, bias: DataFrame | None = None, keys: list[str] = SITE, above: dict[int, float] | None = None, digits: int | None = None) -> DataFrame:
    """``keys, offset, filter, act`` for the positive activations of all windows (of equal length).

    With ``above`` only activations of at least a filter's threshold leave the task, with ``digits`` they are rounded before anything else.
    """
    ids, w, b = filter_arrays(weights, bias)
    floor = np.array([(above or {}).get(f, 0.0) for f in ids])
    rows = windows.select(*keys, "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 128):
                part = pdf.iloc[s : s + 128]
                act = _rounded(_act(list(part["seq"]), w, b), digits)
                i, j, f = np.nonzero((act > 0) & (act >= floor))
                out = part[keys].iloc[i].reset_index(drop=True)
                yield out.assign(offset=j.astype(np.int32), filter=np.array(ids, np.int32)[f], act=act[i, j, f])

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("offset", T.IntegerType()), T.StructField("filter", T.IntegerType()), T.StructField("act", T.DoubleType())])
    return rows.mapInPandas(run, schema)


def activation_summary(windows: DataFrame, weights: DataFrame, bias: DataFrame | None = None, keys: list[str] = SITE, delta: int | None = None) -> DataFrame:
    """``keys, filter, mean, wmean, max`` over the positions of each window, or over its ``2 * delta + 1`` middle ones."""
    ids, w, b = filter_arrays(weights, bias)
    rows = windows.select(*keys, "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 128):
                part = pdf.iloc[s : s + 128]
                act = _act(list(part["seq"]), w, b)
                if delta is not None:
                    mid = act.shape[1] // 2
                    act = act[:, max(0, mid - delta) : mid + delta + 1]
                n = act.shape[1]
                half = -(-n // 2)
                rise = np.linspace(0.1, 1, half)
                tri = np.r_[rise, rise[: n - half][::-1]]
                shape = (len(part), len(ids))
                out = part[keys].loc[part.index.repeat(len(ids))].reset_index(drop=True)
                yield out.assign(
                    filter=np.tile(np.array(ids, np.int32), len(part)), mean=act.mean(axis=1).reshape(-1),
                    wmean=(np.einsum("wpf,p->wf", act, tri) / tri.sum()).reshape(shape[0] * shape[1]), max=act.max(axis=1).reshape(-1),
                )

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("filter", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in AGGREGATES)])
    return rows.mapInPandas(run, schema)


#: Steps of the ladder of quantiles that brackets a rank, and rows of a bracket that are sorted at last.
LADDER, BRACKET = 64, 1 << 16


def ranked_from_top(acts: DataFrame, ranks: dict[int, int]) -> dict[int, tuple[float, float]]:
    """For each filter of ``ranks`` the ``act`` of that rank from the top (1 is the largest), and of the rank before it (of rank 1 itself).

    No rows are sorted or ranked but those of a small bracket: Spark's quantile sketch, which merges partial results, gives a ladder of
    values around the rank, exact counts say whether the bracket holds it, and the next pass looks at its rows only, until they
    are few or all alike. A bracket that misses the rank (a sketch is approximate) is taken back and widened. State is a few numbers for
    each filter; every filter must have as many rows as its rank.
    """
    spark = acts.sparkSession
    lo, hi, above, inside, margin = ({f: x for f in ranks} for x in (float("-inf"), float("inf"), 0, None, 1))
    found: dict[int, tuple[float, float]] = {}
    first = lambda f: max(1, ranks[f] - 1)

    def within(bounds: dict[int, tuple[float, float]]) -> DataFrame:
        rows = spark.createDataFrame([(f, *b) for f, b in bounds.items()], "filter int, __lo double, __hi double")
        low, high = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
        return acts.filter(F.col("act").between(low, high)).join(F.broadcast(rows), "filter")  # a row for each filter

    todo = set(ranks)
    while todo:
        rows = within({f: (lo[f], hi[f]) for f in todo}).filter("act BETWEEN __lo AND __hi")
        ladder = F.percentile_approx("act", F.array(*[F.lit(i / LADDER) for i in range(LADDER + 1)]), F.lit(50 * LADDER))
        steps = {r["filter"]: r for r in rows.groupBy("filter").agg(F.count("*").alias("n"), ladder.alias("q")).collect()}
        tried = {}
        for f, r in steps.items():
            inside[f] = r.n
            at = lambda rank: (r.n - (rank - above[f])) / r.n * LADDER  # noqa: B023, E731  steps below the rank
            down, up = int(np.floor(at(ranks[f]))) - margin[f], int(np.ceil(at(first(f)))) + 1 + margin[f]
            tried[f] = (r.q[down] if down > 0 else lo[f], r.q[up] if up < LADDER else hi[f])
        counts = within(tried).groupBy("filter").agg(F.count_if(F.col("act") > F.col("__hi")).alias("above"), F.count_if(F.col("act").between(F.col("__lo"), F.col("__hi"))).alias("n"))
        # what lies above the rows that were read is above every bracket in them
        high = max(b[1] for b in tried.values())
        beyond = {r["filter"]: r.n for r in acts.filter(F.col("act") > high).groupBy("filter").agg(F.count("*").alias("n")).collect()} if np.isfinite(high) else {}
        last = set()
        for r in counts.collect():
            f, up = r["filter"], r.above + beyond.get(r["filter"], 0)
            if up >= first(f) or up + r.n < ranks[f]:
                margin[f] *= 4
                continue
            stuck = r.n == inside[f]
            (lo[f], hi[f]), above[f], inside[f] = tried[f], up, r.n
            if lo[f] == hi[f]:
                found[f] = lo[f], lo[f]
            elif r.n <= BRACKET or stuck:
                last.add(f)
        if last:
            few = within({f: (lo[f], hi[f]) for f in last}).filter("act BETWEEN __lo AND __hi").groupBy("filter", "act").agg(F.count("*").alias("n"))
            each = few.groupBy("filter").agg(F.sort_array(F.collect_list(F.struct("act", "n")), asc=False).alias("rows"))  # at most BRACKET, or few values
            for r in each.collect():
                f, seen, values = r["filter"], above[r["filter"]], []
                for act, n in r["rows"]:
                    values += [act for rank in (first(f), ranks[f]) if seen < rank <= seen + n]
                    seen += n
                found[f] = values[1], values[0]
        todo -= set(found)
    return found


def activation_threshold(acts: DataFrame, n_positions: int, share: float = 0.5, most: int = 25_000) -> DataFrame:
    """``filter, threshold``: the larger of mean + share * (max - mean) and the value that ``most`` positions reach.

    ``acts`` has the positive activations, or how often each occurs (``activation_counts``); the other of the ``n_positions`` are zero. The
    quantile is interpolated like a percentile of all positions, from the ranks next to it (``ranked_from_top``, or the running sum of the counts).
    """
    most = min(most, n_positions)
    at = (n_positions - 1) * (1 - most / n_positions)  # rank from 0, of all positions in order
    low, part = int(at), at - int(at)
    rank = n_positions - low  # from the top
    if "n" in acts.columns:
        return _threshold_of_counts(acts, n_positions, share, rank, part)
    stats = acts.groupBy("filter").agg((F.sum("act") / n_positions).alias("mean"), F.max("act").alias("max"), F.min("act").alias("min"), F.count("*").alias("n"))
    own = {r["filter"]: r for r in stats.collect()}  # a row for each filter
    ends = ranked_from_top(acts, {f: rank for f, r in own.items() if r.n >= rank})
    rows = []
    for f, r in own.items():
        a, b = ends.get(f, (0.0, r.min if r.n == rank - 1 else 0.0))  # beyond the activations all is zero
        rows.append((f, max(r.mean + share * (r.max - r.mean), a + (b - a) * part)))
    return acts.sparkSession.createDataFrame(rows, "filter int, threshold double")


def _threshold_of_counts(counts: DataFrame, n_positions: int, share: float, rank: int, part: float) -> DataFrame:
    counts = equi_depth(counts, ["filter"], "act", "activation-counts")
    seen = running(counts, ["filter"], ["act"], F.col("__b"), {"__seen": ("sum", F.col("n"))}, reverse=True)
    holds = lambda r: (F.col("__seen") >= r) & (F.col("__seen") - F.col("n") < r)
    at = lambda r: F.coalesce(F.max(F.when(holds(r), F.col("act"))), F.lit(0.0))  # noqa: E731  beyond the activations all is zero
    ends = seen.groupBy("filter").agg(at(rank).alias("__a"), at(max(1, rank - 1)).alias("__b"), (F.sum(F.col("act") * F.col("n")) / n_positions).alias("__mean"), F.max("act").alias("__max"))
    a, b, mean = F.col("__a"), F.col("__b"), F.col("__mean")
    return ends.select("filter", F.greatest(mean + share * (F.col("__max") - mean), a + (b - a) * part).alias("threshold"))


def activating_kmers(acts: DataFrame, windows: DataFrame, thresholds: DataFrame, filter_len: int, keys: list[str] = SITE) -> DataFrame:
    """``filter, keys, offset, kmer``: the letters under each activation of at least the threshold; too near an end they are skipped."""
    half = filter_len // 2
    hits = acts.join(thresholds, "filter").filter(F.col("act") >= F.col("threshold"))
    j = F.col("offset")
    met = hits.join(windows.select(*keys, F.upper("seq").alias("seq")), keys).filter((j >= half) & (j <= F.length("seq") - filter_len - 1))
    return met.select("filter", *keys, "offset", F.substring("seq", (j - half + 1).cast("int"), F.lit(2 * half + filter_len % 2)).alias("kmer"))


def pwm(kmers: DataFrame, min_sites: int = 10) -> DataFrame:
    """``filter, offset, nt, freq, nb_site`` of filters with at least ``min_sites`` fragments; all four letters of each offset."""
    letters = F.posexplode(F.split("kmer", "")).alias("offset", "nt")
    counts = kmers.select("filter", letters).groupBy("filter", "offset").agg(*[F.count_if(F.col("nt") == c).alias(c) for c in LETTERS], F.count("*").alias("nb_site"))
    long = counts.filter(F.col("nb_site") >= min_sites).unpivot(["filter", "offset", "nb_site"], list(LETTERS), "nt", "n")
    known = F.sum("n").over(Window.partitionBy("filter", "offset"))
    return long.select("filter", "offset", "nt", F.try_divide(F.col("n").cast("double"), known).alias("freq"), "nb_site")


def _information(freq: Column) -> Column:
    return F.sum(freq * F.log2(freq + EPS) + 0.5)


def information_content(pwms: DataFrame, by: list[str] = ["filter"]) -> DataFrame:
    return pwms.groupBy(*by).agg(_information(F.col("freq")).alias("ic"))


def trim_pwm(pwms: DataFrame, threshold: float) -> DataFrame:
    """The rows from the first to the last offset of at least so much information, both included."""
    ic = information_content(pwms, ["filter", "offset"]).filter(F.col("ic") >= threshold)
    ends = ic.groupBy("filter").agg(F.min("offset").alias("__a"), F.max("offset").alias("__b"))
    return pwms.join(ends, "filter").filter(F.col("offset").between(F.col("__a"), F.col("__b"))).select(*pwms.columns)


def filter_stats(acts: DataFrame, n_positions: int, pwms: DataFrame) -> DataFrame:
    """``idx, motif, act_mean, act_std, ic, nb_site``, highest mean first; filters that never activate have no row. ``acts`` as in ``activation_threshold``."""
    act, n = F.col("act"), _times(acts)
    mean = F.sum(act * n) / n_positions
    stats = acts.groupBy("filter").agg(mean.alias("act_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(act * act * n) / n_positions - mean * mean)).alias("act_std"))
    about = pwms.groupBy("filter").agg(_information(F.col("freq")).alias("ic"), F.max("nb_site").alias("nb_site"))
    out = stats.filter("act_mean > 0").join(about, "filter", "left").join(consensus_motif(pwms.withColumnRenamed("freq", "weight")), "filter", "left")
    return out.select(F.col("filter").alias("idx"), "motif", "act_mean", "act_std", "ic", "nb_site").orderBy(F.desc("act_mean"), "idx")


def consensus_motif(weights: DataFrame) -> DataFrame:
    """``filter, motif``: the heaviest letter at each offset; ties go to the first in code order."""
    code = F.expr(f"instr('{LETTERS}', nt)")
    best = weights.groupBy("filter", "offset").agg(F.max_by("nt", F.struct("weight", -code)).alias("nt"))
    ordered = F.sort_array(F.collect_list(F.struct("offset", "nt")))  # as many as a filter has offsets
    return best.groupBy("filter").agg(F.array_join(F.transform(ordered, lambda x: x["nt"]), "").alias("motif"))


def activation_histogram(acts: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """``filter, bin, n``: bins 1 to ``bins``, 0 below and ``bins + 1`` above the range. ``acts`` as in ``activation_threshold``."""
    return acts.groupBy("filter", F.width_bucket("act", F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.sum(_times(acts)).alias("n"))


def activation_pca(summary: DataFrame, value: str = "mean", most: int = 1000, k: int = 2, seed: int = 0, keys: list[str] = SITE) -> DataFrame:
    """``filter`` and its first ``k`` principal components over the activations in at most ``most`` windows (all, if there are no more)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    picked = summary.select(*keys).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), *keys).limit(most)
    rows = summary.join(picked, keys)
    rows = rows.withColumn("__v", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    vectors = rows.groupBy("filter").agg(array_to_vector(F.transform(F.sort_array(F.collect_list(F.struct(*keys, "__v"))), lambda x: x["__v"])).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors)
    return model.transform(vectors).select("filter", vector_to_array("pc").alias("pc")).select("filter", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)])


def effect_slice(effects: DataFrame, delta: int) -> DataFrame:
    return effects.withColumn("effect", center_slice(F.col("effect"), delta, True))


def effect_by_letter(effect: str, how: str) -> Column:
    """An effect reduced over positions to an array of four numbers, one per letter."""
    letter = lambda c: aggregate_window(F.transform(effect, lambda r: r[c]), how)
    return F.array(*[letter(c) for c in range(4)])


def effect_aggregate(effects: DataFrame, how: str) -> DataFrame:
    return effects.withColumn("effect", effect_by_letter("effect", how))


def effect_profile(effects: DataFrame) -> DataFrame:
    """``target, offset, effect``: the mean over windows of the largest absolute effect of a letter."""
    rows = effects.select("target", F.posexplode("effect").alias("offset", "e"))
    return rows.groupBy("target", "offset").agg(F.avg(F.array_max(F.transform("e", lambda x: F.abs(x)))).alias("effect"))


def motif_report(stats: DataFrame, hits: DataFrame, names: DataFrame) -> DataFrame:
    """All filters and all hits, joined by ``idx``, with the name of the motif that was hit."""
    drop = [c for c in ("query_id", "optimal_offset") if c in hits.columns]
    named = names.select(F.col("id").alias("target_id"), "protein", "url")
    return stats.join(hits.drop(*drop), "idx", "full").join(named, "target_id", "left")


def top_hit_per_filter(report: DataFrame) -> DataFrame:
    """The row of smallest q-value of each filter, then of highest activation, then of first target."""
    w = Window.partitionBy("idx").orderBy(F.asc_nulls_last("q_value"), F.desc_nulls_last("act_mean"), F.asc_nulls_last("target_id"))
    return report.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
