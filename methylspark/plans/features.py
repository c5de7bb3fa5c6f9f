"""Plans of whole workloads: feature tables, evaluation, motif analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import statistic
from ..operators import dna, evaluation, intervals, motifs, neighbors, sites, windows
from ..schema import SITE
from ..staging import bucketed, staged


def site_table(profiles: DataFrame, names: list[str], min_cells: int = 1, gate: int = 3) -> DataFrame:
    """Sites that enough cells observe, with statistics over cells, in order: one shuffle on the site."""
    names = [n for n in names if n != "cov"]
    v = F.col("value")
    seen = profiles.groupBy(*SITE).agg(F.count(v).alias("cov"), *[statistic(n)(v).alias(n) for n in names]).filter(F.col("cov") >= min_cells)
    return seen.select(*SITE, "cov", *[F.when(F.col("cov") >= gate, F.col(n)).alias(n) for n in names]).orderBy(*SITE)


def feature_table(
    profiles: DataFrame, cells: list[str], k: int = 25, names: list[str] = ["mean", "var", "diff"], lengths: list[int] = [1001],
    tracks: DataFrame | None = None, tiles: DataFrame | None = None, wlen: int = 1001, min_cells: int = 1, tile: int = dna.TILE,
) -> DataFrame:
    """One row per site: states and neighbours of each cell, statistics, flags of tracks and the sequence window.

    Profiles and neighbours are written once each, in buckets of sites: the sites' coverage, the grid, statistics over cells and
    in windows, and the joins between them need no exchange. Neighbours are searched for once.
    """
    own = bucketed(profiles.select(*SITE, "cell", "value"), "profiles", SITE)
    seen = own.groupBy(*SITE).agg(F.count("value").alias("cov"), *[c.alias(n) for n, c in sites.gated(names).items()]).filter(F.col("cov") >= min_cells)
    grid = seen.select(*SITE, F.explode(F.array(*[F.lit(c) for c in cells])).alias("cell"))
    near = bucketed(neighbors.knn_neighbors(grid, own, k, own=True).select("*", *windows.cell_means(lengths)), "neighbours", SITE)
    wide = [c.alias(f"win_{n}_{m}") for n in lengths for m, c in windows.stats_of_means(names, n).items()]
    by_cell = F.map_from_entries(F.collect_list(F.struct("cell", F.struct("value", "state", "dist")))).alias("cells")
    out = near.groupBy(*SITE).agg(by_cell, *wide).join(seen.select(*SITE, *names), SITE)
    targets = seen.select(*SITE)
    if tracks is not None:
        out = out.join(intervals.tracks_of_sites(targets, tracks), SITE, "left")
    if tiles is not None:
        out = out.join(dna.extract_dna_windows(targets, tiles, wlen, tile).select(*SITE, "seq"), SITE, "left")
    return out


def evaluation_report(preds: DataFrame, tracks: DataFrame, min_sites: int = 100, points: int | None = None, curves: list[str] = ["roc", "pr"]) -> tuple[DataFrame, DataFrame]:
    """Metrics, and curves of binary outputs (at most ``points`` each), global and per track; annotated predictions are counted, and written once."""
    kept = [*SITE, "output", "y", "z", *[c for c in evaluation.CLASSES if c in preds.columns]]
    keys, found = ["anno", "output"], {name: evaluation.curve(name) for name in curves}
    rows = staged(evaluation.annotated_counts(preds.select(*kept), tracks, min_sites), "annotated")
    each = []
    for name, of in found.items():
        points_of = of(rows, keys)
        each.append((points_of if points is None else evaluation.thin_curve(points_of, points, keys)).withColumn("curve", F.lit(name)))
    return evaluation.evaluate_outputs(rows, keys), sites.concat_tables(*each)


#: Activations are sums of floating numbers; rounded, those that should tie with a threshold do.
DIGITS = 6


def activations(windows_: DataFrame, weights: DataFrame, wlen: int) -> tuple[DataFrame, int, DataFrame]:
    """How often each activation occurs (written once), the number of positions, and the filters' thresholds."""
    n = windows_.count() * wlen
    counts = staged(motifs.activation_counts(windows_, weights, digits=DIGITS), "activation-counts")
    return counts, n, staged(motifs.activation_threshold(counts, n), "thresholds")


def activating_kmers(windows_: DataFrame, weights: DataFrame, thresholds: DataFrame, filter_len: int, keys: list[str] = SITE) -> DataFrame:
    """The letters under the activations that reach a threshold, by a scan from which nothing else leaves the tasks."""
    above = {r["filter"]: r["threshold"] for r in thresholds.collect()}  # a row per filter
    hits = motifs.scan_filters(windows_, weights, keys=keys, above=above, digits=DIGITS)
    return motifs.activating_kmers(hits, windows_, thresholds, filter_len, keys)


def motif_table(windows_: DataFrame, weights: DataFrame, filter_len: int, wlen: int, keys: list[str] = SITE) -> tuple[DataFrame, DataFrame]:
    """Filter statistics and position weights. Windows are scanned twice: for the thresholds, then for what passes them."""
    counts, n, thresholds = activations(windows_, weights, wlen)
    pwms = motifs.pwm(activating_kmers(windows_, weights, thresholds, filter_len, keys))
    return motifs.filter_stats(counts, n, pwms), pwms
