"""Closed intervals ``start .. end`` on chromosomes.

All functions take the columns that separate sets of intervals as ``by`` (for instance
track and chromosome).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BIN, SITE
from .running import running

#: Track names become array elements, so their number is bounded.
MAX_TRACKS = 100_000
#: Intervals are looked up in bins of 16, 256, ... positions: the smallest size that is no shorter than the interval.
STEP = 16


def track_names(intervals: DataFrame) -> list[str]:
    names = sorted(r.track for r in intervals.filter("track IS NOT NULL").select("track").distinct().limit(MAX_TRACKS + 1).collect())
    if len(names) > MAX_TRACKS:
        raise ValueError(f"more than {MAX_TRACKS} tracks")
    return names


def group_intervals(intervals: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """``intervals`` with ``group``, from 0: those that overlap, directly or over others, share one."""
    bin = F.floor(F.col("start") / bin_size)
    seen = running(intervals, by, ["start", "end"], bin, {"__end": ("max", F.col("end"))}, before=True)
    new = F.coalesce((F.col("start") > F.col("__end")).cast("int"), F.lit(1))
    # of equal intervals the one that begins a group comes first
    flagged = seen.withColumn("__new", new).withColumn("__old", 1 - F.col("__new"))
    out = running(flagged, by, ["start", "end", "__old"], bin, {"group": ("sum", F.col("__new"))})
    return out.select(*intervals.columns, (F.col("group") - 1).alias("group"))


def merge_intervals(intervals: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """Unions of overlapping intervals; ends that touch merge, neighbouring integers don't."""
    rows = intervals.select(*by, "start", "end").distinct()
    merged = group_intervals(rows, by, bin_size).groupBy(*by, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(*by, "start", "end")


def extend_intervals(intervals: DataFrame, min_len: int, min_pos: int = 1) -> DataFrame:
    """Intervals shorter than ``min_len`` grow evenly; what the lower limit takes is added at the end."""
    start, end = F.col("start"), F.col("end")
    missing = F.greatest(F.lit(0), min_len - (end - start + 1))
    lower = F.greatest(F.lit(min_pos), start - F.floor(missing / 2))
    grown = intervals.withColumn("__start", lower)
    upper = end + F.greatest(F.lit(0), min_len - (end - F.col("__start") + 1))
    return grown.withColumn("end", upper).withColumn("start", F.col("__start")).drop("__start")


def _bin_size() -> Column:
    """The bin size of an interval's length, as a whole power of ``STEP``."""
    n = F.greatest(F.col("end") - F.col("start") + 1, F.lit(1)).cast("long")
    sizes = [STEP**k for k in range(1, 16)]
    return F.coalesce(*[F.when(n <= s, F.lit(s).cast("long")) for s in sizes])


def overlapping(points: DataFrame, intervals: DataFrame, by: list[str], columns: list[Column]) -> DataFrame:
    """``points`` (columns ``by`` and ``pos``) with ``columns`` of each interval that holds one: a row for every such pair.

    An equi-join on bins. Intervals stand in the one or two bins of their own size that they reach
    into, points in one bin of each size that occurs, so a point is compared with few
    intervals that don't hold it, whatever their lengths.
    """
    sized = intervals.filter(F.col("start") <= F.col("end")).withColumn("__size", _bin_size())
    sizes = sorted(r[0] for r in sized.select("__size").distinct().collect())  # at most 15
    names = [c.alias(f"__v{i}") for i, c in enumerate(columns)]
    bins = F.sequence(F.floor(F.col("start") / F.col("__size")), F.floor(F.col("end") / F.col("__size")))
    right = sized.select(*[F.col(c).alias(f"__i_{c}") for c in by], F.col("__size").alias("__i_size"), F.explode(bins).alias("__i_bin"), F.col("start").alias("__s"), F.col("end").alias("__e"), *names)
    keys = F.array(*[F.lit(s).cast("long") for s in sizes]) if sizes else F.array().cast("array<bigint>")
    left = points.withColumn("__size", F.explode(keys)).withColumn("__bin", F.floor(F.col("pos") / F.col("__size")))
    on = [left[c] == right[f"__i_{c}"] for c in by] + [left["__size"] == right["__i_size"], left["__bin"] == right["__i_bin"], left["pos"].between(right["__s"], right["__e"])]
    return left.join(right, on).select(*points.columns, *[f"__v{i}" for i in range(len(columns))])


def interval_index(points: DataFrame, intervals: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """``points`` with ``index``: the place, from 0, of the interval that holds it among those of its set, or -1.

    Intervals must not overlap.
    """
    bin = F.floor(F.col("start") / bin_size)
    placed = running(intervals.select(*by, "start", "end"), by, ["start"], bin, {"__n": ("count", F.lit(1))})
    hits = overlapping(points.select(*by, "pos").distinct(), placed, by, [F.col("__n") - 1]).select(*[F.col(c).alias(f"__h_{c}") for c in (*by, "pos")], "__v0")
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__h_{c}") for c in (*by, "pos")])
    return points.join(hits, on, "left").select(*points.columns, F.coalesce("__v0", F.lit(-1)).cast("long").alias("index"))


def index_of_sites(sites: DataFrame, intervals: DataFrame, tracks: list[str] | None = None, bin_size: int = BIN) -> DataFrame:
    """``sites`` with ``track`` and ``index`` as in ``interval_index``, a row for each track; a track's intervals must not overlap.

    The intervals that hold a site are found per site, not per site and track.
    """
    own = intervals.filter("track IS NOT NULL").select("track", "chromo", "start", "end")
    tracks = track_names(own) if tracks is None else tracks
    placed = running(own, ["track", "chromo"], ["start"], F.floor(F.col("start") / bin_size), {"__n": ("count", F.lit(1))})
    met = overlapping(sites.select(*SITE).distinct(), placed, ["chromo"], [F.col("track"), F.col("__n") - 1])
    held = met.groupBy(*[F.col(c).alias(f"__h_{c}") for c in SITE]).agg(F.map_from_entries(F.collect_list(F.struct("__v0", "__v1"))).alias("__index"))  # at most an entry for each track
    near = sites.join(held, (F.col("chromo") == F.col("__h_chromo")) & (F.col("pos") == F.col("__h_pos")), "left")
    each = near.select(*sites.columns, "__index", F.explode(F.array(*[F.lit(t) for t in tracks]).cast("array<string>")).alias("track"))
    return each.select(*sites.columns, "track", F.coalesce(F.try_element_at("__index", F.col("track")), F.lit(-1)).cast("long").alias("index"))


def tracks_of_sites(sites: DataFrame, intervals: DataFrame) -> DataFrame:
    """``chromo, pos, tracks``: the different tracks, in order, whose intervals hold a site; sites that none holds have no row.

    Overlaps within a track need no merging for this.
    """
    met = overlapping(sites.select(*SITE).distinct(), intervals.filter("track IS NOT NULL"), ["chromo"], [F.col("track")])
    return met.groupBy(*SITE).agg(F.sort_array(F.collect_set("__v0")).alias("tracks"))  # as many as there are tracks


def annotate_sites(sites: DataFrame, intervals: DataFrame, tracks: list[str] | None = None) -> DataFrame:
    """``sites`` with ``track`` and ``flag``, a row for each track: 1 if an interval of it holds the site."""
    tracks = track_names(intervals) if tracks is None else tracks
    held = tracks_of_sites(sites, intervals).select(*[F.col(c).alias(f"__h_{c}") for c in SITE], F.col("tracks").alias("__tracks"))
    met = sites.join(held, (F.col("chromo") == F.col("__h_chromo")) & (F.col("pos") == F.col("__h_pos")), "left")
    each = met.select(*sites.columns, "__tracks", F.explode(F.array(*[F.lit(t) for t in tracks]).cast("array<string>")).alias("track"))
    return each.select(*sites.columns, "track", F.coalesce(F.array_contains("__tracks", F.col("track")).cast("int"), F.lit(0)).alias("flag"))


def nearest_interval_distance(points: DataFrame, intervals: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """``points`` with ``distance``: 0 inside an interval, else to the nearest end; null where the set has no interval."""
    both = points.withColumn("__end", F.lit(None).cast("long")).withColumn("__start", F.lit(None).cast("long"))
    ends = intervals.select(*by, F.col("start").cast(points.schema["pos"].dataType).alias("pos"), F.col("end").cast("long").alias("__end"), F.col("start").cast("long").alias("__start"))
    events = both.unionByName(ends, allowMissingColumns=True).withColumn("__kind", F.col("__end").isNull().cast("int"))
    bin = F.floor(F.col("pos") / bin_size)
    met = running(events, by, ["pos", "__kind"], bin, {"__last": ("max", F.col("__end")), "__next": ("min", F.col("__start"), True)})
    pos = F.col("pos")
    gap = F.when(F.col("__last") >= pos, 0).otherwise(F.least(pos - F.col("__last"), F.col("__next") - pos))
    return met.filter("__kind = 1").select(*points.columns, gap.cast("long").alias("distance"))
