"""The k nearest observed sites on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BIN, SITE
from ..staging import staged
from .running import running


def knn_neighbors(targets: DataFrame, profiles: DataFrame | None, k: int, rank_bin: int = 4096, own: bool = False) -> DataFrame:
    """``chromo, pos, cell, state, dist``: arrays of 2k, left neighbours far to near, then right ones near to far.

    With ``own`` also ``value``, what the profile has at the site itself.

    ``targets`` has ``chromo, pos, cell``; neighbours are the observed sites of the whole
    profile (one row per site and cell), the site itself left out. Slots without a
    neighbour are null.

    Without ``profiles`` the targets, a row for each site and cell, have ``value`` and are the whole profile as well; they are read
    twice, so write them before.

    Observed sites are numbered along the chromosome (two-level running count) and cut
    into bins of ``rank_bin`` numbers, to whose edges the k sites beyond are copied: each
    task holds a bin, however long the chromosome or dense the cell.
    """
    if k < 1 or rank_bin <= k:
        raise ValueError("k must be at least 1 and less than rank_bin")
    if profiles is None:
        rows = targets.select(*SITE, "cell", F.lit(True).alias("__t"), "value")
    else:
        seen = profiles.filter("value IS NOT NULL").select(*SITE, "cell", "value")
        rows = targets.select(*SITE, "cell").distinct().withColumn("__t", F.lit(True)).join(seen, [*SITE, "cell"], "full")
        rows = staged(rows, "sites-and-sources")  # the running count reads them twice
    by = ["chromo", "cell"]
    n = F.when(F.col("value").isNotNull(), 1)
    ranked = running(rows, by, ["pos"], F.floor(F.col("pos") / BIN), {"__r": ("count", n)})
    at = lambda r: F.floor(r / rank_bin)
    r, observed = F.col("__r"), F.col("value").isNotNull()
    bins = F.when(observed, F.array_distinct(F.array(at(F.greatest(r - k, F.lit(0))), at(r), at(r + k)))).otherwise(F.array(at(r)))
    spread = ranked.withColumn("__own", at(r)).withColumn("__bin", F.explode(bins))
    spread = spread.withColumn("__seen", F.when(observed, F.struct("pos", "value")))
    near = lambda f, i: F.expr(f"{f}(__seen, {i}) IGNORE NULLS OVER (PARTITION BY chromo, cell, __bin ORDER BY pos)")
    slots = F.array(*[near("lag", i) for i in range(k, 0, -1)], *[near("lead", i) for i in range(1, k + 1)])
    met = spread.withColumn("__slots", slots).filter("__t AND __bin = __own")
    return met.select(
        *SITE, "cell", F.transform("__slots", lambda x: x["value"]).alias("state"),
        F.transform("__slots", lambda x: F.abs(x["pos"] - F.col("pos")).cast("double")).alias("dist"), *(["value"] if own else []),
    )


def neighbor_rows(neighbors: DataFrame) -> DataFrame:
    """Long form: ``chromo, pos, cell, slot, n_state, n_dist`` for the slots that hold a neighbour."""
    slots = F.posexplode(F.arrays_zip(F.col("state").alias("n_state"), F.col("dist").alias("n_dist"))).alias("slot", "__n")
    return neighbors.select(*SITE, "cell", slots).select(*SITE, "cell", "slot", "__n.n_state", "__n.n_dist").filter("n_dist IS NOT NULL")
