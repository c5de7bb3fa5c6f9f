"""Sequence tiles, windows around sites and k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LETTERS, SITE

TILE = 1 << 16


def cut_tiles(sequences: DataFrame, overlap: int, tile: int = TILE) -> DataFrame:
    """``chromo, tile, start, seq, n`` from ``chromo, seq``: tiles with ``overlap`` letters beyond either end.

    ``start`` is the 1-based position of the first letter, ``n`` the length of the whole sequence.
    """
    n = F.length("seq")
    cut = sequences.select("chromo", "seq", n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / tile)))).alias("tile"))
    start = F.greatest(F.lit(1), F.col("tile") * tile + 1 - overlap)
    end = F.least(F.col("n"), (F.col("tile") + 1) * tile + overlap)
    return cut.select("chromo", "tile", start.cast("long").alias("start"), F.substring("seq", start.cast("int"), (end - start + 1).cast("int")).alias("seq"), "n")


def extract_dna_windows(sites: DataFrame, tiles: DataFrame, wlen: int, tile: int = TILE) -> DataFrame:
    """``sites`` with ``seq``: the ``wlen`` letters around each, upper case, N beyond the ends, and ``is_cpg``.

    ``tiles`` must overlap by at least ``wlen // 2``. ``seq`` is null for a position that
    the sequence does not have; ``check_positions`` reports those.
    """
    if wlen % 2 == 0:
        raise ValueError("the window length must be odd")
    half = wlen // 2
    t = tiles.select(F.col("chromo").alias("__c"), F.col("tile").alias("__t"), F.col("start").alias("__s"), F.col("seq").alias("__seq"), "n")
    met = sites.join(t, (F.col("chromo") == F.col("__c")) & (F.floor((F.col("pos") - 1) / tile) == F.col("__t")), "left")
    first = F.greatest(F.lit(1), F.col("pos") - half)
    last = F.least(F.col("n"), F.col("pos") + half)
    core = F.upper(F.substring("__seq", (first - F.col("__s") + 1).cast("int"), (last - first + 1).cast("int")))
    window = F.concat(F.repeat(F.lit("N"), (first - (F.col("pos") - half)).cast("int")), core, F.repeat(F.lit("N"), (F.col("pos") + half - last).cast("int")))
    inside = (F.col("pos") >= 1) & (F.col("pos") <= F.col("n"))
    met = met.withColumn("seq", F.when(inside, window))
    return met.select(*[c for c in sites.columns if c != "seq"], "seq", (F.substring("seq", half + 1, 2) == "CG").alias("is_cpg"))


def fill_unknown(windows: DataFrame, seed: int = 0, wlen: int | None = None) -> DataFrame:
    """``windows`` (``chromo, pos, seq``) with a letter for each that isn't A, T, G or C, given by a hash of seed, chromosome and position.

    So windows that overlap agree on every letter, on any machine and in any run. The middle of ``seq`` stands at
    ``pos``; all windows are ``wlen`` long, or as long as the row's own. Letters beyond the chromosome's ends are filled too. Null stays null.
    """
    half = F.floor((F.length("seq") if wlen is None else F.lit(wlen)) / 2)
    digest = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), "chromo", (F.col("pos").cast("long") - half + i).cast("string")))
    code = lambda i: (F.conv(F.substring(digest(i), 1, 8), 16, 10).cast("long") % 4).cast("int")
    letter = lambda x, i: F.when(x.isin(*LETTERS), x).otherwise(F.substring(F.lit(LETTERS), code(i) + 1, F.lit(1)))
    filled = F.concat_ws("", F.transform(F.split(F.upper("seq"), ""), letter))
    return windows.withColumn("seq", F.when(F.upper("seq").rlike(f"[^{LETTERS}]"), filled).otherwise(F.upper("seq")))


def check_cpg_sites(windows: DataFrame) -> DataFrame:
    """Sites at which the sequence is not CG, or that lie outside of it."""
    return windows.filter("is_cpg IS NULL OR NOT is_cpg").select(*SITE, "seq")


def kmer_freq(sequences: DataFrame, k: int, keys: list[str], piece: int = 4096) -> DataFrame:
    """``keys``, ``kmer``, ``index`` and ``n`` for every k-mer of ``seq`` that occurs.

    The index is the sum of code * 4^i over the letters, from the first. K-mers with
    letters other than A, C, G and T are left out. Sequences are cut into pieces, of which one
    expression takes all k-mers; chromosomes should come as tiles.
    """
    n = F.length("seq")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - k) / piece).cast("int")), lambda i: F.substring("seq", i * piece + 1, F.lit(piece + k - 1)))
    pieces = sequences.filter(n >= k).select(*keys, F.explode(cut).alias("__p"))
    every = F.regexp_extract_all(F.upper("__p"), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    rows = pieces.select(*keys, F.explode(every).alias("kmer"))
    codes = F.split(F.translate("kmer", LETTERS, "0123"), "")
    index = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0).cast("long"), lambda a, i: a + F.get(codes, i).cast("long") * F.pow(F.lit(4.0), i).cast("long"))
    return rows.groupBy(*keys, "kmer").agg(F.count("*").alias("n")).select(*keys, "kmer", index.alias("index"), "n")


def kmer_vector(freq: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """``keys`` and ``counts``: the 4^k counts of each sequence, for small k."""
    found = freq.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("index", "n"))).alias("__m"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), lambda i: F.coalesce(F.try_element_at("__m", i.cast("long")), F.lit(0))).alias("counts"))


def nucleotide_background(windows: DataFrame) -> DataFrame:
    """``nt, freq`` of the four letters over all windows, one added to each count."""
    counts = [(F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(c)))) + 1).alias(c) for c in LETTERS]
    wide = windows.select(F.upper("seq").alias("seq")).agg(*[F.coalesce(c, F.lit(1)).alias(n) for c, n in zip(counts, LETTERS)])
    long = wide.unpivot([], list(LETTERS), "nt", "n")
    total = sum(F.col(c) for c in LETTERS)
    return long.join(F.broadcast(wide.select(total.alias("all")))).select("nt", (F.col("n") / F.col("all")).alias("freq"))
