"""Readers of profiles, sites, intervals, sequences and motifs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import format_chromo
from ..operators.dna import TILE
from ..operators.intervals import merge_intervals
from ..operators.sites import filter_chromos, validate_values
from ..staging import staged


def _lines(spark: SparkSession, paths) -> DataFrame:
    """``line, file`` of text files; gzip files are one split each, so rows are dealt out afterwards by the caller."""
    return spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def _name(file: Column, folder: str) -> Column:
    """What a file is called: its folder's value where that is ``folder=value``, else its name up to the first dot."""
    own = F.regexp_extract(file, f"/{folder}=([^/]+)/", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(file, r"([^/.]*)[^/]*$", 1))


def read_profiles(spark: SparkSession, paths, chromos: list[str] | None = None, check: bool = True) -> DataFrame:
    """``chromo, pos, cell, value`` from tab-separated or bedGraph files, one per cell.

    The cell is the file's name up to the first dot, or the value of a folder ``cell=``. A file with a ``track`` line is
    bedGraph, with the value in the fourth column. ``#`` starts a comment. Values outside
    of [0, 1] are an error if ``check``.
    """
    lines = _lines(spark, paths)
    bed = lines.filter(F.col("line").startswith("track")).select("file").distinct().withColumn("bed", F.lit(True))
    part = F.split("line", "\t")
    rows = lines.filter(~F.col("line").rlike("^(#|track)") & (F.trim("line") != "")).join(bed, "file", "left")
    value = F.when(F.col("bed"), F.get(part, F.lit(3))).otherwise(F.get(part, F.lit(2)))
    out = rows.select(
        format_chromo(F.get(part, F.lit(0))).alias("chromo"), F.get(part, F.lit(1)).cast("int").alias("pos"),
        _name(F.col("file"), "cell").alias("cell"), value.cast("double").alias("value"),
    )
    if chromos:
        out = filter_chromos(out, chromos)
    if check and (bad := validate_values(out).first()):
        raise ValueError(f"a value outside of [0, 1]: {bad.asDict()}")
    return out


def read_positions(spark: SparkSession, paths) -> DataFrame:
    """Different sites of two-column files."""
    t = spark.read.csv(paths, sep="\t", comment="#", schema="chromo string, pos int")
    return t.select(format_chromo(F.col("chromo")).alias("chromo"), "pos").distinct().orderBy("chromo", "pos")


def read_bed(spark: SparkSession, paths, merge: bool = False, most: int | None = None) -> DataFrame:
    """``track, chromo, start, end`` from the first three columns; the track is the file's name up to the first dot, or the value of a folder ``track=``."""
    t = spark.read.csv(paths, sep="\t", comment="#", schema="chromo string, start int, end int")
    t = t.select(_name(F.col("_metadata.file_path"), "track").alias("track"), format_chromo(F.col("chromo")).alias("chromo"), "start", "end")
    if most is not None:
        t = t.orderBy("track", "chromo", "start", "end").limit(most)
    return merge_intervals(t, ["track", "chromo"]) if merge else t


#: The chromosome in a file's name.
NAME = r"(?i)chromosome\.([^.]+)\.fa"
#: Letters of a record that are handed on together.
PIECE = 1 << 16
_PIECES = "file string, split long, record int, head string, offset long, seq string"


def _pieces(spark: SparkSession, paths) -> DataFrame:
    """``file, split, record, head, offset, seq``: the letters of every split of every file in pieces.

    Splits are those of Spark's text reader, told apart by where they begin; its rows come in the order of
    the file. ``record`` counts the head lines within the split (0: what goes on from the split
    before), ``offset`` the letters before the piece since that head line. A head line is a row of its own.
    """
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("record", pa.int32()), ("head", pa.string()), ("offset", pa.int64()), ("seq", pa.string())])
        last, record, offset, held, size, rows = None, 0, 0, [], 0, []

        def flush() -> None:
            nonlocal offset, held, size
            if held:
                rows.append({"file": last[0], "split": last[1], "record": record, "head": None, "offset": offset, "seq": "".join(held)})
                offset, held, size = offset + size, [], 0

        for batch in batches:
            for line, file, split in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != last:
                    flush()
                    last, record, offset = (file, split), 0, 0
                line = line.strip()
                if line.startswith(">"):
                    flush()
                    record, offset = record + 1, 0
                    rows.append({"file": file, "split": split, "record": record, "head": line, "offset": 0, "seq": ""})
                elif line:
                    held.append(line)
                    size += len(line)
                    if size >= PIECE:
                        flush()
            if len(rows) >= 16:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows.clear()
        flush()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return lines.select("line", "file", "split").mapInArrow(run, _PIECES)


def read_fasta(spark: SparkSession, paths, overlap: int = 1000, tile: int = TILE, single: bool = False) -> DataFrame:
    """Tiles ``chromo, tile, start, seq, n`` (see ``cut_tiles``) of all records of FASTA files, plain or gzip.

    With ``single``, a file of more than one record is an error.

    The chromosome is the first word of a record's head line; where a file has one record and its name has
    ``chromosome.<c>.fa``, that is the chromosome, and a head line isn't needed. Other letters without a
    head line are an error. A record without letters is one empty tile.

    A record may go on over any number of splits: each split's task cuts its own letters; how many records and letters came before follows from
    a row per split. No task holds more than a piece or a tile.
    """
    pieces = staged(_pieces(spark, paths), "fasta-pieces")
    n = F.length("seq").cast("long")
    splits = pieces.groupBy("file", "split", "record").agg(F.sum(n).alias("n")).groupBy("file", "split").agg(F.max("record").alias("heads"), F.max_by("n", "record").alias("tail"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    splits = splits.withColumn("__sum", zero(F.sum("tail").over(before)))  # of what follows each split's last head
    since = zero(F.max(F.when(F.col("heads") > 0, F.col("__sum"))).over(before))
    splits = splits.select(F.col("file").alias("__f"), F.col("split").alias("__s"), zero(F.sum("heads").over(before)).alias("__records"), (F.col("__sum") - since).alias("__letters"))
    met = pieces.join(splits, (F.col("file") == F.col("__f")) & (F.col("split") == F.col("__s")))
    at = F.when(F.col("record") == 0, F.col("__letters")).otherwise(0) + F.col("offset")
    placed = met.select("file", (F.col("__records") + F.col("record")).alias("id"), "head", at.alias("at"), "seq")

    records = placed.groupBy("file", "id").agg(F.max("head").alias("head"), F.sum(n).alias("n"))
    own = F.regexp_extract(F.regexp_extract("file", r"([^/]*)$", 1), NAME, 1)
    files = records.groupBy("file").agg(F.count("*").alias("__count")).select(F.col("file").alias("__file"), "__count")
    word = F.regexp_extract("head", r"^>\s*(\S*)", 1)
    lost = F.raise_error(F.concat(F.lit("letters without a head line in "), "file"))
    many = F.raise_error(F.concat(F.lit("more than one sequence in "), "file"))
    name = F.when(F.lit(single) & (F.col("__count") > 1), many).when((own != "") & (F.col("__count") == 1), own).when(F.col("head").isNotNull(), word).otherwise(lost)
    named = records.join(files, F.col("file") == F.col("__file")).select(F.col("file").alias("__f"), F.col("id").alias("__id"), format_chromo(name).alias("chromo"), "n")

    met = placed.join(named, (F.col("file") == F.col("__f")) & (F.col("id") == F.col("__id")))
    end, most = F.col("at") + n, F.greatest(F.lit(0), F.ceil(F.col("n") / tile) - 1)
    first = F.least(most, F.greatest(F.lit(0), F.floor((F.col("at") - overlap) / tile)))
    tiles = F.explode(F.sequence(first, F.greatest(first, F.least(most, F.floor((end - 1 + overlap) / tile))))).alias("tile")
    met = met.select("file", "id", "chromo", "n", "at", "seq", tiles)
    low, high = F.greatest(F.lit(0), F.col("tile") * tile - overlap), (F.col("tile") + 1) * tile + overlap
    cut = F.greatest(F.col("at"), low)
    part = F.substring("seq", (cut - F.col("at") + 1).cast("int"), F.greatest(F.lit(0), F.least(end, high) - cut).cast("int"))
    whole = met.select("file", "id", "chromo", "n", "tile", F.struct("at", part.alias("part")).alias("__p")).groupBy("file", "id", "chromo", "n", "tile").agg(F.sort_array(F.collect_list("__p")).alias("__p"))
    seq = F.array_join(F.transform("__p", lambda x: x["part"]), "")
    return whole.select("chromo", "tile", (F.greatest(F.lit(0), F.col("tile") * tile - overlap) + 1).alias("start"), seq.alias("seq"), "n")


def read_meme_motifs(spark: SparkSession, paths) -> DataFrame:
    """``id, protein, url`` of the motifs of a MEME file that have a name; the protein's name without brackets, up to ``_``."""
    text = spark.read.text(paths, wholetext=True)
    # only blocks that begin a line are motifs, like the lines that name them
    split = F.split("value", r"(?m)^MOTIF")
    blocks = text.select(F.explode(F.slice(split, F.lit(2), F.size(split) - 1)).alias("b"))
    words = F.split(F.trim(F.split("b", r"\r?\n")[0]), r"\s+")
    protein = F.split(F.regexp_replace(words[1], r"\(([^)]+)\)", "$1"), "_")[0]
    return blocks.filter(F.size(words) >= 2).select(words[0].alias("id"), protein.alias("protein"), F.regexp_extract("b", r"(?m)^URL\s+(\S+)", 1).alias("url"))


def read_motif_hits(spark: SparkSession, paths) -> DataFrame:
    """Matches of filters with motifs: lower-case columns with ``_``, ``idx`` from the number after ``filter``; numbers are cast."""
    t = spark.read.csv(paths, sep="\t", header=True)
    t = t.toDF(*[re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") for c in t.columns])
    numbers = [c for c in t.columns if re.fullmatch("[peq]_value", c)]
    t = t.withColumns({c: F.col(c).cast("double") for c in numbers} | {c: F.col(c).cast("int") for c in t.columns if c in ("overlap", "optimal_offset")})
    return t.withColumn("idx", F.regexp_extract("query_id", r"filter(\d+)", 1).cast("int")).filter("query_id IS NOT NULL")
