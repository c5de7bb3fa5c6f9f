"""Queries that write the driver's tables as files of a format, and read them back.

Files are written to the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dna, motifs
from ..sources import readers, writers
from ..sources import store
from ..sources.profiles import scan_profiles as scan
from ..staging import scratch_path
from . import adapters as a
from . import queries as q
from .queries import query


#: Sequences of a gzip file. A file for each sequence would make as many files as there are documents.
RECORDS = 20_000


def _text(rows: DataFrame, path: str, folder: str, order: str) -> str:
    """``value`` lines, a file for each ``folder``, in order."""
    rows.repartition(folder).sortWithinPartitions(folder, order).select(folder, "value").write.partitionBy(folder).option("compression", "gzip").text(path)
    return path


@query("SELECT chromo, pos::INT AS pos, cell, value FROM profiles", "profiles")
def read_profiles(s, d):
    """Half of the cells as tab-separated files with a comment, half as bedGraph."""
    return readers.read_profiles(s, _profile_files(s, d, scratch_path(s, "profiles")))


def _profile_files(s, d, path: str) -> str:
    p = a.profiles(s, d)
    bed, chromo = F.col("cell") >= "c5", F.concat(F.lit("chr"), F.lower("chromo"))
    line = F.when(bed, F.concat_ws("\t", chromo, "pos", F.col("pos") + 1, "value")).otherwise(F.concat_ws("\t", chromo, "pos", "value"))
    heads = p.select("cell").distinct().select("cell", F.lit(-1).cast("long").alias("pos"), F.when(bed, "track type=bedGraph").otherwise("# chromo pos value").alias("value"))
    rows = p.select("cell", "pos", line.alias("value")).unionByName(heads)
    return _text(rows, path, "cell", "pos")


@query("SELECT chromo, pos::INT AS pos, cell, value FROM profiles WHERE chromo IN ('A', 'R') AND pos BETWEEN 50 AND 1500 AND cell <> 'c2' AND value > 0.5", "profiles")
def scan_profiles(s, d):
    """The files of ``read_profiles`` through the data source, with filters that are pushed to it and others that aren't."""
    path = scratch_path(s, "profile-files")
    _profile_files(s, d, path)
    return scan(s, path).filter("chromo IN ('A', 'R') AND pos BETWEEN 50 AND 1500 AND cell <> 'c2' AND value > 0.5")


@query("SELECT chromo, pos::INT AS pos FROM sites", "sites")
def read_positions(s, d):
    """Every site twice, with other spellings of its chromosome."""
    path = scratch_path(s, "positions")
    lines = a.sites(s, d).select(F.explode(F.array(F.concat(F.lit("chr"), "chromo"), F.lower("chromo"))).alias("c"), "pos")
    lines.select(F.concat_ws("\t", "c", "pos").alias("value")).write.text(path)
    return readers.read_positions(s, path)


@query('SELECT track, chromo, "start"::INT AS "start", "end"::INT AS "end" FROM merged', "merged")
def read_bed(s, d):
    rows = a.intervals(s, d).select("track", "start", F.concat_ws("\t", F.concat(F.lit("chr"), "chromo"), "start", "end", F.lit("name")).alias("value"))
    return readers.read_bed(s, _text(rows, scratch_path(s, "bed"), "track", "start"), merge=True)


@query(
    """SELECT chromo, t AS tile, greatest(1, t * 256 - 15) AS "start", substr(seq, greatest(1, t * 256 - 15)::INT, (least(length(seq), t * 256 + 272) - greatest(1, t * 256 - 15) + 1)::INT) AS seq, length(seq)::BIGINT AS n
       FROM (SELECT chromo, seq, unnest(range(greatest(1, (length(seq) + 255) // 256))) AS t FROM sequences)""",
    "sequences",
)
def read_fasta(s, d):
    """gzip files of up to ``RECORDS`` sequences each, with lines of 60 letters."""
    text = F.concat(F.lit(">"), "chromo", F.lit(" dna\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    path = scratch_path(s, "fasta")
    rows = a.sequences(s, d).repartition("chromo").select(text.alias("value"))
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return readers.read_fasta(s, path, overlap=16, tile=256)


@query(
    """SELECT chromo, t AS tile, greatest(1, t * 1000 - 49) AS "start", substr(seq, greatest(1, t * 1000 - 49)::INT, (least(length(seq), t * 1000 + 1050) - greatest(1, t * 1000 - 49) + 1)::INT) AS seq, length(seq)::BIGINT AS n
       FROM (SELECT 'D' || chromo AS chromo, seq, unnest(range(greatest(1, (length(seq) + 999) // 1000))) AS t FROM sequences)""",
    "sequences",
)
def read_fasta_records(s, d):
    """All sequences as records of eight plain files, which Spark may split anywhere."""
    text = F.concat(F.lit(">chrD"), "chromo", F.lit(" dna\n"), F.regexp_replace("seq", "(.{50})", "$1\n"))
    path = scratch_path(s, "fasta-records")
    a.sequences(s, d).select(text.alias("value")).repartition(8, "value").write.text(path)
    return readers.read_fasta(s, path, overlap=50, tile=1000)


@query("SELECT 'm' || s_suppkey AS id, split_part(s_name, '_', 1) AS protein, 'http://r' || s_nationkey AS url FROM supplier WHERE s_suppkey % 2 = 1")
def read_meme_motifs(s, d):
    """Suppliers as motifs, every other one without a name."""
    name = F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit(" ("), "s_name", F.lit(")_x"))).otherwise("")
    text = F.concat(F.lit("MOTIF m"), F.col("s_suppkey").cast("string"), name, F.lit("\nletter-probability matrix: a MOTIF of no letters\nURL http://r"), F.col("s_nationkey").cast("string"), F.lit("\n"))
    path = scratch_path(s, "meme-motifs")
    s.read.parquet(f"{d}/supplier.parquet").select(text.alias("value")).write.text(path)
    return readers.read_meme_motifs(s, path)


@query(
    """SELECT 'filter' || (s_suppkey % 24) AS query_id, 'm' || s_nationkey AS target_id, (s_suppkey % 7)::INT AS optimal_offset, (s_suppkey * 37 % 50)::DOUBLE / 100 AS p_value,
       (s_suppkey * 31 % 50)::DOUBLE / 100 AS e_value, (s_suppkey * 29 % 50)::DOUBLE / 100 AS q_value, (s_suppkey % 11)::INT AS overlap, s_name AS target_consensus, (s_suppkey % 24)::INT AS idx FROM supplier"""
)
def read_motif_hits(s, d):
    k = F.col("s_suppkey")
    share = lambda n: (k * n % 50).cast("double") / 100
    path = scratch_path(s, "motif-hits")
    s.read.parquet(f"{d}/supplier.parquet").select(
        F.concat(F.lit("filter"), k % 24).alias("#Query ID"), F.concat(F.lit("m"), "s_nationkey").alias("Target ID"), (k % 7).alias("Optimal offset"),
        share(37).alias("p-value"), share(31).alias("E-value"), share(29).alias("q-value"), (k % 11).alias("Overlap"), F.col("s_name").alias("Target consensus"),
    ).write.csv(path, sep="\t", header=True)
    return readers.read_motif_hits(s, path)


@query(
    """SELECT chromo, pos, (n - 1) // 1000 AS chunk, (n - 1) // 1000 * 1000 AS "start", least(((n - 1) // 1000 + 1) * 1000, c) AS "end"
       FROM (SELECT *, row_number() OVER (PARTITION BY chromo ORDER BY pos) AS n, count(*) OVER (PARTITION BY chromo) AS c FROM sites)""",
    "sites",
)
def write_feature_chunks(s, d):
    path = scratch_path(s, "chunks")
    writers.write_feature_chunks(a.sites(s, d), path, 1000)
    return s.read.parquet(path)


@query(
    """SELECT DISTINCT printf('c%s_%06d-%06d.parquet', chromo, (n - 1) // 1000 * 1000, least(((n - 1) // 1000 + 1) * 1000, c)) AS file, count(*) AS rows
       FROM (SELECT *, row_number() OVER (PARTITION BY chromo ORDER BY pos) AS n, count(*) OVER (PARTITION BY chromo) AS c FROM sites) GROUP BY ALL""",
    "sites",
)
def feature_chunk_files(s, d):
    """The files of ``write_feature_chunks`` and how many rows are in each."""
    path = scratch_path(s, "chunk-files")
    writers.write_feature_chunks(a.sites(s, d), path, 1000)
    return s.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))


@query(q.ORACLES["bedgraph_rows"])
def write_bedgraph(s, d):
    path = scratch_path(s, "bedgraph")
    writers.write_bedgraph(q.evaluation.impute(a.named_outputs(s, d)), path)
    rows = s.read.csv(path, sep="\t", schema="chromo string, start long, end long, value string")
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.bedGraph\.gz$", 1).alias("name"))


@query("SELECT chromo, pos, output, y, z FROM named_outputs", "named_outputs")
def write_predictions(s, d):
    path = scratch_path(s, "predictions")
    writers.write_predictions(a.named_outputs(s, d).drop("cell"), path)
    return s.read.parquet(path)


@query(
    """SELECT output, count(*)::VARCHAR AS nb_tot, count(y)::VARCHAR AS nb_obs, format('{:.5f}', count(y) / count(*)) AS frac_obs, format('{:.5f}', avg(y)) AS mean, format('{:.5f}', var_pop(y)) AS var
       FROM predictions GROUP BY output""",
    "predictions",
)
def write_report_tsv(s, d):
    path = scratch_path(s, "report")
    writers.write_report_tsv(q.sites.output_stats(a.predictions(s, d).select("output", F.col("y").alias("value"))), path, gzip=True)
    return s.read.csv(path, sep="\t", header=True)


@query(
    f"WITH {q._WINDOWS}, {q._THR}, {q._KMERS} SELECT filter, kmer AS value FROM kmers UNION ALL SELECT filter, '>' || (row_number() OVER (PARTITION BY filter) - 1) FROM kmers", q._MOTIF
)
def write_kmers_fasta(s, d):
    path = scratch_path(s, "kmers")
    writers.write_kmers_fasta(q.activating_kmers(s, d), path)
    return s.read.text(path).select("filter", "value")


_FOUR = "format('{:.4f}', floor(freq * 10000 + 0.5) / 10000)"


@query(
    f"""WITH {q._WINDOWS}, {q._THR}, {q._KMERS},
    bg AS (SELECT nt, n / sum(n) OVER () AS freq FROM (SELECT nt, sum(length(seq) - length(replace(seq, nt, ''))) + 1 AS n FROM wins, (SELECT unnest(['A', 'T', 'G', 'C']) AS nt) GROUP BY nt))
    SELECT unnest(['MEME version 4', 'ALPHABET= ACGT', 'Background letter frequencies:']) AS value UNION ALL SELECT string_agg(nt || ' ' || {_FOUR}, ' ' ORDER BY nt) FROM bg
    UNION ALL SELECT DISTINCT 'MOTIF filter' || filter FROM pw
    UNION ALL SELECT 'letter-probability matrix: alength= 4 w= ' || count(DISTINCT "offset") || ' nsites= ' || max(nb_site) FROM pw GROUP BY filter
    UNION ALL SELECT string_agg({_FOUR}, ' ' ORDER BY nt) FROM pw GROUP BY filter, "offset" """,
    q._MOTIF,
)
def write_meme(s, d):
    """The file's lines, without the empty ones."""
    path = scratch_path(s, "meme")
    w, _, _, thr = q._motif_parts(s, d)
    writers.write_meme(motifs.pwm(q._kmers(s, d, w, thr)), dna.nucleotide_background(w), path)
    return s.read.text(path).filter("value <> ''")


@query("SELECT chromo, pos, cell, value FROM profiles WHERE chromo = 'N' AND pos BETWEEN 100 AND 1200", "profiles")
def region_of_store(s, d):
    """A region of the profiles as a clustered store."""
    path = scratch_path(s, "site-store")
    store.write_site_store(a.profiles(s, d), path, rows_per_file=2000)
    return store.read_region(s, path, "N", 100, 1200)


@query("SELECT chromo, min(pos) AS low, max(pos) AS high, count(*) AS rows FROM profiles GROUP BY chromo", "profiles")
def store_bounds(s, d):
    """The bounds of each chromosome from those of the store's files."""
    path = scratch_path(s, "site-store")
    store.write_site_store(a.profiles(s, d), path, rows_per_file=2000)
    return store.file_bounds(s, path).groupBy("chromo").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
