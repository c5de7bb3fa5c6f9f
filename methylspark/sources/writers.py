"""Writers of feature chunks, bedGraph files, reports and motifs."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import output_group, output_leaf
from ..operators.sites import assign_chunks
from ..schema import SITE

#: Fixed value: the order of letters in MEME files.
MEME_LETTERS = "ACGT"


def publish_named(rows: DataFrame, path: str, suffix: str, order: list[str], write) -> list[str]:
    """One file ``<name><suffix>`` in ``path`` for each value of the column ``name``, sorted by ``order``; returns the names.

    Rows are dealt out by name and written to a hidden folder by Spark's own writer, ``write(writer, folder)``, whose commit keeps
    what failed tasks leave out. Only when all is written are the files renamed, and ``_SUCCESS`` is put last. If anything fails
    no file is left: those published so far and the hidden folder are deleted. A name that is null, holds ``/``, or is there already, is an
    error. A name is one task's stream, as it is one file. Without rows there are no files.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # PySpark has no calls for files
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    hidden, done = f"{path}/_{uuid.uuid4().hex}", []
    store = at(path).getFileSystem(conf)
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, "name").sortWithinPartitions("name", *order)
        write(dealt.write.partitionBy("name"), hidden)
        found = {}
        for folder in store.listStatus(at(hidden)):
            if folder.isDirectory():
                name = unquote(folder.getPath().getName().removeprefix("name="))
                files = [f.getPath() for f in store.listStatus(folder.getPath()) if not f.getPath().getName().startswith(("_", "."))]
                if name == "__HIVE_DEFAULT_PARTITION__" or "/" in name or len(files) != 1 or store.exists(at(path, name + suffix)):
                    raise ValueError(f"can't publish {name + suffix} in {path}")
                found[name + suffix] = files[0]
        for name, file in found.items():
            done.append(name)
            if not store.rename(file, at(path, name)):
                raise OSError(f"can't rename {file.toString()} to {name}")
        store.create(at(path, "_SUCCESS"), True).close()
    except BaseException:
        for name in done:
            store.delete(at(path, name), False)
        raise
    finally:
        store.delete(at(hidden), True)
    return done


def write_feature_chunks(features: DataFrame, path: str, chunk_size: int = 32_768, sites: DataFrame | None = None) -> list[str]:
    """Parquet files of at most ``chunk_size`` sites, ``c<chromo>_<start>-<end>.parquet`` by the range of sites in order; returns the names.

    ``chunk, start, end`` stay in the rows.
    """
    chunks = assign_chunks(features.select(*SITE).distinct() if sites is None else sites, chunk_size)
    rows = features.join(chunks, SITE)
    rows = rows.withColumn("name", F.format_string("c%s_%06d-%06d", "chromo", "start", "end"))
    return publish_named(rows, path, ".parquet", SITE, lambda w, folder: w.parquet(folder))


def bedgraph_rows(imputed: DataFrame) -> DataFrame:
    """``name, chromo, start, end, value``: text as in the files, a file name per output (cells by their name)."""
    o = F.col("output")
    name = F.when(output_group(o) == "cpg", output_leaf(o)).otherwise(F.replace(o, F.lit("/"), F.lit("_")))
    return imputed.select(
        name.alias("name"), F.concat(F.lit("chr"), "chromo").alias("chromo"), F.col("pos").cast("long").alias("start"),
        (F.col("pos") + 1).cast("long").alias("end"), F.format_string("%.5f", F.col("value")).alias("value"),
    )


def write_bedgraph(imputed: DataFrame, path: str) -> list[str]:
    """A file ``<name>.bedGraph.gz`` for each output, sorted, without a header; returns the names. A cell has no more sites than its genome, so it is one task's work."""
    rows = bedgraph_rows(imputed)
    return publish_named(rows, path, ".bedGraph.gz", ["chromo", "start"], lambda w, folder: w.option("compression", "gzip").csv(folder, sep="\t"))


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.repartition("output", "chromo").sortWithinPartitions("output", *SITE).write.partitionBy("output").parquet(path)


def report_text(df: DataFrame) -> DataFrame:
    """Floating numbers with five decimals, as text."""
    five = lambda c: F.format_string("%.5f", F.col(c))
    return df.select(*[F.when(F.col(c).isNotNull(), five(c)).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


def write_report_tsv(df: DataFrame, path: str, gzip: bool = False, one_file: bool = True) -> None:
    out = report_text(df)
    (out.coalesce(1) if one_file else out).write.option("compression", "gzip" if gzip else "none").csv(path, sep="\t", header=True)  # reports are small


def kmer_fasta(kmers: DataFrame) -> DataFrame:
    """``filter, value``: FASTA records, numbered from 0 per filter."""
    from pyspark.sql import Window

    w = Window.partitionBy("filter").orderBy(*[c for c in kmers.columns if c != "filter"])  # fragments of a filter are capped by its threshold
    n = F.row_number().over(w) - 1
    return kmers.select("filter", n.alias("n"), F.concat(F.lit(">"), n.cast("string"), F.lit("\n"), "kmer").alias("value"))


def write_kmers_fasta(kmers: DataFrame, path: str) -> None:
    rows = kmer_fasta(kmers)
    rows.repartition("filter").sortWithinPartitions("filter", "n").select("filter", "value").write.partitionBy("filter").text(path)


def meme_blocks(pwms: DataFrame) -> DataFrame:
    """``filter, block``: the text of each motif."""
    row = pwms.groupBy("filter", "offset", "nb_site").pivot("nt", list(MEME_LETTERS)).agg(F.first("freq"))
    line = F.format_string(" ".join(["%.4f"] * 4), *[F.col(c) for c in MEME_LETTERS])
    lines = row.groupBy("filter").agg(F.max("nb_site").alias("nb_site"), F.sort_array(F.collect_list(F.struct("offset", line.alias("line")))).alias("rows"))  # a row per offset
    head = F.format_string("MOTIF filter%d\nletter-probability matrix: alength= 4 w= %d nsites= %d", F.col("filter"), F.size("rows"), F.col("nb_site"))
    return lines.select("filter", F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n")).alias("block"))


def meme_head(background: DataFrame) -> DataFrame:
    """One row ``block`` with the introduction."""
    freq = {c: F.max(F.when(F.col("nt") == c, F.col("freq"))) for c in MEME_LETTERS}
    text = F.format_string(" ".join(f"{c} %.4f" for c in MEME_LETTERS), *freq.values())
    return background.agg(F.concat(F.lit(f"MEME version 4\n\nALPHABET= {MEME_LETTERS}\n\nBackground letter frequencies:\n"), text, F.lit("\n")).alias("block"))


def write_meme(pwms: DataFrame, background: DataFrame, path: str) -> None:
    """One MEME file of all filters, in order."""
    head = meme_head(background).select(F.lit(-1).alias("filter"), "block")
    rows = head.unionByName(meme_blocks(pwms).select(F.col("filter").cast("int").alias("filter"), "block"))
    rows.coalesce(1).sortWithinPartitions("filter").select("block").write.text(path)  # filters are a few hundred
