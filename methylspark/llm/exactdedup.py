"""Exact dedup by deterministic block naming (DataFrame functions only).

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted over all partitions (by their first bytes, then by a hash, then by the rest where two share
both) and numbered by their place, so each document becomes a row of integers; then
adjacent pairs of integers are sorted and numbered in the same way, again and again, until one integer is
left. Two documents have the same integer (at the same number of blocks) exactly when
their bytes are equal: a number stands for content and not for a hash of it, and is the same
however the table is partitioned.

Block content is shuffled once, to find the distinct ones; sorting moves its first bytes only, as the
bounds of a range sort are drawn from what it sorts by and pass through the driver. Documents find the numbers by a 64-bit
hash of the block, after a look at all numbered blocks has shown that no two of them
share a hash; if two do, the join takes the content instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unstage

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _blocks(data: Column, n_blocks: Column, size: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda i: F.struct(i.alias("idx"), F.substring(data, i * size + 1, F.lit(size)).alias("block")),
    )


#: Bytes that blocks are sorted by before their hash.
LEAD = 32
#: Groups of more than this share of all rows are joined by a broadcast; there are fewer of them than its inverse.
HOT_SHARE = 1 / 5000


def _numbered(distinct: DataFrame, keys: list[str], kept: list[str], label: str) -> DataFrame:
    """The columns ``kept`` and ``name``: the place of each row, from 1, in the order of ``keys``.

    Rows are dealt out by range and sorted within partitions; a place is the one within the
    partition after the sizes of those before it.
    """
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    placed = staged(ordered.select(*kept, F.spark_partition_id().alias("__part"), at.alias("__at")), label)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(sizes), "__part").select(*kept, (F.col("__before") + F.col("__at") + 1).alias("name"))


def block_identities(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = 2048, hash_bits: int = 64
) -> DataFrame:
    """One row per document: ``row_id, doc_id, n_blocks, name, text_sha256``.

    ``(n_blocks, name)`` is the identity of the normalised text. ``row_id`` tells apart
    repeated rows. ``hash_bits`` is for tests, which make blocks collide.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    norm = norm.withColumn("data", F.col("norm").cast("binary"))
    norm = norm.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block_bytes)).cast("int"))
    key = F.shiftright(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block")
    cut = F.inline(_blocks(F.col("data"), F.col("n_blocks"), block_bytes))

    blocks = norm.select(cut).select(key.alias("h"), "block").distinct().withColumn("lead", F.substring("block", 1, LEAD))
    names = _numbered(blocks.select("lead", "h"), ["lead", "h"], ["h"], "block-names")
    clash = not names.groupBy("h").count().filter("count > 1").isEmpty()
    on = ["h"]
    if clash:
        unstage(names)
        on = ["h", "block"]
        names = _numbered(blocks, ["lead", "h", "block"], on, "block-names")

    rows = norm.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_blocks", F.sha2("norm", 256).alias("text_sha256"), "data"
    )
    rows = rows.select("row_id", "doc_id", "n_blocks", "text_sha256", F.inline(_blocks(F.col("data"), F.col("n_blocks"), block_bytes)))
    first = F.col("idx") == 0
    rows = rows.select(
        "row_id", "n_blocks", "idx", key.alias("h"), *(["block"] if clash else []),
        F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("text_sha256")).alias("text_sha256"),
    )
    named = staged(rows.join(names, on).select("row_id", "n_blocks", "idx", "name", "doc_id", "text_sha256"), "named-blocks")
    unstage(names)

    heads = named.filter("idx = 0").select("row_id", "doc_id", "n_blocks", "text_sha256")
    one = named.filter("n_blocks = 1").select("row_id", "name")
    most = named.agg(F.max("n_blocks")).first()[0] or 1
    level = named.filter("n_blocks > 1").select("row_id", F.col("n_blocks").alias("left"), "idx", "name")
    done, used = [one], []
    while most > 1:
        odd = F.col("idx") % 2 == 1
        pairs = level.groupBy("row_id", "left", F.expr("idx div 2").alias("idx")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(0)).alias("b")
        )
        pairs = staged(pairs, "block-pairs")
        numbers = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "pair-names")
        used += [pairs, numbers]
        level = pairs.join(numbers, ["a", "b"]).select("row_id", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.col("idx").cast("int").alias("idx"), "name")
        level = staged(level, "block-level")
        used.append(level)
        done.append(level.filter("left = 1").select("row_id", "name"))
        level = level.filter("left > 1")
        most = (most + 1) // 2
    ids = done[0]
    for x in done[1:]:
        ids = ids.unionByName(x)
    out = staged(heads.join(ids, "row_id"), "identities")
    unstage(named, *used)
    return out


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = 2048, hash_bits: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Null and empty texts are equal. Of equal texts the row with the smallest id stays;
    null ids come last, and of rows that repeat id and text exactly one stays. Very long
    texts are more blocks, each a row of its own. Other columns of ``docs`` are ignored,
    whatever their names. No rows in, no rows out.
    """
    ids = block_identities(docs, text_col, id_col, block_bytes, hash_bits)
    groups = ids.groupBy("n_blocks", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("best"),
    )
    groups = staged(groups, "groups")
    most = ids.count() * HOT_SHARE
    large = groups.filter(F.col("group_size") > most)  # so rows of one group don't meet in one task
    keys = ["n_blocks", "name"]
    rest = ids.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.filter(F.col("group_size") <= most), keys)
    return ids.join(F.broadcast(large), keys).unionByName(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256"
    )
