"""Near copies at a similarity: SimHash first, MinHash bands for what it can't reach, every link checked.

At a Jaccard similarity of 0.8 two fingerprints of 64 bits differ in about ten bits, which no
ball around them can bridge. So links of up to three bits (meeting in the middle, as in
``simhash``) join the closest copies with few comparisons, and texts that share one of
20 bands of five MinHash values are compared after that, unless they are joined already: a
pair of similarity 0.8 shares one with probability 0.9996. Shingle sets are compared in
full before any link is made, and are kept only for texts that share a key with another.

Keys of very many texts are never one task's work. First each part of such a group is
compared with the group's first text, which joins most of a large family of copies; then the texts
outside of the largest joined family meet all others, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .components import components
from .simhash import close_links, fingerprint, shingle_hashes

BANDS, ROWS = 20, 5
#: Bands of each round; what a round joins, the next need not compare.
ROUNDS = ((0, 4), (4, BANDS))
#: Texts, and shingles, that one block of a comparison holds on either side.
BLOCK_TEXTS, BLOCK_SHINGLES = 500, 1 << 20
#: Values that keys are mapped to when rows are looked up by a broadcast; it bounds the broadcast.
MARKS = 1 << 20

_RND = np.random.default_rng(17)
_MUL = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band from the sorted hashes of distinct shingles; none for a text without words."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 1024):
        x = shingles[k : k + 1024, None] * _MUL + _ADD
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), b) - (1 << 63) for b, band in enumerate(least.reshape(BANDS, ROWS))]


def _distinct(data: bytes | None, n: int) -> tuple[list[int], np.ndarray]:
    hashes = shingle_hashes(data or b"", n)
    return hashes, np.unique(np.array(hashes, np.uint64))


def signatures(rows: DataFrame, n: int) -> DataFrame:
    """``key, set_id, size, fp, bands`` of ``key, text``: a name for the set of shingles, its size, the SimHash, the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                both = [_distinct(x.as_py(), n) for x in part.column("text").cast(pa.binary())]
                columns = [
                    pa.array([xxhash.xxh128_hexdigest(x.tobytes()) for _, x in both]), pa.array([len(x) for _, x in both], pa.int64()),
                    pa.array([fingerprint(h) for h, _ in both], pa.int64()), pa.array([band_keys(x) for _, x in both], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], ["key", "set_id", "size", "fp", "bands"])

    return rows.mapInArrow(run, T.StructType([rows.schema["key"], *T._parse_datatype_string("set_id string, size long, fp long, bands array<bigint>").fields]))


def _marked(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARKS))


def _marks(keys: DataFrame) -> DataFrame:
    """The marks of ``key``: at most ``MARKS`` rows, whatever the number of keys, so that a broadcast is safe."""
    return F.broadcast(staged(keys.select(_marked("key").alias("mark")).distinct(), "marks"))


def shingle_sets(rows: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """``set_id, shingles`` for the rows of ``sets`` (``key, set_id``): the sorted hashes as bytes.

    Of ``rows`` only those whose mark occurs are moved to be joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                data = [_distinct(x.as_py(), n)[1].tobytes() for x in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.array(data, pa.binary())], ["set_id", "shingles"])

    few = rows.withColumn("mark", _marked("key")).join(_marks(sets), "mark", "left_semi").drop("mark")
    return few.join(sets, "key").dropDuplicates(["set_id"]).select("set_id", "text").mapInArrow(run, "set_id string, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _forest(ids: list[str], sets: list[np.ndarray], roots: list[str], similarity: float) -> list[tuple[str, str]]:
    """Links that join those which are similar, directly or in steps; texts of one root are joined already."""
    out, rest = [], list(range(len(ids)))
    by_root: dict[str, list[int]] = {}
    for i, r in enumerate(roots):
        by_root.setdefault(r, []).append(i)
    left = set(rest)
    for first in rest:
        if first not in left:
            continue
        queue = by_root[roots[first]]
        left.difference_update(queue)
        queue = list(queue)
        while queue and left:
            x = queue.pop()
            for y in list(left):
                if y in left and similar(sets[x], sets[y], similarity):
                    out.append((ids[x], ids[y]))
                    family = by_root[roots[y]]
                    queue += family
                    left.difference_update(family)
    return out


def checked_links(cells: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links within each ``cell`` of ``cell, set_id, root``, each checked on the whole sets."""
    rows = cells.join(shingles, "set_id").select("cell", "set_id", "root", "shingles").repartition("cell").sortWithinPartitions("cell", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, roots, found = None, [], [], []
        batch_of = lambda links: pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.string()) for k in (0, 1)], ["a", "b"])
        for batch in batches:
            for s in range(0, batch.num_rows, 128):  # so that few sets are held twice
                part = batch.slice(s, 128)
                for cell, i, r, x in zip(*(part.column(k).to_pylist() for k in range(4))):
                    if cell != last:
                        if ids:
                            yield batch_of(_forest(ids, found, roots, similarity))
                        last, ids, roots, found = cell, [], [], []
                    if not ids or ids[-1] != i:
                        ids.append(i)
                        roots.append(r)
                        found.append(np.frombuffer(x, np.uint64))
        if ids:
            yield batch_of(_forest(ids, found, roots, similarity))

    return rows.mapInArrow(run, "a string, b string")


def _near_fingerprints(sets: DataFrame) -> DataFrame:
    """``cell, set_id``: pairs of sets of equal fingerprints (with the first such set) or of close ones."""
    first = staged(sets.groupBy("fp").agg(F.min("set_id").alias("first")), "fingerprints")
    close = close_links(first.select("fp"))
    close = close.join(first.toDF("a", "sa"), "a").join(first.toDF("b", "sb"), "b").select("sa", "sb")
    equal = sets.join(first, "fp").filter("set_id > first").select(F.col("first").alias("sa"), F.col("set_id").alias("sb"))
    pairs = close.unionByName(equal)
    return pairs.select(F.xxhash64("sa", "sb").alias("cell"), F.explode(F.array("sa", "sb")).alias("set_id"))


def _cells(members: DataFrame, blockwise: bool) -> DataFrame:
    """``cell, set_id, root`` from ``key, set_id, root, size``: what has to be compared of keys that span several roots.

    Keys of few texts are a cell. Of others each part is a cell with the key's first text; or, if
    ``blockwise``, each pair of a part and a part of the texts outside of the key's largest root.
    """
    part_of = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK_TEXTS, F.col(size) / BLOCK_SHINGLES))
    keys = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.struct(F.xxhash64("set_id").alias("h"), "set_id", "root")).alias("first"),
    ).filter("least <> most").withColumn("parts", part_of("n", "shingles"))
    dealt = F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("parts"))
    if not blockwise:
        met = members.join(keys, "key").withColumn("part", F.when(F.col("parts") > 2, dealt).otherwise(F.lit(0).cast("long")))
        own = met.select(F.xxhash64("key", "part").alias("cell"), "set_id", "root")
        heads = keys.filter("parts > 2").select("key", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        return own.unionByName(heads.select(F.xxhash64("key", "part").alias("cell"), "first.set_id", "first.root"))
    large = keys.filter("parts > 2").select("key", "parts")
    sizes = members.join(large.select("key"), "key", "left_semi").groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    of = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), (F.sum("n") - F.max("n")).alias("others"), F.sum("shingles").alias("shingles"))
    of = of.join(large, "key").withColumn("other_parts", F.least(part_of("others", "shingles"), F.col("parts")))
    met = members.join(of.select("key", "parts", "top", "other_parts"), "key").withColumn("part", dealt)
    other = F.pmod(F.xxhash64("set_id", F.lit(2)), F.col("other_parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = met.select("key", "part", every("other_parts").alias("other"), "set_id", "root")
    right = met.filter("root <> top").select("key", every("parts").alias("part"), other.alias("other"), "set_id", "root")
    return left.unionByName(right).select(F.xxhash64("key", "part", "other").alias("cell"), "set_id", "root")


def similar_roots(rows: DataFrame, sets: DataFrame, n: int, similarity: float) -> DataFrame:
    """``set_id, root`` of the distinct sets (``key, set_id, size, fp, bands``) of ``rows`` (``key, text``)."""
    close = staged(_near_fingerprints(sets), "near-fingerprints")
    bands = sets.select("set_id", "size", F.posexplode("bands").alias("band", "hash")).withColumn("key", F.xxhash64("band", "hash"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    bands = staged(bands.select("set_id", "size", "band", "key").join(shared, "key"), "shared-bands")
    asked = close.select("set_id").union(bands.select("set_id")).distinct()
    shingles = staged(shingle_sets(rows, sets.select("key", "set_id").join(asked, "set_id", "left_semi"), n), "shingles")

    links = staged(checked_links(close.withColumn("root", F.col("set_id")), shingles, similarity), "similar-links")
    roots = components(links)
    for k, (first, last) in enumerate((*ROUNDS, (0, BANDS))):
        own = bands.filter(F.col("band").between(first, last - 1))
        own = own.join(roots, own.set_id == roots.node, "left").select("key", "set_id", "size", F.coalesce("root", "set_id").alias("root"))
        more = staged(checked_links(_cells(own, k == len(ROUNDS)), shingles, similarity), "similar-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    return sets.join(roots, sets.set_id == roots.node, "left").select("set_id", F.coalesce("root", "set_id").alias("root"))


def drop_similar(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component of similar texts: that of the smallest id.

    Null and empty texts have no words and are alike. Rows that repeat both id and text count
    as one. Null ids are smallest here, so that exactly one document of a component stays.
    Other columns are kept as they are, whatever their names. No rows in, no rows out.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    found = staged(signatures(rows, n), "signatures")
    sets = staged(found.groupBy("set_id").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-sets")
    rooted = sets.join(similar_roots(rows, sets, n, similarity), "set_id").select("key", "root")
    stay = staged(rooted.groupBy("root").agg(F.min("key").alias("key")).select("key"), "representatives")
    # most rows stay and have a mark of their own: only the others are moved to be looked at
    doubtful = found.groupBy("key").agg(F.count("*").alias("n")).join(stay.withColumn("stays", F.lit(True)), "key", "left").filter("n > 1 OR stays IS NULL")
    marks = _marks(doubtful)
    whole = docs.select(F.struct("*").alias("row"), key.alias("key")).withColumn("own", _marked("key"))  # so no column of docs can clash
    sure = whole.join(marks, F.col("own") == F.col("mark"), "left_anti")
    asked = whole.join(marks, F.col("own") == F.col("mark"), "left_semi").join(stay, "key", "left_semi").dropDuplicates(["key"])
    return sure.select("row").union(asked.select("row")).select("row.*")
