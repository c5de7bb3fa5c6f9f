"""MinHash near-dedup: universal hash minima, bands, signatures and full sets, components by stars.

A document's set are its distinct shingles of five words. 120 functions of a universal family
(multiply, add, take the upper half) hash each set; their minima are its signature, and
24 bands of five of them decide who is compared with whom: a pair of similarity 0.85 shares a
band with probability 1 - 8e-7. Of a pair that meets, first the signatures are compared: it goes on if they
agree in as many places as a pair at the limit does in all but one of 10^9 cases. Then the whole sets
are, so no link is made that they don't confirm.

Texts of one set are one row here, so exact copies cost nothing. Bands are taken in rounds; what
one has joined, the next need not compare. Bands of very many texts are cut into blocks
(``similar._cells``), never one task's work and never written as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_size, staged
from . import similar
from .similar import _cells, _marked, _marks
from .stars import near_roots, star_components, star_step

BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: Bands of each round; after them, what is left of bands of very many texts, if there are any, is compared block by block.
ROUNDS = ((0, 4), (4, BANDS))
#: How often a pair at the limit may fail the comparison of signatures.
MISSES = 1e-9
#: Words that are looked at together, whatever the length of a text.
PIECE = 1 << 16

_RND = np.random.default_rng(29)
_MUL = _RND.integers(0, 1 << 63, (HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RND.integers(0, 1 << 63, (HASHES, 1), np.uint64)


def shingle_set(data: bytes | None, n: int) -> np.ndarray:
    """The sorted XXH64 (seed 42) of the distinct ``n``-word shingles; of fewer words the whole sequence, of none nothing.

    ASCII letters are lowered and words end at ASCII white space. Long texts are cut into
    pieces that share ``n - 1`` words.
    """
    digest, found, kept, left = xxhash.xxh64_intdigest, [], [], (data or b"").lower()
    while left:
        words = left.split(None, PIECE)
        left = words.pop() if len(words) > PIECE else b""
        words = kept + words
        if len(words) >= n:
            found.append(np.unique(np.fromiter((digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(n)))), np.uint64)))
        kept = words[-(n - 1) :] if n > 1 else []
    if not found:
        return np.array([digest(b" ".join(kept), 42)] if kept else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature: for each hash function the least value over the shingles' lower halves."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    x = shingles & np.uint64(0xFFFFFFFF)
    for k in range(0, len(x), 512):
        h = _MUL * x[k : k + 512]
        h += _ADD
        h >>= np.uint64(32)
        np.minimum(least, h.min(axis=1), out=least)
    return least.astype("<u4")


def least_agreement(similarity: float, misses: float = MISSES) -> int:
    """The most places that may be asked to agree so that a pair at ``similarity`` has fewer with a probability of ``misses`` at most."""
    total = 0.0
    for k in range(HASHES + 1):
        total += comb(HASHES, k) * similarity**k * (1 - similarity) ** (HASHES - k)
        if total > misses:
            return k
    return HASHES


def signatures(rows: DataFrame, n: int) -> DataFrame:
    """``set_id, size, signature`` beside ``key`` for the rows ``key, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                ids, sizes, signs = [], [], []
                for x in part.column("text").cast(pa.binary()):
                    shingles = shingle_set(x.as_py(), n)
                    ids.append(xxhash.xxh128_hexdigest(shingles.tobytes()))
                    sizes.append(len(shingles))
                    signs.append(minima(shingles).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], ["key", "set_id", "size", "signature"])

    return rows.mapInArrow(run, T.StructType([rows.schema["key"], *T._parse_datatype_string("set_id string, size long, signature binary").fields]))


def full_sets(rows: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """``set_id, signature, shingles`` for the rows of ``sets`` (``key, set_id, signature``); of ``rows`` only those whose mark occurs are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                data = [shingle_set(x.as_py(), n).tobytes() for x in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("set_id"), part.column("signature"), pa.array(data, pa.binary())], ["set_id", "signature", "shingles"])

    marks = _marks(sets).withColumnRenamed("mark", "__mark")
    few = rows.withColumn("__own", _marked("key")).join(marks, F.col("__own") == F.col("__mark"), "left_semi").drop("__own")
    return few.join(sets, "key").dropDuplicates(["set_id"]).select("set_id", "signature", "text").mapInArrow(run, "set_id string, signature binary, shingles binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection of two sets is at least ``percent`` hundredths of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _forest(ids: list[str], roots: list[str], signs: list[bytes], sets: list[np.ndarray], percent: int, agree: int) -> list[tuple[str, str]]:
    """Links that join the members of one cell which are alike, directly or in steps; members of one root are joined already."""
    signature = np.frombuffer(b"".join(signs), "<u4").reshape(-1, HASHES)
    sizes = np.array([len(x) for x in sets])
    root = np.unique(np.array(roots), return_inverse=True)[1]
    left, out = np.ones(len(ids), bool), []
    for first in range(len(ids)):
        if not left[first]:
            continue
        queue = list(np.flatnonzero(root == root[first]))
        left[queue] = False
        while queue and left.any():
            x = queue.pop()
            rest = np.flatnonzero(left)
            near = (np.minimum(sizes[rest], sizes[x]) * 100 >= percent * np.maximum(sizes[rest], sizes[x])) & ((signature[rest] == signature[x]).sum(axis=1) >= agree)
            for y in rest[near]:
                if left[y] and alike(sets[x], sets[y], percent):
                    out.append((ids[x], ids[y]))
                    family = np.flatnonzero((root == root[y]) & left)
                    left[family] = False
                    queue += list(family)
    return out


def verified_links(cells: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links within each ``cell`` of ``cell, set_id, root``, signatures first, then the whole sets."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(full, "set_id").select("cell", "set_id", "root", "signature", "shingles").repartition(parts, "cell").sortWithinPartitions("cell", "set_id")
    agree = least_agreement(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            found = _forest(*members, percent, agree) if len(members[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["a", "b"])

        last, members = None, ([], [], [], [])
        rows = (row for batch in batches for s in range(0, batch.num_rows, 128) for row in zip(*(batch.slice(s, 128).column(k).to_pylist() for k in range(5))))
        for cell, i, r, sign, x in chain(rows, [(None, "", "", b"", b"")]):
            if cell != last:
                if members[0]:
                    yield links()
                last, members = cell, ([], [], [], [])
            if not members[0] or members[0][-1] != i:
                for column, value in zip(members, (i, r, sign, np.frombuffer(x, np.uint64))):
                    column.append(value)

    return rows.mapInArrow(run, "a string, b string")


def minhash_roots(rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """``node, root`` of the distinct sets (``key, set_id, size, signature``) that are linked with another."""
    band = lambda k: F.xxhash64(k, F.substring("signature", k * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    bands = sets.select("set_id", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    bands = staged(bands.join(shared, "key", "left_semi"), "minhash-bands")
    asked = bands.select("set_id").distinct()
    full = staged(full_sets(rows, sets.join(asked, "set_id", "left_semi").select("key", "set_id", "signature"), n), "minhash-sets")
    sizes = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    large = staged(sizes.filter((F.col("n") > 2 * similar.BLOCK_TEXTS) | (F.col("shingles") > 2 * similar.BLOCK_SHINGLES)).select("key"), "minhash-large")
    rounds = [bands.filter(F.col("band").between(first, last - 1)) for first, last in ROUNDS]
    if not large.isEmpty():
        rounds.append(bands.join(large, "key", "left_semi"))
    links = None
    for k, own in enumerate(rounds):
        own = own.withColumn("root", F.col("set_id"))
        if links is not None:
            roots = near_roots(links)
            own = own.join(roots, own.set_id == roots.node, "left").select("key", "set_id", "size", F.coalesce(roots.root, "set_id").alias("root"))
        more = staged(verified_links(_cells(own.select("key", "set_id", "size", "root"), k == len(ROUNDS)), full, percent), "minhash-links")
        if not more.isEmpty():
            links = star_step(more if links is None else links.unionByName(more))
    return sets.sparkSession.createDataFrame([], "node string, root string") if links is None else star_components(links)


def minhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts link if the intersection of their shingle sets is at least ``percent`` hundredths of the union.
    ``component_id`` is the smallest id that can be reached over links, the row's own included;
    ``kept`` tells the rows that have it. Null texts, and texts without words, have no shingles and
    are linked with nothing, not even with each other. Null ids never become a component's id unless it
    has no other (then all its rows are kept). Repeated rows stay, each with the same result. Other columns are
    ignored, whatever their names. No rows in, no rows out.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("version"))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    found = staged(signatures(rows, n), "minhash-signatures")
    filled = found.filter("size > 0")
    sets = filled.groupBy("set_id").agg(
        F.min("key").alias("key"), F.min("key.id").alias("least"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("signature").alias("signature")
    )
    sets = staged(sets, "minhash-distinct")
    roots = minhash_roots(rows, sets.select("key", "set_id", "size", "signature"), n, percent)
    rooted = sets.join(roots, sets.set_id == roots.node, "left").select("set_id", "least", "n", F.coalesce("root", "set_id").alias("root"))
    rooted = staged(rooted, "minhash-rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = staged(join_by_size(rooted, groups, ["root"], "size", rooted.count(), "inner").select("set_id", "component_id", "n"), "minhash-names")
    own = filled.select("key", "set_id", "size")
    met = join_by_size(own, named, ["set_id"], "n", own.count(), "inner").select("key", "size", "component_id")
    alone = found.filter("size = 0").select("key", "size", F.col("key.id").alias("component_id"))
    out = met.unionByName(alone)
    return out.select(F.col("key.id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.col("key.id").eqNullSafe(F.col("component_id")).alias("kept"))
