"""SimHash near-dedup by meeting in the middle of Hamming balls.

A fingerprint is 64 bits; a bit is set if it is set in more than half of the hashes of
the word shingles. Fingerprints link at ``radius`` (3) or fewer differing bits.

Two fingerprints meet if the balls of half the radius around them overlap. Half of 3 is
not whole: balls of one bit miss a difference of three, balls of two bits have 2,081
members. So the 64 bits are split into fields (three), and each fingerprint emits its
ball once per field with that field masked: of at most three differing bits
one field holds at least one (or none differ), what is left differs in at most two, and
balls of one bit overlap. That makes 131 variants, and no link is lost. Equal
variants meet in a shuffle; the fingerprints that meet are compared, so that what only
seems close is dropped. Radius and number of fields are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_size, staged
from .components import components

RADIUS, FIELDS = 3, 3


def shingle_hashes(data: bytes, n: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``n`` words, repeats included."""
    words = data.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(b" ".join(words), 42)]
    return [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(n)))]


def fingerprint(hashes: list[int]) -> int:
    """The SimHash as a signed 64-bit integer; no hashes give zero."""
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; null texts have no words and fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = [fingerprint(shingle_hashes(x.as_py() or b"", n)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variant_masks(radius: int = RADIUS, fields: int = FIELDS) -> list[tuple[int, int]]:
    """For each variant (131 at the defaults): the bits that are kept, the bits that are flipped or set.

    A field holds at least ``radius / fields`` of the differing bits, rounded up; the
    balls' radius is half of what may be left.
    """
    ball = -(-(radius - -(-radius // fields)) // 2)
    edges = [round(64 * k / fields) for k in range(fields + 1)]
    if min(b - a for a, b in zip(edges, edges[1:])) < fields.bit_length():
        raise ValueError("fields must have room for their number")
    out = []
    for k, (start, end) in enumerate(zip(edges, edges[1:])):
        field = ((1 << end - start) - 1) << start
        tag = (k + 1) << start  # the masked bits tell which field they are
        free = [b for b in range(64) if not field >> b & 1]
        flips = [sum(1 << b for b in bits) for n in range(ball + 1) for bits in combinations(free, n)]
        out += [(_signed((1 << 64) - 1 ^ field), _signed(tag | flip)) for flip in flips]
    return out


def variants(fps: DataFrame, radius: int = RADIUS, fields: int = FIELDS) -> DataFrame:
    """``key, fp``: the masked balls of the column ``fp``."""
    fp = F.col("fp")
    masks = variant_masks(radius, fields)
    if len(masks) <= 256:
        keys = F.array(*[fp.bitwiseAND(F.lit(k)).bitwiseXOR(F.lit(f)) for k, f in masks])
    else:  # too many for one generated expression
        keep, flip = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*masks))
        keys = F.zip_with(keep, flip, lambda k, f: fp.bitwiseAND(k).bitwiseXOR(f))
    return fps.select("fp", F.explode(keys).alias("key"))


def _near(a: np.ndarray, b, radius: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= radius


def _forest(run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the members of one key which are close, directly or in steps."""
    out, rest = [], run
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _near(rest, x, radius)
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key to verified links, without all pairs of a key."""
    empty = np.empty(0, np.int64)
    keys, fps = empty, empty

    def of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        start, end = np.r_[0, cuts], np.r_[cuts, len(keys)]
        size = end - start
        two = start[size == 2]
        a, b = fps[two], fps[two + 1]
        ok = _near(a, b, radius)
        a, b = a[ok], b[ok]
        more = [p for s, e in zip(start[size > 2], end[size > 2]) for p in _forest(fps[s:e], radius)]
        if more:
            more = np.array(more, np.int64)
            a, b = np.r_[a, more[:, 0]], np.r_[b, more[:, 1]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        keys = np.r_[keys, batch.column("key").to_numpy()]
        fps = np.r_[fps, batch.column("fp").to_numpy()]
        if len(keys) and keys[0] != keys[-1]:
            cut = np.searchsorted(keys, keys[-1])  # the last key may go on
            yield of(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield of(keys, fps)


def close_links(fps: DataFrame, radius: int = RADIUS, fields: int = FIELDS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``).

    Every pair of at most ``radius`` differing bits is linked, directly or in steps that are
    links too. Fingerprints are small and their balls are not, so they are dealt out anew before.
    """
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    met = variants(spread, radius, fields).repartition("key").sortWithinPartitions("key", "fp").select("key", "fp")
    return met.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3, radius: int = RADIUS, fields: int = FIELDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links, its own
    included. Null and empty texts have fingerprint zero and are linked like others; null
    ids never become a component's id unless it has no other. Repeated rows stay. Other
    columns are ignored, whatever their names. No rows in, no rows out.
    """
    rows = staged(fingerprints(docs, text_col, id_col, n), "fingerprints")
    least = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(staged(close_links(least.select("fp"), radius, fields), "fingerprint-links"))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(group, "root").select("fp", "component_id", "n"), "fingerprint-components")
    return join_by_size(rows, named, ["fp"], "n", rows.count(), "inner").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id.

    Texts link at a Jaccard similarity of their ``n``-word shingles, which ``similar``
    checks after it has searched by SimHash and more; without a ``similarity`` they link by the
    bits of their fingerprints alone. Rows that repeat both id and text count as one. Null ids
    are smallest here, so that exactly one document of a component stays. Null texts and those without words are alike. No rows in, no rows out.
    """
    if similarity is not None:
        from .similar import drop_similar

        return drop_similar(docs, text_col, id_col, n, similarity)
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"))
    rows = docs.withColumn("__key", key)
    groups = simhash_groups(rows, text_col, "__key", n)
    stay = staged(groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__key")).distinct(), "representatives")
    return rows.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
