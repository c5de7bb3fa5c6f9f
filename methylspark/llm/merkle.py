"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Every row is a leaf. The leaves of each source, by id, are the bottom of a tree of runs of three; the roots of the
sources, by source, are the bottom of another one, whose root stands for the dataset. A tree is cut into
aligned blocks of ``3 ** HEIGHT`` leaves, each a row of one table: its digests in van Emde Boas
order (the top half of the levels first, then the subtrees below it one after another, each laid out in
the same way), so that a path from a leaf to the block's root lies in few stretches of memory whatever the
size of a cache line. ``address`` says where a node is; building, looking up siblings and folding go by it. The
blocks' roots are the leaves of the next tier, and so on until a tier has one block.

A task holds one block at a time. Proofs go down the tiers: a block gets the siblings above it as one
row, its leaves add their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import staged

ARITY = 3
#: Levels of a block above its leaves: 729 leaves, 1,093 digests of 32 bytes.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes ``index`` of the level ``depth`` (0 is the root) in a full tree of ``levels``."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(depth, index, top)
    width = ARITY ** (depth - top)  # of the node's level within its subtree
    return tree_size(top) + index // width * tree_size(levels - top) + address(depth - top, index % width, levels - top)


@cache
def places(levels: int) -> tuple[np.ndarray, ...]:
    """``address`` of every node, by depth."""
    return tuple(address(d, np.arange(ARITY**d), levels) for d in range(levels))


def digest(*parts: bytes) -> bytes:
    """SHA-256 of digests, joined as lower-case hex text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def build_block(leaves: list[bytes], height: int) -> tuple[bytearray, bytes]:
    """The digests of a block in van Emde Boas order and its root, ``height`` levels above the leaves; places without a node are zero."""
    at = places(height + 1)
    nodes = bytearray(32 * tree_size(height + 1))

    def put(depth: int, row: list[bytes]) -> None:
        for place, x in zip(at[depth], row):
            nodes[32 * place : 32 * place + 32] = x

    put(height, leaves)
    row = leaves
    for depth in range(height - 1, -1, -1):
        row = [digest(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
        put(depth, row)
    return nodes, row[0]


def siblings(nodes: bytes, leaf: int, count: int, height: int) -> tuple[bytes, bytes]:
    """What is beside the path from a leaf to the block's root: the digests level by level, left to right, and for each level how many lie left and right, in one byte."""
    at, found, shape = places(height + 1), [], bytearray()
    for depth in range(height, 0, -1):
        start = leaf - leaf % ARITY
        run = range(start, min(start + ARITY, count))
        found += [nodes[32 * at[depth][i] : 32 * at[depth][i] + 32] for i in run if i != leaf]
        shape.append((leaf - start) << 4 | run[-1] - leaf)
        leaf, count = leaf // ARITY, -(-count // ARITY)
    return b"".join(found), bytes(shape)


def fold(leaf: bytes, path: bytes, shape: bytes) -> bytes:
    """The root that a leaf and the siblings beside its path give."""
    k = 0
    for x in shape:
        left, right = 32 * (x >> 4), 32 * (x & 15)
        leaf = digest(path[k : k + left] + leaf + path[k + left : k + left + right])
        k += left + right
    return leaf


def levels_of(count: int) -> int:
    """Levels between so many leaves and the one node above them all."""
    levels = 0
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


def _height(count: int, height: int) -> int:
    """A tree of one block ends where one node is left; others go through the whole block."""
    return min(height, levels_of(count))


def field(column: Column) -> Column:
    """``-`` if null, else the number of bytes, a colon and the value."""
    x = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 within ``group`` in the order, and ``size``, the group's rows.

    Rows are dealt out by range and sorted in their partitions, so a large group spans many; places come from the number of each
    partition's rows of each group. Those counts are at most partitions plus groups and are joined by a shuffle or a broadcast, as Spark decides.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = staged(ordered.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), label)
    counts = placed.groupBy(F.struct(group).alias("__group"), "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    own = Window.partitionBy("__group")
    before = F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__group", "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(own).alias("size"))
    met = placed.withColumn("__group", F.struct(group)).join(counts, ["__group", "__part"])
    return met.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("idx"), "size")


def _by_block(rows: DataFrame, more: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", *more)


def _streamed(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict]:
    for batch in batches:
        for s in range(0, batch.num_rows, size):
            yield from batch.slice(s, size).to_pylist()


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """``tree, block, count, size, nodes, root`` from ``tree, idx, size, leaf``."""
    rows = leaves.select("tree", F.floor(F.col("idx") / ARITY**height).alias("block"), "idx", "size", "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(key: tuple, own: list[bytes]) -> dict:
            nodes, root = build_block(own, _height(key[2], height))
            return {"tree": key[0], "block": key[1], "count": len(own), "size": key[2], "nodes": bytes(nodes), "root": root}

        last, own, done = None, [], []
        for x in _streamed(batches):
            key = (x["tree"], x["block"], x["size"])
            if key != last:
                if own:
                    done.append(block(last, own))
                    if len(done) >= 16:
                        yield pa.RecordBatch.from_pylist(done, kinds)
                        done = []
                last, own = key, []
            own.append(x["leaf"])
        if own:
            done.append(block(last, own))
        if done:
            yield pa.RecordBatch.from_pylist(done, kinds)

    kinds = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("count", pa.int64()), ("size", pa.int64()), ("nodes", pa.binary()), ("root", pa.binary())])
    return _by_block(rows, ["idx"]).mapInArrow(run, "tree string, block long, count long, size long, nodes binary, root binary")


def tiers(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The stored blocks of all trees of ``tree, idx, size, leaf``, a table for each tier: ``tree, block, count, size, nodes, root``.

    The roots of a tree's blocks are the leaves of its next tier; a tree of one block has none.
    """
    out = [staged(_blocks(leaves, height), "merkle-blocks")]
    width = ARITY**height
    while not (more := out[-1].filter(F.col("size") > width)).isEmpty():
        up = more.select("tree", F.col("block").alias("idx"), F.ceil(F.col("size") / width).alias("size"), F.col("root").alias("leaf"))
        out.append(staged(_blocks(up, height), "merkle-blocks"))
    return out


def tree_roots(stored: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``tree, root`` of each tree: the root of its only block in its last tier."""
    tops = [x.filter(F.col("size") <= ARITY**height).select("tree", "root") for x in stored]
    out = tops[0]
    for x in tops[1:]:
        out = out.unionByName(x)
    return out


def _below(blocks: DataFrame, above: DataFrame, rows: DataFrame, height: int, each, schema: T.StructType) -> DataFrame:
    """Stored blocks, the path above each (``tree, block`` and ``PATH``) and the ``rows`` of their leaves (``tree, idx, row``) meet; ``each`` makes of tree, row and the leaf's whole path what goes out.

    A block is the first row of its own stream, so it is held once and its leaves pass by.
    """
    over = above.select(F.col("tree").alias("__tree"), F.col("block").alias("__block"), *PATH)
    heads = blocks.join(over, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block"))).select(
        "tree", "block", F.lit(-1).cast("long").alias("idx"), F.struct("count", "size", "nodes", "path", "shape", "subroot").alias("head"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"),
    )
    own = rows.select("tree", F.floor(F.col("idx") / ARITY**height).alias("block"), "idx", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "row")
    stream = _by_block(heads.unionByName(own), ["idx"])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, done = None, []
        for x in _streamed(batches):
            if x["idx"] < 0:
                head = x["head"]
                levels = _height(head["size"], height)
                continue
            found, shape = siblings(head["nodes"], x["idx"] % ARITY**height, head["count"], levels)
            done.append(each(x["tree"], x["row"], {"path": found + head["path"], "shape": shape + head["shape"], "subroot": head["subroot"]}))
            if len(done) >= 512:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return stream.mapInArrow(run, schema)


#: The digests beside a path, how many are left and right at each level, and the root of the source's tree where the path begins in one.
PATH = ("path", "shape", "subroot")
_PATH = "path binary, shape binary, subroot binary"


def paths_down(stored: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``tree, block`` and the ``PATH`` above every block of the lowest tier, given ``tree`` and the ``PATH`` above each tree's root."""
    only = lambda x: x.filter(F.col("size") <= ARITY**height).select("tree", F.lit(0).cast("long").alias("block"))
    over = lambda x: x.join(above.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree"))).select("tree", "block", *PATH)
    found = over(only(stored[-1]))
    for k in range(len(stored) - 2, -1, -1):
        lower = stored[k].filter(F.col("size") > ARITY**height).select("tree", F.col("block").alias("idx"), F.struct("block").alias("row"))
        each = lambda tree, row, path: {"tree": tree, "block": row["block"], **path}
        found = staged(_below(stored[k + 1], found, lower, height, each, T._parse_datatype_string(f"tree string, block long, {_PATH}")), "merkle-paths").unionByName(over(only(stored[k])))
    return found


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs`` (``FIELDS``), digests as hex.

    A leaf is the digest of the fields, nulls told from empty texts. The leaves of a source ascend by ``doc_id`` (null first, rows of one id by
    leaf), sources by their bytes, null first. ``tampered``, if given, is the text that somebody hands in later: ``folded_root`` comes from
    its leaf and the siblings of the stored one, and ``verified`` says whether that is ``root``. ``proof_sha256`` is the digest of the siblings from the leaf up to the root,
    of nothing if there are none. Repeated rows are leaves of their own. Other columns are ignored, whatever their names. No rows in, no rows out.
    """
    rows = docs.select(
        F.col("source").cast("string").alias("tree"), "doc_id", leaf_digest().alias("leaf"), leaf_digest(text=F.col("text") if tampered is None else tampered).alias("given"),
    )
    rows = staged(rows.withColumn("given", F.when(F.col("given") != F.col("leaf"), F.col("given"))), "merkle-rows")
    leaves = staged(numbered(rows, "tree", ["doc_id", "leaf"], "merkle-order"), "merkle-leaves")
    stored = tiers(leaves.select("tree", "idx", "size", "leaf"), height)
    subroots = staged(tree_roots(stored, height), "merkle-subroots")
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf"))
    sources = staged(numbered(sources, "tree", ["source"], "merkle-order"), "merkle-sources")
    upper = tiers(sources.select("tree", "idx", "size", "leaf"), height)
    nothing = docs.sparkSession.createDataFrame([("", b"", b"", b"")], f"tree string, {_PATH}")
    each = lambda tree, row, path: {**path, "tree": row["source"], "subroot": row["leaf"]}
    row = sources.select("tree", "idx", F.struct("source", "leaf").alias("row"))
    above = staged(_below(upper[0], paths_down(upper, nothing, height), row, height, each, T._parse_datatype_string(f"tree string, {_PATH}")), "merkle-paths")
    top = tree_roots(upper, height).first()  # one digest
    root = top["root"].hex() if top else None

    def prove(tree: str | None, row: dict, path: dict) -> dict:
        folded = fold(row["given"] or row["leaf"], path["path"], path["shape"]).hex()
        return {
            "doc_id": row["doc_id"], "leaf": row["leaf"].hex(), "subroot": path["subroot"].hex(), "root": root, "proof_sha256": digest(path["path"]).hex(), "folded_root": folded, "verified": folded == root,
        }

    schema = T.StructType([docs.select("doc_id").schema["doc_id"], *T._parse_datatype_string("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    return _below(stored[0], paths_down(stored, above, height), leaves.select("tree", "idx", F.struct("doc_id", "leaf", "given").alias("row")), height, prove, schema)
