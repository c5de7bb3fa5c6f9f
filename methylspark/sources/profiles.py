"""Profiles as a data source of Spark: ``spark.read.format("profiles")``, with filters on site and cell pushed to the files.

Files are opened by Arrow in the tasks, so their store must be one that Arrow knows (local or mounted folders, S3, GCS,
HDFS); ``readers.read_profiles`` reads whatever Spark does.
"""

from __future__ import annotations

import fnmatch
import gzip
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "chromo string, pos int, cell string, value double"
#: Bytes of a plain file that one task reads, and bytes that are parsed together.
SPLIT, BLOCK = 64 << 20, 4 << 20
_ARROW = pa.schema([("chromo", pa.string()), ("pos", pa.int32()), ("cell", pa.string()), ("value", pa.float64())])
_COMPARISONS = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), os.path.abspath(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """Address and size of the files of a path: a file, a folder with all below it, or a pattern; hidden ones (``_`` and ``.``) are left out."""
    head = re.split(r"[*?\[]", path, maxsplit=1)[0]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    store, root = _open(head if head == path else head.rsplit("/", 1)[0] or "/")
    own = store.get_file_info(root)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [own] if own.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    if head != path:
        pattern = f"{root.rstrip('/')}/{path[len(head.rsplit('/', 1)[0]) + 1 :]}"
        found = [x for x in found if fnmatch.fnmatchcase(x.path, pattern) or fnmatch.fnmatchcase(x.path, pattern + "/*")]
    below = lambda x: x.path[len(root) :]
    return sorted((scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and not re.search(r"/[_.]", below(x) or "/" + x.base_name))


def cell_of(path: str) -> str:
    """The value of a folder ``cell=``, else the file's name up to the first dot."""
    own = re.search("/cell=([^/]+)/", path)
    return own[1] if own else path.rsplit("/", 1)[-1].split(".")[0]


@dataclass
class Split(InputPartition):
    """A range of bytes of a file; a line belongs to the range in which it begins."""

    path: str
    start: int
    end: int


class ProfileSource(DataSource):
    """Options: ``path`` or ``paths`` (a JSON list), ``check`` (false: values outside of [0, 1] are no error), ``split`` (bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "profiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ProfileReader(self.options)


class ProfileReader(DataSourceReader):
    """Tab-separated files and bedGraph files; which of them a file is, its first line tells, once for each split of it."""

    def __init__(self, options: dict) -> None:
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths, self.check, self.split = paths, options.get("check", "true").lower() != "false", int(options.get("split", SPLIT))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of chromo, pos and cell with values are taken on; all others stay with Spark."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column in ("chromo", "pos", "cell") and type(f) in _COMPARISONS and (f.value is not None):
                self.filters.append((column, _COMPARISONS[type(f)], f.value))
            elif column in ("chromo", "pos", "cell") and isinstance(f, In) and None not in f.value:
                self.filters.append((column, "in", list(f.value)))
            else:
                yield f

    def _holds(self, column: str, value) -> bool:
        """Whether a constant column passes its filters."""
        row = pa.table({column: [value]})
        return all(self._mask(row, f)[0].as_py() for f in self.filters if f[0] == column)

    @staticmethod
    def _mask(rows: pa.Table, f: tuple) -> pa.ChunkedArray:
        column, how, value = f
        if how == "in":
            return pc.is_in(rows[column], pa.array(value, rows[column].type))
        return getattr(pc, how)(rows[column], value)

    def partitions(self) -> list[Split]:
        files = [f for p in self.paths for f in list_files(p)]
        files = [f for f in files if self._holds("cell", cell_of(f[0]))]  # files of other cells aren't opened
        whole = lambda path, size: [Split(path, 0, size)]
        cut = lambda path, size: [Split(path, s, min(size, s + self.split)) for s in range(0, max(size, 1), self.split)]
        return [x for path, size in files for x in (whole if path.endswith(".gz") else cut)(path, size)] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        store, path = _open(split.path)
        zipped = path.endswith(".gz")
        with store.open_input_stream(path, compression=None) if zipped else store.open_input_file(path) as raw:
            data = gzip.GzipFile(fileobj=raw) if zipped else raw
            first = data.readline() if zipped else self._line(raw, 0)
            bed = first.startswith(b"track")
            for block in self._blocks(data, split, first if zipped else None):
                yield from self._parse(block, bed, split.path)

    @staticmethod
    def _line(raw, at: int) -> bytes:
        """The line at a place."""
        raw.seek(at)
        out = b""
        while chunk := raw.read(1 << 12):
            out += chunk
            if b"\n" in chunk:
                return out[: out.index(b"\n") + 1]
        return out

    def _blocks(self, data, split: Split, first: bytes | None) -> Iterator[bytes]:
        """The lines that begin in the split, some megabytes at a time."""
        if first is not None:
            rest, left = first, None
        else:
            at = split.start
            if at:  # the line that goes on from before belongs there
                at += len(self._line(data, at - 1)) - 1
            data.seek(at)
            rest, left = b"", split.end - at
        while left is None or left > 0:
            chunk = data.read(BLOCK if left is None else min(BLOCK, left))
            if not chunk:
                break
            left = None if left is None else left - len(chunk)
            whole, newline, rest_ = (rest + chunk).rpartition(b"\n")
            rest = rest_
            if newline:
                yield whole + b"\n"
        if rest and left is not None and data.tell() >= split.end:
            rest = rest + self._line(data, data.tell())  # the last line may end beyond
        if rest:
            yield rest

    def _parse(self, block: bytes, bed: bool, path: str) -> Iterator[pa.RecordBatch]:
        block = re.sub(rb"(?m)^(#|track)[^\n]*\n|^[ \t\r]*\n", b"", block if block.endswith(b"\n") else block + b"\n")
        if not block.strip():
            return
        value = "f3" if bed else "f2"
        rows = csv.read_csv(
            pa.py_buffer(block), read_options=csv.ReadOptions(autogenerate_column_names=True, use_threads=False, block_size=len(block) + 1), parse_options=csv.ParseOptions(delimiter="\t", quote_char=False),
            convert_options=csv.ConvertOptions(include_columns=["f0", "f1", value], column_types={"f0": pa.string(), "f1": pa.int32(), value: pa.float64()}),
        ).rename_columns(["chromo", "pos", "value"])
        rows = rows.set_column(0, "chromo", pc.replace_substring_regex(pc.utf8_upper(rows["chromo"]), "^CHR", ""))
        if self.check and pc.any(pc.or_(pc.less(rows["value"], 0), pc.greater(rows["value"], 1))).as_py():
            raise ValueError(f"a value outside of [0, 1] in {path}")
        for f in self.filters:
            if f[0] != "cell":
                rows = rows.filter(self._mask(rows, f))
        if rows.num_rows:
            cell = pa.array([cell_of(path)] * rows.num_rows, pa.string())
            yield from pa.table([rows["chromo"], rows["pos"], cell, rows["value"]], schema=_ARROW).combine_chunks().to_batches()


def scan_profiles(spark: SparkSession, paths: str | list[str], check: bool = True, split: int = SPLIT) -> DataFrame:
    """``chromo, pos, cell, value`` of profile files through the data source.

    Filters with constants on ``chromo``, ``pos`` and ``cell`` are pushed to it: files of other cells aren't opened, and other rows
    don't leave the task that reads them. Values outside of [0, 1] are an error if ``check``, in all rows that are read.
    """
    spark.dataSource.register(ProfileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("profiles").option("paths", json.dumps(paths)).option("check", str(check).lower()).option("split", str(split)).load()
