"""A WARC writer and reader with Zstandard dictionaries.

Each archive holds the records that one task has written until they reach
``archive_bytes``. A dictionary is trained on an even sample of those records and stands
in a leading skippable frame; every record is a frame of its own that is compressed with
it, so that a record can be read alone by its offset. Of pages with equal payloads one
is stored as a response, and the others as revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICT_FRAME = 0x184D2A5D  # fixed value: the skippable frame of a WARC dictionary
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, record_type string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def assign_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, record_type, refers_to`` for every page.

    Null html is an empty payload. Of pages with equal payloads of at least
    ``min_bytes`` that with the largest id is the response, and rows that repeat it are
    responses too; null ids are responses only where the group has no other. Payloads
    are compared by SHA-256 and length; revisits carry none. Payloads may have any length that a row may. Other columns
    are ignored, whatever their names. No rows in, no rows out.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("key", F.sha2("payload", 256))
    best = rows.groupBy("key").agg(F.max("page_id").alias("best"))
    response = F.col("page_id").eqNullSafe(F.col("best")) | (F.col("payload_bytes") < min_bytes)
    return rows.join(best, "key").select(
        "page_id", "url", "payload", "payload_bytes",
        F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("best")).alias("refers_to"),
    )


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> bytes:
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in (url or "").encode())


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes) -> bytes:
    """A WARC record; that of a revisit states digest and size of a payload that it doesn't hold."""
    block = HTTP if kind == "revisit" else HTTP + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: %s" % kind.encode(),
        b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id),
        b"WARC-Payload-Digest: sha1:%s" % digest(payload).encode(),
        b"WARC-Payload-Bytes: %d" % len(payload),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: %s" % _uri(url))
    if kind == "revisit":
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To: <urn:page:%s>" % (b"null" if refers_to is None else b"%d" % refers_to))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on every k-th record, k such that they have about 100 times its size; plain content if they are too few to train on."""
    k = max(1, sum(map(len, records)) // (100 * size))
    sample = records[::k]
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-size:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], dict_bytes: int, level: int) -> tuple[bytes, list[tuple[int, int]]]:
    """An archive, and offset and length of each record in it."""
    d = dictionary(records, dict_bytes)
    raw = zstandard.ZstdCompressor(level=level).compress(d.as_bytes())
    out = io.BytesIO()
    out.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
    writer = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True, write_content_size=True)
    at = []
    for r in records:
        frame = writer.compress(r)
        at.append((out.tell(), len(frame)))
        out.write(frame)
    return out.getvalue(), at


def opened(head: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor with the dictionary at the start of an archive, and where records start."""
    magic, n = struct.unpack("<II", head[:8])
    if magic != DICT_FRAME:
        raise ValueError("the archive does not start with a dictionary")
    content = zstandard.ZstdDecompressor().decompress(head[8 : 8 + n])
    trained = content[:4] == b"\x37\xa4\x30\xec"
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdDecompressor(dict_data=d), 8 + n


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed stream."""
    stream = io.BufferedReader(stream, 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def write_warc(records: DataFrame, folder: str, archive_bytes: int = 24 << 20, dict_bytes: int = 64 << 10, level: int = 3) -> DataFrame:
    """Write ``assign_records`` output as archives in ``folder``; returns the index of all records.

    ``folder`` is a URI that all executors reach. A file's name holds the task attempt,
    so a task that runs again writes other files; the index is what counts, and files
    that it doesn't name may be deleted. Keep the index (``staged``) before using it:
    every evaluation writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        kept: list[tuple] = []
        size = n_files = 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, size, n_files
            name = f"records-{task.partitionId():05d}-{task.taskAttemptId()}-{n_files:05d}.warc.zst"
            data, at = pack([x[2] for x in kept], dict_bytes, level)
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(data)
            ids, kinds, _ = zip(*kept)
            kept, size, n_files = [], 0, n_files + 1
            offsets, lengths = zip(*at)
            columns = [pa.array(ids, pa.int64()), pa.array(kinds), pa.array([f"{folder}/{name}"] * len(ids)), pa.array(offsets), pa.array(lengths)]
            return pa.RecordBatch.from_arrays(columns, ["page_id", "record_type", "file", "offset", "length"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "payload")]
            for i in range(batch.num_rows):
                page, url, kind, refers, payload = (c[i].as_py() for c in columns)
                data = record(page, url, kind, refers, payload)
                kept.append((page, kind, data))
                size += len(data)
                if size >= archive_bytes:
                    yield flush()
        if kept:
            yield flush()

    return records.select("page_id", "url", "record_type", "refers_to", "payload").mapInArrow(run, INDEX)


def _page(urn: str | None) -> int | None:
    text = (urn or "null")[len("<urn:page:") : -1]
    return int(text) if urn and text != "null" else None


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that the column ``file`` names, each of which is read by one task.

    Sizes and digests of responses are those of the payloads read; a response whose
    header says otherwise is an error. Revisits have what their headers state, and a
    null payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                reader, start = opened(data)
                rows, size = [], 0
                stream = reader.stream_reader(memoryview(data)[start:], read_across_frames=True)
                for head, block in parse(stream):
                    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload, n = None, int(head["WARC-Payload-Bytes"])
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if digest(payload) != stated or len(payload) != n:
                            raise ValueError(f"{uri}: the payload of {head['WARC-Record-ID']} is damaged")
                    rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, _page(head.get("WARC-Refers-To")), n, stated, payload))
                    size += len(block) + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)][: len(names)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)][: len(names)], names)

    return files.select("file").mapInArrow(run, RECORDS + (", payload binary" if with_payload else ""))


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record alone, by its place in the index."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        head = f.read(8)
        reader, _ = opened(head + f.read(struct.unpack("<II", head)[1]))
        f.seek(offset)
        return next(parse(io.BytesIO(reader.decompress(f.read(length)))))


def archives(index: DataFrame) -> DataFrame:
    """The files of an index, dealt out over the cluster: as many tasks as there are shuffle partitions, however short the names are."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("file").distinct().repartition(parts, F.xxhash64("file"))  # by the name itself it would be the shuffle of distinct, which is merged by bytes


def round_trip(pages: DataFrame, folder: str, keep, **options) -> DataFrame:
    """Write ``pages`` to ``folder`` and read every archive back; ``keep`` stores the index.

    A record for every row, repeated rows and null ids included; other columns than those of ``assign_records`` are left out. No pages, no archives.
    """
    index = keep(write_warc(assign_records(pages), folder, **options))
    return read_warc(archives(index), with_payload=False)
