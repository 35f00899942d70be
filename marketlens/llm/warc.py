"""WARC archives as chunked record tables.

Pages are written as response records, later copies of large payloads as revisit records that
point to the response. Payloads are cut into rows of (record, chunk number, bytes) before they are
written and come back as such rows; digests are carried along from chunk to chunk, so no task of
Python ever holds a record whole. The table of records is the last chunk row of each.

Null payloads are empty ones, repeated rows are records of their own, an empty table gives no
file and no record, other columns of the pages are left out whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketlens.session import batches_of as _batches_of, shared_dir

CHUNK = 1 << 16
BATCH = 1 << 22  # bytes of chunks that a task holds at once
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | str | None, copy: int) -> str:
    return f"<urn:page:{'' if page is None else page}:{copy}>"


def _page_of(record: str | None) -> int | None:
    number = record.split(":")[2] if record else ""
    return int(number) if number else None


# ---- writing ----------------------------------------------------------------------------


def with_references(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Pages as (page, url, payload, digest, n_bytes, refers_to).

    Only digests are shuffled by digest, with a partial maximum, so a group of copies costs one
    row per task; the join that brings the answer back may be split by adaptive execution.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n_bytes": F.octet_length("payload").cast("long")})
    large = pages.select(F.col(id_col).cast("long").alias("page"), payload.alias("payload")).where(F.octet_length("payload") >= least_bytes)
    firsts = large.groupBy(F.unhex(F.sha1("payload")).alias("_digest")).agg(F.max("page").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("n_bytes") >= least_bytes), "left")
    other = F.col("_first").isNotNull() & ~F.col("page").eqNullSafe(F.col("_first"))
    return joined.select("page", "url", "payload", "digest", "n_bytes", F.when(other, F.col("_first")).alias("refers_to"))


def _header(kind: str, record: str, url: str | None, digest: bytes, length: int, refers_to: str | None) -> bytes:
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_REVISIT}"] if refers_to else []),
        f"Content-Length: {length}",
    ]
    return ("\r\n".join(fields) + "\r\n\r\n").encode()


class _Member:
    """One gzip member of a file."""

    def __init__(self, out):
        self._out, self._zip = out, zlib.compressobj(6, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self._out.write(self._zip.compress(data))

    def close(self) -> None:
        self._out.write(self._zip.flush())


def chunked(named: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``with_references`` as the chunked record table: a row per (record, chunk), in chunk order.

    A payload is cut where it lies, so the chunks of a record stay together without a shuffle. A
    revisit and an empty payload are one row with no bytes; the address stands on the first row alone.
    """
    held = F.when(F.col("refers_to").isNull(), F.col("payload").cast("binary")).otherwise(F.lit(b""))
    rows = named.select("page", "url", "digest", "n_bytes", "refers_to", held.alias("_held"))
    last = F.greatest(F.lit(1), F.ceil(F.octet_length("_held") / chunk)).cast("int") - 1
    rows = rows.withColumn("_last", last).select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("chunk"))
    return rows.select(
        "page", F.when(F.col("chunk") == 0, F.col("url")).alias("url"), "digest", "n_bytes", "refers_to", "chunk",
        (F.col("chunk") == F.col("_last")).alias("last"), F.substr("_held", F.col("chunk") * F.lit(chunk) + 1, F.lit(chunk)).alias("data"),
    )


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        # A repeated attempt writes the same final name; readers never see a file half done.
        held, name, records, stream = f"{root}/.{part}-{uuid.uuid4().hex}", f"{root}/pages-{part:06d}.warc.gz", 0, None
        try:
            for batch in batches:
                for page, url, digest, size, refers_to, chunk, last, data in zip(*(column.to_pylist() for column in batch.columns)):
                    if stream is None:
                        stream = store.open_output_stream(held, compression=None)
                    if chunk == 0:
                        target = None if refers_to is None else record_id(refers_to, 0)
                        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                        kind, length = ("revisit", len(http)) if target else ("response", len(http) + size)
                        copy = 0 if target is None and page is not None else part << 33 | records
                        member, running = _Member(stream), hashlib.sha1()
                        member.write(_header(kind, record_id(page, copy), url, digest, length, target) + http)
                    running.update(data)
                    member.write(data)
                    if last:
                        if target is None and running.digest() != digest:
                            raise ValueError(f"{record_id(page, copy)}: the chunks do not have the digest of the payload")
                        member.write(b"\r\n\r\n")
                        member.close()
                        records += 1
        finally:
            if stream is not None:
                stream.close()
        if records:
            store.move(held, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records]})

    return write


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000,
) -> DataFrame:
    """Writes one gzipped WARC file per partition into ``folder``; returns (path, records).

    Of records with equal payloads of at least ``least_bytes`` the one with the largest id is
    the response, the others revisit it. The writer gets chunk rows and checks the digest it has
    carried over them against that in the header. Null payloads are empty ones. Pages without an id
    revisit a page with one, or are responses. A repeated row of the response is a response.
    """
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    files = chunked(with_references(pages, id_col, url_col, payload_col, least_bytes)).mapInArrow(_write(folder), "path string, records long")
    with _batches_of(pages.sparkSession, BATCH):
        written = files.toPandas()  # one row per file
    return pages.sparkSession.createDataFrame(written, "path string, records long")


# ---- reading ----------------------------------------------------------------------------


class _Reader:
    """Bytes of a (gzipped) stream, unpacked as they are asked for."""

    def __init__(self, stream):
        self._stream, self._zip, self._held = stream, None, b""

    def fill(self) -> bool:
        data = b""
        if self._zip is not None:
            data = self._zip.unused_data if self._zip.eof else self._zip.unconsumed_tail
        data = data or self._stream.read(CHUNK)
        if not data:
            return False
        if self._zip is None or self._zip.eof:
            self._zip = zlib.decompressobj(47)
        # What is left of the input stays packed, however much it unpacks to.
        self._held += self._zip.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self._held.find(mark)) < 0:
            if not self.fill():
                return None
        out, self._held = self._held[:at], self._held[at + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in chunks."""
        while n:
            if not self._held and not self.fill():
                raise ValueError("the archive ends inside a record")
            part, self._held = self._held[: min(n, CHUNK)], self._held[min(n, CHUNK):]
            n -= len(part)
            if part:
                yield part


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(stream) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """(fields, payload bytes by the HTTP header, payload chunks) of each record of a WARC stream.

    The chunks of a record must be used up before the next record is asked for.
    """
    reader = _Reader(stream)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        http = reader.until(b"\r\n\r\n") or b""
        yield fields, int(_fields(http).get("content-length", 0)), reader.take(int(fields["content-length"]) - len(http) - 4)
        b"".join(reader.take(4))


def _opened(path: str, folder: str):
    store, _ = arrow_fs.FileSystem.from_uri(folder)
    return store.open_input_stream(path, compression=None)


_CHUNKS = pa.schema([
    ("record", pa.string()), ("page", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()),
    ("last", pa.bool_()), ("bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary()),
])
_CHUNK_TYPES = "record string, page long, record_type string, refers_to long, chunk long, last boolean, bytes long, digest string, data binary"


def _chunk_rows(stream) -> Iterator[tuple]:
    """Rows of the chunk table of one file; the digest so far is spelt out on the last row of a record alone."""
    for fields, size, parts in records(stream):
        name, kind = fields["warc-record-id"], fields["warc-type"]
        stated = b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        known = (name, _page_of(name), kind, _page_of(fields.get("warc-refers-to")))
        if kind == "revisit":
            for _ in parts:
                pass
            yield *known, 0, True, size, stated, b""
            continue
        running, seen, held = hashlib.sha1(), 0, b""
        for k, data in enumerate(parts):
            if k:
                yield *known, k - 1, False, seen, None, held
            running.update(data)
            seen, held, at = seen + len(data), data, k
        if running.hexdigest() != stated or seen != size:
            raise ValueError(f"{name}: the payload does not have the stated digest")
        yield *known, at if seen else 0, True, seen, stated, held


def read_chunks(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The chunked record table, one task per file: (record, chunk, data) and what is carried along.

    ``chunk`` counts from 0, ``bytes`` are those up to and with this chunk, ``last`` marks the end
    of a record, whose ``digest`` was computed chunk by chunk and equals the record's own (an error
    if not). A revisit is one row without data that has the size and digest it states; an empty
    payload is one row without data. No files: no rows. Repeated records come back repeated.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _opened(path, folder) as stream:
                    rows, size = [], 0
                    for row in _chunk_rows(stream):
                        rows.append(row)
                        size += len(row[-1]) + 256
                        if size >= BATCH:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return _spread(files).mapInArrow(read, _CHUNK_TYPES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """One row per record: page, record_type, payload_bytes, payload_digest (hex), refers_to.

    They are the last rows of the chunk table: size and digest were carried up to there, so no
    record is put together again and nothing is shuffled. Empty, repeated and null as there.
    """
    ends = read_chunks(files.sparkSession, files, folder).where("last")
    return ends.select("page", "record_type", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to")


def _spread(files: DataFrame) -> DataFrame:
    """A task per file: with a number given, adaptive execution does not put the few bytes of all names together.

    The numbers that deal them come from a window over one short row per file.
    """
    names = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("_task"))
    return names.repartitionById(max(1, files.count()), "_task").select("path")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    base = shared_dir(spark)
    return f"{base if ':' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
