"""Web archives in Zstandard: a writer that marks revisits, and a frame-by-frame reader.

An archive (``.warc.zst``) starts with a skippable frame that holds the
dictionary; each record then is one frame of its own.  The reader loads the
dictionary, decodes one frame at a time from a stream, and checks each
record's version line, headers, lengths, end marks and payload digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_folder

#: Magic number of the skippable frame that holds the dictionary; that of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Bytes of records in one archive; bytes of samples and of the dictionary trained on them.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 32 << 10
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


class ArchiveError(ValueError):
    """The archive's bytes aren't what the format asks for."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record.  A revisit keeps the HTTP head (with the payload's length) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        clean = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of these records.  Where a dictionary can't be trained (few records), there is none."""
    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[: SAMPLE_BYTES // 8])
        size += len(samples[-1])
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        dictionary = None
    out = []
    if dictionary is not None:
        body = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        out += [DICTIONARY_MAGIC.to_bytes(4, "little"), len(body).to_bytes(4, "little"), body]
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join([*out, *map(packer.compress, records)])


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each frame of an archive, read in blocks."""
    data = stream.read(READ_BYTES)
    dictionary = None
    if int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        while len(data) < 8 + size:
            more = stream.read(READ_BYTES)
            if not more:
                raise ArchiveError("the dictionary frame is cut off")
            data += more
        body, data = data[8 : 8 + size], data[8 + size :]
        if int.from_bytes(body[:4], "little") == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body)
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                return
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not data:
                data = stream.read(READ_BYTES)
                if not data:
                    raise ArchiveError("a frame is cut off")
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame can't be decoded: {e}") from e
            data = b""
        data = frame.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """A record's fields, after checks of its headers, lengths, end and digest."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ArchiveError("no WARC version line or no end of headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name != name.strip():
            raise ArchiveError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"header {name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block isn't as long as its header says")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"unexpected record type {kind}")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((line.split(b":")[1] for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")), b"")
    digest = fields.get("warc-payload-digest", "")
    if not mark or not length.strip().isdigit() or not digest.startswith("sha256:"):
        raise ArchiveError("no HTTP head, length or digest")
    size, digest = int(length), digest[7:]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError("the payload isn't what its length and digest say")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ArchiveError("a revisit has a payload or refers to nothing")

    def page(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), digest, and first_id: the page that holds an equal payload, null where the page holds its own."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= REVISIT_BYTES
    shared = p.where(long).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = p.join(shared, "digest", "left")
    return known.withColumn("first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page into archives below ``folder`` (a URI); one row per archive when it is run.

    An archive's name is made of its task's partition and a number, and rows
    are sorted within the partition, so a task that runs again writes the same
    files again; each appears under its name only when it is whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        held: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/part-{part:06d}-{number:05d}.warc.zst"
            body = archive_bytes(held)
            files.create_dir(base, recursive=True)
            with files.open_output_stream(f"{base}/_{part}-{number}-{attempt}.tmp", compression=None) as out:
                out.write(body)
            files.move(f"{base}/_{part}-{number}-{attempt}.tmp", name)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [len(held)], "bytes": [len(body)]})

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, html, digest, first = (c[i].as_py() for c in columns)
                held.append(record_bytes(page_id, url, html.encode(), digest, first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    ordered = with_revisits(pages).select("page_id", "url", "html", "digest", "first_id").sortWithinPartitions("page_id", "digest", "url")
    return ordered.mapInArrow(rows, "archive string, records bigint, bytes bigint")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all ``.warc.zst`` files below ``folder``; a broken archive fails the read with its name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                held: list[dict] = []
                size = 0
                try:
                    with files.open_input_stream(at, compression=None) as stream:
                        for raw in frames(stream):
                            held.append(parse_record(raw))
                            size += len(raw)
                            if size >= BATCH_BYTES:
                                yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
                                held, size = [], 0
                except ArchiveError as e:
                    raise ArchiveError(f"{path}: {e}") from e
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORD)

    # the paths only: file contents stay unread by Spark
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
    return listing.mapInArrow(rows, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads the records back.

    A null html is an empty payload; payloads under 100 bytes are always
    responses.  Rows that repeat the smallest page_id of a payload are
    responses too.  A null page_id stays null and never is referred to.  Other
    columns don't matter.  An empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    folder = folder or own_folder(spark, "warc")
    total = write_archives(pages, folder).agg(F.sum("records").alias("n")).first()["n"]
    if not total:
        return spark.createDataFrame([], "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")
    return read_archives(spark, folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
