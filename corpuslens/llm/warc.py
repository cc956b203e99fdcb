"""Web archives (WARC 1.1, a gzip member per record): a writer that records repeated payloads as revisits, and a
salvage reader.

The reader checks every record (whole gzip member, version line, lengths, end of record, digests). After a failed check it
searches for the next gzip member or version line at which a whole record can be read, goes on there, and reports the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.arrowmap import in_tasks
from corpuslens.runtime import new_path, ship_package

#: A file is closed once it has so many bytes.
FILE_BYTES = 16 << 20
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Compressed bytes fed to zlib at once.
CHUNK = 1 << 16

RECORDS = "file string, offset bigint, length bigint, reason string, record_type string, record_id string, refers_to string, target string, payload_bytes bigint, payload_digest string, payload binary"


class Damaged(Exception):
    """A check that failed."""


def sha1_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response, or a revisit of the response for the page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1_field(payload)), ("WARC-Block-Digest", sha1_field(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(plain: bytes, level: int = 4) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(plain) + press.flush()


def _parse(data: bytes | memoryview, at: int) -> tuple[dict, int]:
    """The checked record that begins at a place of plain bytes, and where it ends."""
    data = memoryview(data)
    head = bytes(data[at : at + CHUNK])
    if not VERSION.match(head):
        raise Damaged("no version line")
    stop, width = head.find(b"\r\n\r\n"), CHUNK
    while stop < 0 and at + width < len(data):
        width *= 2
        head = bytes(data[at : at + width])
        stop = head.find(b"\r\n\r\n")
    if stop < 0:
        raise Damaged("no end of the header")
    fields = {}
    for line in head[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    begin, end = at + stop + 4, at + stop + 4 + int(fields["content-length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise Damaged("no end of the record")
    block = bytes(data[begin:end])
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"] != sha1_field(block):
        raise Damaged("block digest differs")
    out = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target": fields.get("warc-target-uri"), "payload": None, "payload_bytes": None, "payload_digest": None}
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        try:
            out["payload_digest"] = base64.b32decode(digest[5:]).hex()
        except ValueError as e:
            raise Damaged("payload digest can't be read") from e
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if out["record_type"] == "response":
            if digest and digest != sha1_field(payload):
                raise Damaged("payload digest differs")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        elif m := re.search(rb"(?i)\r\ncontent-length: *(\d+)", http):
            out["payload_bytes"] = int(m[1])
    return out, end + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """What the gzip member that begins at a place holds, and where it ends."""
    press, parts, end = zlib.decompressobj(31), [], at
    try:
        while not press.eof:
            if end >= len(data):
                raise Damaged("gzip member is cut off")
            piece = data[end : end + CHUNK]
            parts.append(press.decompress(piece))
            end += len(piece)
            if not VERSION.match(parts[0][:10].ljust(10)) and len(parts[0]) >= 10:
                raise Damaged("gzip member without a version line")
    except zlib.error as e:
        raise Damaged(f"gzip member can't be read: {e}") from e
    return b"".join(parts), end - len(press.unused_data)


def _at(data: memoryview, at: int) -> tuple[list[dict], int]:
    """All records of the member, or the plain record, that begins at a place, and where that ends."""
    if bytes(data[at : at + 3]) != b"\x1f\x8b\x08":
        found, end = _parse(data, at)
        return [found], end
    plain, end = _inflate(data, at)
    found, inner = [], 0
    while inner < len(plain):
        one, inner = _parse(plain, inner)
        found.append(one)
    if not found:
        raise Damaged("gzip member is empty")
    return found, end


def salvage(data: bytes) -> Iterator[dict]:
    """Records (reason None) and gaps (what failed first) of an archive, in order; together they cover all its bytes."""
    view, at, lost, why = memoryview(data), 0, None, None
    while at < len(view):
        try:
            found, end = _at(view, at)
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            m = BEGIN.search(view, at + 1)
            at = m.start() if m else len(view)
            continue
        if lost is not None:
            yield {"offset": lost, "length": at - lost, "reason": why}
            lost = None
        for one in found:
            yield one | {"offset": at, "length": end - at, "reason": None}
        at = end
    if lost is not None:
        yield {"offset": lost, "length": len(view) - lost, "reason": why}


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, payload, refers_to.

    Of pages with equal payloads of at least so many bytes, all but that with the largest page_id refer to it. A null
    html is an empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).otherwise(F.concat(F.lit("own "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    # a row for each payload that more than one page has
    repeated = keyed.where(F.octet_length("payload") >= least).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(repeated, "key", "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url, payload, refers_to as files in folder, a URI that all machines share; returns file, records, bytes.

    Lazy: the files are written by whatever runs the returned frame. A task that runs again replaces its own files.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)

        def close() -> pa.RecordBatch:
            nonlocal number, held, size
            own, name = f"{path}/.{uuid.uuid4().hex}", f"part-{part:06d}-{number:06d}.warc.gz"
            with system.open_output_stream(own, compression=None) as out:
                for x in held:
                    out.write(x)
            system.move(own, f"{path}/{name}")
            row = pa.RecordBatch.from_pylist([{"file": name, "records": len(held), "bytes": size}])
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(member(record(page, url, payload, refers)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    return pages.select(F.col("page_id").cast("bigint"), "url", "payload", F.col("refers_to").cast("bigint")).mapInArrow(in_tasks(run), "file string, records bigint, bytes bigint")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, whole: bool = False) -> DataFrame:
    """Records and quarantined gaps (reason not null) of the archives in folder; gaps have no other fields but file, offset and length.

    payloads: whether the payload column is filled in. whole: a gap is an error.
    """
    ship_package(spark)
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                for x in salvage(content.as_buffer()):
                    if whole and x["reason"] is not None:
                        raise ValueError(f"{name}: gap at {x['offset']}: {x['reason']}")
                    held.append(x | {"file": name} if payloads else x | {"file": name, "payload": None})
                    if len(held) == 200:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(in_tasks(run), RECORDS)


def page_of(column: str):
    """page_id from a record id; null for null and for others."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1), '') AS bigint)")


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write pages (page_id, url, html) to a new folder in the shared one and read the archives back; a gap in them is an error.

    Empty tables give no file and no row; repeated rows are each written. Columns: page_id, refers_to (page_id) and those
    of read_archives().
    """
    from corpuslens.runtime import materialise

    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    written = materialise(write_archives(with_revisits(pages), folder), "files")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id bigint, refers_to bigint, " + RECORDS.replace("refers_to", "refers_to_id"))
    found = read_archives(spark, folder, payloads, whole=True)
    return found.withColumnRenamed("refers_to", "refers_to_id").withColumns({"page_id": page_of("record_id"), "refers_to": page_of("refers_to_id")})
