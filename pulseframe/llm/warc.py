"""WARC archives: a writer of one gzip member per record and a reader that splits files anywhere.

Writing: every payload's digest decides in Spark which page is the response of its group; tasks then
write archives into the shared folder under names of their own attempt, and the manifest of finished files
is written as a table. Files of failed or repeated attempts are in no manifest and so are never read.

Reading: files are cut into byte ranges. A task looks for gzip magic in its range, takes a place for a member
only if the bytes decode and begin with a WARC version line, and owns the records of members that start inside its
range, whether a member has one or several; it reads past the end as far as its last member goes. After a member it goes on where that ended.
An archive that isn't compressed and a member that breaks off after its first record raise an error.
Payloads are UTF-8 text, in which the magic can't occur, so stored deflate blocks can't imitate a member.

Sizes and digests of responses are taken from the bytes that were read, and a payload or block that doesn't have its header's SHA-1
raises an error, as does a range with other than the number of records that the manifest tells. A manifest of other archives
may lack offsets, then records aren't counted. Ids are any text; page_id is the number in ids that the writer made. Of HTTP messages
the payload is the body as it stands, whose digest isn't compared, since writers differ in whether they undo transfer codings first.

Defined cases: null html counts as empty (an empty payload is a payload like any other); null page_id is
written as an empty id, comes back null and refers to its group's first page like others; groups refer to their least non-null page_id, and rows that
share it are all responses; a null url has no target line; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, columns, materialise, shared_path, table

#: Bytes of payload to an archive, before compression; records are never cut.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a read range.
SPLIT_BYTES = 4 << 20
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_LEVEL = 4

#: Ranges that a read task takes.
RANGES = 8

FILES = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("offsets", pa.list_(pa.int64()))])
RECORDS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...) and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with one record. A revisit has no block; its payload's size and digest stand in the headers."""
    ident = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{ident}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_URL)}")
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


_URL = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def _sha1(value: str | None) -> str | None:
    """The SHA-1 of a digest header in upper-case base32; None for other kinds."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32encode(bytes.fromhex(text)).decode() if len(text) == 40 else text.upper()


def _page(ident: str | None) -> int | None:
    """The page's number in an id that member() made."""
    number = (ident or "").removeprefix("urn:page:")
    return int(number) if ident and number != ident and number.lstrip("-").isdecimal() else None


def records(raw: bytes) -> list[tuple]:
    """The rows of a decoded member, one or more records; none if it doesn't begin with a whole record. One that breaks off after that raises an error."""
    out, at = [], 0
    while raw.startswith(_VERSION, at):
        gap = raw.find(b"\r\n\r\n", at)
        lines = (line.partition(":") for line in raw[at : max(gap, at)].decode("utf-8", "replace").split("\r\n")[1:])
        fields = {name.strip().lower(): value.strip() for name, colon, value in lines if colon}
        length = fields.get("content-length", "")
        if gap < 0 or not length.isdecimal() or len(raw) < (end := gap + 4 + int(length)):
            if out:
                raise ValueError(f"a member breaks off inside its record {len(out) + 1}")
            return []
        out.append(record(fields, raw[gap + 4 : end]))
        at = end
        while raw.startswith(b"\r\n", at):
            at += 2
    return out


def record(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a record. Content that differs from its digest raises an error."""

    def ident(key: str) -> str | None:
        return fields[key].removeprefix("<").removesuffix(">") if key in fields else None

    kind, told, http = fields.get("warc-type"), _sha1(fields.get("warc-payload-digest")), fields.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    if (whole := _sha1(fields.get("warc-block-digest"))) and whole != sha1_base32(block):
        raise ValueError(f"the block of record {ident('warc-record-id')} doesn't have its digest")
    if kind == "revisit":
        size, digest = int(fields.get("x-payload-length", len(payload))), told
    else:
        size, digest = len(payload), sha1_base32(payload)
        if not http and told and told != digest:
            raise ValueError(f"the payload of record {ident('warc-record-id')} doesn't have its digest")
    url, own, first = fields.get("warc-target-uri"), ident("warc-record-id"), ident("warc-refers-to")
    return own, _page(own), size, digest, kind, first, _page(first), None if url is None else urllib.parse.unquote(url), payload


def responses(pages: DataFrame) -> DataFrame:
    """pages with payload and _first, the page that holds the payload.

    Ids and digests find the group's first page (ids only, so a hot group is light and adaptive skew handling
    may split it); the payloads themselves are dealt by page, evenly.
    """
    digest = F.unhex(F.sha2("payload", 256))
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    ids = materialise(pages.select("page_id", digest.alias("sha")).distinct(), "payload-digests")
    first = ids.groupBy("sha").agg(F.min("page_id").alias("_first"))
    decided = ids.join(first, "sha").select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "_first")
    key = lambda page, sha: F.unhex(F.md5(F.concat(sha, F.coalesce(page.cast("string"), F.lit("")).cast("binary"))))
    rows = pages.withColumn("_key", key(F.col("page_id"), digest))
    return rows.join(decided.select(key(F.col("_page"), F.col("_sha")).alias("_key"), "_first"), "_key").drop("_key")


def write_warc(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page; returns the manifest (path, bytes, records, offsets of the records) of the archives."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, size, offsets, raw = None, 0, [], 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": len(offsets), "offsets": offsets}], FILES)

        for batch in batches:
            for page_id, url, payload, first in zip(*columns(batch, "page_id", "url", "payload", "_first")):
                if out is None:
                    name, size, offsets, raw = f"pages-{uuid.uuid4().hex}.warc.gz", 0, [], 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = member(page_id, url, payload, first, first is not None and first != page_id)
                out.write(data)
                offsets.append(size)
                size, raw = size + len(data), raw + len(payload)
                if raw >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    files = responses(pages).select("page_id", "url", "payload", "_first").mapInArrow(run, "path string, bytes bigint, records bigint, offsets array<bigint>")
    return materialise(files, "warc-manifest")


class FileView:
    """A moving view of a file from a given place on."""

    def __init__(self, file: pa.NativeFile, start: int, size: int, chunk: int = 1 << 20):
        self.file, self.size, self.chunk, self.at, self.data = file, size, chunk, start, bytearray()

    def need(self, end: int) -> bool:
        """Have the bytes up to end, if the file goes so far."""
        while self.at + len(self.data) < min(end, self.size):
            self.file.seek(self.at + len(self.data))
            if not (more := self.file.read(min(self.chunk, self.size - self.at - len(self.data)))):
                return False
            self.data += more
        return end <= self.size

    def skip(self, to: int) -> None:
        del self.data[: to - self.at]
        self.at = to


def decode_member(view: FileView) -> tuple[bytes, int] | None:
    """The member at the start of the view and its compressed size; None if there is none."""
    if not view.need(view.at + 18) or not view.data.startswith(_MAGIC):
        return None
    squeeze, used, out = zlib.decompressobj(31), 0, []
    try:
        while not squeeze.eof:
            if used == len(view.data) and not view.need(view.at + used + 1):
                return None
            part = view.data[used : used + view.chunk]
            out.append(squeeze.decompress(part))
            used += len(part) - len(squeeze.unused_data)
            if len(out) == 1 and not out[0].startswith(_VERSION[: len(out[0])]):
                return None
    except zlib.error:
        return None
    return b"".join(out), used


def split_records(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple]:
    """The records of the members whose first byte is in [start, end). An archive that isn't compressed raises an error."""
    view = FileView(file, start, size)
    if start == 0 and view.need(len(_VERSION)) and view.data.startswith(_VERSION):
        raise ValueError("the archive isn't compressed by members")
    while view.at < end:
        found = decode_member(view)
        rows = found and records(found[0])
        if rows:
            yield from rows
            view.skip(view.at + found[1])
            continue
        view.need(view.at + view.chunk)
        place = view.data.find(_MAGIC, 1)
        if place < 0:  # the last two bytes may begin the magic
            place = max(1, len(view.data) - 2)
        view.skip(view.at + place)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives in a manifest (path, bytes, and offsets if they are known), a task to RANGES byte ranges."""
    starts = F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")
    known = F.col("offsets") if "offsets" in files.columns else F.lit(None).cast("array<bigint>")
    ranges = files.where("bytes > 0").select("path", "bytes", known.alias("offsets"), F.explode(starts).alias("start"))
    expected = F.when(F.col("offsets").isNotNull(), F.size(F.filter("offsets", lambda x: (x >= F.col("start")) & (x < F.col("start") + split_bytes))))
    ranges = ranges.select("path", "bytes", "start", expected.alias("expected"))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    parts = max(-(-total // RANGES), min(total, files.sparkSession.sparkContext.defaultParallelism * 4))
    ranges = ranges.repartition(parts, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, size, start, expected in zip(*columns(batch, "path", "bytes", "start", "expected")):
                    fs, place = open_fs(path)
                    found = 0
                    with fs.open_input_file(place) as file:
                        for row in split_records(file, size, start, min(size, start + split_bytes)):
                            found += 1
                            yield row
                    if expected is not None and found != expected:
                        raise ValueError(f"{path} holds {found} records from byte {start} on, not {expected}")

        yield from batches_of(rows(), RECORDS, 256)

    kinds = "record_id string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to_id string, refers_to bigint, url string, payload binary"
    return ranges.mapInArrow(run, kinds)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    records = read_warc(write_warc(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
