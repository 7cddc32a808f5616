"""WARC archives: writing records with revisits, and a sequential reader.

Archives are rows (archive, part, content): consecutive parts of an archive are its bytes.
A Parquet table of them can be written, read and lost-and-recomputed like any other, by
any store that Spark knows; `archives_of_files` gives the same rows for .warc.gz files that
lie there already, and `save_archives` writes such files to a mounted folder.

Every record is a gzip member of its own. The reader goes through an archive in order,
inflates member by member, frames blocks by Content-Length and checks both digests; it
holds one part and one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of archive that a row holds; a longer record gets a row of its own.
PART = 1 << 18
#: Bytes after which a new archive begins.
ARCHIVE = 32 << 20
VERSION = b"WARC/1.1"
#: Of records that stand for rows without an id.
NO_ID = "none"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ZERO_DATE = "1970-01-01T00:00:00Z"


#: Bytes of the largest record that is read; a member that inflates to more is an error.
LARGEST = 1 << 30
#: Bytes inflated at a time.
STEP = 1 << 20


class WarcError(ValueError):
    """An archive breaks the format, or its bytes don't match a digest."""


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def matches(said: str, data: bytes) -> bool | None:
    """Whether a digest field (NAME:VALUE in hexadecimal, base32 or base64) is that of the data; None for unknown names."""
    name, _, value = said.strip().partition(":")
    kind = name.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512") or not value:
        return None
    raw = hashlib.new(kind, data).digest()
    bare = value.strip().rstrip("=")
    return bare.lower() in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower()) or bare == base64.b64encode(raw).decode().rstrip("=")


def plain(said: str) -> str:
    """A SHA-1 field as bare upper-case base32, any other as it is."""
    name, _, value = said.strip().partition(":")
    if name.lower().replace("-", "") != "sha1":
        return said.strip()
    value = value.strip()
    try:
        return base64.b32encode(bytes.fromhex(value)).decode() if len(value) == 40 else value.upper()
    except ValueError:
        return value.upper()


def decoded(value: bytes) -> str:
    """A header's text: UTF-8, or else Latin-1, which older writers use."""
    try:
        return value.decode()
    except UnicodeDecodeError:
        return value.decode("latin-1")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with a whole record."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", ZERO_DATE), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def one_line(value: str) -> str:
    """A header value without line ends, which would end the header."""
    return " ".join(value.split())


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE) -> DataFrame:
    """archive, part, content: the records of pages (page_id, url, html, refers_to).

    A row whose refers_to is its own page_id, or null, becomes a response with its html
    as payload; others become revisits without payload that name the full payload's
    digest and length. Rows that repeat a page_id have records of one WARC-Record-ID.
    Null html is an empty payload, a null url about:blank. Parts of an archive are rows of
    one partition, in order. Other columns are ignored. Empty in, empty out.
    """
    schema = pa.schema([("archive", pa.string()), ("part", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, part, parts, written = TaskContext.get().partitionId(), 0, 0, bytearray(), 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}.warc.gz"]), pa.array([part], pa.int64()), pa.array([bytes(parts)], pa.binary())], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers = (batch.column(c)[i].as_py() for c in range(4))
                payload = (html or "").encode()
                name = NO_ID if page_id is None else str(page_id)
                headers = [("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Target-URI", one_line(url or "about:blank")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
                if refers is None or refers == page_id:
                    made = record("response", headers, http(len(payload)) + payload)
                else:
                    made = record("revisit", [*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")], http(len(payload)))
                if parts and len(parts) + len(made) > PART:
                    yield row()
                    part, parts = part + 1, bytearray()
                parts += made
                written += len(made)
                if written >= archive_bytes:
                    yield row()
                    number, part, parts, written = number + 1, 0, bytearray(), 0
        if parts:
            yield row()

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.col("refers_to").cast("long")]
    return pages.select(*columns).mapInArrow(run, "archive string, part long, content binary")


class Reader:
    """Feeds on an archive's bytes in order and yields (headers, block) of each record."""

    def __init__(self):
        self.inflater, self.data = None, bytearray()

    def feed(self, content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        while content:
            if self.inflater is None:
                self.inflater = zlib.decompressobj(31)
            try:
                self.data += self.inflater.decompress(content, STEP)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            if len(self.data) > LARGEST:
                raise WarcError(f"a record of over {LARGEST} bytes")
            content = self.inflater.unconsumed_tail
            if self.inflater.eof:
                content, self.inflater = self.inflater.unused_data, None
                yield self.framed(bytes(self.data))
                self.data.clear()

    def close(self) -> None:
        if self.inflater is not None:
            raise WarcError("the archive ends inside a member")

    @staticmethod
    def framed(member: bytes) -> tuple[dict[str, str], bytes]:
        head, found, rest = member.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        if not found or not version.startswith(b"WARC/1."):
            raise WarcError("no WARC header")
        headers = {decoded(k.strip()).lower(): decoded(v.strip()) for k, _, v in (line.partition(b":") for line in lines)}
        if not headers.get("warc-type"):
            raise WarcError("no WARC-Type")
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no Content-Length") from e
        if rest[length:] != b"\r\n\r\n":
            raise WarcError("the block's length is not Content-Length")
        block = rest[:length]
        if (said := headers.get("warc-block-digest")) and matches(said, block) is False:
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        return headers, block


def page_of(uri: str | None) -> int | None:
    """The id in <urn:page:ID>."""
    name = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def bare_id(uri: str | None) -> str | None:
    """A record's id without its angle brackets."""
    return uri.strip().removeprefix("<").removesuffix(">") if uri else None


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload, record_id, refers_to_id, verified."""
    kind = headers["warc-type"]
    framed = kind in ("response", "revisit", "request") and "http" in headers.get("content-type", "application/http")
    head, _, payload = block.partition(b"\r\n\r\n") if framed else (b"", b"", block)
    said = headers.get("warc-payload-digest", "")
    same = matches(said, payload) if said and kind != "revisit" else None
    if same is False:
        raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
    fields = (x.partition(b":") for x in head.split(b"\r\n"))
    told = next((v.strip() for k, _, v in fields if k.lower() == b"content-length"), b"")
    length = int(told) if told.isdigit() else len(payload)
    own, refers = headers.get("warc-record-id"), headers.get("warc-refers-to")
    block_said = headers.get("warc-block-digest", "")
    verified = bool(same) or bool(block_said and matches(block_said, block))
    return page_of(own), kind, headers.get("warc-target-uri"), length, plain(said) if said else None, page_of(refers), payload if kind != "revisit" else None, bare_id(own), bare_id(refers), verified


def read_archives(archives: DataFrame, payloads: bool = True, in_order: bool = False) -> DataFrame:
    """One row per record of archives (archive, part, content), checked as it is read.

    Columns: page_id, record_type, url, payload_bytes and payload_digest (of the full
    payload, also for revisits), refers_to, payload (null for revisits, and if `payloads`
    is false), record_id and refers_to_id as they are written, verified (a digest was there
    and was that of the data). page_id and refers_to are null where a record isn't of write_archives. Records of
    all types come out; digests by MD5, SHA-1, SHA-256 or SHA-512 are checked, in whatever
    spelling, others pass. A damaged archive raises WarcError. Null contents count as empty. With
    `in_order` the parts of an archive are taken to lie together and in order, as
    write_archives gives them and a checkpoint keeps them; else they are brought so.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("verified", pa.bool_())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, Reader()
        for batch in batches:
            for i in range(batch.num_rows):
                if at != (name := batch.column(0)[i].as_py()):
                    reader.close()
                    at, reader = name, Reader()
                rows = []
                for headers, block in reader.feed(batch.column(1)[i].as_py() or b""):
                    row = parsed(headers, block)
                    rows.append(row if payloads else (*row[:6], None, *row[7:]))
                yield batch_of(rows)
        reader.close()

    dealt = archives if in_order else archives.repartition("archive").sortWithinPartitions("archive", "part")
    return dealt.select("archive", "content").mapInArrow(run, "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string, refers_to_id string, verified boolean")


def archives_of_files(files: DataFrame, part: int = PART) -> DataFrame:
    """archive, part, content of the rows that spark.read.format("binaryFile") gives, in pieces of `part` bytes.

    Spark's reader loads a file into one row of its JVM; it leaves that in pieces, so
    that Python holds a piece and a record at a time, however large the file.
    """
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / part))))
    cut = files.select(F.col("path").alias("archive"), pieces.alias("part"), "content")
    return cut.select("archive", "part", F.expr(f"substring(content, cast(part * {part} + 1 as int), {part})").alias("content"))


def save_archives(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a file of `folder`, which all executors must have mounted."""

    def run(rows) -> None:
        # Written under a name of the task's own first, so that a second attempt harms nothing.
        attempt = f".{uuid.uuid4().hex}.part"
        for name, parts in itertools.groupby(rows, key=lambda row: row.archive):
            with open(os.path.join(folder, name + attempt), "wb") as f:
                for row in parts:
                    f.write(row.content)
            os.replace(f.name, os.path.join(folder, name))

    archives.repartition("archive").sortWithinPartitions("archive", "part").foreachPartition(run)


def revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page_id of an equal payload.

    Payloads are compared by SHA-1 and length; null html is an empty payload. Only digests
    are grouped, partly before the shuffle. Those of equal payloads then meet the group's
    one row by digest, a few bytes each, where adaptive execution splits or broadcasts; html
    goes by page_id, so no task holds a group's pages. Rows that repeat a page_id with other
    html keep decisions of their own. Other columns are ignored. Empty in, empty out.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    digests = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    first = digests.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = digests.join(first, ["digest", "bytes"]).where("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    return pages.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.sha1(payload) == F.col("again_digest")), "left").select("page_id", "url", "html", "refers_to")
