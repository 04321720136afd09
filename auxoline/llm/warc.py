"""WARC archives: a writer with one gzip member per record and a sequential reader that checks every digest.

:func:`write_pages` writes a record per page into archives of bounded size in the shared folder; the table of finished archives is what
counts, so that files of lost or repeated tasks are never read. Pages of at least ``least`` bytes that have equal payloads are stored once:
the row with the largest page id is a response, the others are revisits that name it and keep the HTTP header only.

:func:`read_records` streams over each archive once: pieces of the file are inflated incrementally, one decompressor per member, headers are
framed by the empty line and blocks by Content-Length, and SHA-1 is taken on the way, so a task holds a few pieces whatever the
size of archives and records (the payload of one record more where contents are asked for). Checked are the gzip checksum, the framing, the block
and payload digests, the HTTP length and the number of records that the table of archives names; :func:`dangling` finds revisits whose response is
missing or has another digest.

Rules: a null payload is empty, a null url or page id has no field and reads back as null. Null page ids come last: they are the response
only among themselves. Of rows that repeat a page id and payload exactly one is the response. Control characters and blanks in urls are percent-encoded in
WARC-Target-URI, and the exact bytes kept beside it. An empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.frames import stored, with_ids
from auxoline.llm.registry import query, table
from auxoline.session import checkpoint_dir, spread

#: Payloads below so many bytes are always responses.
LEAST = 1000
#: A payload with at least this share of all rows is heavy; 1 / SHARE bounds the table of heavy payloads that is broadcast.
SHARE = 1 / 1000
#: Compressed bytes after which a task begins another archive, the compression level, and the bytes read or inflated at a time.
ROLL, LEVEL, PIECE = 64 << 20, 6, 1 << 16
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6f1d3c4e-5b0a-4f3e-9a57-0c8d8b1f2a11")
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
RECORD = "path string, record_type string, record_id string, page_id binary, url binary, date string, refers_id string, refers_to binary, payload_bytes long, payload_digest string, content binary"


class WarcError(ValueError):
    """An archive that cannot be read as written."""


def decide(pages: DataFrame, row: str, page_id: str, url: str, html: str, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """row, page_id, url, bytes, digest (SHA-1) of every page, top_row and top_page of the response that it revisits (else null), and the payload of responses.

    Payloads with a ``share`` of all rows are decided where they are read, and only responses carry theirs through the shuffle.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    given = pages.select(F.col(row).alias("row"), F.col(page_id).alias("page_id"), F.col(url).cast("binary").alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= least
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")
    groups = given.filter(large).select("row", "page_id", F.unhex(F.sha2("payload", 256)).alias("key")).groupBy("key").agg(F.max(order).alias("top"), F.count("*").alias("n"))
    winners = stored(groups.filter("n > 1").select("key", F.col("top.row").alias("top_row"), F.col("top.page_id").alias("top_page"), "n"))
    least_heavy = max(2, int(given.count() * share))
    heavy = winners.filter(F.col("n") >= least_heavy).select("key", F.struct("top_row", "top_page").alias("heavy"))
    light = winners.filter(F.col("n") < least_heavy).select("key", F.struct("top_row", "top_page").alias("light"))
    keyed = given.withColumn("key", F.when(large, F.unhex(F.sha2("payload", 256)))).withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    keyed = keyed.join(F.broadcast(heavy), "key", "left")
    revisits = lambda top: F.col(top).isNotNull() & (F.col(f"{top}.top_row") != F.col("row"))
    # What is decided goes on under a key of its own.
    own = F.unhex(F.sha2(F.col("row").cast("string"), 256))
    open_ = keyed.withColumn("payload", F.when(~revisits("heavy"), F.col("payload"))).withColumn("key", F.when(F.col("key").isNotNull() & F.col("heavy").isNull(), F.col("key")).otherwise(own))
    top = F.when(revisits("heavy"), F.col("heavy")).when(revisits("light"), F.col("light"))
    done = open_.join(light, "key", "left").withColumn("top", top)
    return done.select("row", "page_id", "url", "bytes", "digest", F.col("top.top_row").alias("top_row"), F.col("top.top_page").alias("top_page"), F.when(F.col("top").isNull(), F.col("payload")).alias("payload"))


def _record_id(row: int) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(row))}>".encode()


def _sha1(digest: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(digest)


def _field(name: str, value: bytes | None) -> list[tuple[str, bytes]]:
    """A field that reads back as ``value``, with its exact bytes beside it where a header line cannot hold them."""
    if value is None:
        return []
    safe = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], value)
    return [(name, safe)] if safe == value else [(name, safe), (f"X-Exact-{name}", base64.b64encode(value))]


def frame_record(fields: list[tuple[str, bytes]], *block: bytes, level: int = LEVEL) -> Iterator[bytes]:
    """One record as a gzip member, piece by piece."""
    digest = hashlib.sha1()
    for part in block:
        digest.update(part)
    fields = [*fields, ("WARC-Block-Digest", _sha1(digest.digest())), ("Content-Length", b"%d" % sum(map(len, block)))]
    head = VERSION + b"\r\n" + b"".join(name.encode() + b": " + value + b"\r\n" for name, value in fields) + b"\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    for part in (head, *block, b"\r\n\r\n"):
        yield z.compress(part)
    yield z.flush()


def write_records(rows: DataFrame, folder: str, level: int = LEVEL, roll: int = ROLL) -> DataFrame:
    """Write the rows of :func:`decide` into archives below ``folder``; path, records and bytes of each finished one."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ").encode()
    text = lambda c: F.col(c).cast("string").cast("binary").alias(c)
    given = rows.select("row", text("page_id"), "url", "bytes", "digest", "top_row", text("top_page"), "payload")

    def page_record(row, page, url, size, digest, top_row, top_page, payload) -> Iterator[bytes]:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        fields = [("WARC-Type", b"response" if top_row is None else b"revisit"), ("WARC-Record-ID", _record_id(row)), ("WARC-Date", date), ("Content-Type", b"application/http; msgtype=response")]
        fields += [*_field("WARC-Target-URI", url), *_field("X-Page-Id", page), ("WARC-Payload-Digest", _sha1(bytes.fromhex(digest)))]
        if top_row is not None:
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(top_row)), *_field("X-Refers-To-Page-Id", top_page)]
        return frame_record(fields, http, *(() if top_row is not None else (payload,)), level=level)

    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, path, records, size = None, None, 0, 0

        def finished():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                if out is None:
                    # A name of its own for every attempt of a task.
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, records, size = f"{folder.rstrip('/')}/{name}", 0, 0
                    out = system.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)
                    info = [("WARC-Type", b"warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>".encode()), ("WARC-Date", date), ("Content-Type", b"application/warc-fields")]
                    for piece in frame_record(info, b"format: WARC File Format 1.1\r\n", level=level):
                        size += out.write(piece)
                for piece in page_record(*(v.as_py() for v in values)):
                    size += out.write(piece)
                records += 1
                if size >= roll:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return given.mapInArrow(run, "path string, records long, bytes long")


class Members:
    """The gzip members of a stream, inflated piece by piece."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece, self.rest, self.z = stream, piece, b"", None
        self.out = b""

    def following(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        self.rest = self.rest or self.stream.read(self.piece)
        if not self.rest:
            return False
        self.z, self.out = zlib.decompressobj(31), b""
        return True

    def some(self) -> bytes:
        """More of this member, at most a piece; empty at its end."""
        if self.out:
            out, self.out = self.out, b""
            return out
        while not self.z.eof:
            data = self.rest or self.stream.read(self.piece)
            try:
                out = self.z.decompress(data, self.piece)
            except zlib.error as e:
                raise WarcError(f"member cannot be inflated: {e}") from e
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
            if not data and not self.z.eof:
                raise WarcError("stream ends within a member")
        return b""

    def back(self, data: bytes) -> None:
        self.out = data + self.out

    def until(self, mark: bytes) -> bytes:
        """All up to ``mark``, which is passed over."""
        found, looked = bytearray(), 0
        while (at := found.find(mark, looked)) < 0:
            looked = max(0, len(found) - len(mark) + 1)
            data = self.some()
            if not data:
                raise WarcError("header without end")
            found += data
        self.back(bytes(found[at + len(mark) :]))
        return bytes(found[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            data = self.some()
            if not data:
                raise WarcError(f"block is {n} bytes short")
            if len(data) > n:
                self.back(data[n:])
                data = data[:n]
            n -= len(data)
            yield data


def _fields(head: bytes) -> dict[str, bytes]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no field: {line[:80]!r}")
        out[name.decode("latin-1").lower()] = value.strip(b" ")
    return out


def _whole(value: bytes | None, what: str) -> int:
    if value is None or not re.fullmatch(rb"[0-9]+", value):
        raise WarcError(f"{what} is {value!r}")
    return int(value)


def _exact(fields: dict[str, bytes], name: str) -> bytes | None:
    kept = fields.get(f"x-exact-{name}")
    return fields.get(name) if kept is None else base64.b64decode(kept)


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def records(stream, content: bool = False, piece: int = PIECE) -> Iterator[tuple]:
    """The records of one archive in order, as the columns of RECORD without the path; raises WarcError at the first that is damaged."""
    members = Members(stream, piece)
    while members.following():
        version, _, head = members.until(b"\r\n\r\n").partition(b"\r\n")
        if version not in (b"WARC/1.0", b"WARC/1.1"):
            raise WarcError(f"no record: {version[:40]!r}")
        f = _fields(head)
        length, kind = _whole(f.get("content-length"), "Content-Length"), _text(f.get("warc-type"))
        block, payload, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
        http, start = f.get("content-type", b"").startswith(b"application/http"), bytearray()
        declared = None
        for data in members.exactly(length):
            block.update(data)
            if http and declared is None:
                looked = max(0, len(start) - 3)
                start += data
                at = start.find(b"\r\n\r\n", looked)
                if at < 0:
                    continue
                declared, data = _fields(bytes(start[:at]).partition(b"\r\n")[2]), bytes(start[at + 4 :])
            payload.update(data)
            size += len(data)
            if content:
                kept.append(data)
        if http and declared is None:
            raise WarcError("HTTP header without end")
        end = b"".join(iter(members.some, b""))
        if end != b"\r\n\r\n":
            raise WarcError(f"record ends with {end[:20]!r}")
        if "warc-block-digest" in f and f["warc-block-digest"] != _sha1(block.digest()):
            raise WarcError("block digest differs")
        given = f.get("warc-payload-digest")
        whole = _whole(declared["content-length"], "HTTP Content-Length") if http and "content-length" in declared else None
        if kind == "revisit":
            # The payload is elsewhere: its length and digest are what the record says.
            digest, size = base64.b32decode(given[5:]).hex() if given else None, whole
        else:
            digest = payload.hexdigest()
            if given is not None and given != _sha1(payload.digest()):
                raise WarcError("payload digest differs")
            if whole is not None and whole != size:
                raise WarcError(f"payload has {size} bytes, not {whole}")
        yield kind, _text(f.get("warc-record-id")), _exact(f, "x-page-id"), _exact(f, "warc-target-uri"), _text(f.get("warc-date")), _text(f.get("warc-refers-to")), _exact(f, "x-refers-to-page-id"), size, digest, b"".join(kept) if content and kind != "revisit" else None


def read_records(archives: DataFrame, content: bool = False, piece: int = PIECE) -> DataFrame:
    """The columns of RECORD for every record of the archives (path, and records where their number is known), warcinfo left out."""
    known = F.col("records") if "records" in archives.columns else F.lit(None).cast("bigint")
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64() if " long" in c else pa.binary() if " binary" in c else pa.string() for c in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(path)
                rows, held, n = [], 0, 0
                with system.open_input_stream(at, compression=None) as stream:
                    try:
                        for r in records(stream, content, piece):
                            if r[0] == "warcinfo":
                                continue
                            n += 1
                            rows.append((path, *r))
                            held += len(r[-1] or b"") + 200
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                                rows, held = [], 0
                    except WarcError as e:
                        raise WarcError(f"{path}, after {n} records: {e}") from e
                if expected is not None and n != expected:
                    raise WarcError(f"{path} has {n} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spread(archives.select("path", known.alias("records")), "path").mapInArrow(run, RECORD)


def dangling(read: DataFrame) -> DataFrame:
    """refers_id and payload_digest of revisits whose response is not among the records or has another payload."""
    named = read.filter("record_type = 'revisit'").select("refers_id", "payload_digest").distinct()
    return named.join(read.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), "payload_digest"), ["refers_id", "payload_digest"], "left_anti")


def write_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, share: float = SHARE, folder: str | None = None, level: int = LEVEL, roll: int = ROLL) -> DataFrame:
    """path, records and bytes of the archives that hold a record per page; they lie in ``folder``, or in a new one below the shared folder."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    numbered, row = with_ids(pages.select(page_id, url, html), page_id)
    return stored(write_records(decide(numbered, row, page_id, url, html, least, share), folder, level, roll))


def read_pages(archives: DataFrame, page_id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the pages in archives; all records and references are checked."""
    read = stored(read_records(archives))
    lost = dangling(read).first()
    if lost is not None:
        raise WarcError(f"no response {lost.refers_id} with payload {lost.payload_digest}")
    known = lambda c: F.col(c).cast("string").cast(page_id_type).alias(c)
    return read.filter("record_type IN ('response', 'revisit')").select(known("page_id"), "payload_bytes", "payload_digest", "record_type", known("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
"""


@query("op13_warc", ORACLE)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(write_pages(table(spark, sf_dir, "pages")))
