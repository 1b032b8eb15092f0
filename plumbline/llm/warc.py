"""WARC archives: writing with revisit records, and a salvage reader for damaged files.

``write_archives`` stores pages as WARC/1.1 records, one gzip member each, in files of about ``roll`` bytes in a folder that
all executors share. ``read_archives`` reads files back record by record. When a check fails (gzip header, stream or checksum,
version line, header, Content-Length, end of record, block or payload digest) it notes the failure, searches for the next place where a
record begins (a gzip member that opens with a version line, or a version line, in any file), goes on from there, and
reports the bytes between as a gap. Members may hold several records: a damaged one is passed over inside its member, and
a member that breaks off gives the records before the break. A record is held in memory whole (2 GiB at most, as a row can
hold no more; a longer one is a gap), a member or file never is. ``gaps`` lists what was passed over; ``round_trip`` counts
the records of each archive and stops if one did not come back.

Equal payloads: of the pages with one payload digest, that with the smallest page_id is the response and the others
revisit it, if the payload has at least ``least`` bytes. The smallest ids come from a pre-aggregated table
that is joined back by digest, dealt anew so that hot digests can be split.

Defined results: null html is an empty payload; a null page_id comes last, and is the response only if all ids of its
payload are null; rows repeating the smallest page_id of a payload are all responses; an empty table gives no archives and no
rows; a task that is run again writes files of new names, and only those of the attempt that counted are listed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes
from .shared import drop_at_exit, respread, scratch, shuffle_partitions, table

_ID = "urn:page:"
CHUNK = 1 << 20
MOST = 1 << 31


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers alone."""
    mark = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{quote(page_id)}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{mark}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{quote(refers_to or '')}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Damage(ValueError):
    """A record that fails a check."""


class Broken(Damage):
    """A gzip member that can't be unpacked further."""


class _File:
    """Reads at any offset of a file, through a window of one chunk."""

    def __init__(self, source):
        self.source, self.size, self.at, self.held = source, source.size(), 0, b""
        self.known: dict[bytes, tuple[int, int]] = {}

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(min(max(n, CHUNK), max(0, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int, most: int | None = None) -> int | None:
        """Next place of ``what``, at most ``most`` bytes away."""
        since, place = self.known.get(what, (0, -1))
        if since <= at <= place:
            return place if most is None or place - at <= most else None
        here, stop = at, self.size if most is None else min(self.size, at + most)
        while here < stop:
            part = self.read(here, CHUNK)
            i = part.find(what)
            if i >= 0:
                self.known[what] = at, here + i
                return here + i if here + i <= stop else None
            here += max(1, len(part) - len(what) + 1)
        if stop == self.size:
            self.known[what] = at, self.size
        return None


class _Member:
    """The content of the gzip member at ``at``, unpacked while it is read, forwards only."""

    def __init__(self, f: _File, at: int):
        self.f, self.here, self.end = f, at, None
        self.unpack, self.at, self.held = zlib.decompressobj(31), 0, bytearray()

    def _more(self) -> bool:
        part = self.unpack.unconsumed_tail
        if not part and not self.unpack.eof:
            part = self.f.read(self.here, CHUNK)
            self.here += len(part)
            if not part:
                raise Broken("truncated member")
        if self.unpack.eof:
            if self.end is None:
                self.here -= len(self.unpack.unused_data)
                self.end = self.here
            return False
        try:
            self.held += self.unpack.decompress(part, CHUNK)
        except zlib.error as e:
            raise Broken("gzip member") from e
        return True

    def place(self) -> int:
        """Where in the file the content unpacked so far ends."""
        return self.here - len(self.unpack.unconsumed_tail) - len(self.unpack.unused_data) if self.end is None else self.end

    def read(self, at: int, n: int) -> bytes:
        while self.at + len(self.held) < at + n and self._more():
            pass
        return bytes(self.held[at - self.at : at - self.at + n])

    def find(self, what: bytes, at: int, most: int | None = None) -> int | None:
        here = at
        while most is None or here - at <= most:
            i = self.held.find(what, here - self.at)
            if i >= 0:
                return self.at + i
            here = max(here, self.at + len(self.held) - len(what) + 1)
            if most is None:
                self.forget(here)
            if not self._more():
                return None
        return None

    def forget(self, before: int) -> None:
        if before > self.at:
            del self.held[: before - self.at]
            self.at = before


def _headers(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _length(head: dict[str, str]) -> int:
    n = head.get("content-length", "")
    if not (n.isascii() and n.isdigit()) or len(n) > 10 or int(n) >= MOST:
        raise Damage("Content-Length")
    return int(n)


def _checked(head: dict[str, str], block: bytes) -> dict:
    """The record's fields, after its digests have been compared."""
    mark = head.get("warc-block-digest", "")
    if mark.lower().startswith("sha1:") and digest(block) != mark[5:].upper():
        raise Damage("block digest")
    kind = head.get("warc-type", "")
    http, gap, payload = block.partition(b"\r\n\r\n") if "application/http" in head.get("content-type", "") else (b"", b"", block)
    declared = head.get("warc-payload-digest", "").rpartition(":")[2].upper()
    if kind == "revisit":
        try:
            size = _length(_headers(http.partition(b"\r\n")[2]))
        except Damage:
            size = None
        payload = b""
    else:
        size = len(payload)
        own = digest(payload)
        if declared and declared != own:
            raise Damage("payload digest")
        declared = own
    return {"head": head, "kind": kind, "payload": payload, "size": size, "digest": declared or None}


def _record_at(f: _File | _Member, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends."""
    if f.read(at, 7) != b"WARC/1.":
        raise Damage("version line")
    end = f.find(b"\r\n\r\n", at, CHUNK)
    if end is None:
        raise Damage("header")
    head = _headers(f.read(at, end - at).partition(b"\r\n")[2])
    n = _length(head)
    block = f.read(end + 4, n + 4)
    if len(block) < n + 4:
        raise Damage("truncated record")
    if block[n:] != b"\r\n\r\n":
        raise Damage("end of record")
    return _checked(head, block[:n]), end + 8 + n


def _in_member(f: _File, at: int) -> Iterator[dict]:
    """Records and gaps of one member. Each waits until the content after it could be unpacked, or the member's checksum was right."""
    m, here, held = _Member(f, at), 0, None
    while m.read(here, 1):
        if held:
            yield held
            at = held["end"]
        m.forget(here)
        try:
            found, here = _record_at(m, here)
        except Broken:
            raise
        except Damage as e:
            found = {"kind": "gap", "reason": str(e)}
            place = m.find(b"\nWARC/1.", here)
            here = m.at + len(m.held) if place is None else place + 1
        held = {"at": at, "end": m.place(), **found}
    if held is None:
        raise Damage("empty member")
    yield {**held, "end": m.end}


def _begins(f: _File, at: int, packed: bool) -> bool:
    try:
        if packed:
            return _Member(f, at).read(0, 7) == b"WARC/1."
        return f.read(at - 1, 1) == b"\n" or bool(_record_at(f, at))
    except Damage:
        return False


def _next(f: _File, at: int) -> int:
    """Where the next record may begin."""
    while True:
        places = [(f.size if i is None else i, packed) for packed in (True, False) for i in (f.find(b"\x1f\x8b\x08" if packed else b"WARC/1.", at),)]
        at, packed = min(places)
        if at >= f.size or _begins(f, at, packed):
            return at
        at += 1


def salvage(source) -> Iterator[dict]:
    """Records and gaps of one file, in order; ``source`` has size(), seek() and read()."""
    f, at = _File(source), 0
    while at < f.size:
        try:
            if f.read(at, 2) == b"\x1f\x8b":
                begin = at
                for r in _in_member(f, begin):
                    yield r
                    at = r["end"]
            else:
                found, end = _record_at(f, at)
                yield {"at": at, "end": end, **found}
                at = end
        except Damage as e:
            end = _next(f, at + 1)
            yield {"at": at, "end": end, "kind": "gap", "reason": str(e)}
            at = end


def with_responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html in; beside them first, the page_id of the response that a revisit refers to (null for responses)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).alias("n"))
    groups = rows.filter(F.col("n") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("times"), F.min("page_id").alias("first"))
    shared = respread(groups.filter((F.col("times") > 1) & F.col("first").isNotNull()).select(F.col("sha").alias("sha2"), "first"))
    joined = rows.join(shared, F.col("sha") == F.col("sha2"), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str, *, roll: int = 16 << 20, packed: bool = True) -> DataFrame:
    """Write rows page_id, url, html, first; path, records, bytes of each file. Runs when the result is read."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.col("html").alias("text"), F.col("first").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, records, size = "", None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])], ["path", "records", "bytes"])

        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc{'.gz' if packed else ''}"
                        out, records, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    data = record("response" if first is None else "revisit", "" if page_id is None else page_id, url or "", (html or "").encode(), first)
                    data = member(data) if packed else data
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= roll:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    return rows.mapInArrow(run, "path string, records long, bytes long")


RECORD = "path string, at long, end long, kind string, reason string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def read_archives(files: DataFrame, *, payload: bool = True) -> DataFrame:
    """Records and gaps (kind 'gap', with a reason) of the files in column path."""

    def name(value: str | None) -> str | None:
        value = (value or "").strip("<>")
        return unquote(value[len(_ID) :]) if value.startswith(_ID) else value or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as source:
                    for r in salvage(source):
                        head = r.get("head", {})
                        rows.append((path, r["at"], r["end"], r["kind"], r.get("reason"), name(head.get("warc-record-id")), name(head.get("warc-refers-to")), head.get("warc-target-uri"), r.get("digest"), r.get("size"), r.get("payload") if payload else None))
                        held += r["end"] - r["at"]
                        if held > 8 * CHUNK or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path").repartition(shuffle_partitions(files.sparkSession), "path").mapInArrow(run, RECORD)


def gaps(found: DataFrame) -> DataFrame:
    """path, at, end, reason of the bytes that ``read_archives`` passed over."""
    return found.filter(F.col("kind") == "gap").select("path", "at", "end", "reason")


def round_trip(pages: DataFrame, spark: SparkSession, *, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; one row per record."""
    folder = scratch(spark, "warc")
    files = table(write_archives(with_responses(pages, least), folder), "warc-files")
    drop_at_exit(spark, folder)
    kind = pages.schema["page_id"].dataType
    found = table(read_archives(files, payload=False).drop("payload"), "warc-records")
    written = files.agg(F.sum("records")).first()[0] or 0
    read = found.filter(F.col("kind") != "gap").count()
    if written != read:
        raise RuntimeError(f"{written} records were written and {read} read; passed over: {gaps(found).limit(20).collect()}")
    return found.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"),
    )
