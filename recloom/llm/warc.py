"""Legacy archive converter: ARC version 1 and 2 to WARC 1.0.

An ARC file starts with a version block (``filedesc://``) whose second line names the version; each following record has
one header line of five (version 1) or ten (version 2) fields, the last of which is the declared length of what follows.
The converter walks the declared lengths and never searches the content for record starts.  For each record it makes a
WARC identifier (name-based UUID of URL, date, offset and digest, so that a rerun gives the same), an ISO date from the
14-digit one, a record type and SHA-1 digests.  The version block becomes a ``warcinfo`` record, a record with an HTTP
status line a ``response`` (or ``revisit``), any other (such as ``text/dns``) a ``resource``.

WARC files hold a gzip member per record and are cut at ``FILE_BYTES``.  A task writes under names of its own attempt, and
the manifest, a table, holds the files of the tasks that Spark committed.  Files are read as streams, one record at a time,
so neither a file's size nor its number of members matters.

Edge cases: a null or empty body gives a record of length 0; a truncated, damaged or unreadable record, or gzip member, ends
its archive with a row whose ``error`` is set, after all records before it; a header of too few fields is such a row, too,
but the next record is read; URLs may hold white space, and records may be parted by line feeds with or without carriage
returns; a date that no calendar has is cut to its sound part and kept in ``X-Archive-Date``; repeated rows give repeated
records; an empty table gives no record; extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recloom.llm.store import Scratch, file_system, put_whole

FILE_BYTES = 256 << 20
#: Rows (page and response) that are broadcast at most, some 100 bytes each; beyond, the pages are shuffled.
BROADCAST_MARKS = 300_000
#: A header block or line that is longer than this is none.
HEADER_BYTES = 1 << 20
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CAPTURED = "20200101000000"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 recloom\n{ARC_FIELDS[version]}\n".encode()
    if version == 1:
        head = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {len(body)}\n"
    else:
        head = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain 200 - - 0 {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def one_word(field: str) -> str:
    """White space and control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in field)


def arc_record(version: int, url: str, content: bytes, offset: int, name: str, date: str = CAPTURED) -> bytes:
    """One record.  White space in the URL is percent-encoded, as fields are parted by it."""
    url = one_word(url or "unknown:")
    if version == 1:
        head = f"{url} 0.0.0.0 {date} text/html {len(content)}\n"
    else:
        head = f"{url} 0.0.0.0 {date} text/html 200 - - {offset} {name} {len(content)}\n"
    return head.encode() + content + b"\n"


class Source:
    """Bytes of a stream on demand, plain or a row of gzip members.  What can't be unpacked ends it, with ``error`` set."""

    def __init__(self, stream):
        self.stream, self.ready, self.at, self.error = stream, bytearray(), 0, None
        self.packed = stream.read(1 << 16)
        self.member = zlib.decompressobj(31) if self.packed[:2] == b"\x1f\x8b" else None
        self.gzip = self.member is not None

    def _more(self) -> bool:
        if self.error:
            return False
        raw = self.packed or self.stream.read(1 << 16)
        self.packed = b""
        if not self.gzip:
            self.ready += raw
            return bool(raw)
        if not raw:
            if self.member is not None:
                self.error = "truncated gzip member"
            return False
        try:
            if self.member is None:
                raw = raw.lstrip(b"\0")  # padding between members
                self.member = zlib.decompressobj(31) if raw else None
            if self.member is not None:
                self.ready += self.member.decompress(raw)
                if self.member.eof:
                    self.packed, self.member = self.member.unused_data, None
        except zlib.error as e:
            self.error = f"gzip: {e}"
        return True

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.ready) < n and self._more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to ``mark`` and it; null (and nothing taken) if it doesn't come within ``HEADER_BYTES``."""
        start = 0
        while (found := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark) + 1)
            if len(self.ready) > HEADER_BYTES or not self._more():
                return None
        return self.take(found + len(mark))

    def ended(self) -> bool:
        while not self.ready:
            if not self._more():
                return True
        return False


def opened(data) -> Source:
    return Source(io.BytesIO(data) if isinstance(data, bytes) else data)


def parse_arc(data) -> Iterator[dict]:
    """Records of one archive (bytes or a stream, plain or gzip members), by the version that its first block declares; that
    block comes first, with ``kind`` warcinfo.  The URL is all before the last four (nine) fields, white space included.  A
    header of too few fields gives a row with ``error``; as its length is declared, the records after it are read."""
    source, version = opened(data), 0
    while True:
        while not source.ended() and source.ready[:1] in (b"\n", b"\r"):  # separators between records
            source.take(1)
        if source.ended():
            if source.error:
                yield {"offset": source.at, "error": source.error}
            return
        at = source.at
        line = (source.until(b"\n") or b"").decode("utf-8", "replace").rstrip("\r\n")
        last = line.rpartition(" ")[2]
        length = int(last) if last.isascii() and last.isdigit() and len(last) < 19 else -1
        body = source.take(length) if length >= 0 else b""
        if length < 0 or len(body) < length:
            yield {"offset": at, "error": source.error or "header or declared length unreadable"}
            return
        kind = "record"
        if not version:
            version = int(body[:1]) if line.startswith("filedesc://") and body[:2] in (b"1 ", b"2 ") else 0
            kind = "warcinfo"
            if not version:
                yield {"offset": at, "error": "no version block"}
                return
        fields = line.rsplit(" ", 4 if version == 1 else 9)
        if len(fields) != (5 if version == 1 else 10):
            yield {"offset": at, "error": f"{len(fields)} fields in a version {version} header"}
            continue
        yield {"kind": kind, "version": version, "url": fields[0], "ip": fields[1], "date": fields[2], "mime": fields[3], "offset": at, "content": body, "error": None}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block with its blank line, and payload; all is payload if there is no HTTP status line."""
    if content.startswith(b"HTTP/"):
        at = content.find(b"\r\n\r\n")
        if at >= 0:
            return content[: at + 4], content[at + 4 :]
    return b"", content


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode("utf-8", "replace")
    return None


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(date14: str) -> str:
    """The ISO form of as much of a 14-digit date as is one: what lies beyond the first part that no calendar has, or is missing,
    is the earliest it can be; without a year it is 1970."""
    ascii_digits = date14 if date14.isascii() and date14.isdigit() else ""
    parts = [ascii_digits[:4], *(ascii_digits[i : i + 2] for i in range(4, 14, 2))]
    best, own = datetime(1970, 1, 1), []
    for part, first in zip(parts, (4, 2, 2, 2, 2, 2), strict=True):
        if len(part) < first:
            break
        own.append(int(part))
        try:
            best = datetime(*own, *(1, 1)[len(own) - 1 :]) if len(own) < 3 else datetime(*own)
        except ValueError:
            break
    return f"{best.year:04d}{best:-%m-%dT%H:%M:%SZ}"


def warc_id(digest: str, key: str) -> str:
    """Name-based: who knows payload digest and key of a record knows its identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {key}')}>"


def warc_record(rec: dict, refers_to: str | None = None) -> bytes:
    """One record with the blank lines that end it; with ``refers_to`` (key of the record with the same payload) a revisit
    that holds only the HTTP headers."""
    http, payload = split_http(rec["content"])
    digest, date = sha1_label(payload), warc_date(rec["date"])
    kind = "warcinfo" if rec.get("kind") == "warcinfo" else "revisit" if refers_to else "response" if http else "resource"
    block, mime = http if refers_to else rec["content"], "application/http; msgtype=response" if http else rec["mime"]
    if kind == "warcinfo":
        names = rec["content"].decode("utf-8", "replace").split("\n")[1:2]
        block, mime = f"format: WARC File Format 1.0\r\nconverted-from: ARC version {rec['version']}\r\narc-fields: {''.join(names)}\r\n".encode(), "application/warc-fields"
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {warc_id(digest, rec.get('key') or rec['url'] + ' ' + date)}", f"WARC-Date: {date}"]
    if kind == "warcinfo":
        head.append(f"WARC-Filename: {rec['url'].removeprefix('filedesc://')}")
    else:
        head += [f"WARC-Target-URI: {one_word(rec['url'])}", f"WARC-IP-Address: {one_word(rec['ip'])}", f"WARC-Payload-Digest: {digest}"]
    head += [f"WARC-Block-Digest: {sha1_label(block)}", f"Content-Type: {mime}"]
    if "".join(c for c in date if c.isdigit()) != rec["date"].ljust(14, "0"):
        head.append(f"X-Archive-Date: {one_word(rec['date'])}")
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {warc_id(digest, refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data) -> Iterator[tuple[dict, bytes, str | None]]:
    """Headers (lower-case names), block and error of each record of an archive (bytes or a stream, plain or gzip members), by
    declared lengths.  A record that can't be read ends it: no headers, and the error."""
    source = opened(data)
    while not source.ended():
        at = source.at
        lines = (source.until(b"\r\n\r\n") or b"").decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        if not lines[0].startswith("WARC/") or not (length.isascii() and length.isdigit() and len(length) < 19):
            yield {}, b"", source.error or f"no WARC record at byte {at}"
            return
        block, end = source.take(int(length)), source.take(4)
        if len(block) < int(length) or end != b"\r\n\r\n":
            yield {}, b"", source.error or f"record at byte {at} is not as long as it declares"
            return
        yield head, block, None
    if source.error:
        yield {}, b"", source.error


CONVERTED = T.StructType([T.StructField("key", T.StringType()), T.StructField("record", T.BinaryType()), T.StructField("error", T.StringType())])


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """``archives``: ``content`` binary (an ARC file, plain or gzip) and ``refs`` map<string, string>, which gives for
    the X-Record-Key of a record the key of the response that it revisits (null or absent: response).
    Returns ``key``, ``record`` (a WARC record) and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("record", pa.binary()), ("error", pa.string())])
        for b in batches:
            for content, refs in zip(b.column("content"), b.column("refs"), strict=True):
                refs = dict(refs.as_py() or ())
                rows: list[tuple] = []
                for rec in parse_arc(content.as_py() or b""):
                    if rec["error"]:
                        rows.append((None, None, rec["error"]))
                        continue
                    key = http_field(split_http(rec["content"])[0], b"x-record-key")
                    rows.append((key, warc_record(rec | {"key": key}, refs.get(key)), None))
                cols = zip(*rows, strict=True) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, schema.types, strict=True)], schema=schema)

    return archives.select("content", "refs").mapInArrow(run, CONVERTED)


def pages_to_arc(pages: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """Pages (``key`` string, ``url``, ``html``, ``ref_key``) as ARC archives of about ``block_bytes``, versions
    1 and 2 in turn; a page longer than that is an archive by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("content", pa.binary()), ("refs", pa.map_(pa.string(), pa.string()))])
        n, version, parts, size, refs = 0, 1, [], 0, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([refs], schema.types[1])], schema=schema)

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("key", "url", "html", "ref_key")), strict=True):
                key, url, html, ref_key = row
                if not parts:
                    version, name = 1 + n % 2, f"block-{n}.arc"
                    parts = [arc_version_block(version, name)]
                    size = len(parts[0])
                body = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Record-Key: {key}\r\n\r\n".encode()
                parts.append(arc_record(version, url, http + body, size, name))
                size += len(parts[-1])
                if ref_key is not None:
                    refs.append((key, ref_key))
                if size >= block_bytes:
                    yield done()
                    n, parts, refs = n + 1, [], []
        if parts:
            yield done()

    schema = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("refs", T.MapType(T.StringType(), T.StringType()))])
    return pages.select("key", "url", "html", "ref_key").mapInArrow(run, schema)


def assign_revisits(pages: DataFrame, min_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """Adds ``ref_key``: of pages (``page_id`` long, ``html``) with equal payloads of at least ``min_bytes``, the largest
    page_id; null for itself, for smaller payloads and for payloads that occur once.  Digests alone are grouped; rows of one
    go to ``salts`` tasks, so that a payload held by a third of all pages is no single task's work.  The pages are joined
    with what they refer to by broadcast while that is ``BROADCAST_MARKS`` rows at most."""
    scratch = Scratch(pages.sparkSession, "revisits")
    body = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha1(body.cast("binary"))
    own = scratch.save(pages.filter(F.octet_length(body) >= min_bytes).select("page_id", digest.alias("digest")), "digests")
    top = own.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null")
    top = top.select("digest", "top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    later = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(top, ["digest", "salt"])
    later = later.filter(~F.col("top").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("m_id"), F.col("digest").alias("m_digest"), F.col("top").alias("ref_key"))
    marks = scratch.save(later.distinct(), "marks")
    if marks.count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    return pages.join(marks, F.col("page_id").eqNullSafe(F.col("m_id")) & (digest == F.col("m_digest")), "left").drop("m_id", "m_digest")


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """WARC files with a gzip member per record, and their manifest: ``file``, ``records``, ``bytes``, ``error``.  To be saved,
    which runs it: a row stands for a file of a task that was committed, or, without ``file``, for a record of the old archive
    that could not be converted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rejects: list[str] = []

        def good() -> Iterator[bytes]:
            for b in batches:
                rejects.extend(e for e in b.column("error").to_pylist() if e is not None)
                yield from (x.as_py() for x in b.column("record") if x.is_valid)

        def manifest(files: list, records: list, sizes: list, errors: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["file", "records", "bytes", "error"])

        rows = good()
        part, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        while (first := next(rows, None)) is not None:
            count = 0

            def members() -> Iterator[bytes]:
                nonlocal count
                size = 0
                for record in chain([first], rows):
                    packed = gzip.compress(record, 6, mtime=0)
                    count, size = count + 1, size + len(packed)
                    yield packed
                    if size >= file_bytes:
                        return

            file = f"{path}/{part:05d}-{n:05d}-{attempt}.warc.gz"
            size = put_whole(file, members())
            yield manifest([file], [count], [size], [None])
            n += 1
        if rejects:
            yield manifest([None] * len(rejects), [0] * len(rejects), [0] * len(rejects), rejects)

    return records.select("record", "error").mapInArrow(run, "file string, records long, bytes long, error string")


READ = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to_key", T.StringType()),
    T.StructField("intact", T.BooleanType()), T.StructField("error", T.StringType()),
])


def list_archives(spark: SparkSession, path: str, glob: str = "*.warc*") -> DataFrame:
    """``file`` of each archive below a folder that no manifest describes; the files' contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"))


def read_archives(files: DataFrame) -> DataFrame:
    """Records of the archives named in ``file``, each file a stream in one task.  ``payload_digest`` is bare hex; ``intact``
    tells that block and payload digests fit what was read.  A revisit's payload size is the Content-Length of the HTTP
    headers it keeps.  A damaged archive gives the records before the damage and a row with ``error``."""

    def read(head: dict, block: bytes, error: str | None) -> tuple:
        if error:
            return (*[None] * 8, False, error)
        http, payload = split_http(block)
        kind, digest = head.get("warc-type"), head.get("warc-payload-digest")
        revisit = kind == "revisit"
        ok = head.get("warc-block-digest") in (None, sha1_label(block)) and (revisit or digest in (None, sha1_label(payload)))
        size = http_field(http, b"content-length") if revisit else None
        size = (int(size) if (size or "").isdigit() else None) if revisit else len(payload)
        try:
            bare = None if digest is None else base64.b32decode(digest.removeprefix("sha1:")).hex()
        except ValueError:
            bare, ok = None, False
        return http_field(http, b"x-record-key"), head.get("warc-record-id"), kind, head.get("warc-date"), head.get("warc-target-uri"), size, bare, head.get("x-refers-to-key"), ok, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        for b in batches:
            for file in b.column("file").to_pylist():
                fs, own = file_system(file)
                with fs.open_input_stream(own, compression=None) as stream:
                    records = (read(*x) for x in parse_warc(stream))
                    while rows := [r for _, r in zip(range(2000), records)]:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=READ.names)

    files = files.filter("file is not null")
    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(run, READ)


def convert_pages(spark: SparkSession, pages: DataFrame, path: str, min_bytes: int = 1000) -> DataFrame:
    """Pages to ARC archives, those to WARC archives below ``path``, and the pages' records read back (see ``read_archives``)."""
    marked = assign_revisits(pages.select("page_id", "url", "html"), min_bytes)
    arc = pages_to_arc(marked.select(F.col("page_id").cast("string").alias("key"), "url", "html", F.col("ref_key").cast("string").alias("ref_key")))
    return convert(spark, arc, path).filter("record_type is distinct from 'warcinfo'")


def convert(spark: SparkSession, archives: DataFrame, path: str) -> DataFrame:
    """ARC archives (see ``arc_to_warc``) to WARC archives below ``path``, read back; what could not be converted is a row with
    ``error``, as is what can't be read back."""
    manifest = Scratch(spark, "warc").save(write_archives(arc_to_warc(archives), path), "manifest")
    lost = manifest.filter("file is null").select(*(F.col("error") if f.name == "error" else F.lit(None).cast(f.dataType).alias(f.name) for f in READ))
    return read_archives(manifest).unionByName(lost.withColumn("intact", F.lit(False)))
