"""Legacy ARC archives to WARC.

An ARC file starts with a version block; version 1 header lines have five fields, version 2 lines ten, and
the last is the length of what follows. Each record becomes a WARC record with a synthesised identifier,
timestamp, type and digests. Of equal payloads one is a response, the others revisit it.

Archives are written by Spark's text sink, so they can lie in any store that Spark reaches: a row is one
gzip member followed by the head of an empty member, and the line separator is that member's tail.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged
from consigna.session import shared_folder

#: An empty gzip member, cut before its last eight bytes, which are zero.
_EMPTY = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03\0"
_TAIL = "\0" * 8
#: Payloads from this size on are checked for equals.
REVISIT_BYTES = 1000
#: Rows up to which the list of revisits is broadcast; beyond, records are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of records in one Arrow batch.
BATCH = 16 * 2**20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Archive:
    """Bytes of a plain or gzipped file (any number of members), read in order, inflated as needed."""

    def __init__(self, content: bytes):
        self.raw, self.at = memoryview(content), 0
        self.gz = content[:2] == b"\x1f\x8b"
        self.z = None
        self.buffer, self.place = bytearray(), 0

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at:self.at + 2**16]
        if not self.gz:
            self.buffer += part
            self.at += len(part)
            return True
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.buffer += self.z.decompress(part)
        self.at += len(part) - len(self.z.unused_data)
        if self.z.eof:
            self.z = None
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"archive ends inside a record at {self.place}")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.place += n
        return out

    def line(self) -> bytes | None:
        """The next line with its end; None at the end of the file."""
        seen = 0
        while (i := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                return self.take(len(self.buffer)) if self.buffer else None
        return self.take(i + 1)


def version_block(version: int, name: str, date: str) -> bytes:
    fields = "URL IP-address Archive-date Content-type" + (" Result-code Checksum Location Offset Filename" if version == 2 else "") + " Archive-length"
    body = f"{version} 0 consigna\n{fields}\n".encode()
    middle = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body + b"\n"


def _safe(url: str) -> str:
    return "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url) or "-"


def arc_record(version: int, url: str, date: str, block: bytes, name: str) -> bytes:
    middle = f" 200 {hashlib.sha1(block).hexdigest()} - 0 {name}" if version == 2 else ""
    return f"{_safe(url)} 127.0.0.1 {date} text/html{middle} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000") -> None:
    """pages (page_id, url, html) as ARC files, one for each partition, versions 1 and 2 in turn.

    Null html is empty. The block is an HTTP response; a header of it carries the page id.
    """
    pages = spread(pages.select("page_id", "url", "html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"
        out, held = [member(version_block(version, name, date)) + _EMPTY], 0
        for b in batches:
            for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n"
                head += f"X-Page-Id: {page}\r\n\r\n" if page is not None else "\r\n"
                out.append(member(arc_record(version, url or "", date, head.encode() + payload, name)) + _EMPTY)
                held += len(out[-1])
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _sink(pages.mapInArrow(work, "value binary"), folder)


def _sink(members: DataFrame, folder: str) -> None:
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _TAIL).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def arc_records(content: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(place, header fields, block) of each record of an ARC file, the version block included."""
    a = Archive(content)
    version = None
    while (place := a.place, line := a.line())[1] is not None:
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        text = line.decode("utf-8", "replace")
        if text.startswith("filedesc:"):
            block = a.take(int(text.rpartition(" ")[2]))
            version = int(block[:1])
            yield place, {"url": text.split(" ")[0], "ip": "0.0.0.0", "date": text.split(" ")[2], "type": "text/plain"}, block
            continue
        parts = text.rsplit(" ", 9 if version == 2 or version is None and text.count(" ") >= 9 else 4)
        if len(parts) < 5 or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at {place}: {text[:200]!r}")
        yield place, {"url": parts[0], "ip": parts[1], "date": parts[2], "type": parts[3]}, a.take(int(parts[-1]))


def sha1_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    d = (date + "19700101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*origin: object) -> str:
    """The same identifier for the same origin, so that a task run again writes the same records."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(origin).encode()).digest()[:16], version=5)}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", sha1_field(block)), ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{head}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _convert(files: DataFrame, full: bool) -> DataFrame:
    """A row for each ARC record: file, place, page_id, n, digest; with full also the finished member and,
    for HTTP responses, what a revisit record needs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                name = path.as_py().rpartition("/")[2]
                rows, held = [], 0
                for place, f, block in arc_records(content.as_py()):
                    head, sep, payload = block.partition(b"\r\n\r\n")
                    http = head[:5] == b"HTTP/" and bool(sep) and not f["url"].startswith(("filedesc:", "dns:"))
                    info = f["url"].startswith("filedesc:")
                    page = http_fields(head).get("x-page-id") if http else None
                    digest = hashlib.sha1(payload if http else block)
                    full_member, stub = None, None
                    if full:
                        who = record_id(name, place)
                        base = [("WARC-Type", "warcinfo" if info else "response" if http else "resource"), ("WARC-Record-ID", who), ("WARC-Date", warc_date(f["date"]))]
                        if info:
                            block = b"software: consigna\r\nformat: WARC File Format 1.0\r\nconverted-from: " + f["url"].encode("utf-8", "surrogatepass") + b"\r\n"
                            base += [("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                        else:
                            base += [("WARC-Target-URI", f["url"]), ("WARC-IP-Address", f["ip"]), ("Content-Type", "application/http;msgtype=response" if http else f["type"])]
                            base.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest.digest()).decode()))
                        full_member = member(warc_record(base, block)) + _EMPTY
                        stub = "\n".join(f"{k}: {v}" for k, v in base[1:]).encode("utf-8", "surrogatepass") + b"\0" + head + sep if http else None
                    rows.append((name, place, int(page) if page else None, len(payload) if http else None, digest.hexdigest(), full_member, stub))
                    held += len(full_member or b"") + 200
                    if held >= BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(work, "file string, place long, page_id long, n long, digest string, member binary, stub binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "place", "page_id", "n", "digest", "member", "stub"])


def revisits(index: DataFrame) -> DataFrame:
    """file, place, to_file, to_place, to_page: records whose payload a record with a larger page id has.

    index has file, place, page_id, n, digest. Payloads under REVISIT_BYTES never revisit. Records with
    equal payload and page id: the one latest by file and place is the response. Null ids are smallest.
    Counts and maxima combine before the shuffle; a frequent payload is one row on the right side of the
    join, whose left side adaptive execution can split.
    """
    large = index.where(F.col("n") >= REVISIT_BYTES)
    last = large.groupBy("digest").agg(F.max(F.struct("page_id", "file", "place")).alias("to"), F.count(F.lit(1)).alias("c")).where("c > 1")
    both = large.join(last.select("digest", "to"), "digest")
    return both.where((F.col("file") != F.col("to.file")) | (F.col("place") != F.col("to.place"))).select(
        F.col("file").alias("r_file"), F.col("place").alias("r_place"), F.col("to.file").alias("to_file"), F.col("to.place").alias("to_place"), F.col("to.page_id").alias("to_page"))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str) -> None:
    """All ARC files of a folder as WARC files of another. A damaged archive fails with file and place.

    The first reading keeps ids, sizes and digests only. Records are shuffled in the second only when the
    list of revisits is too large to broadcast. A file is read whole by one task; its size is that of an
    input split.
    """
    files = _files(spark, arc_folder)
    index = staged(_convert(files, False).select("file", "place", "page_id", "n", "digest").where("n IS NOT NULL"), "arc-index")
    again = staged(revisits(index), "arc-revisits")
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    here: Column = (F.col("file") == F.col("r_file")) & (F.col("place") == F.col("r_place"))
    rows = _convert(files, True).join(side, here, "left").select("member", "stub", "to_file", "to_place", "to_page")

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column("to_file").null_count == len(b):
                yield pa.RecordBatch.from_arrays([b.column("member")], ["value"])
                continue
            out = []
            for full, stub, file, place, page in zip(*[b.column(c).to_pylist() for c in b.schema.names], strict=True):
                if file is not None:
                    kept, _, head = stub.partition(b"\0")
                    fields = [("WARC-Type", "revisit"), *[tuple(x.split(": ", 1)) for x in kept.decode("utf-8", "surrogatepass").split("\n")]]
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(file, place))]
                    if page is not None:
                        fields.append(("X-Refers-To-Page", str(page)))
                    full = member(warc_record(fields, head)) + _EMPTY
                out.append(full)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _sink(rows.mapInArrow(seal, "value binary"), warc_folder)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, cut by declared lengths."""
    a = Archive(content)
    while (line := a.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {a.place - len(line)}")
        fields = {}
        while (line := a.line()) is not None and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, a.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the HTTP records of all archives."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for content in b.column("content"):
                rows = []
                for f, block in warc_records(content.as_py()):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = http_fields(head)
                    told = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if f["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != told or size != int(http["content-length"]):
                            raise ValueError(f"payload of {f['warc-record-id']} does not match its header")
                    else:
                        size, digest = int(http["content-length"]), told
                    page, to = http.get("x-page-id"), f.get("x-refers-to-page")
                    rows.append((int(page) if page else None, size, digest, f["warc-type"], int(to) if to else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return _files(spark, folder).mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """pages written as ARC files, converted, and the WARC files read back. Empty input gives no rows."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
