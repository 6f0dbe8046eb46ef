"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

A package holds a stored member archive/data.warc.gz (each record a gzip member
of its own) and a stored index indexes/index.cdxj with the offset and length of
each record in that member.  The reader finds the central directory from the
package's tail (ZIP64 too), takes from it where the members' bytes lie, reads
the index and then only the ranges of records.

Packages are written by tasks to a shared folder under names that no other
attempt uses; only those that a finished task reports are read back, so lost
executors and retries leave the result whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, prepare, shared_dir

#: Shorter payloads are always stored in full.
LEAST_REVISIT = 1000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_RECORD_ID = "urn:lantern:page:"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
_RECORDS = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- packages


class ZipWriter:
    """Writes stored members one after the other to a stream that can't seek."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # bit 3: checksum and sizes follow the data; bit 11: UTF-8 names
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Returns where in the member the data begins."""
        m = self.members[-1]
        start = m[3]
        m[2], m[3] = zlib.crc32(data, m[2]), m[3] + len(data)
        self._put(data)
        return start

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sI2Q", b"PK\7\x08", crc, size, size))

    def close(self) -> None:
        begin = self.at
        for raw, offset, crc, size in self.members:
            wide = self.zip64 or size >= _MAX32 or offset >= _MAX32
            extra = struct.pack("<2H3Q", 1, 24, size, size, offset) if wide else b""
            n, o = (_MAX32, _MAX32) if wide else (size, offset)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x808, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, count = self.at - begin, len(self.members)
        if self.zip64 or begin >= _MAX32 or size >= _MAX32 or count >= _MAX16:
            end64 = self.at
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, begin))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end64, 1))
            count, size, begin = _MAX16, _MAX32, _MAX32
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, count, count, size, begin, 0))


def directory(read_at, total: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of its local header, size, method), from the central directory; read_at(offset, length) reads a range."""
    tail_at = max(0, total - _MAX16 - 22 - 20)
    tail = read_at(tail_at, total - tail_at)
    k = tail.rfind(b"PK\5\6")
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, size, begin = struct.unpack_from("<H2I", tail, k + 10)
    if count == _MAX16 or size == _MAX32 or begin == _MAX32:
        sign, _, end64, _ = struct.unpack("<4sIQI", read_at(tail_at + k - 20, 20))
        if sign == b"PK\6\7":
            head = read_at(end64, 56)
            if head[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, size, begin = struct.unpack_from("<3Q", head, 32)
    data, at, out = read_at(begin, size), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, (packed, plain), (n, m, c), offset = struct.unpack_from("<H", data, at + 10)[0], struct.unpack_from("<2I", data,
            at + 20), struct.unpack_from("<3H", data, at + 28), struct.unpack_from("<I", data, at + 42)[0]
        name, extra = data[at + 46 : at + 46 + n].decode("utf-8"), data[at + 46 + n : at + 46 + n + m]
        e = 0
        while e + 4 <= len(extra):
            tag, length = struct.unpack_from("<2H", extra, e)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                offset = next(wide) if offset == _MAX32 else offset
            e += 4 + length
        out[name] = (offset, packed, method)
        at += 46 + n + m + c
    return out


def data_start(read_at, offset: int) -> int:
    head = read_at(offset, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header where the central directory points")
    n, m = struct.unpack_from("<2H", head, 26)
    return offset + 30 + n + m


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the record of refers_to: the HTTP head then keeps the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    own = "" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_RECORD_ID}{own}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_RECORD_ID}{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    said = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    number = lambda x: int(v) if (v := x.strip("<>").removeprefix(_RECORD_ID)) else None
    url = fields.get("warc-target-uri")
    response = fields["warc-type"] == "response"
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if response and (len(body) != said or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError("a payload doesn't match its record's length or digest")
    return {
        "page_id": number(fields["warc-record-id"]), "url": url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"), "record_type": fields["warc-type"],
        "payload_digest": digest, "refers_to": None if response else number(fields["warc-refers-to"]), "payload_bytes": said, "payload": body if response else None,
    }


# ---------------------------------------------------------------- Spark


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the largest page_id of the payload's copies, null for that page itself and for payloads under least bytes."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    copies = cut(copies.where("n > 1").select(F.col("digest").alias("of"), "holder"))
    n = copies.count()
    joined = rows.join(F.broadcast(copies) if n <= BROADCAST_ROWS // 4 else copies, F.col("digest") == F.col("of"), "left")
    revisit = (F.col("holder").isNotNull()) & ~F.col("holder").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("holder")).alias("refers_to"))


def write_packages(rows: DataFrame, folder: str, roll: int = 256 << 20, zip64: bool = False) -> DataFrame:
    """Writes what mark_revisits returns; (path, records, bytes) of each package, checkpointed.  A package is closed once it has roll bytes."""

    prepare(rows.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        zipped = stream = None
        index, done = [], []

        def close():
            zipped.end()
            zipped.begin(INDEX)
            zipped.write("".join(index).encode())
            zipped.end()
            zipped.close()
            stream.close()
            done.append((path, len(index), zipped.at))
            index.clear()

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if zipped is None:
                    name = f"part-{uuid.uuid4().hex}.zip"
                    path = folder.rstrip("/") + "/" + name
                    stream = fs.open_output_stream(base.rstrip("/") + "/" + name)
                    zipped = ZipWriter(stream, zip64)
                    zipped.begin(ARCHIVE)
                packed = gzip.compress(record(page_id, url, payload, digest, refers_to), 5, mtime=0)
                index.append(json.dumps({"page_id": page_id, "offset": zipped.write(packed), "length": len(packed), "digest": digest}) + "\n")
                if zipped.at >= roll:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


def _reader(path: str):
    fs, own = open_fs(path)
    source = fs.open_input_file(own)

    def read_at(offset: int, length: int) -> bytes:
        data = source.read_at(length, offset)
        if len(data) != length:
            raise ValueError("a range goes beyond the package")
        return data

    return source, read_at


def record_ranges(packages: DataFrame, span: int = 4 << 20) -> DataFrame:
    """(path, start, length, cuts): spans of records in a package, of about span bytes; cuts are the records' lengths."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("cuts", pa.list_(pa.int64()))])
        for b in batches:
            for path in b.column(0).to_pylist():
                source, read_at = _reader(path)
                with source:
                    members = directory(read_at, source.size())
                    offset, size, method = members[INDEX]
                    base, _, stored = members[ARCHIVE]
                    if method or stored:
                        raise ValueError("members must be stored, not deflated")
                    base = data_start(read_at, base)
                    lines = read_at(data_start(read_at, offset), size).splitlines()
                spans, cuts, start, total = [], [], None, 0
                for x in map(json.loads, lines):
                    start = x["offset"] if start is None else start
                    cuts.append(x["length"])
                    total += x["length"]
                    if total >= span:
                        spans.append((start, cuts))
                        cuts, start, total = [], None, 0
                if cuts:
                    spans.append((start, cuts))
                yield pa.RecordBatch.from_pydict({"path": [path] * len(spans), "start": [base + s for s, _ in spans],
                    "length": [sum(c) for _, c in spans], "cuts": [c for _, c in spans]}, schema=schema)

    return packages.select("path").mapInArrow(run, "path string, start long, length long, cuts array<long>")


def read_packages(packages: DataFrame, span: int = 16 << 20) -> DataFrame:
    """Every record of the packages (path, and bytes if known, for about span bytes a task): page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload (null for revisits)."""

    prepare(packages.sparkSession)
    def run(batches):
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for b in batches:
            for path, start, length, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                source, read_at = _reader(path)
                with source:
                    data = read_at(start, length)
                rows, at = [], 0
                for n in cuts:
                    rows.append(parse(gzip.decompress(data[at : at + n])))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ranges = record_ranges(packages)
    tasks = packages.sparkSession.sparkContext.defaultParallelism
    if "bytes" in packages.columns:
        tasks = max(tasks, (packages.agg(F.sum("bytes")).first()[0] or 0) // span)
    spread = ranges.repartition(tasks, "path", "start")  # a given number: the rows are few, what they stand for isn't
    return spread.mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages (page_id, url, html) written as WARC packages and read back; a row per page.

    A null html is an empty payload, a null url stays null, rows that repeat
    page_id and html are all responses, and an empty pages gives no packages
    and no rows.  Other columns of pages are left out.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_packages(write_packages(mark_revisits(pages), folder))
