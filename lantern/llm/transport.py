"""MPEG transport streams as columns: a multiplexer, a demultiplexer, and a table of streams with their timestamps and random-access points.

A stream is 188-byte packets: a program association and a program map table,
repeated at every random-access point, and one elementary stream in PES packets
with presentation times.  The demultiplexer takes any such stream: it finds the
programs by their tables, checks their CRCs and the continuity counters, puts
the elementary packets together again and lists access units with their times.

Streams are a binary column beside arrays of the access units' times and of the
random-access points' places, written as Parquet, so a reader can take a part
of a stream from the last random-access point before a time.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_dir

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, NULL_PID = 0, 0x100, 0x101, 0x1FFF
#: Stream type 6 (private data in PES packets) and its stream id: the samples are bytes.
PRIVATE_TYPE, PRIVATE_ID = 6, 0xBD
#: Samples are padded to a multiple of GRAIN; an access unit has UNIT of them, the last of a stream what is left.
GRAIN, UNIT = 192, 1536
#: Ticks of the 90 kHz clock from unit to unit, and units from one random-access point to the next.
TICKS, ACCESS = 3600, 8
_CLOCK = 1 << 33


# ---------------------------------------------------------------- tables


@functools.cache
def _crc_steps() -> list[int]:
    """CRC-32/MPEG-2 of each byte, by its rule: polynomial 0x04C11DB7, not reflected."""
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


@functools.lru_cache(4096)
def crc_mpeg(data: bytes) -> int:
    """0 for a section with a right CRC at its end."""
    c, steps = 0xFFFFFFFF, _crc_steps()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ steps[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc_mpeg(head))


@functools.lru_cache(256)
def program_map(section: bytes) -> tuple[tuple[int, int], ...]:
    """(type, PID) of a program's elementary streams."""
    at, end, out = 12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF), len(section) - 4, []
    while at + 5 <= end:
        kind, pid, info = struct.unpack_from(">BHH", section, at)
        out.append((kind, pid & 0x1FFF))
        at += 5 + (info & 0xFFF)
    return tuple(out)


@functools.lru_cache(256)
def program_association(section: bytes) -> tuple[tuple[int, int], ...]:
    """(program, PID of its map); program 0 is the network's and left out."""
    pairs = (struct.unpack_from(">HH", section, k) for k in range(8, len(section) - 4, 4))
    return tuple((n, pid & 0x1FFF) for n, pid in pairs if n)


# ---------------------------------------------------------------- multiplexer


@functools.cache
def _layout(size: int, access: bool) -> tuple[np.ndarray, np.ndarray]:
    """An access unit of size bytes as packets: their bytes without times, counters and samples, and where the samples go."""
    pes = struct.pack(">3sBHBBB", b"\0\0\1", PRIVATE_ID, size + 8, 0x84, 0x80, 5) + bytes(5)
    packets, places, done = [], [], 0
    while done < size:
        first = not done
        # the first packet has the clock and the random-access mark in its adaptation field; the last one is filled up there
        control = bytes([0x50 if access else 0x10]) + bytes(6) if first else b""
        head = pes if first else b""
        room = PACKET - 4 - len(head) - (1 + len(control) if first else 0)
        take = min(room, size - done)
        fill = room - take
        if fill and not first:
            control, fill = (b"", fill - 1) if fill == 1 else (b"\0", fill - 2)
        field_ = control + b"\xff" * fill
        adapted = first or take < room
        raw = struct.pack(">BHB", SYNC, (0x4000 if first else 0) | STREAM_PID, 0x30 if adapted else 0x10)
        raw += (bytes([len(field_)]) + field_ if adapted else b"") + head
        places.append(np.arange(take) + len(packets) * PACKET + len(raw))
        packets.append(raw + bytes(take))
        done += take
    flat = np.frombuffer(b"".join(packets), np.uint8)
    assert len(flat) == len(packets) * PACKET
    return flat, np.concatenate(places)


def _time_bytes(pts: np.ndarray) -> np.ndarray:
    """The five bytes of presentation times."""
    return np.stack([0x21 | pts >> 29 & 0xE, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE], 1).astype(np.uint8)


def _clock_bytes(pts: np.ndarray) -> np.ndarray:
    """The six bytes of clock references without extension."""
    return np.stack([pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF, (pts & 1) << 7 | 0x7E, pts * 0], 1).astype(np.uint8)


def _units(samples: np.ndarray, first: int, count: int, size: int) -> list[np.ndarray]:
    """Packets of count access units of the given size from number first on."""
    out: list[np.ndarray] = [None] * count
    number = np.arange(first, first + count)
    for access in (True, False):
        own = np.flatnonzero((number % ACCESS == 0) == access)
        if len(own):
            flat, places = _layout(size, access)
            block = np.tile(flat, (len(own), 1))
            block[:, places] = samples.reshape(count, size)[own]
            pts = (number[own] + 1) * TICKS % _CLOCK
            block[:, 6:12] = _clock_bytes(pts)
            block[:, 21:26] = _time_bytes(pts)
            for k, row in zip(own.tolist(), block, strict=True):
                out[k] = row
    return out


def padded(raw: bytes) -> bytes:
    """raw with spaces up to a positive multiple of GRAIN."""
    return raw + b" " * (-len(raw) % GRAIN or (0 if raw else GRAIN))


@functools.cache
def _tables() -> np.ndarray:
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_TYPE, 0xE000 | STREAM_PID, 0xF000))
    packets = (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + s for pid, s in ((PAT_PID, pat), (PMT_PID, pmt)))
    return np.frombuffer(b"".join(p + b"\xff" * (PACKET - len(p)) for p in packets), np.uint8)


def multiplex(payload: bytes) -> tuple[bytes, list[int], list[int]]:
    """(stream, times of its access units, byte offsets of its random-access points) of a payload of a positive multiple of GRAIN bytes."""
    samples = np.frombuffer(payload, np.uint8)
    whole, rest = divmod(len(samples), UNIT)
    units = _units(samples[: whole * UNIT], 0, whole, UNIT) + (_units(samples[whole * UNIT :], whole, 1, rest) if rest else [])
    parts, points, at = [], [], 0
    for k, unit in enumerate(units):
        if k % ACCESS == 0:
            points.append(at)
            parts.append(_tables())
            at += 2 * PACKET
        parts.append(unit)
        at += len(unit)
    stream = np.concatenate(parts).reshape(-1, PACKET)
    pids = (stream[:, 1].astype(np.int64) & 0x1F) << 8 | stream[:, 2]
    for pid in (PAT_PID, PMT_PID, STREAM_PID):
        own = np.flatnonzero(pids == pid)
        stream[own, 3] |= (np.arange(len(own)) & 15).astype(np.uint8)
    return stream.tobytes(), [(k + 1) * TICKS % _CLOCK for k in range(len(units))], points


# ---------------------------------------------------------------- demultiplexer


@dataclass
class Elementary:
    """One elementary stream: a tuple (time or None, decoding time or None, random access, offset in the stream's bytes, size) a PES packet."""

    program: int
    kind: int
    pid: int
    units: list[tuple] = field(default_factory=list)
    data: bytes = b""


@dataclass
class Demultiplexed:
    packets: int
    lost_sync: int  # packets without the sync byte
    damaged: int  # packets marked as in error or scrambled, and sections with a wrong CRC
    discontinuities: int  # jumps of a continuity counter that aren't announced
    duplicates: int  # packets that repeat the one before, counter and all
    streams: list[Elementary]


def _time(raw: bytes, at: int) -> int:
    a, b, c = struct.unpack_from(">BHH", raw, at)
    return (a >> 1 & 7) << 30 | b >> 1 << 15 | c >> 1


def _sections(data: bytes, starts: list[int]) -> list[bytes]:
    """Whole sections in a PID's payload; starts: where packets with a pointer begin.  What lies before the place that a pointer names ends the section before."""
    out = []
    for at, end in zip(starts, [*starts[1:], len(data)], strict=False):
        chunk = data[at + 1 + data[at] : end]
        if end < len(data):
            chunk += data[end + 1 : end + 1 + data[end]]
        k = 0
        while k + 3 <= len(chunk) and chunk[k] != 0xFF:
            size = 3 + (struct.unpack_from(">H", chunk, k + 1)[0] & 0xFFF)
            if k + size <= len(chunk):
                out.append(chunk[k : k + size])
            k += size
    return out


def demultiplex(stream: bytes) -> Demultiplexed:
    """Every program's elementary streams.  A tail shorter than a packet is left out; packets without sync, in error or scrambled are counted and left out, so that what they held is missing from their units."""
    packets = np.frombuffer(stream, np.uint8, len(stream) // PACKET * PACKET).reshape(-1, PACKET)
    n = len(packets)
    good = packets[:, 0] == SYNC
    lost = n - int(good.sum())
    broken = good & ((packets[:, 1] & 0x80 != 0) | (packets[:, 3] & 0xC0 != 0))
    packets = packets[good & ~broken]
    damaged = int(broken.sum())
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    control = packets[:, 3]
    length = np.where(control & 0x20, packets[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(length > 1, packets[:, 5], 0)
    begin = np.where(control & 0x10, np.minimum(4 + length, PACKET), PACKET)
    keep = np.ones(len(packets), bool)
    jumps = duplicates = 0
    members: dict[int, np.ndarray] = {}
    for pid in np.unique(pids).tolist():
        if pid == NULL_PID:
            continue
        own = np.flatnonzero(pids == pid)
        count, carries, new = control[own] & 15, control[own] & 0x10 != 0, flags[own] & 0x80 != 0
        if len(own) > 1:
            step = count[1:] - count[:-1] & 15
            same = (step == 0) & carries[1:] & carries[:-1] & ~new[1:]
            if same.any():
                at = np.flatnonzero(same)
                # the clock may differ in a repeated packet, so only what follows the adaptation field is compared
                for k in at.tolist():
                    if packets[own[k + 1], begin[own[k + 1]] :].tobytes() != packets[own[k], begin[own[k]] :].tobytes():
                        same[k] = False
                duplicates += int(same.sum())
                keep[own[1:][same]] = False
            jumps += int(((step != carries[1:]) & ~same & ~new[1:]).sum())
        members[pid] = own[keep[own] & carries]

    def payload(pid: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of a PID, where its packets begin in them, and the packets."""
        own = members.get(pid, np.zeros(0, np.int64))
        inside = np.arange(PACKET) >= begin[own][:, None]
        return packets[own][inside].tobytes(), np.cumsum(PACKET - begin[own]) - (PACKET - begin[own]), own

    def sections(pid: int, table_id: int) -> list[bytes]:
        nonlocal damaged
        data, at, own = payload(pid)
        found = [s for s in _sections(data, [k for k in at[packets[own, 1] & 0x40 != 0].tolist() if k < len(data)]) if s[:1] == bytes([table_id])]
        right = [s for s in found if len(s) >= 12 and crc_mpeg(s) == 0]
        damaged += len(found) - len(right)
        return list(dict.fromkeys(right))

    streams: dict[int, Elementary] = {}
    for association in sections(PAT_PID, 0):
        for program, pid in program_association(association):
            for section in sections(pid, 2):
                if struct.unpack_from(">H", section, 3)[0] == program:
                    for kind, own in program_map(section):
                        streams.setdefault(own, Elementary(program, kind, own))
    for s in streams.values():
        data, at, own = payload(s.pid)
        first = np.flatnonzero(packets[own, 1] & 0x40)
        parts, size = [], 0
        ends = [*at[first[1:]].tolist(), len(data)]
        for k, start, end in zip(first.tolist(), at[first].tolist(), ends, strict=False):
            if data[start : start + 3] != b"\0\0\1" or end - start < 9:
                damaged += 1
                continue
            length_, marks, head = struct.unpack_from(">HxBB", data, start + 4)
            pts = _time(data, start + 9) if marks & 0x80 and head >= 5 else None
            dts = _time(data, start + 14) if marks & 0xC0 == 0xC0 and head >= 10 else pts
            body = data[start + 9 + head : min(end, start + 6 + length_) if length_ else end]
            s.units.append((pts, dts, bool(flags[own[k]] & 0x40), size, len(body)))
            parts.append(body)
            size += len(body)
        s.data = b"".join(parts)
    return Demultiplexed(n, lost, damaged, jumps, duplicates, list(streams.values()))


def feature(found: Demultiplexed) -> str:
    """Counts, times and random-access points of a stream's first program stream, as text."""
    head = f"packets={found.packets} lost={found.lost_sync} damaged={found.damaged} jumps={found.discontinuities} repeats={found.duplicates}"
    for s in found.streams[:1]:
        times = [u[0] for u in s.units if u[0] is not None]
        points = [u[3] for u in s.units if u[2]]
        head += f" program={s.program} type={s.kind} pid={s.pid} units={len(s.units)} pts={min(times, default=0)}..{max(times, default=0)} points={len(points)} last_point={points[-1] if points else 0}"
    return head


# ---------------------------------------------------------------- tables of streams


def stored(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as a table of streams under path: (id, n_bytes, media, times, points), written as Parquet and read back.

    A null text counts as empty, and an empty text is one grain of spaces; a
    null id stays null and rows that repeat are kept.  Other columns of docs,
    whatever their names, aren't written.  An empty docs gives an empty table.
    The files are the caller's.
    """

    def run(batches):
        names = ["n_bytes", "media", "times", "points"]
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            rows = [(len(raw), *multiplex(padded(raw))) for raw in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *names])

    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    streams = source.mapInArrow(run, "id long, n_bytes long, media binary, times array<long>, points array<long>")
    streams.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def units(streams: DataFrame, media: str = "media") -> DataFrame:
    """(id, program, pid, unit, pts, dts, random_access, data): every access unit of a table of streams (id, media); a null media has none."""
    schema = "id long, program int, pid int, unit int, pts long, dts long, random_access boolean, data binary"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches):
        for b in batches:
            for i, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [(i, s.program, s.pid, k, u[0], u[1], u[2], s.data[u[3] : u[3] + u[4]]) for s in demultiplex(raw or b"").streams for k, u in enumerate(s.units)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                    names=[x.split()[0] for x in schema.split(", ")])

    return streams.select("id", media).mapInArrow(run, schema)


def clips(streams: DataFrame, start: int, end: int) -> DataFrame:
    """units() of access units with start <= pts < end; of each stream only the part from the last random-access point before start is parsed."""
    n = F.size(F.filter("times", lambda t: t <= start))  # times rise, and points are every ACCESS units
    at = F.element_at("points", F.greatest(F.lit(1), F.ceil(n / F.lit(ACCESS)).cast("int")))
    past = F.ceil(F.size(F.filter("times", lambda t: t < end)) / F.lit(ACCESS)).cast("int") + 1
    stop = F.coalesce(F.get("points", past - 1), F.octet_length("media").cast("long"))
    part = F.substring("media", (at + 1).cast("int"), (stop - at).cast("int"))
    return units(streams.select("id", part.alias("media"))).where((F.col("pts") >= start) & (F.col("pts") < end))


def features(streams: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of a table of streams, from the stored bytes."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for i, n, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = demultiplex(media)
                data = b"".join(s.data for s in found.streams)
                rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return streams.select("id", "n_bytes", "media").mapInArrow(run, schema)


def folder(spark: SparkSession) -> str:
    """A new folder for a table of streams where driver and executors share one."""
    return f"{shared_dir(spark).rstrip('/')}/streams-{uuid.uuid4().hex}"
