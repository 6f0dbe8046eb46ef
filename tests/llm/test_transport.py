"""Transport streams: exact round trips, a plain byte-wise demultiplexer, damaged streams, tables and the query."""

import hashlib
import random
import struct
import zlib

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import queries as Q  # noqa: E402
from lantern.llm import transport as T  # noqa: E402


def plain(stream):
    """(payload, [(pts, random access)], [PIDs in order], continuity holds): one byte after the other, for streams with one program."""
    pes, current, counters, holds, pids, pmt_pid, es_pid = [], None, {}, True, [], None, None
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid, k, access = (p[1] & 31) * 256 + p[2], 4, False
        pids.append(pid)
        if p[3] & 0x20:
            access = p[4] > 0 and bool(p[5] & 0x40)
            k += 1 + p[4]
        if pid in counters and p[3] & 15 != (counters[pid] + 1) % 16:
            holds = False
        counters[pid] = p[3] & 15
        if pid == 0:
            pmt_pid = (p[k + 1 + 10] & 31) * 256 + p[k + 1 + 11]
        elif pid == pmt_pid:
            es_pid = (p[k + 1 + 13] & 31) * 256 + p[k + 1 + 14]
        elif pid == es_pid:
            if p[1] & 0x40:
                current = [access, b""]
                pes.append(current)
            current[1] += p[k:]
    out, times = b"", []
    for access, b in pes:
        assert b[:4] == b"\x00\x00\x01\xbd" and int.from_bytes(b[4:6]) == len(b) - 6
        t = b[9:14]
        assert t[0] & 1 and t[2] & 1 and t[4] & 1
        times.append((((t[0] >> 1) & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1, access))
        out += b[9 + b[8] :]
    return out, times, pids, holds


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1344, 1536, 1537, 3072, 12288, 12480, 100_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = T.padded(raw)
    assert len(payload) % 192 == 0 and len(payload) - max(n, 1) < 192 and payload == raw + b" " * (len(payload) - n)
    stream, times, points = T.multiplex(payload)
    data, found, pids, holds = plain(stream)
    assert data == payload and holds and [t for t, _ in found] == times == [(k + 1) * 3600 for k in range(len(times))]
    assert [a for _, a in found] == [k % 8 == 0 for k in range(len(times))]
    assert points == [188 * k for k, pid in enumerate(pids) if pid == 0]
    d = T.demultiplex(stream)
    (s,) = d.streams
    assert (d.packets, d.lost_sync, d.damaged, d.discontinuities, d.duplicates) == (len(pids), 0, 0, 0, 0)
    assert s.data == payload and [(u[0], u[2]) for u in s.units] == found and (s.program, s.kind, s.pid) == (1, 6, 0x101)


def packets(stream):
    return [stream[k : k + 188] for k in range(0, len(stream), 188)]


def test_damage():
    payload = T.padded(bytes(range(256)) * 40)
    whole = packets(T.multiplex(payload)[0])
    media = [k for k, p in enumerate(whole) if (p[1] & 31) * 256 + p[2] == 0x101]
    lost = T.demultiplex(b"".join(whole[: media[5]] + whole[media[6] :]))
    assert lost.discontinuities == 1 and len(lost.streams[0].data) == len(payload) - 184
    twice = T.demultiplex(b"".join(whole[: media[5] + 1] + whole[media[5] :]))
    assert twice.duplicates == 1 and twice.discontinuities == 0 and twice.streams[0].data == payload
    bad = bytearray(whole[1])
    bad[14] ^= 1
    assert T.demultiplex(b"".join([whole[0], bytes(bad), *whole[2:9]])).damaged == 1
    sync = T.demultiplex(b"".join([*whole, b"\0" * 188, b"\x47tail"]))
    assert sync.lost_sync == 1 and sync.streams[0].data == payload
    error = bytearray(whole[media[5]])
    error[1] |= 0x80
    marked = T.demultiplex(b"".join([*whole[: media[5]], bytes(error), *whole[media[5] + 1 :]]))
    assert marked.damaged == 1 and marked.discontinuities == 1
    nothing = T.demultiplex(b"")
    assert nothing.streams == [] and nothing.packets == 0
    cut = T.demultiplex(b"".join(whole[3:]))  # from the middle of a group on: no program is known before the next tables
    assert cut.streams == [] or cut.streams[0].units


def test_two_programs_and_a_section_over_packets():
    """Two programs, tables whose sections span packets, a unit without times, one with both, null packets."""
    pat = T._section(0, 1, b"".join(struct.pack(">HH", n, 0xE000 | pid) for n, pid in [(0, 0x10), (7, 0x200), (8, 0x300)]))
    maps = {n: T._section(2, n, struct.pack(">HH", 0xE000 | es, 0xF000) + b"".join(struct.pack(">BHH", 6, 0xE000 | e, 0xF000 | 60) + bytes(60) for e in (es, es + 1, es + 2)))
        for n, es in ((7, 0x210), (8, 0x310))}
    assert len(maps[7]) > 183

    def pack(pid, body, count, begins=True):
        out = b""
        while body or begins:
            room, stuffed = 184, b""
            take = min(room, len(body))
            if take < room:
                fill = room - take
                stuffed = bytes([fill - 1]) + (b"\0" + b"\xff" * (fill - 2) if fill > 1 else b"")
            out += struct.pack(">BHB", 0x47, (0x4000 if begins else 0) | pid, (0x30 if stuffed else 0x10) | count % 16) + stuffed + body[:take]
            body, begins, count = body[take:], False, count + 1
        return out

    def pes(body, times):
        coded = b"".join(bytes([m << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1]) for m, t in times)
        return b"\0\0\1\xbd" + struct.pack(">HBBB", len(body) + 3 + len(coded), 0x80, (0, 0x80, 0xC0)[len(times)], len(coded)) + coded + body

    stream = pack(0, b"\0" + pat, 0) + pack(0x200, b"\0" + maps[7], 0) + pack(0x300, b"\0" + maps[8], 0) + pack(0x1FFF, b"x", 3)
    stream += pack(0x210, pes(b"a" * 500, []), 14) + pack(0x310, pes(b"b" * 300, [(3, (1 << 33) - 1), (1, 5)]), 0) + pack(0x210, pes(b"c", [(2, 77)]), 17)
    d = T.demultiplex(stream)
    by = {s.pid: s for s in d.streams}
    assert set(by) == {0x210, 0x211, 0x212, 0x310, 0x311, 0x312} and (d.damaged, d.discontinuities) == (0, 0)
    assert by[0x210].data == b"a" * 500 + b"c" and by[0x210].units == [(None, None, False, 0, 500), (77, 77, False, 500, 1)]
    assert by[0x310].units == [((1 << 33) - 1, 5, False, 0, 300)] and (by[0x310].program, by[0x210].program) == (8, 7)


TEXTS = ["", None, "a", "é" * 500, "x" * 200_000, "same", "same", "\x00퟿\U0001f600", " " * 192]


def test_table(spark, tmp_path):
    docs = spark.createDataFrame([(k if k != 6 else None, t, "m", "p") for k, t in enumerate(TEXTS)] + [(0, "", "m", "p")] * 2, "doc_id long, text string, media string, id string")
    streams = T.stored(docs, f"file://{tmp_path}/t")
    got = T.features(streams).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[6 if r.id is None else r.id] or ""
        payload = T.padded(text.encode())
        stream = T.multiplex(payload)[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest())
    assert len({r.feature for r in got if r.id in (0, 1)}) == 1
    long = streams.where("id = 4")
    every = {r.unit: r for r in T.units(long).collect()}
    assert b"".join(bytes(every[k].data) for k in sorted(every)) == T.padded(b"x" * 200_000)
    for start, end in ((0, 1), (3600, 3601), (40_000, 90_000), (28_801, 28_802), (400_000, 1 << 33), (90_000, 40_000)):
        part = T.clips(long, start, end).collect()
        assert sorted(r.pts for r in part) == [r.pts for _, r in sorted(every.items()) if start <= r.pts < end]
    assert T.features(T.stored(docs.limit(0), f"file://{tmp_path}/e")).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = Q.op12_media_columns(spark, d)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"),
        ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        want[r.doc_id] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    rows = got.collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == want and len(rows) == len(want)
    assert all(" lost=0 damaged=0 jumps=0 repeats=0 " in r.feature for r in rows)
