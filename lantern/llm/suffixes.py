"""Removal of repeated byte strings with suffix arrays by linear grouping.

The texts' bytes are cut at anchors: substrings of K bytes whose least inner
run of S bytes stands at an edge (closed syncmers).  An anchor depends on its
own bytes alone and every string of LENGTH bytes holds one, so two occurrences
of a string have the same anchors in it.  Each start of a string belongs to
the first anchor in it.  An anchor, or a pair of neighbouring anchors at their
distance, that occurs once in the corpus can't lie in a repeated string; what
is left are segments: an anchor's starts and the bytes of their strings.

Equal segments are counted.  A segment that occurs more than once is repeated
at every start.  One that occurs once is compared with the other segments of
its anchor: the suffix array of all that agree with another on enough bytes
around the anchor is built, and strings that are equal on LENGTH bytes stand
side by side in it; as half of these bytes are on one side, only segments that
share that half with another are sent there at all.  Where the segments of an anchor hold
too many bytes for one suffix array, they are dealt out: strings whose starts
lie within a few bytes of each other, seen from the anchor, share the bytes
that all of them cover, so those that share these meet in a suffix array of
their own; and so on with fewer starts, down to one.

The suffix array is built in two linear phases.  First, groups of suffixes,
from the highest down, hand their order on: for each suffix the pointer to the
previous smaller suffix is found, and the suffixes pointed at move to groups
above their own, by how many of the group point at them; in the end the groups
are those of equal Lyndon prefixes.  Then, from the least suffix up, each
suffix sends those that end their Lyndon prefix before it to their group's
front.  No names are given and nothing is sorted again.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

LENGTH, S = 200, 8
K = (LENGTH + S) // 2
#: Repeated hashes up to which they go to every task (8 bytes each); beyond, a filter of EACH bits a hash goes, and of BITS at most: what it lets through beside them is only more to compare.
KNOWN = 3_000_000
EACH, BITS, SLICES = 12, 1 << 29, 64
#: Numbers in all verdicts (two for a segment's key and its ranges' ends) up to which they go to every task; beyond, segments are joined with theirs.
VERDICTS = 6_000_000
#: Bytes of distinct segments that one suffix array takes (its lists hold some 100 times as many); those of an anchor with more are dealt out by DEALS, numbers of starts.
CROWD = 1 << 18
DEALS = (49, 12, 1)
#: Anchors that occur more often are hot: their segments are dealt out by their keys, not by the anchor, and then as those of a crowd are.  At most so many are.
HOT_ANCHOR, HOT_ANCHORS, SALTS = 50_000, 1_000_000, 256
#: Bytes of distinct segments that a task holds before it sends them on.
HELD = 12 << 20
#: Distinct segments whose keys a task holds before it sends them on.
SEEN = 100_000
_BLOCK = 1 << 18


# ---------------------------------------------------------------- suffix arrays


def _numbers(values, n: int):
    """A list, or for large n an array: lists are faster, arrays need a tenth of the memory."""
    return list(values) if n < 1 << 15 else array("i", values)


def suffix_array(data: bytes) -> list[int] | array:
    """The starts of the suffixes of data in ascending order, in linear time."""
    n = len(data)
    if n < 2:
        return list(range(n))
    # groups, in ascending order as a doubly linked list; group 0 is below all
    letters = sorted(set(data))
    of_letter = {c: g for g, c in enumerate(letters, 1)}
    group = _numbers([of_letter[c] for c in data], n)
    members: list[list[int]] = [[] for _ in range(len(letters) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    below = _numbers(range(-1, len(letters)), n)
    above = _numbers([*range(1, len(letters) + 1), -1], n)
    size = _numbers(map(len, members), n)
    previous, done = _numbers([-1], n) * n, bytearray(n)
    g = len(letters)
    while g > 0:
        own, members[g] = members[g], ()  # not asked for again
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        if len(own) == 1:
            i = own[0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0 and size[group[p]] > 1:
                old = group[p]
                new = len(members)
                members.append([p])
                size.append(1)
                size[old] -= 1
                group[p] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
            g = below[g]
            continue
        for i in own:
            done[i] = 1
        own.sort()
        count: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        by: dict[tuple[int, int], list[int]] = {}
        for p, k in count.items():
            key = (-k, group[p])
            if key in by:
                by[key].append(p)
            else:
                by[key] = [p]
        for key in sorted(by) if len(by) > 1 else by:
            level, old = by[key], key[1]
            if len(level) == size[old]:
                continue  # the whole group moves: its order among groups stays
            new = len(members)
            members.append(level)
            size.append(len(level))
            size[old] -= len(level)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for p in level:
                group[p] = new
        g = below[g]
    front, at, g = _numbers([0], n) * len(members), 0, above[0]
    while g >= 0:
        front[g] = at
        at += size[g]
        g = above[g]
    out, placed = _numbers([0], n) * n, bytearray(n)
    i = n - 1  # the end of data is the least suffix: its predecessors go first
    while i >= 0 and not placed[i]:
        out[front[group[i]]] = i
        front[group[i]] += 1
        placed[i] = 1
        i = previous[i]
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            placed[i] = 1
            i = previous[i]
    return out


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """For each segment the starts in it whose string of length bytes also starts elsewhere in the segments, in order."""
    data = b"\0".join(segments)
    base, bounds = [], []
    at = 0
    for s in segments:
        base.append(at)
        bounds.append(at + len(s) - length)
        at += len(s) + 1
    owner = np.full(len(data), -1, dtype=np.int32)
    for k, (a, b) in enumerate(zip(base, bounds, strict=True)):
        owner[a : b + 1] = k
    order = np.array(suffix_array(data), dtype=np.int32)
    hit = set()
    before, string = -1, None
    for i in order[owner[order] >= 0].tolist():
        now = data[i : i + length]
        if now == string:
            hit.add(before)
            hit.add(i)
        before, string = i, now
    out: list[list[int]] = [[] for _ in segments]
    for i in sorted(hit):
        out[owner[i]].append(i - base[owner[i]])
    return out


def _agreeing(leads: list[int], bodies: list[bytes]) -> list[tuple[int, int, int]]:
    """(index, begin, end) of an anchor's segments that may hold a string of another of them, and the part of each that does: both have its bytes around the anchor, LENGTH - K in all.

    The first anchor in a string is the same wherever the string stands, so
    equal strings of two segments lie alike to it.
    """
    more, half = LENGTH - K, (LENGTH - K) // 2
    before = [b[max(0, x - more) : x] for x, b in zip(leads, bodies, strict=True)]
    after = [b[x + K : x + K + more] for x, b in zip(leads, bodies, strict=True)]
    n = len(bodies)
    if n > 8:  # half of the bytes are on one side
        seen: dict[tuple[int, bytes], int] = {}
        sides = [[(0, x[-half:])] * (len(x) >= half) + [(1, y[:half])] * (len(y) >= half) for x, y in zip(before, after, strict=True)]
        for side in sides:
            for key in side:
                seen[key] = seen.get(key, 0) + 1
        return [(k, 0, len(bodies[k])) for k, side in enumerate(sides) if any(seen[key] > 1 for key in side)]
    # a number's low bytes are those next to the anchor; how many agree shows in the lowest bit of the difference
    left, right = [int.from_bytes(x, "big") for x in before], [int.from_bytes(y, "little") for y in after]
    wide: list[tuple[int, int] | None] = [None] * n
    for i in range(1, n):
        for j in range(i):
            x, y = left[i] ^ left[j], right[i] ^ right[j]
            a = min(len(before[i]), len(before[j]), ((x & -x).bit_length() - 1) // 8 if x else more)
            b = min(len(after[i]), len(after[j]), ((y & -y).bit_length() - 1) // 8 if y else more)
            if a + b >= more:
                for k in (i, j):
                    have = wide[k]
                    wide[k] = (a, b) if have is None else (max(a, have[0]), max(b, have[1]))
    return [(k, leads[k] - w[0], leads[k] + K + w[1]) for k, w in enumerate(wide) if w]


# ---------------------------------------------------------------- anchors


class Batch:
    """Anchors of some texts, side by side: at and ends are places in data."""

    def __init__(self, texts: list[bytes]):
        self.data = data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        found = [np.empty(0, np.int64)]
        for b in range(0, len(data) - K + 1, _BLOCK):
            part = data[b : b + _BLOCK + K - 1]
            eight = np.ndarray((len(part) - S + 1,), "<u8", part, 0, (1,))
            runs = ((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
            width, least, done = K - S + 1, runs, 1
            while done * 2 <= width:
                least = np.minimum(least[:-done], least[done:])
                done *= 2
            if done < width:
                least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
            found.append(b + np.flatnonzero((runs[: len(least)] == least) | (runs[width - 1 :] == least)))
        at = np.concatenate(found)
        text = np.searchsorted(self.ends, at, side="right")
        inside = at + K <= self.ends[text] if len(at) else np.empty(0, bool)
        self.at, self.text = at[inside], text[inside]
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.array([digest(data[p : p + K]) for p in self.at.tolist()], dtype=np.uint64)
        self.paired = self.text[1:] == self.text[:-1]

    def pairs(self) -> np.ndarray:
        """A hash of each two neighbouring anchors at their distance (where paired)."""
        h = (self.hashes[:-1] * np.uint64(0x9FB21C651E98DF25)) ^ (self.hashes[1:] + np.uint64(0x632BE59BD9B4E019) * np.diff(self.at).astype(np.uint64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))

    def segments(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, anchor hash, begin, end and the anchor's place in it of each segment; known: the sorted hashes of repeated anchors and pairs."""
        at, n = self.at, len(self.at)
        if not n:
            return self.text, self.hashes, at, at, at
        whole = np.append(self.paired & _in(known, self.pairs()), False)  # an anchor and the next may be in one string
        stop = np.minimum.accumulate(np.where(whole, n, np.arange(n))[::-1])[::-1] + 1  # the first anchor that no string may reach
        last, next_ = self.ends[self.text], np.minimum(stop, n - 1)
        wall = np.where((stop < n) & (self.text[next_] == self.text), at[next_] + K - 1, last)
        end = np.minimum(np.minimum(at + LENGTH, wall), last)
        before = np.append(-1, np.where(self.paired, at[:-1], -1)) + 1
        begin = np.maximum(np.maximum(before, self.starts[self.text]), at - (LENGTH - K))
        keep = (end - begin >= LENGTH) & _in(known, self.hashes)
        return self.text[keep], self.hashes[keep], begin[keep], end[keep], (at - begin)[keep]

    def keys(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray) -> list[bytes]:
        """128 bits for each segment's anchor, the anchor's place and the bytes."""
        digest, data = xxhash.xxh3_128_digest, self.data
        seeds = h + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return [digest(data[x:y], seed=g) for g, x, y in zip(seeds.tolist(), begin.tolist(), end.tolist(), strict=True)]


def _halves(keys: list[bytes]) -> np.ndarray:
    """128-bit keys as rows of two longs."""
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def _places(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each hash in its slice of width bits."""
    return x & np.uint64(width - 1), (x >> np.uint64(29)) & np.uint64(width - 1)


def _in(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are known: sorted hashes, or the bytes of a filter, which also has some others."""
    if not len(known):
        return np.zeros(len(x), bool)
    if known.dtype != np.uint8:
        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
    width, out = len(known) * 8 // SLICES, np.ones(len(x), bool)
    for place in _places(x, width):
        at = (x >> np.uint64(58)) * np.uint64(width) + place
        out &= (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def _batches(column: pa.Array, size: int = 1 << 19):
    """(index of the first text, Batch) for each size bytes of a column."""
    held, total, first = [], 0, 0
    for k, x in enumerate(column):
        held.append(x.as_py())
        total += len(held[-1])
        if total >= size:
            yield first, Batch(held)
            held, total, first = [], 0, k + 1
    if held:
        yield first, Batch(held)


# ---------------------------------------------------------------- Spark


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(h, n): hashes of the anchors and pairs that occur more than once, and how often."""

    def run(batches):
        for b in batches:
            for _, t in _batches(b.column(0)):
                if len(t.at):
                    h, n = np.unique(np.concatenate([t.hashes, t.pairs()[t.paired]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([_long(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    return rows.select("data").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def hot_anchors(repeated: DataFrame) -> np.ndarray:
    """The sorted hashes of anchors that occur more than HOT_ANCHOR times; of so many that they don't go to every task, those that occur most."""
    hot = repeated.where(F.col("n") > HOT_ANCHOR).orderBy(F.desc("n"), "h").limit(HOT_ANCHORS)
    return np.sort(_unsigned(hot, "h"))


def _unsigned(df: DataFrame, column: str) -> np.ndarray:
    return np.asarray(df.select(column).toArrow().column(0), dtype=np.int64).view(np.uint64)


def _knowing(hashes: DataFrame) -> Broadcast:
    """The hashes (h) for every task, once a worker: sorted, or where they are many as a filter that tasks make slice by slice."""
    n, context = hashes.count(), hashes.sparkSession.sparkContext
    if n <= KNOWN:
        return context.broadcast(np.sort(_unsigned(hashes, "h")))
    width = min(BITS, max(1 << 16, 1 << (EACH * n - 1).bit_length())) // SLICES

    def run(batches):
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            own = (x >> np.uint64(58)).astype(np.int32)
            for s in np.unique(own).tolist():
                bits = slices.setdefault(s, np.zeros(width, bool))
                for place in _places(x[own == s], width):
                    bits[place] = True
        for s, bits in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    dealt = hashes.select("h").repartition(SLICES, F.shiftrightunsigned("h", 58))
    known = np.zeros(SLICES * width // 8, np.uint8)
    for s, bits in dealt.mapInArrow(run, "slice int, bits binary").toLocalIterator():
        known[s * width // 8 : (s + 1) * width // 8] = np.frombuffer(bits, np.uint8)
    return context.broadcast(known)


def _found(b, known: Broadcast):
    """(index of the first row, Batch, its segments) of a batch of (doc_id, data)."""
    for first, t in _batches(b.column(1)):
        yield first, t, t.segments(known.value)


def _sides(data: bytes, h: int, begin: int, end: int, lead: int) -> tuple[int | None, int | None]:
    """Hashes of an anchor with half of LENGTH - K bytes before it, and after it, that lie in its segment: two segments with an equal string share one."""
    half, at, digest = (LENGTH - K) // 2, begin + lead, xxhash.xxh3_64_intdigest
    return (digest(data[at - half : at], seed=h) if lead >= half else None,
        digest(data[at + K : at + K + half], seed=h ^ 0x9E3779B97F4A7C15) if end - at - K >= half else None)


def _keyed(rows: DataFrame, known: Broadcast) -> DataFrame:
    """(k1, k2, n, a, b): each segment, how often it occurs and its _sides."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def sent(seen):
        keys, (n, a, b) = _halves(list(seen)), zip(*seen.values(), strict=True)
        sides = [pa.array([x if x is None else x - (x >> 63 << 64) for x in side], pa.int64()) for side in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n), *sides], schema=schema)

    def run(batches):
        seen: dict[bytes, list] = {}
        for b in batches:
            for _, t, (_, h, begin, end, lead) in _found(b, known):
                for key, g, x, y, at in zip(t.keys(h, begin, end, lead), h.tolist(), begin.tolist(), end.tolist(), lead.tolist(), strict=True):
                    got = seen.get(key)
                    if got is not None:
                        got[0] += 1
                    else:
                        seen[key] = [1, *_sides(t.data, g, x, y, at)]
                if len(seen) >= SEEN:
                    yield sent(seen)
                    seen = {}
        if seen:
            yield sent(seen)

    each = rows.mapInArrow(run, "k1 long, k2 long, n long, a long, b long")
    return each.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))


def shared_sides(keyed: DataFrame) -> DataFrame:
    """(h): the _sides that several segments share, one of which occurs once."""
    sides = keyed.select("n", F.explode(F.array("a", "b")).alias("h")).where("h is not null")
    return sides.groupBy("h").agg(F.count(F.lit(1)).alias("of"), F.min("n").alias("least")).where("of > 1 and least = 1").select("h")


_PARTS = "h long, k1 long, k2 long, n long, lead long, body binary"
_SAID = "crowd int, k1 long, k2 long, n long, lead long, body binary, covered array<long>"
_KEY = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("lead", pa.int64()), ("body", pa.binary())])


def _returned():
    """Gives memory that a task held back to the system, for the worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


class _Held:
    """Distinct segments of a task: anchor hash, count, lead and bytes by key."""

    def __init__(self):
        self.rows: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, key: bytes, h: int, n: int, lead: int, body: bytes) -> None:
        got = self.rows.get(key)
        if got is not None:
            got[1] += n
        else:
            self.rows[key] = [h, n, lead, body]
            self.bytes += len(body)

    def sent(self) -> pa.RecordBatch:
        keys, (h, n, lead, body) = _halves(list(self.rows)), zip(*self.rows.values(), strict=True)
        batch = pa.RecordBatch.from_arrays([_long(np.array(h, np.uint64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n), pa.array(lead),
            pa.array(body, pa.binary())], schema=_KEY)
        self.rows, self.bytes = {}, 0
        return batch


def _distinct_segments(rows: DataFrame, known: Broadcast, sides: Broadcast) -> DataFrame:
    """(h, k1, k2, n, lead, body): each task's distinct segments with one of sides, how often they occur in it and where the anchor is in them."""

    def run(batches):
        held = _Held()
        for b in batches:
            for _, t, (_, h, begin, end, lead) in _found(b, known):
                data = t.data
                both = [_sides(data, *x) for x in zip(h.tolist(), begin.tolist(), end.tolist(), lead.tolist(), strict=True)]
                open_ = np.zeros(len(h), bool)
                for side in zip(*both, strict=True):
                    given = np.array([x is not None for x in side])
                    open_[given] |= _in(sides.value, np.array([x for x in side if x is not None], np.uint64))
                h, begin, end, lead = h[open_], begin[open_], end[open_], lead[open_]
                for key, g, x, y, a in zip(t.keys(h, begin, end, lead), h.tolist(), begin.tolist(), end.tolist(), lead.tolist(), strict=True):
                    held.add(key, g, 1, a, data[x:y])
                if held.bytes >= HELD:
                    yield held.sent()
        if held.rows:
            yield held.sent()
        _returned()

    return rows.mapInArrow(run, _PARTS)


def _occurrences(rows: DataFrame, known: Broadcast) -> DataFrame:
    """(doc_id, of, k1, k2, begin, size) of each segment; of: a hash of the text, which tells rows of one doc_id apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("begin", pa.int32()), ("size", pa.int32())])

    def run(batches):
        for b in batches:
            for first, t, (text, h, begin, end, lead) in _found(b, known):
                of = np.array([xxhash.xxh32_intdigest(t.data[x:y]) for x, y in zip(t.starts.tolist(), t.ends.tolist(), strict=True)], np.uint32).view(np.int32)
                keys = _halves(t.keys(h, begin, end, lead))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text + first)), pa.array(of[text]), pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]), pa.array((begin - t.starts[text]).astype(np.int32)), pa.array((end - begin).astype(np.int32))], schema=schema)

    return rows.mapInArrow(run, "doc_id long, of int, k1 long, k2 long, begin int, size int")


def _runs(starts: list[int]) -> list[int]:
    """Covered ranges, begin and end in turn, of strings at ascending starts."""
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = s + LENGTH
        else:
            out += [s, s + LENGTH]
    return out


def _settled(parts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Tasks' segments by anchor -> (crowd, k1, k2, n, lead, body, covered).

    crowd 0: the verdict on a segment, with the ranges that its repeated
    strings cover, null for all of it.  crowd 1: segments of an anchor that has
    more than CROWD bytes of them, or is hot, sent on as they are; so no task
    holds more, and none gets all of a hot anchor's.
    """
    schema = pa.schema([("crowd", pa.int32()), *[_KEY.field(i) for i in range(1, 6)], ("covered", pa.list_(pa.int64()))])

    def run(batches):
        held: list[list] = []
        out: list[tuple] = []
        anchor, crowd, total, waiting = None, False, 0, 0

        def settle():
            nonlocal waiting
            if crowd:
                out.extend((1, a, b, n, lead, body, None) for (a, b), n, lead, body in held)
                waiting += total
            else:
                out.extend((0, a, b, None, None, None, None) for (a, b), n, _, _ in held if n > 1)
                if len(held) > 1 and any(n == 1 for _, n, _, _ in held):
                    own = _agreeing([x for _, _, x, _ in held], [body for _, _, _, body in held])
                    starts = repeated_starts([held[k][3][x:y] for k, x, y in own]) if own else []
                    for (k, x, _), at in zip(own, starts, strict=True):
                        (a, b), n, _, _ = held[k]
                        if n == 1 and at:
                            out.append((0, a, b, None, None, None, _runs([x + i for i in at])))
            held.clear()

        def sent():
            nonlocal waiting
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
            waiting = 0
            return batch

        for b in batches:
            salts = b.column(6).to_pylist() if b.num_columns > 6 else [-1] * b.num_rows
            for h, k1, k2, n, lead, body, salt in zip(*(c.to_pylist() for c in b.columns[:6]), salts, strict=True):
                if (h, salt) != anchor:
                    settle()
                    anchor, crowd, total = (h, salt), salt >= 0, 0
                if held and held[-1][0] == (k1, k2):
                    held[-1][1] += n
                    continue
                if total >= CROWD:
                    crowd = True
                    settle()
                    total = 0
                held.append([(k1, k2), n, lead, body])
                total += len(body)
                if len(out) >= 5000 or waiting >= 1 << 20:
                    yield sent()
        settle()
        if out:
            yield sent()
        _returned()

    if not len(hot):
        return parts.repartition("h").sortWithinPartitions("h", "k1", "k2").mapInArrow(run, _SAID)
    own = parts.sparkSession.createDataFrame([(int(x),) for x in hot.view(np.int64)], "hot long")
    flagged = parts.join(F.broadcast(own), F.col("h") == F.col("hot"), "left")
    salted = flagged.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod("k1", F.lit(SALTS)).cast("int")).otherwise(-1))
    met = salted.repartition("h", "salt").sortWithinPartitions("h", "salt", "k1", "k2")
    return met.select("h", "k1", "k2", "n", "lead", "body", "salt").mapInArrow(run, _SAID)


def deals(lead: int, body: bytes, width: int):
    """(group, begin, end, lead) of the parts of a segment with up to width starts each; strings in parts of one group agree on the bytes that all of its starts' strings cover."""
    most = len(body) - LENGTH
    for j in range(max(lead - most, 0) // width, lead // width + 1):
        low, high = max(0, lead - (j + 1) * width + 1), min(most, lead - j * width)
        if low <= high:
            group = xxhash.xxh3_64_intdigest(body[lead - j * width : lead - (j + 1) * width + 1 + LENGTH], seed=j)
            yield group, low, high + LENGTH, lead - low


def _part_key(group: int, lead: int, body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body, seed=(group + lead * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)


def _dealt(own: DataFrame, width: int) -> DataFrame:
    """The parts of segments own (k1, k2, n, lead, body), distinct in each task: columns as of _distinct_segments, h is the group."""

    def run(batches):
        held = _Held()
        for b in batches:
            for n, lead, body in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                for group, x, y, at in deals(lead, body, width):
                    part = body[x:y]
                    held.add(_part_key(group, at, part), group, n, at, part)
                if held.bytes >= HELD:
                    yield held.sent()
        if held.rows:
            yield held.sent()

    return own.mapInArrow(run, _PARTS)


def _parts_of(own: DataFrame, width: int) -> DataFrame:
    """(k1, k2, p1, p2, begin, size): where each part of a segment lies in it."""
    names = ["k1", "k2", "p1", "p2", "begin", "size"]

    def run(batches):
        for b in batches:
            for row in range(0, b.num_rows, 4096):
                out: list[tuple] = []
                keys: list[bytes] = []
                for k1, k2, _, lead, body in zip(*(c.slice(row, 4096).to_pylist() for c in b.columns), strict=True):
                    for group, x, y, at in deals(lead, body, width):
                        keys.append(_part_key(group, at, body[x:y]))
                        out.append((k1, k2, x, y - x))
                if out:
                    p, (k1, k2, begin, size) = _halves(keys), zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k1, k2, p[:, 0], p[:, 1], begin, size)], names=names)

    return own.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _same(a: str, b: str, c: str, d: str):
    return (F.col(a) == F.col(c)) & (F.col(b) == F.col(d))


def _verdicts(parts: DataFrame, widths: tuple[int, ...], hot: np.ndarray) -> DataFrame:
    """(k1, k2, covered) of tasks' segments; those of anchors with too many bytes are dealt out by the first of widths."""
    if not widths:  # parts of one start are strings: what occurs twice is repeated
        return cut(parts.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where("n > 1").select("k1", "k2", F.lit(None).cast("array<bigint>").alias("covered")))
    settled = cut(_settled(parts, hot))
    said, crowds = settled.where("crowd = 0").select("k1", "k2", "covered"), settled.where("crowd = 1")
    if crowds.isEmpty():
        return said
    own = cut(crowds.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.first("lead").alias("lead"), F.first("body").alias("body")))
    often = own.where("n > 1").select("k1", "k2", F.lit(None).cast("array<bigint>").alias("covered"))
    inner = _verdicts(_dealt(own, widths[0]), widths[1:], hot[:0]).select(F.col("k1").alias("v1"), F.col("k2").alias("v2"), F.col("covered").alias("inner"))
    hits = _parts_of(own.where("n = 1"), widths[0]).join(inner, _same("p1", "p2", "v1", "v2"))
    ranges = F.when(F.col("inner").isNull(), F.array("begin", F.col("begin") + F.col("size"))).otherwise(F.transform("inner", lambda x: x + F.col("begin")))
    gathered = hits.select("k1", "k2", ranges.alias("r")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("r")).alias("covered"))
    return cut(said.union(often).union(gathered))


def verdicts(rows: DataFrame, known: Broadcast, hot: np.ndarray) -> DataFrame:
    """(k1, k2, covered): the segments with repeated strings and the ranges these cover, which may overlap; null: all of it."""
    keyed = cut(_keyed(rows, known))
    often = keyed.where("n > 1").select("k1", "k2", F.lit(None).cast("array<bigint>").alias("covered"))
    sides = cut(shared_sides(keyed))
    if sides.isEmpty():
        return often
    return often.union(_verdicts(_distinct_segments(rows, known, _knowing(sides)), DEALS, hot).where("covered is not null"))


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _schema(texts: bool) -> str:
    return _OUT + ", kept binary" if texts else _OUT


def _without(ids: pa.Array, data: bytes, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, texts: bool) -> pa.RecordBatch:
    """The rows of texts data[starts:ends] without the bytes of ranges begin:end."""
    change = np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    gone = np.cumsum(change)[:-1] > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    opens[starts[starts < len(data)]] = gone[starts[starts < len(data)]]
    removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
    kept = [left[x:y] for x, y in zip((starts - removed[starts]).tolist(), (ends - removed[ends]).tolist(), strict=True)]
    cols = [pa.array(ends - starts), pa.array(removed[ends] - removed[starts]), pa.array(spans[ends] - spans[starts]),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
    if texts:
        cols.append(pa.array(kept, pa.binary()))
    return pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols) + 1])


def _by_lookup(rows: DataFrame, known: Broadcast, said: DataFrame, texts: bool) -> DataFrame:
    """The result where all verdicts fit into every task: no text is shuffled."""
    table = said.orderBy("k1").toArrow()  # sorted by the executors
    low, high = (np.asarray(table.column(c)) for c in ("k1", "k2"))
    ranges = table.column("covered").combine_chunks()
    count = np.asarray(ranges.value_lengths().fill_null(0)) // 2
    edge = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)  # a segment without ranges is repeated as a whole
    values = np.asarray(ranges.flatten()).astype(np.int16).reshape(-1, 2)
    shared = rows.sparkSession.sparkContext.broadcast((low, high, edge, values))
    del table, ranges, count, low, high, edge, values

    def run(batches):
        low, high, edge, values = shared.value
        for b in batches:
            for k, t, (_, h, begin, end, lead) in _found(b, known):
                mine = _halves(t.keys(h, begin, end, lead))
                at = np.minimum(np.searchsorted(low, mine[:, 0]), max(len(low) - 1, 0))
                hit = (low[at] == mine[:, 0]) & (high[at] == mine[:, 1]) if len(low) else np.zeros(len(mine), bool)
                begin, end, at = begin[hit], end[hit], at[hit]
                n = (edge[at + 1] - edge[at]).astype(np.int64)
                full = n == 0
                n, first = n[~full], edge[at[~full]].astype(np.int64)
                which = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                base = np.repeat(begin[~full], n)
                yield _without(b.column(0).slice(k, len(t.ends)), t.data, t.starts, t.ends, np.concatenate([begin[full], base + values[which, 0]]),
                    np.concatenate([end[full], base + values[which, 1]]), texts)

    return rows.mapInArrow(run, _schema(texts))


def _by_join(rows: DataFrame, known: Broadcast, said: DataFrame, texts: bool) -> DataFrame:
    """The result by joins: each segment with its verdict, each text with its ranges."""
    hits = _occurrences(rows, known).join(said.withColumnsRenamed({"k1": "v1", "k2": "v2"}), _same("k1", "k2", "v1", "v2"))
    begin, size = F.col("begin").cast("long"), F.col("size").cast("long")
    hits = hits.select("doc_id", "of", F.when(F.col("covered").isNull(), F.array(begin, begin + size)).otherwise(F.transform("covered", lambda x: x + begin)).alias("r"))
    found = hits.groupBy("doc_id", "of").agg(F.flatten(F.collect_list("r")).alias("ranges")).select(F.col("doc_id").alias("c_doc"), F.col("of").alias("c_of"), "ranges")

    def packed(batches):
        for b in batches:
            data = b.column(1).to_pylist()
            own = np.array([xxhash.xxh32_intdigest(x) for x in data], np.uint32).view(np.int32)
            size = pa.array([len(x) for x in data], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array([pa.compress(x, "zstd", asbytes=True) for x in data], pa.binary()), pa.array(own)], names=["doc_id", "size", "data", "of"])

    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("of") == F.col("c_of"))
    joined = rows.mapInArrow(packed, "doc_id long, size int, data binary, of int").join(found, same, "left").select("doc_id", "size", "data", "ranges")

    def run(batches):
        for b in batches:
            sizes, first = b.column(1).to_pylist(), 0
            while first < b.num_rows:
                last, total = first, 0
                while last < b.num_rows and total < 1 << 19:
                    total, last = total + sizes[last], last + 1
                data, ranges = (b.column(c).slice(first, last - first) for c in (2, 3))
                ends = np.cumsum(sizes[first:last])
                starts = ends - sizes[first:last]
                own = np.repeat(starts, ranges.value_lengths().fill_null(0).to_numpy()) + ranges.flatten().to_numpy()
                joint = b"".join(pa.decompress(x, n, "zstd", asbytes=True) if n else b"" for x, n in zip(data.to_pylist(), sizes[first:last], strict=True))
                yield _without(b.column(0).slice(first, last - first), joint, starts, ends, own[::2], own[1::2], texts)
                first = last

    return joined.mapInArrow(run, _schema(texts))


def deduplicate(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row: its bytes without those of strings of LENGTH bytes that also start elsewhere.

    A null text is empty; texts under LENGTH bytes stay whole; all copies lose
    what repeats, rows with equal ids and texts too.  kept is binary, as cuts
    may fall within a character; without texts it is left out.  Very long texts
    are one row; other columns of docs are left out.
    """
    prepare(docs.sparkSession)
    repeated = cut(repeated_anchors(_rows(docs)))
    rows, known = _rows(docs), _knowing(repeated)
    said = cut(verdicts(rows, known, hot_anchors(repeated)))
    if said.agg(F.coalesce(F.sum(2 + F.coalesce(F.size("covered"), F.lit(0))), F.lit(0))).first()[0] <= VERDICTS:
        return _by_lookup(rows, known, said, texts)
    return _by_join(rows, known, said, texts)
