"""SimHash fingerprints and their links by bit-sliced comparison.

Fingerprints that share enough of their bits meet in a bucket.  In a bucket
they are stored as bit planes: word j of a block has bit j of 64 fingerprints.
The distances of one fingerprint to 64 others then grow together in carry-save
counters, a plane at a time; a counter starts so high that it overflows just
when its distance exceeds the radius, and a block is abandoned as soon as all
of its lanes have overflowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, prepare, small
from .graph import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 1 << 15
#: A bucket with more fingerprints is dealt out once more, by further bits that must agree.
HOT_BUCKET = 8192
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: For similar texts: buckets by BANDS keys of ROWS least hashes each meet pairs of similarity 0.8 in all but one of 30,000 cases.
BANDS, ROWS = 20, 4
LIKENESS = 0.8
#: A group of more sets is compared by pivots, over all tasks; of what they leave at most so many hashes go to every task.
HOT_SETS, REST_HASHES = 2000, 4_000_000
#: Differing bits of 64 at which pairs are still compared: 9.7 are expected at a similarity of 0.8, with a deviation of 2.9.
SIMILAR = 22


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are what stands between bytes 0x20 and 0x09 to 0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in pieces; one of the whole sequence if it has fewer words."""
    if not words:
        return
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([digest(line, seed)], dtype=np.uint64)
        return
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    for k in range(0, len(words) - size + 1, _PIECE):
        s, e = starts[k : k + _PIECE][: len(words) - size + 1 - k].tolist(), ends[k + size - 1 : k + size - 1 + _PIECE].tolist()
        yield np.array([digest(line[i:j], seed) for i, j in zip(s, e, strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits, unsigned; a bit is 1 if it is set in over half the hashes; no words: 0."""
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(words_of(text), size):
        total += len(h)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # a byte can count to 255
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: the 64 bits as a signed long) of every row; a null or empty text has 0."""

    prepare(docs.sparkSession)
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- bit planes


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """lanes (blocks, 64) of fingerprints -> planes (64, blocks): bit l of planes[j, k] is bit j of lanes[k, l]."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within(planes: np.ndarray, idle: np.ndarray, queries: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each task (queries[i] against block blocks[i]): tasks with a lane within the radius, and a mask of those lanes.

    idle: for each block the lanes that hold nothing.
    """
    depth = max(1, (radius + 1).bit_length())
    at = np.arange(len(queries))
    over = idle[blocks]
    start = (1 << depth) - 1 - radius
    count = [np.full(len(queries), _ALL if start >> d & 1 else 0, dtype=np.uint64) for d in range(depth)]
    for j in range(64):
        carry = planes[j][blocks] ^ (np.uint64(0) - ((queries >> np.uint64(j)) & np.uint64(1)))
        for d in range(depth):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if j % 8 == 7:
            live = over != _ALL
            if not live.all():
                at, over, queries, blocks, count = at[live], over[live], queries[live], blocks[live], [c[live] for c in count]
                if not len(at):
                    break
    return at, ~over


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _lanes(fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of 64 lanes for consecutive groups: lanes, idle masks, index of each lane's fingerprint, first block and number of blocks by group."""
    blocks = -(-sizes // 64)
    first = np.cumsum(blocks) - blocks
    group = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(fps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = first[group] * 64 + rank
    n = int(blocks.sum())
    lanes, index = np.zeros(n * 64, dtype=np.uint64), np.full(n * 64, -1, dtype=np.int64)
    lanes[slot], index[slot] = fps, np.arange(len(fps))
    idle = np.packbits((index < 0).reshape(n, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return lanes.reshape(n, 64), idle, index, first, blocks


def _set_bits(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit of each bit that is set."""
    return np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def link_groups(fps: np.ndarray, sizes: np.ndarray, radius: int, at_once: int = 1 << 19) -> np.ndarray:
    """The least index each fingerprint reaches by links within its group (consecutive, sizes long)."""
    lanes, idle, index, first, blocks = _lanes(fps, sizes)
    planes = planes_of(lanes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    tasks = blocks[group]
    ends = np.cumsum(tasks)
    root, k = np.arange(len(fps)), 0
    while k < len(fps):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + at_once)))
        who = np.repeat(np.arange(k, stop), tasks[k:stop])
        block = first[group[who]] + np.arange(len(who)) - np.repeat(ends[k:stop] - tasks[k:stop] - (ends[k - 1] if k else 0), tasks[k:stop])
        at, hit = within(planes, idle, fps[who], block, radius)
        row, bit = _set_bits(hit)
        a, b = who[at[row]], index[block[at[row]] * 64 + bit]
        keep = a != b
        # links found so far are only kept as the root of each fingerprint
        root = _roots(len(fps), np.concatenate([a[keep], np.arange(len(fps))]), np.concatenate([b[keep], root]))
        k = stop
    return root


def link_large(fps: np.ndarray, radius: int, at_once: int = 1 << 20) -> np.ndarray:
    """Like link_groups for one large group, over planes that are built once; lanes that need no further comparison hold nothing.

    Where little is found, many are asked for at once, and each leaves the
    planes when it was asked for.  Where much is found, one starts a component
    and what it finds leaves at once, as all of it is linked; it is still asked
    for itself before another component starts, so no link is lost.
    """
    n = len(fps)
    lanes, idle, index, _, blocks = _lanes(fps, np.array([n]))
    planes, slot, count = planes_of(lanes), np.flatnonzero(index >= 0), int(blocks[0])
    waiting, queued, a, b = np.ones(n, dtype=bool), np.zeros(n, dtype=bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    queue, single = np.empty(0, np.int64), 1  # single: so many components more are started one by one

    def leave(which: np.ndarray) -> None:
        which = which[waiting[which]]
        at = slot[which]
        np.bitwise_or.at(idle, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        waiting[which] = False

    while True:
        live = np.flatnonzero(idle != _ALL)
        if len(live) < count // 2:  # blocks that hold nothing are left out
            keep = np.repeat(live * 64, 64) + np.tile(np.arange(64), len(live))
            place = np.full(count * 64, -1, dtype=np.int64)
            place[keep] = np.arange(len(keep))
            planes, idle, index, slot, count = planes[:, live], idle[live], index[keep], place[slot], len(live)
            live = np.arange(count)
        width = int(min(512, max(1, at_once // max(len(live), 1))))
        start = not len(queue)
        if start:
            ask = np.flatnonzero(waiting)[: 1 if single else width]
        else:
            ask, queue = queue[:width], queue[width:]
        if not len(ask) or not len(live):
            break
        at, hit = within(planes, idle, np.repeat(fps[ask], len(live)), np.tile(live, len(ask)), radius)
        if start and not single and int(np.bitwise_count(hit).sum()) > 16 * len(ask):
            single = len(ask)  # asked for again, one by one
            continue
        row, bit = _set_bits(hit)
        found = index[live[at[row] % len(live)] * 64 + bit]
        a.append(ask[at[row] // len(live)])
        b.append(found)
        leave(ask)
        new = np.unique(found)
        new = new[waiting[new] & ~queued[new]]
        queued[new] = True
        queue = np.concatenate([queue, new])
        if single:
            leave(new)
            single -= not len(queue)
    return _roots(n, np.concatenate(a), np.concatenate(b))


def _link_batches(radius: int):
    def flush(k1, k2, fp):
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        fp = fp.view(np.uint64)
        out_a, out_b = [], []
        some = (sizes > 1) & (sizes <= 1024)
        if some.any():
            pick = np.repeat(some, sizes)
            own = fp[pick]
            root = link_groups(own, sizes[some], radius)
            far = root != np.arange(len(own))
            out_a.append(own[far])
            out_b.append(own[root[far]])
        for s, n in zip(starts[sizes > 1024].tolist(), sizes[sizes > 1024].tolist(), strict=True):
            own = fp[s : s + n]
            root = link_large(own, radius)
            far = root != np.arange(n)
            out_a.append(own[far])
            out_b.append(own[root[far]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(3)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1]) + 1 if ((held[0] != held[0][-1]) | (held[1] != held[1][-1])).any() else 0
            if last:
                yield flush(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield flush(*held)

    return run


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of parts of a word of bits."""
    edge = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _key(fp, pieces: list[tuple[int, int]]):
    out, at = F.lit(0).cast("long"), 0
    for shift, width in pieces:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def links(fps: DataFrame, radius: int = 2, parts: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that join just those which links of at most radius differing bits join.

    The 64 bits are cut into parts; two fingerprints within the radius agree on
    some parts - radius of them, so each choice of so many is a bucket key.  A
    bucket of over hot fingerprints is dealt out again by such choices from its
    other bits: with radius 2 and 4 parts 48 bits are then fixed and, as the
    fingerprints differ, none has over 65,536.
    """
    if not 0 <= radius < parts:
        raise ValueError("radius must be under parts")
    pieces = _cuts(64, parts)
    choices = list(combinations(range(parts), parts - radius))
    first = [F.struct(_key(F.col("fp"), [pieces[i] for i in c]).alias("k1"), F.lit(n).alias("t")) for n, c in enumerate(choices)]
    keyed = fps.select("fp", F.explode(F.array(*first)).alias("k")).select("k.k1", "k.t", "fp")
    crowded = cut(keyed.groupBy("k1", "t").count().where(F.col("count") > hot).select(F.col("k1").alias("h1"), F.col("t").alias("ht")))
    n_hot = crowded.count()
    tag = F.col("t").cast("long") - F.lit(len(choices)).cast("long")  # k2 < 0: not dealt out again
    if n_hot:
        keyed = keyed.join(small(crowded, n_hot), (F.col("k1") == F.col("h1")) & (F.col("t") == F.col("ht")), "left")
        again = F.lit(None)
        for n, c in enumerate(choices):
            rest = [p for i in range(parts) if i not in c for p in [(pieces[i][0] + s, w) for s, w in _cuts(pieces[i][1], 2)]]
            subs = list(combinations(range(len(rest)), max(0, len(rest) - radius)))
            keys = F.array(*[_key(F.col("fp"), [rest[i] for i in s]) * F.lit(len(subs) * len(choices)) + F.lit(m * len(choices) + n) for m, s in enumerate(subs)])
            again = F.when(F.col("t") == n, keys).otherwise(again)
        keyed = keyed.select("k1", F.explode(F.when(F.col("h1").isNull(), F.array(tag)).otherwise(again)).alias("k2"), "fp")
    else:
        keyed = keyed.select("k1", tag.alias("k2"), "fp")
    met = keyed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return met.mapInArrow(_link_batches(radius), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    component_id is the least id that a row reaches over fingerprints that
    differ in at most radius bits.  Texts that are null, empty or blank have
    fingerprint 0 and are linked like any other; very long ones are read whole.
    Rows with equal ids each stay; a null id keeps its row, and a component of
    null ids only has a null id.  An empty docs gives no rows; other columns of
    docs, whatever their names, are left out.
    """
    rows = cut(fingerprints(docs, size, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = cut(classes)
    reach = components(links(classes.select("fp"), radius))
    rooted = classes.join(reach, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("of"), "component_id")
    named = rooted.join(lowest, F.col("root") == F.col("of")).select(F.col("fp").alias("own"), "component_id")
    return rows.join(named, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- similar texts


_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the BANDS bands of a set of hashes: ROWS least products each."""
    least = np.full(BANDS * ROWS, _ALL)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k : k + 4096, None] * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def set_of(text: str | None, size: int) -> tuple[np.ndarray, int]:
    """The set of a text's shingle hashes, sorted, and a hash of the set."""
    parts = list(shingle_hashes(words_of(text), size))
    h = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
    return h, xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def print_of(h: np.ndarray) -> int:
    """Signed fingerprint of a set of hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 255):
        ones += np.unpackbits(h[k : k + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, own, fp, bands) of every row: a hash and the fingerprint of its set of shingles, and its bands; a text without words has none."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            own, fps, bands = [], [], []
            for t in b.column(1):
                h, digest = set_of(t.as_py(), size)
                fps.append(print_of(h))
                own.append(digest)
                bands.append(band_keys(h).view(np.int64) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip((own, fps, bands), schema.types[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, own long, fp long, bands array<long>")


def alike(a: np.ndarray, b: np.ndarray, likeness: float = LIKENESS) -> bool:
    """Whether two sorted sets have a Jaccard similarity of likeness or more."""
    if min(len(a), len(b)) < likeness * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= likeness * (len(both) - common) - 1e-9


def link_sets(sets: list[np.ndarray], fps: np.ndarray, radius: int, likeness: float = LIKENESS) -> np.ndarray:
    """The index of the first set that each set reaches by pairs within the radius whose Jaccard similarity is likeness or more.

    What is linked isn't asked for again, so a dense group costs little.
    """
    root, sizes, left = np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)), np.arange(len(sets))
    while len(left):
        seed, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            n = sizes[left]
            near = (np.bitwise_count(fps[left] ^ fps[k]) <= radius) & (np.minimum(n, sizes[k]) >= likeness * np.maximum(n, sizes[k]))
            found = np.zeros(len(left), bool)
            for i in np.flatnonzero(near).tolist():
                found[i] = alike(sets[k], sets[left[i]], likeness)
            root[left[found]] = seed
            queue += left[found].tolist()
            left = left[~found]
    return root


def _verify(size: int, radius: int):
    """Rows (root, own, text) ordered by root -> links (a, b) of own in each group of one root; a text of another own is left out."""

    def links_of(group: dict[int, np.ndarray]):
        own = np.array(list(group), dtype=np.int64)
        sets = list(group.values())
        first = link_sets(sets, np.array([print_of(h) for h in sets], dtype=np.int64).view(np.uint64), radius)
        far = first != np.arange(len(own))
        return pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(own[first[far]])], names=["a", "b"])

    def run(batches):
        at, group = None, {}
        for batch in batches:
            for root, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if root != at:
                    if len(group) > 1:
                        yield links_of(group)
                    at, group = root, {}
                if own not in group:
                    h, digest = set_of(text.as_py(), size)
                    if digest == own:
                        group[own] = h
        if len(group) > 1:
            yield links_of(group)

    return run


def _member_sets(texts: DataFrame, size: int) -> DataFrame:
    """Rows (root, own, text) -> (root, own, hashes); a text of another own is left out."""

    def run(batches):
        for b in batches:
            rows = [(r, o, set_of(t.as_py(), size)) for r, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
            rows = [(r, o, h.view(np.int64)) for r, o, (h, digest) in rows if digest == o]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c,
                t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["root", "own", "hashes"])

    return texts.mapInArrow(run, "root long, own long, hashes array<long>").dropDuplicates(["root", "own"])


def _with_pivots(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Links (a, b) of members (root, own, hashes) with the pivot (root, own, hashes) of their group."""

    def run(batches):
        for b in batches:
            own, pivot = b.column(0).to_pylist(), b.column(1).to_pylist()
            hit = [k for k in range(b.num_rows) if alike(np.asarray(b.column(2)[k].values), np.asarray(b.column(3)[k].values))]
            yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in hit], pa.int64()), pa.array([pivot[k] for k in hit], pa.int64())], names=["a", "b"])

    p = pivots.select(F.col("root").alias("p_root"), F.col("own").alias("p_own"), F.col("hashes").alias("p_hashes"))
    met = members.join(small(p, limit=1000), F.col("root") == F.col("p_root")).select("own", "p_own", "hashes", "p_hashes")
    return met.mapInArrow(run, "a long, b long")


def _with_rest(members: DataFrame, rest: DataFrame) -> DataFrame:
    """Links (a, b) of members with the rest (root, own, hashes) of their group: few sets, which go to every task."""
    known: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in rest.toLocalIterator():
        known.setdefault(r.root, []).append((r.own, np.array(r.hashes, dtype=np.int64)))

    def run(batches):
        for b in batches:
            out = []
            for root, own, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                mine = np.asarray(h.values)
                out += [(own, other) for other, x in known.get(root, ()) if other != own and alike(mine, x)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _link_hot(texts: DataFrame, size: int) -> DataFrame:
    """Links (a, b) that join what pairs of a similarity of LIKENESS or more join, in large groups: rows (root, own, text).

    A pivot of each group is compared with all its members, over all tasks; what
    is like it is of one component.  What is left is compared with all members
    too, so every pair is decided but those within the pivot's component.  A
    group of which too much is left, as it holds several large families, is
    compared in its own task.
    """
    members = cut(_member_sets(texts, size))
    pivots = cut(members.groupBy("root").agg(F.min("own").alias("own")).join(members, ["root", "own"]))
    star = cut(_with_pivots(members, pivots))
    left = cut(members.join(star.select(F.col("a").alias("own")), "own", "left_anti").select("root", "own", F.size("hashes").alias("n")))
    sizes = left.groupBy("root").agg(F.sum("n").alias("n"))
    families = cut(sizes.where(F.col("n") > REST_HASHES // 10).select(F.col("root").alias("wide")))
    rest = left.join(small(families), F.col("root") == F.col("wide"), "left_anti")
    if rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] > REST_HASHES:
        families, rest = cut(sizes.select(F.col("root").alias("wide"))), None
    whole = texts.join(small(families), F.col("root") == F.col("wide"), "left_semi").repartition("root").sortWithinPartitions("root")
    links = star.union(whole.mapInArrow(_verify(size, SIMILAR), "a long, b long"))
    return links if rest is None else links.union(_with_rest(members, rest.select("root", "own").join(members, ["root", "own"])))


def similar_groups(docs: DataFrame, size: int = 5, radius: int = SIMILAR) -> DataFrame:
    """(doc_id, component_id) of every row: texts whose shingle sets have a Jaccard similarity of LIKENESS or more are linked.

    Equal sets are one class.  Classes meet in buckets by their bands and are
    grouped by bit-sliced comparison of their fingerprints, with a radius that
    is wide for the similarity; a crowded bucket is one group without comparison,
    so that no task holds it.  One text of each class of a group goes to the
    group's task, where pairs are compared by their whole sets; large groups are
    compared by pivots in all tasks.  component_id is the least id reached.
    Texts without words are one class.
    """
    rows = cut(shingle_sets(docs, size))
    classes = cut(rows.groupBy("own", "fp").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")))
    keyed = classes.select("fp", F.posexplode("bands").alias("k2", "k1")).select("k1", F.col("k2").cast("long").alias("k2"), "fp").distinct()
    crowd = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")).where("n > 1").select(F.col("k1").alias("m1"),
        F.col("k2").alias("m2"), "n", "first")
    met = keyed.join(crowd, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))).select("k1", "k2", "fp", "n", "first")
    few = met.where(F.col("n") <= HOT_BUCKET).select("k1", "k2", "fp").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    edges = few.mapInArrow(_link_batches(radius), "a long, b long").union(met.where(F.col("n") > HOT_BUCKET).select(F.col("fp").alias("a"), F.col("first").alias("b")))
    reach = components(edges)
    rooted = classes.select("own", "fp", "least").join(reach, F.col("fp") == F.col("node"), "left").select("own", "least", F.coalesce("root", "fp").alias("root"))
    shared = rooted.groupBy("root").count().where("count > 1").select(F.col("root").alias("of"))
    asked = cut(rooted.join(small(shared), F.col("root") == F.col("of")).select("root", "own", F.col("least").alias("rep")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(asked), F.col("doc_id").eqNullSafe(F.col("rep"))).select("root", "own", "text")
    hot = cut(asked.groupBy("root").count().where(F.col("count") > HOT_SETS).select(F.col("root").alias("hot")))
    pairs = texts.join(small(hot), F.col("root") == F.col("hot"), "left_anti").repartition("root").sortWithinPartitions("root").mapInArrow(_verify(size, radius), "a long, b long")
    if not hot.isEmpty():
        pairs = pairs.union(_link_hot(texts.join(small(hot), F.col("root") == F.col("hot"), "left_semi"), size))
    same = components(pairs)
    named = classes.select("own", "least").join(same, F.col("own") == F.col("node"), "left").select("own", "least", "root")
    lowest = named.where("root is not null").groupBy("root").agg(F.min("least").alias("lowest")).select(F.col("root").alias("of"), "lowest")
    ends = named.join(small(lowest), F.col("root") == F.col("of"), "left").select(F.col("own").alias("set"), F.coalesce("lowest", "least").alias("component_id"))
    return rows.select("doc_id", "own").join(ends, F.col("own") == F.col("set")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = 5, radius: int = SIMILAR) -> DataFrame:
    """docs with one document of each group of similar_groups: that of the least doc_id.  Rows with a null doc_id stay; rows that repeat an id stay together."""
    name = free_name(docs, "_gone_id")
    gone = cut(similar_groups(docs, size, radius).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small(gone), F.col("doc_id") == F.col(name), "left_anti")
