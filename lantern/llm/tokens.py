"""Words of many texts at once, as numpy arrays.

A word is a run of letters or a run of digits (with . or , between digits);
bytes over 0x7F count as letters.  Each has a 64-bit hash of its lower-cased
UTF-8 bytes.  Texts are handled whole, about CHUNK bytes of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
LETTER, DIGIT = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x80:] = LETTER
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 2 * CHUNK), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values part."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lowered(data: bytes) -> bytes:
    """data in lower case, byte for byte in place; letters whose case has another length in UTF-8 stay."""
    if data.isascii():
        return data.lower()
    text = data.decode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    if len(low) == len(data):
        a, b = np.frombuffer(low, np.uint8), np.frombuffer(data, np.uint8)
        if (((a & 0xC0) == 0x80) == ((b & 0xC0) == 0x80)).all():
            return low
    code = lambda c: c.encode("utf-8", "surrogatepass")
    table = {c: x for c in set(text) if c != (x := c.lower()) and len(x) == 1 and len(code(x)) == len(code(c))}
    return text.translate(str.maketrans(table)).encode("utf-8", "surrogatepass")


@dataclass
class Words:
    """Words of texts first .. first + n - 1 of a batch."""

    first: int
    n: int
    raw: np.ndarray  # the texts' bytes, each text followed by a zero byte
    text_at: np.ndarray  # where each text begins in raw, and the end
    text: np.ndarray  # which text a word is of, from 0
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    hash: np.ndarray
    upper: np.ndarray  # its first letter is upper case
    shout: np.ndarray  # it has two letters or more, the first two upper case

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n)


def words_of(texts: list[bytes], first: int = 0) -> Words:
    data = b"\0".join(texts) + b"\0"
    raw = np.frombuffer(data, np.uint8)
    low = np.frombuffer(lowered(data), np.uint8)
    text_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    kind = _CLASS[raw]
    dots = np.flatnonzero((raw == 46) | (raw == 44))
    dots = dots[(dots > 0) & (dots < len(raw) - 1)]
    kind[dots[(kind[dots - 1] == DIGIT) & (kind[dots + 1] == DIGIT)]] = DIGIT
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    bounds = np.concatenate([[0], edge, [len(raw)]])
    own = kind[bounds[:-1]] != 0
    start, end = bounds[:-1][own], bounds[1:][own]
    summed = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)))])
    hashes = mix((summed[end] - summed[start]) * powers(_BACK, len(raw) + 1)[start] + (end - start).astype(np.uint64))
    cased = raw != low
    # the case shows in a letter's last byte (or only byte)
    lead = np.where(raw[start] < 0x80, 0, np.where(raw[start] < 0xE0, 1, np.where(raw[start] < 0xF0, 2, 3)))
    at = np.minimum(start + lead, len(raw) - 1)
    upper = cased[at] | cased[start]
    second = np.minimum(at + 1, len(raw) - 1)
    shout = upper & (at + 1 < end) & (cased[second] | ((raw[second] >= 0x80) & cased[np.minimum(second + 1, len(raw) - 1)]))
    return Words(first, len(texts), raw, text_at, np.searchsorted(text_at, start, side="right") - 1, start, end, kind[start], hashes, upper, shout)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Words]:
    """The words of a batch's texts (null: empty), in order."""
    held, total, first = [], 0, 0
    for k, text in enumerate(column):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        held.append(raw)
        total += len(raw)
        if total >= size:
            yield words_of(held, first)
            held, total, first = [], 0, k + 1
    if held:
        yield words_of(held, first)


def windows(values: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each run of size consecutive values (one fewer than size less than there are values)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for j in range(size):
        out += values[j : j + n] * np.uint64(power)
        power = power * base & 0xFFFFFFFFFFFFFFFF
    return mix(out)
