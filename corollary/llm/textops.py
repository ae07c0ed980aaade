"""Vectorised text kernels over Arrow string columns.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters other than
Latin-1 signs, general punctuation (U+2000-U+203F) and CJK punctuation (U+3000-U+303F), after
simple case folding. Folding maps one code point to one code point and never turns a word
character into a separator, so word ordinals of the folded and of the original text agree.
Words become 64-bit hashes, eight bytes at a time through a bijective mixer: no Python object is made
for a word of up to LONG bytes. Different words of up to eight bytes never share a hash by construction
of their letters alone, and longer ones only by chance; whoever needs certainty compares bytes (`same`).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)  # the first i bytes of eight
LONG = 256
_pw = np.ones(1, U)
_ipw = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words with full avalanche."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    global _pw, _ipw
    if len(_pw) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _pw, _ipw = np.full(size, _BASE, U), np.full(size, _INV, U)
        _pw[0] = _ipw[0] = 1
        np.cumprod(_pw, out=_pw)
        np.cumprod(_ipw, out=_ipw)
    return _pw[:n], _ipw[:n]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets, from 0."""
    arr = pc.cast(arr, pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_mask(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    if len(data) and data.max() >= 0xC2:
        nxt = np.append(data[1:], np.uint8(0))
        two = (data == 0xC2) & (nxt != 0xAA) & (nxt != 0xB5) & (nxt != 0xBA)
        three = ((data == 0xE2) | (data == 0xE3)) & (nxt == 0x80)
        for at, width in ((np.flatnonzero(two), 2), (np.flatnonzero(three), 3)):
            for j in range(width):
                k = at + j
                mask[k[k < len(data)]] = False
    return mask


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_ranges(data: np.ndarray, eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges."""
    left = end - start
    h = left.astype(U) * U(0xD6E8FEB86659FD93)
    live: np.ndarray | None = None
    far = np.flatnonzero(left > LONG) if len(left) and left.max() > LONG else ()
    if len(far):
        left = left.copy()
        left[far] = 0
    k = 0
    while True:
        if live is None:
            h = mix(h ^ (eight[start] & _CHUNK[np.minimum(left, 8)]))
        else:
            h[live] = mix((h[live] + U(k)) ^ (eight[start[live] + 8 * k] & _CHUNK[np.minimum(left[live] - 8 * k, 8)]))
        k += 1
        live = np.flatnonzero(left > 8 * k) if live is None else live[left[live] > 8 * k]
        if not len(live):
            break
    for i in far:
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same(eight: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes from start on equal those from `at` on in other; both are eights()."""
    out = np.ones(len(start), bool)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        differ = (eight[start[live] + 8 * k] ^ other[at[live] + 8 * k]) & _CHUNK[np.minimum(size[live] - 8 * k, 8)]
        out[live[differ != 0]] = False
        k += 1
        live = live[(differ == 0) & (size[live] > 8 * k)]
    return out


class Words:
    """Words of a string array: off[i]:off[i + 1] are those of row i; start, end: their bytes; h: their hashes."""

    __slots__ = ("data", "eight", "end", "h", "off", "start", "text_off")

    def __init__(self, arr: pa.Array, fold: bool = True, hashed: bool = True):
        data, toff = buffers(arr)
        if fold and len(data):
            if data.max() < 128:
                data = _LOWER[data]
            else:
                try:
                    data, toff = buffers(pc.utf8_lower(pc.cast(arr, pa.large_string())))
                except pa.ArrowInvalid:  # bytes that aren't UTF-8: fold the ASCII letters alone
                    data = _LOWER[data]
        self.data, self.text_off = data, toff
        mask, n = word_mask(data), len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = mask[:-1], mask[1:]
            full = toff[1:] > toff[:-1]
            before[toff[:-1][full]] = False
            after[toff[1:][full] - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.off = np.searchsorted(self.start, toff)
        self.h = self.eight = None
        if hashed:
            self.eight = eights(data)
            self.h = self.hash_bytes(self.start, self.end)

    def hash_bytes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hash_ranges(self.data, self.eight, start, end)

    def doc(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def ngrams(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one row begin, and the hash of those k words."""
    n, lens = len(h), np.diff(off)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    left = np.repeat(off[1:], lens) - np.arange(n)
    at = np.flatnonzero(left >= k)
    if k <= 8:
        g = h.copy()
        for j in range(1, k):
            g[: n - j] = g[: n - j] * U(0xC2B2AE3D27D4EB4F) + h[j:]
        return at, mix(g[at] + U(k))
    pw, ipw = powers(n + 1)
    p = np.zeros(n + 1, U)
    np.cumsum(h * pw[:n], out=p[1:])
    return at, mix((p[at + k] - p[at]) * ipw[at] + U(k))


def char_at(data: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Code points before each byte offset of one UTF-8 text."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[byte]


def give_back() -> None:
    """Returns what a worker has freed to the system: it lives on beside other operators' tables."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about limit bytes of text, so that temporaries stay small; a longer text comes alone."""
    for b in batches:
        k = b.schema.get_field_index(column)
        _, off = buffers(b.column(k))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
    give_back()


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is one of the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


class Filter:
    """Exact membership in a set of hashes; a bitmap of their low bits turns most others away first."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.values = np.unique(values)
        self.mask = U((1 << bits) - 1)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.values & self.mask] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        hit = self.bitmap[x & self.mask]
        at = np.flatnonzero(hit)
        hit[at] = member(self.values, x[at])
        return hit
