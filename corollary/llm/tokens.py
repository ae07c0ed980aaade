"""Token ids of texts, by a given subword vocabulary, with the ids of recent words at hand.

The vocabulary's pieces don't cross a single space between words, so a text's ids are those of its
words one after the other. A worker keeps the ids and bytes of words it has met in a table of 2**SLOT_BITS
places, found by the words' 64-bit hashes without making Python objects; ids are shared only by words
whose bytes are equal, whatever their hashes. Words of more than LONG bytes are encoded one by one. A text
with other white space (runs of spaces, spaces at its ends, tabs, non-breaking ones and so on) counts as
one word and is encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import shipped
from .textops import U, buffers, eights, hash_ranges, same

TOKENIZER = os.environ.get("COROLLARY_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
SLOT_BITS, LONG, MOST_IDS = 20, 64, 1 << 24  # MOST_IDS: ids or bytes kept before the table is emptied

_workers: dict[str, Encoder] = {}


def _unusual(data: np.ndarray) -> np.ndarray:
    """Byte positions of white space other than single spaces and line feeds, of nulls and of the space mark U+2581."""
    found = [np.flatnonzero((data < 32) & (data != 10))]
    space = data == 32
    found.append(np.flatnonzero(space[1:] & space[:-1]))
    if len(data) and data.max() >= 0xC2:
        pad = np.append(data, np.zeros(2, np.uint8))
        at = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)))
        a, b, c = data[at], pad[at + 1], pad[at + 2]
        odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F) | (b == 0x96) & (c == 0x81))
        found.append(at[odd])
    return np.concatenate(found)


class Encoder:
    """Gives little-endian unsigned 16-bit ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=shipped(path))
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(1 << SLOT_BITS, U)
        self.at, self.n = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int16)
        self.ids, self.used = np.zeros(1 << 16, "<u2"), 0
        self.size, self.place = np.zeros(1 << SLOT_BITS, np.int8), np.zeros(1 << SLOT_BITS, np.int32)
        self.bytes, self.held = np.zeros(1 << 16, np.uint8), 0

    def _add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Appends the ids of words; where they begin, and how many they are."""
        ids = self.model.encode(words, num_threads=1)
        n = np.array([len(x) for x in ids], np.int32)
        new = np.fromiter((i for x in ids for i in x), "<u2", int(n.sum()))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), "<u2")])
        at = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        return at, n

    def _keep(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Appends the bytes of words; where they begin."""
        total = int(size.sum())
        if self.held + total + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), total + 8), np.uint8)])
        to = self.held + np.cumsum(size) - size
        self.bytes[self.held : self.held + total] = data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)]
        self.held += total
        return to

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: where its ids begin and how many they are; for each text: the words before it."""
        data, off = buffers(texts)
        if max(self.used, self.held) > MOST_IDS:
            self._clear()
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        full = off[1:] > off[:-1]
        first, last = off[:-1][full], off[1:][full]
        split = data == 32
        whole = np.unique(np.searchsorted(first, np.concatenate([_unusual(data), first[split[first]], last[split[last - 1]] - 1]), "right") - 1)
        for r in whole:
            split[first[r] : last[r]] = False
        begins = np.zeros(len(data) + 1, bool)
        begins[1:] = split
        begins[first] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(data))
        end -= split[end - 1]
        size = end - start
        eight = eights(data)
        h = hash_ranges(data, eight, start, np.minimum(end, start + LONG)) | U(1)
        slot = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        hit = (self.key[slot] == h) & (self.size[slot] == size)
        known = np.flatnonzero(hit)
        held = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        hit[known] = same(eight, start[known], size[known], held, self.place[slot[known]])
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            stands = miss[one][back]  # the word whose ids each one gets, if it is the same word
            equal = (size[miss] == size[stands]) & (size[miss] <= LONG)
            check = np.flatnonzero(equal)
            equal[check] = same(eight, start[miss[check]], size[miss[check]], eight, start[stands[check]])
            stands = np.where(equal, stands, miss)
            chosen, back = np.unique(stands, return_inverse=True)
            raw = data.tobytes()
            a, m = self._add([raw[i:j].decode() for i, j in zip(start[chosen].tolist(), end[chosen].tolist(), strict=True)])
            at[miss], n[miss] = a[back], m[back]
            keep = size[chosen] <= LONG
            own = chosen[keep]
            s = slot[own]
            self.key[s], self.at[s], self.n[s], self.size[s] = h[own], a[keep], m[keep], size[own]
            self.place[s] = self._keep(data, start[own], size[own])
        return at, n, np.searchsorted(start, off)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text; a null has none."""
        _, n, off = self._words(texts)
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has; with end, each text is followed by that id."""
        at, n, off = self._words(texts)
        total = np.cumsum(n, dtype=np.int64)
        ids = self.ids[np.repeat(at - (total - n), n) + np.arange(int(total[-1]) if len(n) else 0)]
        ends = np.concatenate([[0], total])[off]
        lens = np.diff(ends)
        return (ids, lens) if end is None else (np.insert(ids, ends[1:], end), lens + 1)


def encoder(path: str = TOKENIZER) -> Encoder:
    """The worker's own, loaded once."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]
