"""Benchmark decontamination by a generalised suffix automaton over the normalised test items.

The automaton of all items' words is small and goes to every task; a document's words are streamed
through it, which gives at each word the longest stretch ending there that occurs in some item, and
through suffix links its shorter ones. A stretch is reportable if it has at least `min_words` words,
or `floor` words (all words, of a shorter item) that make up at least `min_coverage` of an item. The
longest reportable stretch at each word is reported unless the next word's goes on with it. An item copied
with changes is a passage: within twice the item's words, runs of `floor` words that together make up
`min_coverage` of the item are reported as one, from the first to the last, in place of the stretches inside.
What is reported is cut out of the text; a document of which no word is left is dropped.

Words that nothing reportable can contain are skipped exactly: it holds `floor` consecutive words of an
item (or `min_words`, or a whole shorter item, if that is fewer), so documents without a run of that many
words found in the items' set of such runs never reach the automaton.

Items beyond `group_words` words are spread over several automata. A worker builds each once, whatever the
number of its tasks. Items are test sets, not corpus: their words' hashes (8 bytes a word) go to every worker.

Defined results: null or empty texts and items match nothing, nor do items of fewer than SHORT words,
which any text may hold; items that normalise to the same words are reported as the one of least id, and a
stretch found in several items as the shortest one's, then the least id's; a repeated row gives repeated
rows; a null doc_id is reported as null; an empty table on either side gives no stretch, and leaves documents
as they are; texts of any length are streamed whole; further columns, whatever their names, are carried along
by decontaminate (n_chars is counted anew) and ignored otherwise.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, need
from .textops import Filter, Words, char_at, ngrams, pieces

MIN_WORDS, MIN_COVERAGE, FLOOR, GROUP_WORDS, SHORT = 13, 0.6, 8, 1_000_000, 4


def _least(size: int, min_words: int, min_coverage: float, floor: int) -> int:
    """Words of a reportable stretch of an item of `size` words."""
    return min(min_words, max(min(floor, size), math.ceil(min_coverage * size - 1e-9)))


class SuffixAutomaton:
    """Generalised: built item by item, each from the root. For every state the shortest item that contains it."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owner: list[tuple[int, int] | None] = [None]  # (words of the item, its id)
        for item, words in sorted(items, key=lambda x: (len(x[1]), x[0])):
            last = 0
            for w in words:
                last = self._extend(last, w)
                if self.owner[last] is None:
                    self.owner[last] = (len(words), item)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            p, own = self.link[v], self.owner[v]
            if p > 0 and own is not None and (self.owner[p] is None or own < self.owner[p]):
                self.owner[p] = own

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(None)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def limits(self, min_words: int, min_coverage: float, floor: int) -> None:
        """For every state the least length that is reported, and its nearest suffix that is."""
        self.least = [1 << 60] + [_least(own[0], min_words, min_coverage, floor) for own in self.owner[1:]]
        self.shorter = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            u = self.link[v]
            self.shorter[v] = u if self.length[u] >= self.least[u] else self.shorter[u]

    def stretches(self, words: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(first word, past the last, item, words of the item): at each word the longest reportable stretch that ends there, without those that the next one goes on with."""
        nxt, link, length, least, shorter = self.next, self.link, self.length, self.least, self.shorter
        v = n = 0
        held = None
        for i, w in enumerate(words):
            to = nxt[v].get(w)
            if to is None:
                while v >= 0 and (to := nxt[v].get(w)) is None:
                    v = link[v]
                n = length[v] if v >= 0 else -1
            v, n = (to, n + 1) if to is not None else (0, 0)
            u, m = (v, n) if n >= least[v] else (shorter[v], length[shorter[v]])
            if not u:
                continue
            if held and i + 1 - m > held[0]:
                yield held
            held = (i + 1 - m, i + 1, self.owner[u][1], self.owner[u][0])
        if held:
            yield held


def _normalised(benchmark: DataFrame) -> list[tuple[int, list[int]]]:
    need(benchmark, "item_id", "text")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and text <> '' and item_id is not null").collect()
    words = Words(pa.array([r[1] for r in rows], pa.string()))
    first: dict[tuple, int] = {}
    for i, r in enumerate(rows):
        key = tuple(words.h[words.off[i] : words.off[i + 1]].tolist())
        if len(key) >= SHORT:
            first[key] = min(first.get(key, r[0]), r[0])
    return [(item, list(key)) for key, item in sorted(first.items(), key=lambda x: x[1])]


def _groups(items: list, limit: int) -> list[list]:
    out, held = [], limit
    for item in items:
        if held + len(item[1]) > limit and held:
            out.append([])
            held = 0
        out[-1].append(item)
        held += len(item[1])
    return out


class _Matcher:
    """From Words to (row, first word, past the last, item, coverage) of what is to be reported."""

    def __init__(self, items: list, min_words: int, min_coverage: float, floor: int):
        self.items, self.min_coverage, self.floor = items, min_coverage, floor
        self.automaton = SuffixAutomaton(items)
        self.automaton.limits(min_words, min_coverage, floor)
        flat = np.array([h for _, w in items for h in w], np.uint64)
        self.off = np.cumsum([0, *(len(w) for _, w in items)])
        self.k = min(floor, min_words, *(len(w) for _, w in items))
        self.runs = Filter(ngrams(flat, self.off, self.k)[1])
        # Runs of `floor` words with their places in the items, for passages.
        at, g = ngrams(flat, self.off, floor)
        order = np.argsort(g, kind="stable")
        self.place, self.gram = at[order], g[order]

    def __call__(self, words: Words) -> Iterator[tuple[int, int, int, int, float]]:
        at, g = ngrams(words.h, words.off, self.k)
        if not len(at):
            return
        for row in np.unique(np.searchsorted(words.off, at[self.runs(g)], "right") - 1):
            own = words.h[words.off[row] : words.off[row + 1]]
            stretches = list(self.automaton.stretches(own.tolist()))
            passages = self.passages(own)
            for a, b, item, share in passages:
                yield int(row), a, b, item, share
            for a, b, item, size in stretches:
                if not any(x <= a and b <= y and item == i for x, y, i, _ in passages):
                    yield int(row), a, b, item, (b - a) / size

    def passages(self, own: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Changed copies of items in one text: (first word, past the last, item, share of the item's words)."""
        n = self.floor
        at, g = ngrams(own, np.array([0, len(own)]), n)
        lo, hi = np.searchsorted(self.gram, g), np.searchsorted(self.gram, g, "right")
        many = hi - lo
        if not many.any():
            return []
        here = np.repeat(at, many)
        there = self.place[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        item = np.searchsorted(self.off, there, "right") - 1
        out = []
        order = np.argsort(item, kind="stable")
        cut = np.flatnonzero(np.append(True, item[order][1:] != item[order][:-1]))
        for x, y in zip(cut, [*cut[1:], len(order)], strict=True):
            i = int(item[order[x]])
            size = int(self.off[i + 1] - self.off[i])
            p, q = here[order[x:y]], there[order[x:y]] - int(self.off[i])
            need = math.ceil(self.min_coverage * size - 1e-9)
            if len(np.unique(q[:, None] + np.arange(n)[None, :])) < need or (np.diff(p) == 1).all() and (np.diff(q) == 1).all():
                continue  # too little, or one unbroken stretch
            out += self._windows(p.tolist(), q.tolist(), size, need, i)
        return out

    def _windows(self, p: list[int], q: list[int], size: int, need: int, i: int) -> list[tuple[int, int, int, float]]:
        n, held, covered, left = self.floor, [0] * size, 0, 0
        found: list[list] = []

        def move(at: int, by: int) -> None:
            nonlocal covered
            for w in range(q[at], q[at] + n):
                before, held[w] = held[w], held[w] + by
                covered += (held[w] > 0) - (before > 0)

        for r in range(len(p)):
            move(r, 1)
            while p[r] + n - p[left] > 2 * size:
                move(left, -1)
                left += 1
            if covered < need:
                continue
            while left < r:  # what adds nothing at the left isn't part of it
                now = covered
                move(left, -1)
                if covered < now:
                    move(left, 1)
                    break
                left += 1
            if found and p[left] < found[-1][1]:
                found[-1] = [min(found[-1][0], p[left]), p[r] + n, max(found[-1][2], covered)]
            else:
                found.append([p[left], p[r] + n, covered])
        return [(a, b, self.items[i][0], c / size) for a, b, c in found]


_built: dict[tuple, _Matcher] = {}


def _matcher(items: list, min_words: int, min_coverage: float, floor: int, name: str, group: int) -> _Matcher:
    """A worker keeps the matchers of one call."""
    key = (name, group)
    if key not in _built:
        for old in [k for k in _built if k[0] != name]:
            del _built[old]
        _built[key] = _Matcher(items, min_words, min_coverage, floor)
    return _built[key]


def _spans(words: Words, original: Words, row: int, a: int, b: int) -> tuple[int, int]:
    """Code point offsets, in the original text, of words a to b of a row."""
    lo = original.text_off[row]
    data = original.data[lo : original.text_off[row + 1]]
    k = original.off[row]
    first, last = char_at(data, np.array([original.start[k + a] - lo, original.end[k + b - 1] - lo]))
    return int(first), int(last)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_coverage: float = MIN_COVERAGE, floor: int = FLOOR, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, n_words, coverage): the reported stretches, offsets in code points, end exclusive."""
    schema = "doc_id long, item_id long, start int, end int, n_words int, coverage double"
    base = id_text(docs)

    name = uuid.uuid4().hex

    def one_pass(group: int, items: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _matcher(shared.value, min_words, min_coverage, floor, name, group)
            for b in pieces(batches):
                words, original = Words(b.column(1)), None
                rows = []
                for row, a, e, item, coverage in find(words):
                    original = original or Words(b.column(1), fold=False, hashed=False)
                    rows.append((b.column(0)[row].as_py(), item, *_spans(words, original, row, a, e), e - a, coverage))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "n_words", "coverage"])

        return base.mapInArrow(match, schema)

    passes = [one_pass(i, g) for i, g in enumerate(_groups(_normalised(benchmark), group_words))]
    return reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_coverage: float = MIN_COVERAGE, floor: int = FLOOR, group_words: int = GROUP_WORDS) -> DataFrame:
    """docs with the reported stretches cut out of text (and n_chars, if there is one, counted anew); all columns kept."""
    need(docs, "doc_id", "text")
    groups = _groups(_normalised(benchmark), group_words)
    shared, name = docs.sparkSession.sparkContext.broadcast(groups), uuid.uuid4().hex
    text_type = docs.schema["text"].dataType

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [_matcher(g, min_words, min_coverage, floor, name, i) for i, g in enumerate(shared.value)]
        for b in pieces(batches, column="text"):
            k = b.schema.get_field_index("text")
            words = Words(b.column(k))
            cut: dict[int, list[tuple[int, int]]] = {}
            for find in finders:
                for row, a, e, _, _ in find(words):
                    cut.setdefault(row, []).append((a, e))
            if not cut:
                yield b
                continue
            original = Words(b.column(k), fold=False, hashed=False)
            texts, keep = b.column(k).to_pylist(), np.ones(b.num_rows, bool)
            counts = b.column(c).to_pylist() if (c := b.schema.get_field_index("n_chars")) >= 0 else None
            for row, spans in cut.items():
                text, out, at, left = texts[row], [], 0, 0
                total = int(words.off[row + 1] - words.off[row])
                merged: list[list[int]] = []
                for a, e in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([a, e])
                left = total - sum(e - a for a, e in merged)
                for a, e in merged:
                    first, last = _spans(words, original, row, a, e)
                    out.append(text[at:first])
                    at = last
                texts[row] = "".join(out) + text[at:]
                keep[row] = left > 0
                if counts is not None and counts[row] is not None:
                    counts[row] = len(texts[row])
            b = b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))
            if counts is not None and pa.types.is_integer(b.schema.field(c).type):
                b = b.set_column(c, b.schema.field(c), pa.array(counts, b.schema.field(c).type))
            yield b if keep.all() else b.filter(pa.array(keep))

    if not groups:
        return docs
    if not isinstance(text_type, T.StringType):
        raise ValueError("text must be a string column")
    return docs.mapInArrow(clean, docs.schema)
