"""Repeated passages by suffix arrays, built by linear grouping.

A word is covered if it lies in a stretch of K words that occurs at least twice in the corpus, in
other documents or in its own. Every stretch of K words names an anchor, the least hash among its
Q-word grams (leftmost of equal ones), so equal stretches name equal anchors. An anchor that occurs
once in the corpus is done with. The others bring their surroundings together: at most K - Q words
before and K words from the anchor on, which hold every stretch that names it. Surroundings that are
equal throughout are covered as they are. Two that differ can share a K-word stretch only if they agree in
the first half of K words from the anchor on, or in more than half before it: so they meet by these halves,
in groups far smaller than the anchor's, and one that meets nobody is done with before its words are read.
In a group, each is cut down to what it shares with any other, and the suffix array of the distinct cuts,
with its LCP, tells the K-word stretches that occur twice. A group of more than HOT surroundings (a passage
in very many documents) isn't brought together: its stretches are counted by their hashes, with partial
aggregates, which tells the same. Words and stretches are compared by 64-bit hashes.

The suffix array is Baier's: groups of suffixes, first by symbol, are taken in descending order; the
previous smaller suffixes of a group's members move to new groups right above their own, which sorts
groups by Lyndon prefix; then suffixes are emitted in ascending order, each one placing the chain of
previous smaller suffixes before it. Nothing is renamed and nothing recurses.

Defined results: null and empty texts and texts of fewer than K words have no passage; a repeated
row is a copy of itself and so covered as a whole, but reported once, as each distinct (doc_id, text) is; rows
that share a doc_id but not a text are apart; a null doc_id is reported as null; an empty table gives none;
equal anchors (ties) in a stretch count as the leftmost; a text of any length is read whole; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, n_partitions, small, stage
from .textops import U, Words, mix, ngrams, pieces, powers

MIN_WORDS, GRAM, HOT = 50, 8, 20_000


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol must be its least and unique."""
    n = len(s)
    if n < 2:
        return list(range(n))
    symbols = sorted(set(s))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [g + 1 for g in range(len(symbols))]
    above[-1] = -1
    below = [g - 1 for g in range(len(symbols))]
    done, jump, smaller = [False] * n, list(range(-1, n - 1)), [-1] * n
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = True
        pointed: list[int] = []
        times: list[int] = []
        for i in own:
            j = jump[i]
            while j >= 0 and done[j]:
                k = jump[j]
                if k >= 0 and done[k]:
                    jump[j] = jump[k]
                j = k
            jump[i] = smaller[i] = j
            if j >= 0:
                if pointed and pointed[-1] == j:
                    times[-1] += 1
                else:
                    pointed.append(j)
                    times.append(1)
        for t in sorted(set(times), reverse=True):
            new: dict[int, int] = {}
            for j, u in zip(pointed, times, strict=True):
                if u != t:
                    continue
                old = group[j]
                k = new.get(old)
                if k is None:
                    k = new[old] = len(members)
                    members.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = k
                    if up >= 0:
                        below[up] = k
                members[k].append(j)
            for j, u in zip(pointed, times, strict=True):
                if u == t:
                    group[j] = new[group[j]]
        g = below[g]
    slot, at, g = [0] * len(members), 0, 0
    while g >= 0:
        slot[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    slot[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            out[slot[group[j]]] = j
            slot[group[j]] += 1
            placed[j] = True
            j = smaller[j]
    return out


def lcp_array(s: list[int], sa: list[int]) -> list[int]:
    """lcp[r]: symbols that the suffixes at ranks r - 1 and r have in common."""
    n = len(s)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(sa):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = sa[r - 1]
        while i + h < n and j + h < n and s[i + h] == s[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def repeated_stretches(texts: list[np.ndarray], counts: list[int], k: int) -> list[list[tuple[int, int]]]:
    """For each of some distinct word sequences, which occur so often, the unions of its k-word stretches that occur twice."""
    out: list[list[tuple[int, int]]] = [[(0, len(t))] if c > 1 and len(t) >= k else [] for t, c in zip(texts, counts, strict=True)]
    if len(texts) < 2:
        return out
    # Each sequence ends in a symbol of its own, less than any word, so that nothing is common beyond it.
    _, code = np.unique(np.concatenate(texts), return_inverse=True)
    s: list[int] = []
    start, at = [], 0
    for i, t in enumerate(texts):
        start.append(len(s))
        s.extend((code[at : at + len(t)] + len(texts)).tolist())
        s.append(len(texts) - 1 - i)
        at += len(t)
    sa = suffix_array(s)
    lcp = lcp_array(s, sa)
    hit = np.zeros(len(s), bool)
    order, common = np.array(sa), np.array(lcp) >= k
    hit[order[common]] = True
    hit[order[np.flatnonzero(common) - 1]] = True
    for i, t in enumerate(texts):
        if counts[i] < 2:
            begin = np.flatnonzero(hit[start[i] : start[i] + len(t)])
            if len(begin):
                cut = np.flatnonzero(np.diff(begin) > k)
                out[i] = [(int(a), int(b) + k) for a, b in zip(begin[np.append(0, cut + 1)], begin[np.append(cut, len(begin) - 1)], strict=True)]
    return out


def _reach(rows: np.ndarray) -> np.ndarray:
    """For each row the longest prefix that it has in common with another (0 stands for no word and equals nothing)."""
    order = np.lexsort(rows.T[::-1])
    r = rows[order]
    same = (r[1:] == r[:-1]) & (r[1:] != 0)
    common = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    best = np.zeros(len(rows), np.int64)
    best[order[1:]] = common
    best[order[:-1]] = np.maximum(best[order[:-1]], common)
    return best


def anchors(words: Words, k: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions of the anchors, and the first word and the end of the k-word stretches that name each."""
    n = len(words.h)
    at, g = ngrams(words.h, words.off, q)
    span = k - q + 1
    starts = np.flatnonzero(np.repeat(words.off[1:], np.diff(words.off)) - np.arange(n) >= k)
    if not len(starts):
        return starts, starts, starts
    low = np.full(n, ~U(0))
    low[at] = (g & ~U(0xFFFFFF)) | (at.astype(U) & U(0xFFFFFF))
    width = 1
    while width * 2 <= span:
        low[: n - width] = np.minimum(low[: n - width], low[width:])
        width *= 2
    least = np.minimum(low[starts], low[starts + span - width])
    found = (starts & ~0xFFFFFF) + (least & U(0xFFFFFF)).astype(np.int64)
    found[found < starts] += 1 << 24
    cut = np.flatnonzero(np.diff(found)) + 1
    return found[np.append(0, cut)], starts[np.append(0, cut)], starts[np.append(cut, len(starts)) - 1] + k


def _counted(fetched: DataFrame, k: int) -> DataFrame:
    """(h, whole, from, to): the k-word stretches of the surroundings that occur twice among them, by counting."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(w.as_buffer(), U) for w in b.column(3)]
            off = np.cumsum([0, *map(len, own)])
            at, g = ngrams(np.concatenate(own) if own else np.zeros(0, U), off, k)
            row = np.searchsorted(off, at, "right") - 1
            start = at - off[row] - b.column(2).to_numpy()[row]
            yield pa.record_batch([*(b.column(c).take(pa.array(row)) for c in (0, 1)), pa.array(start.astype(np.int32)), pa.array(g.view(np.int64))], names=["h", "whole", "from", "g"])

    one = fetched.groupBy("h", "whole").agg(F.min("l").alias("l"), F.min("words").alias("words"))
    every = stage(one.mapInArrow(stretches, "h long, whole long, from int, g long"), "stretches")
    twice = stage(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "twice")
    return every.join(small(twice), "g", "left_semi").select("h", "whole", "from", (F.col("from") + k).alias("to"))


def repeated_passages(docs: DataFrame, k: int = MIN_WORDS, q: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal unions of k-word stretches that occur twice; end exclusive."""
    spark = docs.sparkSession
    if not 0 < q <= k:
        raise ValueError("need 0 < q <= k")
    base = id_text(docs).where("text is not null and text <> ''").withColumn("th", F.xxhash64("text"))
    after, ahead = -(-k // 2), k // 2 + 1  # words from the anchor on, or before it, of which two surroundings share the one or the other

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1))
            a, lo, hi = anchors(words, k, q)
            if not len(a):
                continue
            pw, ipw = powers(len(words.h) + 1)
            p = np.zeros(len(words.h) + 1, U)
            np.cumsum(words.h * pw[:-1], out=p[1:])
            name = mix((p[a + q] - p[a]) * ipw[a] + U(q))
            whole = mix(((p[hi] - p[lo]) * ipw[lo]) ^ ((a - lo).astype(U) << U(40)) ^ (hi - lo).astype(U))
            row = np.searchsorted(words.off, a, "right") - 1
            right, left = np.minimum(a + after, len(words.h)), np.maximum(a - ahead, 0)
            rh = np.where(a + after <= hi, mix((p[right] - p[a]) * ipw[a]) | U(1), U(0))
            lh = np.where(a - ahead >= lo, mix((p[a] - p[left]) * ipw[left]) | U(1), U(0))
            yield pa.record_batch(
                [pa.array(name.view(np.int64)), pa.array(whole.view(np.int64)), b.column(0).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array((a - words.off[row]).astype(np.int32)), pa.array((a - lo).astype(np.int16)), pa.array((hi - a).astype(np.int16)), pa.array(lh.view(np.int64)), pa.array(rh.view(np.int64))],
                names=["h", "whole", "doc_id", "th", "at", "l", "r", "lh", "rh"],
            )

    every = base.mapInArrow(find, "h long, whole long, doc_id long, th long, at int, l short, r short, lh long, rh long")
    twice = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1").select("h", "mixed")
    known = stage(every.join(twice, "h"), "anchors")
    one = known.where("mixed").groupBy("h", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "doc_id", "at", "l", "r")).alias("s"), F.min("lh").alias("lh"), F.min("rh").alias("rh"))
    one = stage(one, "surroundings")
    side = lambda c, n: F.struct(F.lit(n).alias("side"), F.col(c).alias("half"))
    sides = one.select("h", "whole", F.inline(F.array(side("rh", 0), side("lh", 1)))).where("half <> 0")
    groups = stage(sides.groupBy("h", "side", "half").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "groups")
    met = sides.join(small(groups), ["h", "side", "half"]).groupBy("h", "whole").agg(F.collect_list(F.struct("side", "half", "size")).alias("groups"))
    wanted = one.join(met, ["h", "whole"]).select("h", "whole", "n", "s.*", "groups")
    wanted = wanted.groupBy(F.col("doc_id").alias("owner"), F.col("th").alias("owner_th")).agg(F.collect_list(F.struct("h", "whole", "n", "at", "l", "r", "groups")).alias("want"))
    texts = base.join(wanted, F.expr("th = owner_th and doc_id <=> owner")).select("text", "want", "owner", "owner_th")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # a row that is there many times is read once
        for b in pieces(batches, column="text"):
            rows = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            new = [i for i, r in enumerate(rows) if r not in seen and rows.index(r) == i] if len(set(rows)) < len(rows) or seen.intersection(rows) else None
            seen.update(rows)
            if new is not None:
                b = b.take(pa.array(new, pa.int64()))
            words = Words(b.column(b.schema.get_field_index("text")))
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for i, want in enumerate(b.column(b.schema.get_field_index("want")).to_pylist()):
                for x in want:
                    a = int(words.off[i]) + x["at"]
                    own = words.h[a - x["l"] : a + x["r"]].tobytes()
                    for g in x["groups"]:
                        for column, v in zip(out, (x["h"], g["side"], g["half"], x["whole"], x["n"], x["l"], own, g["size"]), strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["h", "side", "half", "whole", "n", "l", "words", "size"])

    fetched = texts.mapInArrow(fetch, "h long, side int, half long, whole long, n long, l short, words binary, size long")
    large = groups.where(F.col("size") > hot).isEmpty() is False
    if large:
        fetched = stage(fetched, "fetched")
    together = fetched.where(F.col("size") <= hot).drop("size")
    together = together.repartition(n_partitions(spark), "h", "side", "half").sortWithinPartitions("h", "side", "half", "whole")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int, int] | None = None
        own: dict[int, tuple[int, int, np.ndarray]] = {}

        def solve() -> tuple[list, ...]:
            keys = list(own)
            left, right = np.zeros((len(own), k - q), U), np.zeros((len(own), k), U)
            for i, (_, x, w) in enumerate(own.values()):
                left[i, :x], right[i, : len(w) - x] = w[:x][::-1], w[x:]
            back = _reach(left) if k > q and len(own) > 1 else np.zeros(len(own), np.int64)
            on = _reach(right) if len(own) > 1 else np.zeros(len(own), np.int64)
            cuts: dict[bytes, list[int]] = {}
            first: list[int] = []
            for i, (n, x, w) in enumerate(own.values()):
                a, b = (0, len(w)) if n > 1 else (x - int(back[i]), x + int(on[i]))
                first.append(a - x)
                if b - a >= k:
                    cuts.setdefault(w[a:b].tobytes(), []).append(i)
            n = [v[0] for v in own.values()]
            spans = repeated_stretches([np.frombuffer(c, U) for c in cuts], [sum(n[i] for i in who) for who in cuts.values()], k)
            out: tuple[list, ...] = ([], [], [], [])
            for who, found in zip(cuts.values(), spans, strict=True):
                for i in who:
                    for a, b in found:
                        for column, v in zip(out, (now[0], keys[i], first[i] + a, first[i] + b), strict=True):
                            column.append(v)
            return out

        def rows(parts: list[tuple[list, ...]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([v for p in parts for v in p[c]], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "whole", "from", "to"])

        for b in batches:
            solved = []
            whole, n, x = (b.column(c).to_numpy() for c in (3, 4, 5))
            for i, (key, raw) in enumerate(zip(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True), b.column(6), strict=True)):
                if now != key:
                    if own:
                        solved.append(solve())
                    now, own = key, {}
                own[int(whole[i])] = (int(n[i]), int(x[i]), np.frombuffer(raw.as_py(), U))
            if solved:
                yield rows(solved)
        if own:
            yield rows([solve()])

    covered = together.mapInArrow(order, "h long, whole long, from int, to int")
    # Surroundings that occur twice as a whole are covered, whomever they meet.
    covered = covered.unionByName(one.where("n > 1").select("h", "whole", (-F.col("s.l")).cast("int").alias("from"), F.col("s.r").cast("int").alias("to")))
    if large:
        covered = covered.unionByName(_counted(fetched.where(F.col("size") > hot), k))
    parts = known.where("not mixed").select("doc_id", "th", (F.col("at") - F.col("l")).alias("from"), (F.col("at") + F.col("r")).alias("to"))
    parts = parts.unionByName(known.where("mixed").join(covered, ["h", "whole"]).select("doc_id", "th", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to")))
    lists = parts.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, th, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                joined: list[list[int]] = []
                for s in spans:
                    if joined and s["from"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s["to"])
                    else:
                        joined.append([s["from"], s["to"]])
                for a, e in joined:
                    for column, v in zip(out, (doc, th, a, e), strict=True):
                        column.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "th", "start_word", "end_word"])

    merged = lists.mapInArrow(merge, "doc_id long, th long, start_word int, end_word int")
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
