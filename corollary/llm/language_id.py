"""Language spans of mixed-language text.

Words are split where the script changes (digits and combining marks have none; Han and kana side by side
are one Japanese word), and a script narrows a word's candidates: the trained languages that have at least
a share READS of their words in it, or one language by default where none has. Where several remain, a
word's score for a language is the log-probability of its letter sequences of 1 to 5 bytes (1 to 9 in
scripts of more bytes a letter), word edges included, under that language's counts. Viterbi over the words of a text, with a penalty for each change of language,
labels them; runs of one label are spans.

The counts come from at most `max_rows` rows of each language that the table labels, chosen by a hash
of doc_id (the documented bound); labelling covers every word of every text. Viterbi runs in lanes: a
text is cut into blocks, all blocks advance in step from every entry language, the blocks' best scores are
chained, and each block is gone through again from the entry that this gives: the same path as one pass
over the text, with one pointer a word and language. Texts are taken a slice of some MB at a time, a
longer one alone.

Defined results: null and empty texts, and texts without a word, give one row of language 'und' from
0 to 0; rows that share a doc_id are labelled one by one, repeated ones twice; a null doc_id is
reported as null; null labels are not trained on; Latin words are 'und' where no language is trained on them; ties go to the
language first in the alphabet; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, need, small, stage
from .textops import U, Words, mix, pieces

MAX_ROWS, BITS, SIZES, PENALTY, BLOCK = 400, 17, (1, 2, 3, 4, 5), 6.0, 32
MOST_CELLS = 1 << 24  # of the blocks' tables of scores
WIDE_SIZES, READS = (1, 2, 3, 4, 6, 8, 9), 0.05  # of letters of 2 and 3 bytes; least share of a language's words in a script

#: (first code point, last, language by default, which also names the script). Latin is what is not listed.
SCRIPTS = (
    (0x0370, 0x03FF, "el"), (0x1F00, 0x1FFF, "el"), (0x0400, 0x052F, "ru"), (0x0530, 0x058F, "hy"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0750, 0x077F, "ar"),
    (0x0900, 0x097F, "hi"), (0x0980, 0x09FF, "bn"), (0x0B80, 0x0BFF, "ta"), (0x0C00, 0x0C7F, "te"), (0x0E00, 0x0E7F, "th"), (0x10A0, 0x10FF, "ka"), (0x1100, 0x11FF, "ko"),
    (0x3040, 0x30FF, "ja"), (0x3400, 0x4DBF, "zh"), (0x4E00, 0x9FFF, "zh"), (0xAC00, 0xD7AF, "ko"), (0x20000, 0x2FA1F, "zh"),
)
_FIRST = np.array([s[0] for s in SCRIPTS])
_ORDER = np.argsort(_FIRST)
OUTSIDE = -12.0  # score of a language that a word's script rules out: dear, but a lone foreign word may be borrowed


DEFAULTS = sorted({s[2] for s in SCRIPTS})
_SCRIPT = np.array([DEFAULTS.index(s[2]) for s in SCRIPTS])
_HAN, _KANA = DEFAULTS.index("zh"), DEFAULTS.index("ja")


def split_scripts(words: Words) -> np.ndarray:
    """Splits the words, in place, where the script changes; of each the script's place in DEFAULTS, or -1 for Latin."""
    far = np.concatenate([[0], np.cumsum(words.data >= 0xCD)])
    mixed = far[words.end] > far[words.start]
    hit = np.flatnonzero(mixed)
    if not len(hit):
        return np.full(len(words.start), -1, np.int64)
    data, lens = words.data, (words.end - words.start)[hit]
    pos = np.repeat(words.start[hit] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
    lead = (data[pos] & 0xC0) != 0x80
    pos, word = pos[lead], np.repeat(hit, lens)[lead]
    at = lambda k: data[np.minimum(pos + k, len(data) - 1)].astype(np.int64) & 0x3F
    b = data[pos].astype(np.int64)
    code = np.select([b < 0x80, b < 0xE0, b < 0xF0], [b, ((b & 0x1F) << 6) | at(1), ((b & 0x0F) << 12) | (at(1) << 6) | at(2)], ((b & 0x07) << 18) | (at(1) << 12) | (at(2) << 6) | at(3))
    k = np.searchsorted(_FIRST[_ORDER], code, "right") - 1
    place = _ORDER[np.maximum(k, 0)]
    own = np.where((k >= 0) & (code <= np.array([x[1] for x in SCRIPTS])[place]), _SCRIPT[place], -1)
    kana = own == _KANA
    own[kana] = _HAN
    # What has no script goes with the letter before it in the word, or else with the next one.
    none = ((code >= 48) & (code <= 57)) | ((code >= 0x300) & (code <= 0x36F))
    here = np.arange(len(pos))
    before = np.maximum.accumulate(np.where(none, -1, here))
    after = np.minimum.accumulate(np.where(none, len(pos), here)[::-1])[::-1]
    before = np.where((before >= 0) & (word[np.maximum(before, 0)] == word), before, -1)
    after = np.where((after < len(pos)) & (word[np.minimum(after, len(pos) - 1)] == word), after, -1)
    source = np.where(before >= 0, before, after)
    own = np.where(source >= 0, own[source], -1)
    head = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (own[1:] != own[:-1])))
    start = pos[head]
    last = np.append(word[head][1:] != word[head][:-1], True)
    end = np.where(last, words.end[word[head]], np.append(start[1:], 0))
    script = np.where(np.logical_or.reduceat(kana, head), _KANA, own[head])
    start, end = np.concatenate([words.start[~mixed], start]), np.concatenate([words.end[~mixed], end])
    script = np.concatenate([np.full(int((~mixed).sum()), -1, np.int64), script])
    order = np.argsort(start, kind="stable")
    words.start, words.end = start[order], end[order]
    words.off = np.searchsorted(words.start, words.text_off)
    words.h = words.hash_bytes(words.start, words.end)
    return script[order]


def letter_runs(words: Words, chosen: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """For the chosen words: the index (in chosen) and hashed place of each byte sequence, those at the edges marked as such."""
    start, end = words.start[chosen], words.end[chosen]
    n = end - start
    who, place = [], []
    for size in sizes:
        many = np.maximum(n - size + 1, 0)
        row = np.repeat(np.arange(len(chosen)), many)
        off = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        s = start[row] + off
        edge = (off == 0).astype(U) + (off == many[row] - 1).astype(U) * U(2)
        who.append(row)
        place.append((mix(words.hash_bytes(s, s + size) + edge * U(0xA0761D6478BD642F) + U(size)) >> U(64 - BITS)).astype(np.int64))
    return np.concatenate(who), np.concatenate(place)


@dataclass
class LanguageModel:
    names: list[str]  # trained languages, in order
    table: np.ndarray  # places x languages: log-probability above the mean of the languages
    reads: np.ndarray  # scripts (DEFAULTS, then Latin) x languages: whether the script is one of the language's

    def word_scores(self, words: Words, script: np.ndarray) -> np.ndarray:
        """Words x languages; equal words are scored once."""
        if not len(words.h):
            return np.zeros((0, len(self.names)))
        _, first, back = np.unique(words.h, return_index=True, return_inverse=True)
        out = np.zeros((len(first), len(self.names)))
        for a in range(0, len(first), 20_000):
            part = first[a : a + 20_000]
            for at, sizes in ((np.flatnonzero(script[part] < 0), SIZES), (np.flatnonzero(script[part] >= 0), WIDE_SIZES)):
                who, place = letter_runs(words, part[at], sizes)
                for j in range(len(self.names)):
                    out[a + at, j] = np.bincount(who, self.table[place, j], len(at))
        n = np.maximum(1, words.end[first] - words.start[first])[:, None]
        return (out / np.sqrt(n))[back.ravel()]


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> LanguageModel | None:
    """Counts of at most max_rows rows of each language in column lang; None without any."""
    need(docs, "doc_id", "text", "lang")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text <> '' and lang <> ''")
    # One pass: each partition keeps max_rows rows of a language before anything moves (a window's group limit).
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", "th"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("th"), "lang", F.xxhash64("doc_id", F.lit(23)).alias("key"))
    chosen = stage(keyed.withColumn("place", place).where(F.col("place") <= max_rows).select("doc_id", "th", "lang").distinct(), "chosen")
    names = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    if not names:
        return None
    rows = base.withColumn("th", F.xxhash64("text")).join(small(chosen.withColumnsRenamed({"doc_id": "d", "th": "h", "lang": "l"})), F.expr("doc_id <=> d and th = h and lang = l"), "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # places, then words by script
        for b in pieces(batches):
            words = Words(b.column(1))
            script = split_scripts(words)
            name = np.array(b.column(0).to_pylist(), object)[words.doc()]
            for keep, sizes in ((np.flatnonzero(script < 0), SIZES), (np.flatnonzero(script >= 0), WIDE_SIZES)):
                if not len(keep):
                    continue
                who, place = letter_runs(words, keep, sizes)
                lang = name[keep]
                for n in set(lang.tolist()):
                    own = held.setdefault(n, np.zeros((1 << BITS) + len(DEFAULTS) + 1, np.int64))
                    own[: 1 << BITS] += np.bincount(place[(lang == n)[who]], minlength=1 << BITS)
                    own[1 << BITS :] += np.bincount(script[keep[lang == n]] % (len(DEFAULTS) + 1), minlength=len(DEFAULTS) + 1)
        if held:
            yield pa.record_batch([pa.array(list(held)), pa.array([c.astype("<i8").tobytes() for c in held.values()], pa.binary())], names=["lang", "counts"])

    counts, used = {n: np.zeros(1 << BITS) for n in names}, {n: np.zeros(len(DEFAULTS) + 1) for n in names}
    for r in rows.coalesce(4).mapInArrow(count, "lang string, counts binary").collect():
        got = np.frombuffer(r[1], "<i8")
        counts[r[0]] += got[: 1 << BITS]
        used[r[0]] += got[1 << BITS :]
    names = [n for n in names if counts[n].sum()]
    if not names:
        return None
    p = np.stack([np.log((counts[n] + 0.5) / (counts[n].sum() + 0.5 * (1 << BITS))) for n in names], axis=1)
    seen = sum(counts[n] for n in names) > 0
    return LanguageModel(names, ((p - p.mean(axis=1, keepdims=True)) * seen[:, None]).astype(np.float32), np.stack([used[n] >= READS * used[n].sum() for n in names], axis=1))


def viterbi(score: np.ndarray, off: np.ndarray, penalty: float, block: int = BLOCK) -> np.ndarray:
    """Best labels of the words of each row under sum of scores less penalty for each change; ties go to staying, then to the least label."""
    n, k = score.shape
    if k < 2 or not n:
        return np.zeros(n, np.int64)
    block = max(block, -(-n * k * k // MOST_CELLS))  # fewer, longer blocks where a text is long or languages are many
    lens = np.diff(off)
    many = -(-lens // block)
    row = np.repeat(np.arange(len(lens)), many)
    b0 = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * block
    size = np.minimum(block, off[row + 1] - b0)
    nb = len(b0)
    order = np.argsort(-size, kind="stable")
    pen = penalty * (1 - np.eye(k))
    # best[b, e, l]: the block's best score with its first word labelled e and its last one l.
    best = np.where(np.eye(k, dtype=bool)[None], score[b0][:, None, :], -np.inf)
    for t in range(1, block):
        live = order[: int((size > t).sum())]
        if not len(live):
            break
        v = best[live]
        best[live] = np.maximum(v, v.max(axis=2, keepdims=True) - penalty) + score[b0[live] + t][:, None, :]
    # Chain the blocks of a row: entry[b]: for each last label, the entry label of the block and the last of the one before.
    first = np.cumsum(many) - many
    value = np.empty((nb, k))
    entry, came = np.zeros((nb, k), np.int32), np.zeros((nb, k), np.int32)
    rows = np.argsort(-many, kind="stable")
    rows = rows[many[rows] > 0]
    for t in range(int(many.max())):
        rows = rows[many[rows] > t]
        b = first[rows] + t
        if t == 0:
            entry_score = np.zeros((len(b), k))
        else:
            before = value[b - 1]
            step = before[:, :, None] - pen[None]  # last label before x entry label
            stay = before >= before.max(axis=1, keepdims=True) - penalty
            lead = before.argmax(axis=1)
            entry_score = step.max(axis=1)
            came[b] = np.where(stay, np.arange(k)[None, :], lead[:, None])
        total = entry_score[:, :, None] + best[b]
        entry[b] = total.argmax(axis=1)
        value[b] = total.max(axis=1)
    label = np.empty(n, np.int64)
    end = np.zeros(nb, np.int64)
    enter = np.zeros(nb, np.int64)
    last = first + many - 1
    rows = np.flatnonzero(many > 0)
    now = value[last[rows]].argmax(axis=1)
    t = 0
    while len(rows):
        b = last[rows] - t
        end[b] = now
        enter[b] = entry[b, now]
        now = came[b, enter[b]].astype(np.int64)
        t += 1
        go = many[rows] > t
        rows, now = rows[go], now[go]
    # Once more through each block, now from its one entry label: k numbers and k pointers a word.
    back = np.zeros((n, k), np.int16 if k < 1 << 15 else np.int32)
    v = np.where(np.arange(k)[None, :] == enter[:, None], score[b0], -np.inf)
    for t in range(1, block):
        live = order[: int((size > t).sum())]
        if not len(live):
            break
        own = v[live]
        top = own.max(axis=1, keepdims=True) - penalty
        stay = own >= top
        back[b0[live] + t] = np.where(stay, np.arange(k)[None, :], own.argmax(axis=1)[:, None])
        v[live] = np.where(stay, own, top) + score[b0[live] + t]
    cur = end.copy()
    for t in range(block - 1, -1, -1):
        live = np.flatnonzero(size > t)
        w = b0[live] + t
        label[w] = cur[live]
        cur[live] = back[w, cur[live]]
    return label


def _emissions(words: Words, script: np.ndarray, model: LanguageModel | None) -> tuple[np.ndarray, list[str]]:
    """Scores of the words for the languages that these texts can be in."""
    trained = model.names if model else []
    present = np.unique(script).tolist()
    readers = {s: np.flatnonzero(model.reads[s]).tolist() if model else [] for s in present}
    names = sorted({*trained, *(DEFAULTS[s] if s >= 0 else "und" for s in present if not readers[s]), *(() if trained else ("und",))})
    score = np.full((len(words.h), len(names)), OUTSIDE)
    own = model.word_scores(words, script) if model else None
    for s in present:
        at = np.flatnonzero(script == s)
        if readers[s]:
            value = own[np.ix_(at, readers[s])]
            # Outside Latin the best is 0, as for a language by default.
            score[np.ix_(at, [names.index(trained[j]) for j in readers[s]])] = value if s < 0 else value - value.max(axis=1, keepdims=True)
        else:
            score[at, names.index(DEFAULTS[s] if s >= 0 else "und")] = 0
        if s == _HAN and "ja" in names and "ja" not in trained:  # Han letters are also Japanese
            score[at, names.index("ja")] = -1
    return score, names


def language_spans(docs: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, lang, n_words): runs of words of one language, in code points, end exclusive; labelled (docs unless given) is trained on."""
    model = train(docs if labelled is None else labelled, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            words = Words(b.column(1))
            script = split_scripts(words)
            score, names = _emissions(words, script, shared.value)
            got = viterbi(score, words.off, penalty)
            doc = words.doc()
            n = len(got)
            head = np.flatnonzero(np.append(True, (got[1:] != got[:-1]) | (doc[1:] != doc[:-1]))) if n else np.zeros(0, np.int64)
            tail = np.append(head[1:], n) - 1 if n else head
            # Code points before each byte of the batch, less those before the row; folding keeps their number.
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            base = points[words.text_off[doc[head]]]
            empty = np.flatnonzero(np.diff(words.off) == 0)
            row = np.concatenate([doc[head], empty])
            zero = np.zeros(len(empty), np.int64)
            order = np.argsort(row, kind="stable")
            columns = [
                np.concatenate([points[words.start[head]] - base, zero]).astype(np.int32),
                np.concatenate([points[words.end[tail]] - base, zero]).astype(np.int32),
            ]
            lang = np.array([*names, "und"], object)[np.concatenate([got[head], zero + len(names)]).astype(np.int64)]
            yield pa.record_batch(
                [b.column(0).take(pa.array(row[order])), *(pa.array(c[order]) for c in columns), pa.array(lang[order].tolist(), pa.string()), pa.array(np.concatenate([tail - head + 1, zero])[order].astype(np.int32))],
                names=["doc_id", "start", "end", "lang", "n_words"],
            )

    return id_text(docs).mapInArrow(label, "doc_id long, start int, end int, lang string, n_words int")
