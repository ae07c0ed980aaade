"""Toxicity by a factorization machine over hashed terms.

A document is the set of its distinct words; a word's terms are itself and its leading bytes (4 to
8 of them), hashed into 2**BITS places. A word has a weight and a factor vector, the sums of its
terms'; the score is w0 + sum of weights + sum over pairs of words of the product of their vectors,
so that pairs of words (an insult and the name of a group) count beyond what each adds alone.
Places whose terms don't tell the classes apart in the training rows (chi-square) are left out.

Training reads at most `max_rows` labelled documents of either class, chosen by a hash of doc_id, one text
each (the documented bound); places are counted on the executors, and the driver gets only the words of
these documents that have an informative term. Scoring covers every document. The threshold is the one of
best F1, of those with a precision of at least LEAST_PRECISION, on the part of the sample held out from
training.

Defined results: null and empty texts score as texts without words; labels that are null, neither 0
nor 1, or of no document are ignored; a doc_id labelled both ways counts as toxic; of a labelled doc_id
with several texts the least one is trained on; without rows of both classes, or without a threshold of that
precision, nothing is toxic; repeated rows are each scored; a null doc_id is scored too; equal scores are
on the same side of the threshold; an empty table of documents or labels gives none; a text of any length is
scored by all of its words; further columns are carried along by reject_toxic, and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_text, need, release, stage
from .textops import U, Words, mix, pieces

BITS, LEADING, FACTORS, MAX_ROWS, LEAST_PRECISION = 18, (4, 5, 6, 7, 8), 8, 4000, 0.5


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The row of each distinct word of each row, and the places of its terms (-1: none), one column for each kind."""
    doc = words.doc()
    _, first = np.unique(mix(words.h + doc.astype(U) * U(0xA0761D6478BD642F)), return_index=True)
    first.sort()
    start, end = words.start[first], words.end[first]
    mask = U((1 << BITS) - 1)
    out = np.full((len(first), 1 + len(LEADING)), -1, np.int32)
    out[:, 0] = words.h[first] & mask
    for j, n in enumerate(LEADING):
        has = np.flatnonzero(end - start >= n)
        out[has, j + 1] = mix(words.hash_bytes(start[has], start[has] + n) + U(n)) & mask
    return doc[first], out


@dataclass
class FactorizationMachine:
    w0: float
    w: np.ndarray  # of places
    v: np.ndarray  # of places x FACTORS
    threshold: float
    used: np.ndarray  # places with a term

    def score(self, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of n rows."""
        place = np.where(self.used[place] & (place >= 0), place, len(self.w) - 1)
        live = np.flatnonzero((place != len(self.w) - 1).any(axis=1))
        doc, place = doc[live], place[live]
        weight, vec = self.w[place].sum(axis=1), self.v[place].sum(axis=1)
        return _sigmoid(_raw(self.w0, doc, weight, vec, n)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _raw(w0: float, doc: np.ndarray, weight: np.ndarray, vec: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.stack([np.bincount(doc, vec[:, f], n) for f in range(vec.shape[1])], axis=1)
    square = np.bincount(doc, (vec * vec).sum(axis=1), n)
    return w0 + np.bincount(doc, weight, n) + 0.5 * ((total * total).sum(axis=1) - square), total


def informative(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places that tell the classes apart. seen: 2 x places, rows of either class that have the place; n: rows of either class."""
    (b, a), (n0, n1) = seen, n
    top = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1)
    chi = top / np.maximum((a + b) * (n0 + n1 - a - b) * n1 * n0, 1e-9)
    used = np.append((a + b >= 5) & (chi > 15), False)  # the last place stands for no term
    return used


def fit(rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, used: np.ndarray, epochs: int = 12, seed: int = 7) -> FactorizationMachine:
    """rows: for each row the places of its distinct words' terms; y: 0 or 1; held: rows that set the threshold only."""
    size = (1 << BITS) + 1
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~held)
    n1, n0 = y[train].sum(), (1 - y[train]).sum()
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)) * used[:, None]
    w0 = float(np.log((n1 + 1) / (n0 + 1)))
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    kept = []
    for r in rows:
        p = np.where(used[r] & (r >= 0), r, size - 1)
        kept.append(p[(p != size - 1).any(axis=1)])
    rate, decay = 0.1, 1e-3
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            doc = np.repeat(np.arange(len(batch)), [len(kept[i]) for i in batch])
            place = np.concatenate([kept[i] for i in batch]) if len(doc) else np.zeros((0, 1 + len(LEADING)), np.int32)
            weight, vec = w[place].sum(axis=1), v[place].sum(axis=1)
            raw, total = _raw(w0, doc, weight, vec, len(batch))
            err = (_sigmoid(raw) - y[batch]) / len(batch)
            step = err.sum()
            g0 += step * step
            w0 -= rate * step / np.sqrt(g0)
            touched, inverse = np.unique(place, return_inverse=True)
            flat = inverse.reshape(-1)
            each = np.repeat(np.arange(len(doc)), place.shape[1])
            dw = np.bincount(flat, err[doc][each], len(touched)) + decay * w[touched] / len(batch)
            pull = err[doc][:, None] * (total[doc] - vec)
            dv = np.stack([np.bincount(flat, pull[each, f], len(touched)) for f in range(FACTORS)], axis=1) + decay * v[touched] / len(batch)
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * dv / np.sqrt(gv[touched])
            w[-1], v[-1] = 0, 0
    model = FactorizationMachine(w0, w.astype(np.float32), v.astype(np.float32), 0.5, used)
    check = np.flatnonzero(held) if held.any() and 0 < y[held].sum() < held.sum() else train
    p = model.score(np.repeat(np.arange(len(check)), [len(rows[i]) for i in check]), np.concatenate([rows[i] for i in check]), len(check))
    order = np.argsort(-p)
    hits, at = np.cumsum(y[check][order]), np.arange(1, len(check) + 1)
    # A cut goes between different scores, and most of what is above it must be toxic; without such a cut nothing is.
    f1 = 2 * hits / (at + y[check].sum())
    f1[np.append(p[order[1:]] == p[order[:-1]], False) | (hits < LEAST_PRECISION * at)] = -1
    best = int(np.argmax(f1))
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    model.threshold = float((p[order[best]] + below) / 2) if f1[best] > 0 else np.inf
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorizationMachine | None:
    """A model of at most max_rows labelled documents of either class; None if a class has none."""
    need(labels, "doc_id", "toxic")
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    clean = clean.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    present = clean.join(id_text(docs).where("text is not null").select("doc_id"), "doc_id", "left_semi")
    chosen = [present.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_rows) for c in (0, 1)]
    sample = {r[0]: r[1] for r in chosen[0].union(chosen[1]).collect()}
    if len(set(sample.values())) < 2:
        return None
    order = sorted(sample)
    held = np.zeros(len(order), bool)
    held[np.random.default_rng(7).permutation(len(order))[: len(order) // 5]] = True
    ids = docs.sparkSession.createDataFrame([(k, sample[k], bool(h)) for k, h in zip(order, held, strict=True)], "doc_id long, toxic int, held boolean")
    texts = id_text(docs).where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "held").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            doc, place = terms(Words(b.column(3)))
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.record_batch([*b.columns[:3], pa.array([place[cut[i] : cut[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["doc_id", "toxic", "held", "places"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for c, h, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if not h:
                    p = np.unique(np.frombuffer(raw.as_buffer(), np.int32))
                    seen[c, p[p >= 0]] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["place", "n0", "n1"])

    staged = stage(texts.mapInArrow(features, "doc_id long, toxic int, held boolean, places binary"), "features")
    y = np.array([sample[k] for k in order], float)
    seen = np.zeros((2, 1 << BITS))
    for r in staged.mapInArrow(count, "place int, n0 long, n1 long").groupBy("place").agg(F.sum("n0"), F.sum("n1")).toLocalIterator():
        seen[:, r[0]] = r[1], r[2]
    used = informative(seen, np.array([(y[~held] == c).sum() for c in (0, 1)], float))
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(3):
                p = np.frombuffer(raw.as_buffer(), np.int32).reshape(-1, 1 + len(LEADING))
                p = np.where(shared.value[p] & (p >= 0), p, -1)
                out.append(p[(p >= 0).any(axis=1)].tobytes())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "places"])

    got = {r[0]: np.frombuffer(r[1], np.int32).reshape(-1, 1 + len(LEADING)) for r in staged.mapInArrow(keep, "doc_id long, places binary").collect()}
    release(staged)
    return fit([got[k] for k in order], y, held, used)


def _scored(docs: DataFrame, model: FactorizationMachine, text: str, column: str) -> DataFrame:
    """docs with the probability of each row in another column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column=text):
            doc, place = terms(Words(b.column(b.schema.get_field_index(text))))
            yield b.append_column(column, pa.array(shared.value.score(doc, place, b.num_rows), pa.float64()))

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxic_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score) of the rows whose score reaches the model's threshold."""
    model = train(docs, labels, max_rows)
    base = id_text(docs)
    if model is None:
        return base.select("doc_id", F.lit(0.0).alias("score")).where("false")
    return _scored(base, model, "text", "score").where(F.col("score") >= model.threshold).select("doc_id", "score")


def reject_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without toxic ones, all columns kept."""
    need(docs, "doc_id", "text")
    model = train(docs, labels, max_rows)
    if model is None:
        return docs
    column = fresh(docs, "score")
    return _scored(docs, model, "text", column).where(F.col(column) < model.threshold).drop(column)
