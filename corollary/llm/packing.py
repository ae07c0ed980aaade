"""Packing into training windows by minimum bin slack.

Documents are counted in tokens and cut into pieces of at most `capacity`; what has to be packed is
a multiset of piece lengths, of which only the histogram (at most `capacity` rows, whatever the
corpus) goes to the driver. There each window opens with the longest length left; a subset-sum
dynamic programme over bitsets (bit s: sum s can be reached) picks, of the remaining multiset, the
counts of lengths that fill the rest closest to capacity, and backtracking through the saved bitsets
recovers them. A pattern found is used as often as the histogram allows. Pieces then find their
windows by their rank within their length, with no data but the plan leaving the driver.

Defined results: null and empty texts have no tokens and no piece; rows that share a doc_id are
packed one by one and stay apart as pieces; a null doc_id is carried as null; an empty table gives
no window; a text of any length is cut into as many pieces as it takes; of equally close fillings the one
with the longer lengths is taken, and equal pieces take windows in the order of doc_id and start; further
columns, whatever their names, are ignored. Windows are numbered from 0; pieces of a window are listed by
doc_id and start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, n_partitions, ship, stage
from .textops import pieces
from .tokens import TOKENIZER, encoder

CAPACITY, PART_ROWS = 2048, 2_000_000

Plan = list[tuple[dict[int, int], int]]  # counts of lengths in a window, and how many such windows


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The counts of lengths, within counts, whose sum is closest to room from below; longest lengths are tried first."""
    reach, full = 1, (1 << (room + 1)) - 1
    saved: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            part = min(part, left)
            saved.append((length, part, reach))
            reach |= (reach << (part * length)) & full
            left -= part
            part *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(saved):
        if not before >> at & 1:
            at -= part * length
            used[length] = used.get(length, 0) + part
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns and multiplicities that use up the histogram."""
    left, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = best_fill(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        plan.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _spread(plan: Plan, histogram: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which another pattern begins, its first window, and pieces of the length in a window."""
    out: dict[int, tuple[list, list, list]] = {k: ([], [], []) for k in histogram}
    done, window = dict.fromkeys(histogram, 0), 0
    for pattern, times in plan:
        for k, n in pattern.items():
            for column, x in zip(out[k], (done[k], window, n), strict=True):
                column.append(x)
            done[k] += n * times
        window += times
    return {k: tuple(np.array(c, np.int64) for c in v) for k, v in out.items()}


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each row whose text has a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n = encoder(tokenizer).count(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(n.astype(np.int32))], names=["doc_id", "n_tokens"])

    ship(docs.sparkSession, tokenizer)
    return id_text(docs).where("text is not null and text <> ''").mapInArrow(count, "doc_id long, n_tokens int").where("n_tokens > 0")


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(window_id, n_tokens, pieces) for rows (doc_id, n_tokens); a piece is (doc_id, start, length) in tokens of its document."""
    spark = lengths.sparkSession
    if capacity < 1:
        raise ValueError("capacity must be positive")
    cut = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity))).alias("start"))
    cut = cut.select("doc_id", "start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start")).cast("int").alias("length"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, me), pa.int32()), pa.array(np.arange(at, at + b.num_rows))], names=["doc_id", "start", "length", "part", "place"])
            at += b.num_rows

    # A rank within each length: a range partitioning by length and doc_id, and the sizes of its parts.
    parts = max(n_partitions(spark), lengths.count() // PART_ROWS)
    ordered = cut.repartitionByRange(parts, "length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
    ordered = stage(ordered.mapInArrow(place, "doc_id long, start int, length int, part int, place long"), "ordered")
    sizes = {r[0]: r[1] for r in ordered.groupBy("part").count().collect()}
    histogram = {r[0]: r[1] for r in ordered.groupBy("length").count().collect()}
    offset, total = {}, 0
    for part in sorted(sizes):
        offset[part], total = total, total + sizes[part]
    first, total = {}, 0
    for length in sorted(histogram):
        first[length], total = total, total + histogram[length]
    shared = spark.sparkContext.broadcast((offset, first, _spread(plan_windows(histogram, capacity), histogram)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, first, spread = shared.value
        for b in batches:
            length, part = b.column(2).to_numpy(), b.column(3).to_numpy()
            rank = b.column(4).to_numpy().copy()
            window = np.empty(len(rank), np.int64)
            for p in np.unique(part):
                rank[part == p] += offset[p]
            order = np.argsort(length, kind="stable")
            values, cut = np.unique(length[order], return_index=True)
            for k, own in zip(values, np.split(order, cut[1:]), strict=True):
                begin, base, n = spread[int(k)]
                r = rank[own] - first[int(k)]
                at = np.searchsorted(begin, r, "right") - 1
                window[own] = base[at] + (r - begin[at]) // n[at]
            yield pa.record_batch([pa.array(window), *b.columns[:3]], names=["window_id", "doc_id", "start", "length"])

    placed = ordered.mapInArrow(assign, "window_id long, doc_id long, start int, length int")
    return placed.groupBy("window_id").agg(F.sum("length").cast("int").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("doc_id", "start", "length"))).alias("pieces"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    # Written once: the range partitioning of the pieces reads the lengths twice.
    return pack_lengths(stage(token_counts(docs, tokenizer), "lengths"), capacity)
