"""Exact deduplication by counting quotient filters.

Every input partition folds the 64-bit fingerprints of its texts into counting quotient filters,
one for each shard of the quotient space. Filters of one shard are merged by walking their sorted
remainders, which loses nothing: a filter stores all 64 bits of a fingerprint (the quotient by
place, the remainder by value) and its count. Fingerprints with a count above one route their
rows, and no others, to a comparison of the texts' bytes.

Defined results: a null text is never a duplicate; empty texts are texts like any other; of equal
texts the row with the least doc_id stays (null ids last, ties by the other orderable columns),
so a repeated row counts as a copy of itself, and rows equal in all of these are one; an empty table
gives an empty table; a text of any length is compared byte by byte; further columns of any name are
carried along untouched. All operators read doc_id as a long: one that isn't a number raises in the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_text, n_partitions, need, small, stage

U = np.uint64


class CountingQuotientFilter:
    """2**q home slots; entries of a quotient form a run of sorted remainders, shifted right past full slots.

    occupied marks quotients that have a run, run_end marks the last slot of each run; an entry
    with a count above one has it in a side vector that runs parallel to the marked slots.
    """

    def __init__(self, q: int, occupied: np.ndarray, run_end: np.ndarray, used: np.ndarray, remainder: np.ndarray, many: np.ndarray, count: np.ndarray):
        self.q, self.occupied, self.run_end, self.used, self.remainder, self.many, self.count = q, occupied, run_end, used, remainder, many, count

    @classmethod
    def build(cls, fp: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From fingerprints, repeated ones included, or from distinct ones with their counts."""
        if counts is None:
            fp, counts = np.unique(fp, return_counts=True)
        else:
            order = np.argsort(fp)
            fp, counts = fp[order], counts[order]
            first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
            fp, counts = fp[first], np.add.reduceat(counts, first) if len(first) else counts
        n = len(fp)
        q = max(1, int(np.ceil(np.log2(max(n, 1) / 0.85 + 1))))
        quotient = (fp >> U(64 - q)).astype(np.int64)
        # Linear probing of sorted entries: each sits at its quotient, or right after its predecessor.
        slot = np.maximum.accumulate(quotient - np.arange(n)) + np.arange(n) if n else np.zeros(0, np.int64)
        size = max(1 << q, int(slot[-1]) + 1 if n else 0)
        occupied, run_end, used = np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool)
        occupied[quotient] = True
        used[slot] = True
        if n:
            run_end[slot[np.append(quotient[1:] != quotient[:-1], True)]] = True
        many = counts > 1
        return cls(q, occupied, run_end, used, fp << U(q) >> U(q), many, counts[many].astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order, and their counts."""
        ends = self.run_end[np.flatnonzero(self.used)]
        run = np.cumsum(ends) - ends
        fp = (np.flatnonzero(self.occupied)[run].astype(U) << U(64 - self.q)) | self.remainder if len(run) else np.zeros(0, U)
        counts = np.ones(len(fp), np.int64)
        counts[self.many] = self.count
        return fp, counts

    def get(self, fp: int) -> int:
        """The count of one fingerprint: its run is found by rank and select on the two bit vectors."""
        quotient = fp >> (64 - self.q)
        if not self.occupied[quotient]:
            return 0
        rank = int(self.occupied[: quotient + 1].sum())
        ends = np.flatnonzero(self.run_end[np.flatnonzero(self.used)])
        lo, hi = (int(ends[rank - 2]) + 1 if rank > 1 else 0), int(ends[rank - 1]) + 1
        at = lo + int(np.searchsorted(self.remainder[lo:hi], U(fp & ((1 << (64 - self.q)) - 1))))
        if at == hi or int(self.remainder[at]) != fp & ((1 << (64 - self.q)) - 1):
            return 0
        return int(self.count[int(self.many[:at].sum())]) if self.many[at] else 1

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Runs come out sorted, so a merge is one pass over sorted remainders; counts of equal fingerprints add up."""
        parts = [f.items() for f in filters]
        return cls.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else cls.build(np.zeros(0, U))

    def to_bytes(self) -> bytes:
        width = (64 - self.q + 7) // 8
        rem = self.remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.q, len(self.used), len(self.remainder), len(self.count)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.used, self.many)) + rem.tobytes() + self.count.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, size, n, m = (int(x) for x in np.frombuffer(raw, "<i8", 4))
        at, bits = 32, []
        for length in (1 << q, size, size, n):
            k = (length + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, k, at), count=length).astype(bool))
            at += k
        width = (64 - q + 7) // 8
        rem = np.zeros((n, 8), np.uint8)
        rem[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        count = np.frombuffer(raw, "<i8", m, at + n * width)
        return cls(q, bits[0], bits[1], bits[2], rem.view("<u8").ravel(), bits[3], count)


def repeated_fingerprints(fingerprints: DataFrame, shards: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once. Input: one long column without nulls."""
    bits = max(0, (shards - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0

        def flush():
            fp, counts = np.unique(np.concatenate(seen), return_counts=True)
            shard = (fp >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), np.int64)
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            # Within a shard the leading bits are the same; they go to the end, so that quotients spread.
            own = [CountingQuotientFilter.build(fp[a:b] << U(bits), counts[a:b]).to_bytes() for a, b in zip(cut, [*cut[1:], len(fp)], strict=True)]
            return pa.record_batch([pa.array(shard[cut], pa.int32()), pa.array(own, pa.binary())], names=["shard", "filter"])

        for b in batches:
            seen.append(b.column(0).to_numpy().view(U))
            held += b.num_rows
            if held >= 4_000_000:
                yield flush()
                seen, held = [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []

        def done():
            fp, counts = CountingQuotientFilter.merge(own).items()
            more = counts > 1
            full = (fp[more] >> U(bits)) | (U(now) << U(64 - bits)) if bits else fp[more]
            return pa.record_batch([pa.array(full.view(np.int64)), pa.array(counts[more], pa.int64())], names=["fp", "n"])

        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != now:
                    if own:
                        yield done()
                    now, own = shard, []
                own.append(CountingQuotientFilter.from_bytes(raw))
                if len(own) == 64:  # merged as they come: memory follows the shard, not the number of partitions
                    own = [CountingQuotientFilter.merge(own)]
        if own:
            yield done()

    built = fingerprints.mapInArrow(build, "shard int, filter binary")
    return built.repartition(n_partitions(fingerprints.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(merge, "fp long, n long")


def _suspects(docs: DataFrame, fp: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs with their fingerprints, and the fingerprints that occur twice (counted and, if small, hinted)."""
    tagged = docs.withColumn(fp, F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))))
    shards = 1 << max(0, (n_partitions(docs.sparkSession) - 1).bit_length())
    twice = stage(repeated_fingerprints(tagged.where(F.col(fp).isNotNull()).select(fp), shards).select(F.col("fp").alias(fp)), "repeated")
    return tagged, small(twice)


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id, n_copies): a row for each document that an equal one with a lesser doc_id stands for."""
    base = id_text(docs)
    tagged, twice = _suspects(base, "fp")
    rows = tagged.join(twice, "fp", "left_semi")
    groups = (
        rows.groupBy("fp", "text").agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("n_copies"))
        .where("n_copies > 1")
    )
    every = rows.groupBy("fp", "text", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    out = every.join(groups, ["fp", "text"]).where("not (doc_id <=> kept_doc_id) or times > 1")
    again = F.when(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")), F.col("times") - 1).otherwise(F.col("times"))
    return out.select("doc_id", "kept_doc_id", "n_copies", F.explode(F.sequence(F.lit(1), again.cast("int"))).alias("_")).drop("_")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without exact copies, with all of its columns."""
    need(docs, "doc_id", "text")
    fp = fresh(docs, "fp")
    tagged, twice = _suspects(docs, fp)
    single = tagged.join(twice, fp, "left_anti").drop(fp)
    cols = docs.columns
    order = [F.col("doc_id").isNull(), *(F.col(f"`{f.name}`") for f in sorted(docs.schema.fields, key=lambda f: f.name != "doc_id") if _orderable(f.dataType) and f.name != "text")]
    row = fresh(docs, "row")
    kept = (
        tagged.join(twice, fp, "left_semi")
        .groupBy(fp, "text")
        .agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in cols if c != "text")), F.struct(*order)).alias(row))
        .select(*(F.col("text") if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in cols))
    )
    return single.unionByName(kept)
