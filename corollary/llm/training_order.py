"""Training-order materialisation: token sequences at permuted slots of fixed-stride binary shards.

Texts are tokenised, each followed by an end token, and joined in the order of the input's partitions
and rows into one stream, which is cut into sequences of `length` tokens; the last one is filled up
with end tokens. A keyed Feistel network with cycle-walking permutes the numbers 0..n-1 of the
sequences: it is a bijection that any task evaluates alone, for any n, in constant memory. A sequence's
image is its slot. Shard s holds the slots from s * per_shard on, `length` little-endian unsigned 16-bit
ids each, so slot t is at byte (t mod per_shard) * length * 2 of shard t // per_shard: reads are
sequential and resume anywhere. Shards are written under another name and then renamed: a task that
runs again leaves the same bytes.

The input is tokenised twice, which is cheaper than keeping the ids: first for the number of tokens of
each partition, one number and a check sum each, whose running sums tell where a partition's stream
begins; then to send the ids to their slots. The second pass raises if it doesn't meet the first one's
check sum; an input that isn't a plain scan with filters and projections, so that its rows may move, is
written to the shared folder first. A document that runs over the end of a sequence sends its pieces to the slots of both.

Defined results: null and empty texts have no token and no place; rows that share a doc_id, and repeated
rows, all count; a null doc_id is listed as null; an empty table gives no sequence and no shard; further
columns are ignored; a text of any length is cut over as many sequences as it takes; there are no ties, as
the order is that of partitions and rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, n_partitions, scratch_root, ship, stage
from .textops import U, mix, pieces
from .tokens import TOKENIZER, encoder

LENGTH, PER_SHARD, KEY, END, ROUNDS = 1024, 16_384, 0x5EED, 2, 4
TASK_BYTES = 256 << 20  # of shards that one task writes, unless one shard is larger
_FIXED = {"Project", "Filter", "LogicalRelation", "LocalRelation", "Union"}  # plans that give the same rows in the same places again


def _replays(plan) -> bool:
    """Whether an optimised plan is made of _FIXED nodes alone."""
    below = plan.children()
    return plan.getClass().getSimpleName() in _FIXED and plan.deterministic() and all(_replays(below.apply(i)) for i in range(below.size()))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Images of x under the permutation of 0..n-1 that key names; inverse takes slots back to sequence numbers."""
    half = _half_bits(n)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) ^ U(key & 0xFFFFFFFFFFFFFFFF))
    out = np.asarray(x).astype(U)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> U(half), out[walk] & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (mix(left ^ keys[r]) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ keys[r]) & mask)
        out[walk] = (left << U(half)) | right
        walk = walk[out[walk] >= U(n)]  # outside the domain: once more, until inside
    return out.astype(np.int64)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_sequences(path: str, first: int, count: int, length: int = LENGTH) -> np.ndarray:
    """count x length ids of a shard, from its first-th sequence on; nothing else is read."""
    system, at = _filesystem(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_at(count * length * 2, first * length * 2), "<u2").reshape(-1, length)


def materialise(docs: DataFrame, folder: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Writes the shards and returns (slot, seq, shard, offset, doc_ids, check): each sequence's place, the documents in it, and a hash of its bytes."""
    spark = docs.sparkSession
    if length < 1 or per_shard < 1:
        raise ValueError("length and per_shard must be positive")
    folder = folder or f"{scratch_root(spark)}/shards-{uuid.uuid4().hex}"

    base = id_text(docs).where("text is not null and text <> ''")
    if not _replays(base._jdf.queryExecution().optimizedPlan()):
        base = stage(base, "docs")
    ship(spark, tokenizer)

    def check_sum(check: int, n: np.ndarray) -> int:
        return zlib.crc32(n.tobytes(), check)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = check = 0
        for b in pieces(batches):
            n = encoder(tokenizer).count(b.column(1)) + 1
            total, check = total + int(n.sum()), check_sum(check, n)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64()), pa.array([check], pa.int64())], names=["part", "n", "check"])

    offset, total = {}, 0
    for part, n, check in sorted(base.mapInArrow(count, "part int, n long, check long").collect()):
        offset[part], total = (total, check), total + n
    n_seq = -(-total // length)
    shared = spark.sparkContext.broadcast(offset)
    n_shards = -(-n_seq // per_shard)
    n_parts = max(1, min(n_shards, max(n_partitions(spark), -(-n_seq * length * 2 // TASK_BYTES))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, expected = shared.value[TaskContext.get().partitionId()]
        check = 0
        for b in pieces(batches):
            doc = b.column(0)
            ids, n = encoder(tokenizer).encode(b.column(1), end)
            check = check_sum(check, n)
            begin = at + np.cumsum(n) - n
            first = begin // length
            many = (begin + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), many)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            lo, hi = np.maximum(seq * length, begin[row]), np.minimum((seq + 1) * length, begin[row] + n[row])
            edges = np.append(lo, hi[-1]) - at if len(row) else np.zeros(1, np.int64)
            slot = permute(seq, n_seq, key)
            shard = slot // per_shard
            cuts = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            at += int(n.sum())
            yield pa.record_batch(
                [pa.array((shard * n_parts // n_shards).astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(slot), pa.array((lo - seq * length).astype(np.int32)), pa.array(seq), doc.take(pa.array(row)), cuts],
                names=["part", "shard", "slot", "at", "seq", "doc_id", "ids"],
            )
        if check != expected:
            raise RuntimeError("the input's rows moved between the passes; write it to a table first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        out = name = None
        now: tuple[int, int, int] | None = None
        own: list[bytes] = []
        ids: list = []
        ready: list[tuple] = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                system.move(f"{name}.{attempt}", name)
                out = None

        def finish():
            raw = b"".join(own)
            raw += np.full(length - len(raw) // 2, end, "<u2").tobytes()
            out.write(raw)
            data = np.frombuffer(raw, "<u2").astype(U)
            check = int(mix((mix(data + U(1)) * (np.arange(length, dtype=U) * U(2) + U(1))).sum(keepdims=True)).view(np.int64)[0])
            ready.append((now[1], now[2], now[0], (now[1] % per_shard) * length * 2, list(dict.fromkeys(ids)), check))

        def rows():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), kinds, strict=True)], names=["slot", "seq", "shard", "offset", "doc_ids", "check"])

        attempt = f"{TaskContext.get().taskAttemptId()}.part"
        for b in batches:
            for shard, slot, seq, doc, raw in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                if now is None or slot != now[1]:
                    if now is not None:
                        finish()
                        if shard != now[0]:
                            close()
                    if out is None:
                        name = f"{root}/shard-{shard:08d}.bin"
                        out = system.open_output_stream(f"{name}.{attempt}")
                    now, own, ids = (shard, slot, seq), [], []
                own.append(raw)
                ids.append(doc)
            if ready:
                yield rows()
                ready.clear()
        if now is not None:
            finish()
            close()
            yield rows()

    schema = "slot long, seq long, shard int, offset long, doc_ids array<long>, check long"
    if not n_seq:
        return spark.createDataFrame([], schema)
    # Part p has the p-th range of shards: a shard is one task's, and sorting makes its writes sequential.
    cuts = base.mapInArrow(cut, "part int, shard int, slot long, at int, seq long, doc_id long, ids binary")
    placed = cuts.repartitionById(n_parts, F.col("part")).drop("part").sortWithinPartitions("shard", "slot", "at")
    return stage(placed.mapInArrow(write, schema), "manifest")
