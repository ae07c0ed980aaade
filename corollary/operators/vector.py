"""Approximate vector search: bit signatures in bands, int8 re-ranking; for one query vector or for all rows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import scratch

BAND_BITS = 16


@dataclass(frozen=True)
class Basis:
    """A rotation of the leading principal directions, and the scale of the int8 form."""

    matrix: np.ndarray  # dimensions x bits
    scale: float


def _totals(blocks: DataFrame, work: Callable[[np.ndarray], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Sum of the matrices and maximum of the numbers that work makes of all blocks, added up on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = None, 0.0
        for b in batches:
            for raw, n in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own, top = work(np.frombuffer(raw.as_buffer(), np.float64).reshape(n, -1))
                total, most = own if total is None else total + own, max(most, top)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([most])], names=["total", "most"])

    parts = blocks.mapInArrow(partial, "total binary, most double").rdd.map(lambda r: (np.frombuffer(r[0]), r[1]))
    total, most = parts.treeReduce(lambda a, b: (a[0] + b[0], max(a[1], b[1])))
    side = round(len(total) ** 0.5)
    return total.reshape(side, side), most


def fit_basis(vectors: DataFrame, column: str, bits: int, rounds: int = 50, seed: int = 42) -> Basis:
    """Iterative quantisation, fitted on all vectors: the driver gets sums of dimensions x dimensions only."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            if len(x):
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()), pa.array([len(x)])], names=["block", "n"])

    # The rounds read packed blocks.
    packed = vectors.select(column).where(F.col(column).isNotNull()).mapInArrow(pack, "block binary, n long")
    table = scratch.write(packed, "vectors")
    if not table.rows:
        raise ValueError("no vectors")
    blocks = table.df(vectors.sparkSession)
    gram, most = _totals(blocks, lambda x: (x.T @ x, float(np.abs(x).max())))
    _, vec = np.linalg.eigh(gram)
    if bits > len(gram):
        raise ValueError("no more bits than dimensions")
    lead = vec[:, ::-1][:, :bits]
    # Signs of eigenvectors are free: fix them, so that a fit can be repeated.
    lead *= np.where(np.abs(lead).max(axis=0) == lead.max(axis=0), 1, -1)
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        now = rotation
        turned, _ = _totals(blocks, lambda x, r=now: (np.sign(x @ lead @ r).T @ (x @ lead), 0.0))
        u, _, w = np.linalg.svd(turned)
        rotation = (u @ w).T
        if np.abs(rotation - now).max() < 1e-12:  # no later round would change it
            break
    return Basis(lead @ rotation, float(127 / max(most, 1e-12)))


def scale_only(vectors: DataFrame, column: str) -> Basis:
    """The int8 form's scale, and 16 bits of no use: what an exact scan needs. One pass, one number."""
    most = vectors.agg(F.max(F.array_max(F.transform(column, lambda x: F.abs(x.cast("double"))))), F.max(F.size(column))).first()
    if most[1] is None or most[1] < 1:
        raise ValueError("no vectors")
    return Basis(np.zeros((most[1], BAND_BITS)), float(127 / max(most[0], 1e-12)))


def basis_table(spark: SparkSession, basis: Basis) -> DataFrame:
    """(place, row): the matrix's rows in order, and at -1 the scale."""
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(basis.matrix)] + [(-1, [basis.scale])], "place int, row array<double>")


def read_basis(table: DataFrame) -> Basis:
    rows = sorted((r[0], r[1]) for r in table.collect())  # a row for each dimension
    return Basis(np.array([r for _, r in rows[1:]]), rows[0][1][0])


def signature_bands(vector: Column, basis: Basis) -> Column:
    """Array of 16-bit band values: the signs of the projections, most significant bit first.

    A product with a matrix: Arrow batches and NumPy, since as column expressions it is one lambda for each bit.
    """
    matrix = basis.matrix
    size = -(-matrix.shape[1] // BAND_BITS)

    @F.pandas_udf("array<int>")
    def bands(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        bits = np.stack(v.to_numpy()).astype(float) @ matrix >= 0
        bits = np.pad(bits, ((0, 0), (0, size * BAND_BITS - bits.shape[1]))).reshape(len(bits), size, BAND_BITS)
        return pd.Series(list((bits * (1 << np.arange(BAND_BITS - 1, -1, -1))).sum(axis=2).astype(np.int32)))

    return bands(vector)


def quantised(vector: Column, basis: Basis) -> Column:
    """int8 components (as integers), rounded half away from zero, clipped to +-127."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * basis.scale).cast("int"))))


def encode(vectors: DataFrame, id_column: str, column: str, basis: Basis) -> DataFrame:
    """(entity, bands, q)."""
    return vectors.select(F.col(id_column).alias("entity"), signature_bands(F.col(column), basis).alias("bands"), quantised(F.col(column), basis).alias("q"))


def band_table(encoded: DataFrame) -> DataFrame:
    """(band, value, entity)."""
    return encoded.select("entity", F.posexplode("bands").alias("band", "value")).select("band", "value", "entity")


def candidates(bands: DataFrame, query: list[int], k: int | None, radius: int, entities: DataFrame | None = None) -> DataFrame:
    """(entity, score): entities of which some band is within radius // bands bits of the query's, by bands matched, then entity."""
    budget = radius // len(query)
    if budget == 0:  # equality reaches the scan
        near = bands.where(F.expr(" or ".join(f"(band = {i} and value = {int(q)})" for i, q in enumerate(query))))
    else:
        wanted = F.get(F.array(*(F.lit(int(q)) for q in query)), F.col("band"))
        near = bands.where(F.bit_count(F.col("value").bitwiseXOR(wanted)) <= budget)
    if entities is not None:
        near = near.join(entities.select(F.col(entities.columns[0]).alias("entity")).distinct(), "entity", "left_semi")
    out = near.groupBy("entity").agg(F.count(F.lit(1)).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "entity").limit(k)


def rerank(encoded: DataFrame, query: list[int], found: DataFrame, k: int | None = None) -> DataFrame:
    """(entity, dot) of the candidates that have a vector, by dot / floor(norm), then entity; zero vectors last."""
    q = F.array(*(F.lit(int(x)) for x in query))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    dot = total(F.zip_with("q", q, lambda a, b: (a * b).cast("long")))
    norm = total(F.transform("q", lambda a: (a * a).cast("long")))
    out = encoded.join(found.select("entity"), "entity", "left_semi").select("entity", dot.alias("dot"), F.floor(F.sqrt(norm.cast("double"))).alias("norm"))
    key = F.when(F.col("norm") > 0, F.col("dot") / F.col("norm"))
    ordered = out.orderBy(F.desc_nulls_last(key), "entity")
    return (ordered if k is None else ordered.limit(k)).select("entity", "dot")


def vector_search(encoded: DataFrame, query_bands: list[int], query_q: list[int], k: int, radius: int = 2, entities: DataFrame | None = None) -> DataFrame:
    """All candidates, re-ranked."""
    return rerank(encoded, query_q, candidates(band_table(encoded), query_bands, None, radius, entities), k)


def hybrid_search(encoded: DataFrame, lexical: DataFrame, query_bands: list[int], query_q: list[int], k: int, radius: int = 2) -> DataFrame:
    """All vector candidates that a lexical search (entity, ..) found too, re-ranked."""
    return vector_search(encoded, query_bands, query_q, k, radius, lexical)


# Every row of a table as a query. The table is cut into blocks, and each pair of blocks is one task.

BLOCKS, BLOCK_ROWS = 8, (1024, 1 << 17)  # blocks of a table, unless their rows are outside these bounds
PAIR_ROWS = (1024, 2048)  # the same where all pairs of a task are returned
CELL = 1 << 20  # pairs that a task looks at together


def _cells(queries: DataFrame, entities: DataFrame, work: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: str, rows: tuple[int, int], *columns: Column) -> DataFrame:
    """work on every pair of a block of queries and one of entities, both (entity, columns)."""
    n = [df.count() for df in (queries, entities)]
    size = [min(rows[1], max(rows[0], -(-x // BLOCKS))) for x in n]
    many = [max(1, -(-x // y)) for x, y in zip(n, size, strict=True)]
    sides = []
    for df, own in ((queries, 0), (entities, 1)):
        names = ("x", "y") if own == 0 else ("y", "x")
        block = F.pmod(F.xxhash64("entity"), F.lit(many[own])).cast("int").alias(names[0])
        other = F.explode(F.sequence(F.lit(0), F.lit(many[1 - own] - 1))).alias(names[1])
        narrow = df.select(F.col("entity").alias("entity"), *columns, block)  # aliases: both sides may come from one table
        # The number is given, since adaptive execution would join small partitions, whatever their work is.
        sides.append(narrow.select("*", other).repartition(min(many[0] * many[1], 20_000), "x", "y"))
    return sides[0].groupBy("x", "y").cogroup(sides[1].groupBy("x", "y")).applyInArrow(lambda left, right: pa.concat_tables(work(left, right)), schema)


def _matrix(table: pa.Table, column: str, kind: type) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(kind)


def _bands_met(left: np.ndarray, right: np.ndarray, budget: int) -> np.ndarray:
    """Queries x entities: how many bands are within budget bits of each other."""
    met = np.zeros((len(left), len(right)), np.uint8)
    for j in range(left.shape[1]):
        met += np.bitwise_count(left[:, j, None] ^ right[None, :, j]) <= budget
    return met


def candidate_pairs(encoded: DataFrame, radius: int, entities: DataFrame | None = None) -> DataFrame:
    """(query, entity, score): the candidates of every row of encoded, all of them, among entities (encoded unless given)."""

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        yield pa.table({"query": pa.array([], pa.int64()), "entity": pa.array([], pa.int64()), "score": pa.array([], pa.int32())})
        if not left.num_rows or not right.num_rows:
            return
        a, b = _matrix(left, "bands", np.uint16), _matrix(right, "bands", np.uint16)
        one, other = left.column("entity").to_numpy(), right.column("entity").to_numpy()
        step = max(1, CELL // len(b))
        for i in range(0, len(a), step):
            met = _bands_met(a[i : i + step], b, radius // a.shape[1])
            x, y = np.nonzero(met)
            yield pa.table({"query": one[i + x], "entity": other[y], "score": met[x, y].astype(np.int32)})

    return _cells(encoded, encoded if entities is None else entities, work, "query long, entity long, score int", PAIR_ROWS, F.col("bands").alias("bands"))


def search_rows(encoded: DataFrame, k: int, radius: int | None, entities: DataFrame | None = None) -> DataFrame:
    """(query, entity, dot): for every row of encoded the k best of its candidates (of all entities without radius), in the order of `rerank`."""

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        yield pa.table({"query": pa.array([], pa.int64()), "entity": pa.array([], pa.int64()), "dot": pa.array([], pa.int64()), "key": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return
        right = right.sort_by("entity")
        a, b = _matrix(left, "bands", np.uint16), _matrix(right, "bands", np.uint16)
        wide = np.float32 if len(right.column("q")[0]) * 127 * 127 < 1 << 24 else np.float64  # dot products stay exact
        p, q = _matrix(left, "q", wide), _matrix(right, "q", wide)
        norm = np.floor(np.sqrt((q.astype(float) ** 2).sum(axis=1)))
        one, other = left.column("entity").to_numpy(), right.column("entity").to_numpy()
        step = max(1, CELL // len(b))
        for i in range(0, len(a), step):
            dot = p[i : i + step] @ q.T
            key = np.where(norm > 0, dot / np.maximum(norm, 1), -1e300)  # zero vectors last
            if radius is not None:
                key[_bands_met(a[i : i + step], b, radius // a.shape[1]) == 0] = -np.inf
            least = np.partition(key, -k, axis=1)[:, -k] if key.shape[1] > k else np.full(len(key), -np.inf)
            x, y = np.nonzero((key >= least[:, None]) & (key > -np.inf))
            order = np.lexsort((y, -key[x, y], x))
            x, y = x[order], y[order]
            keep = np.arange(len(x)) - np.searchsorted(x, x) < k
            x, y = x[keep], y[keep]
            yield pa.table({"query": one[i + x], "entity": other[y], "dot": dot[x, y].astype(np.int64), "key": key[x, y]})

    best = _cells(encoded, encoded if entities is None else entities, work, "query long, entity long, dot long, key double", BLOCK_ROWS, F.col("bands").alias("bands"), F.col("q").cast("array<tinyint>").alias("q"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("key"), "entity"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("query", "entity", "dot")
