"""Plumbing shared by the training-data operators: scratch tables, fresh names, size-checked joins."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import scratch

#: A join side is broadcast only when it has been counted and has at most so many rows of a few longs.
BROADCAST_ROWS = 250_000


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one that spark.checkpoint.dir names."""
    return scratch.root(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in staged:
        scratch.drop(df.sparkSession, df.staged_at)


def ship(spark: SparkSession, path: str) -> str:
    """Gives a file of the driver to all executors; its name, for `shipped`."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def shipped(path: str) -> str:
    """Where a file given by `ship` is on this machine."""
    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't use."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{base}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{base}{k}"
    return name


def need(df: DataFrame, *names: str) -> None:
    """Raises early, and by name, when a column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): whatever else the table holds, and however it is named, stays out of the operator."""
    need(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted size allows, otherwise as it is (a shuffle join follows)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Bits of a sieve at most, as a power of two (16 MB), and of one of its pages.
SIEVE_BITS, PAGE_BITS = 27, 15


def sieve(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bit table (page, words) of n keys, one column of mixed longs, and the power of two of its bits.

    It has 16 bits a key and 16 MB at most, so it is broadcast whatever n is: of rows without a key one in 16
    passes it at that, and more beyond 8 million keys. What it holds back certainly has no key.
    """
    bits = int(min(max(PAGE_BITS, np.ceil(np.log2(16 * max(n, 1)))), SIEVE_BITS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            low = np.sort(b.column(0).to_numpy())
            page = low >> PAGE_BITS
            cut = np.flatnonzero(np.append(True, page[1:] != page[:-1])) if len(low) else np.zeros(0, np.int64)
            for i, j in zip(cut, [*cut[1:], len(low)], strict=True):
                at = low[i:j] & ((1 << PAGE_BITS) - 1)
                words = pages.setdefault(int(page[i]), np.zeros(1 << (PAGE_BITS - 6), np.uint64))
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        for page, words in pages.items():
            yield pa.record_batch([pa.array([page], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words.view(np.int64)))], names=["page", "words"])

    low = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("low"))
    parted = low.repartition(n_partitions(keys.sparkSession), F.shiftright("low", PAGE_BITS))
    return stage(parted.mapInArrow(build, "page int, words array<long>"), "sieve"), bits


def sifted(df: DataFrame, key: str, table: tuple[DataFrame, int], how: str) -> DataFrame:
    """The rows of df whose key may be one of the sieve's ("left_semi"), or those whose key isn't ("left_anti")."""
    page, words = fresh(df, "page"), fresh(df, "words")
    low = df[key].bitwiseAND(F.lit((1 << table[1]) - 1))
    bit = F.getbit(F.get(F.col(words), F.shiftright(low.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)), 6).cast("int")), low.bitwiseAND(F.lit(63)).cast("int"))
    return df.join(F.broadcast(table[0].toDF(page, words)), (F.shiftright(low, PAGE_BITS).cast("int") == F.col(page)) & (bit == 1), how)


def met(df: DataFrame, other: DataFrame, on: list[str], how: str, n: int | None = None) -> DataFrame:
    """df joined to other (null keys meet none): "left", "left_semi" or "left_anti". Beyond the counted limit of a broadcast, only the rows that a sieve lets pass are shuffled."""
    n = other.count() if n is None else n
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(other), on, how)
    key = fresh(df, "key")
    table = sieve(other.select(F.xxhash64(*on)), n)
    tagged = df.withColumn(key, F.xxhash64(*on))
    near = sifted(tagged, key, table, "left_semi").drop(key).join(other, on, how)
    return near if how == "left_semi" else near.unionByName(sifted(tagged, key, table, "left_anti").drop(key), allowMissingColumns=True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
