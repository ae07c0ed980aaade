"""Order statistics and ordered access; tuples are ordered by their columns, in a given order of these."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _columns(df: DataFrame, perm: Sequence[int] | None) -> list[str]:
    if perm is None:
        return df.columns
    if sorted(perm) != list(range(len(df.columns))):
        raise ValueError(f"{list(perm)} isn't an order of {len(df.columns)} columns")
    return [df.columns[i] for i in perm]


def _check(df: DataFrame, tuple_: Sequence) -> None:
    if len(tuple_) != len(df.columns):
        raise ValueError(f"the relation has {len(df.columns)} columns")


def before(names: Sequence[str], values: Sequence, strict: bool = True) -> Column:
    """The tuple comes before values (or equals them): lexicographic, as conjunctions of comparisons, of which the first reaches the scan."""
    out = F.lit(not strict)
    for n, v in reversed(list(zip(names, values, strict=True))):
        out = (F.col(n) < F.lit(v)) | ((F.col(n) == F.lit(v)) & out)
    return (F.col(names[0]) <= F.lit(values[0])) & out if names else out


def within(df: DataFrame, leading: Sequence = ()) -> DataFrame:
    """Tuples that begin with the values given."""
    if len(leading) > len(df.columns):
        raise ValueError(f"the relation has {len(df.columns)} columns")
    return reduce(lambda d, cv: d.where(F.col(cv[0]) == F.lit(cv[1])), zip(df.columns, leading, strict=False), df)


def count(df: DataFrame, leading: Sequence = ()) -> DataFrame:
    return within(df, leading).agg(F.count(F.lit(1)).alias("n"))


def rank(df: DataFrame, tuple_: Sequence, leading: Sequence = (), perm: Sequence[int] | None = None) -> DataFrame:
    """(rank): how many tuples come before the one given, which need not be there."""
    _check(df, tuple_)
    names = _columns(df, perm)
    values = [tuple_[df.columns.index(n)] for n in names]
    return within(df, leading).where(before(names, values)).agg(F.count(F.lit(1)).alias("rank"))


def range_count(df: DataFrame, low: Sequence, high: Sequence, leading: Sequence = (), perm: Sequence[int] | None = None) -> DataFrame:
    """(n): tuples from low on and before high."""
    _check(df, low)
    _check(df, high)
    names = _columns(df, perm)
    at = lambda t: [t[df.columns.index(n)] for n in names]
    return within(df, leading).where(before(names, at(high)) & ~before(names, at(low))).agg(F.count(F.lit(1)).alias("n"))


FEW, CUTS = 100_000, 16  # tuples that are sorted to find one; ranges into which the others are counted


def select(df: DataFrame, k: int, leading: Sequence = (), perm: Sequence[int] | None = None) -> DataFrame:
    """The tuple of rank k; raises if there are no more than k.

    Ranges cut at sampled tuples are counted in one scan, and only the one that holds rank k is looked into
    further: no shuffle of the relation, and the driver gets the counts of CUTS ranges and one tuple.
    """
    if k < 0:
        raise IndexError(k)
    names, own = _columns(df, perm), within(df, leading)
    n = own.count()
    if k >= n:
        raise IndexError(f"the relation has no tuple of rank {k}")
    at = k
    while n > FEW:
        # Bounded by the fraction: some 4000 tuples, whatever n is.
        sample = sorted(tuple(r) for r in own.select(*names).sample(min(1.0, 4000 / n), 17).limit(8000).collect())
        cuts = sorted(set(sample[:: max(1, len(sample) // CUTS)]))
        if not cuts:
            break
        part = reduce(lambda a, b: a + b, [(~before(names, c)).cast("int") for c in cuts])
        found = {r[0]: r[1] for r in own.groupBy(part.alias("part")).count().collect()}
        i = 0
        while at >= found.get(i, 0):
            at -= found.get(i, 0)
            i += 1
        if found[i] == n:
            break
        n = found[i]
        if i > 0:
            own = own.where(~before(names, cuts[i - 1]))
        if i < len(cuts):
            own = own.where(before(names, cuts[i]))
    return own.orderBy(*names).offset(at).limit(1)


def with_rank(df: DataFrame, by: Sequence[str] = (), perm: Sequence[int] | None = None, parts: int | None = None) -> DataFrame:
    """Every tuple with its rank, within the groups of columns by.

    Without groups a global order is needed: ranges are sorted apart, and each is raised by the sizes of
    those before it, so no task sees more than its range.
    """
    names = _columns(df, perm)
    if by:
        return df.withColumn("rank", (F.row_number().over(Window.partitionBy(*by).orderBy(*names)) - 1).cast("long"))
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range of a tuple is found once, in a written table: a second sampling could cut differently.
    from ..store import scratch

    ranged = scratch.write(df.repartitionByRange(parts, *names).withColumn("__part", F.spark_partition_id()), "ranges").df(spark)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("__part").count().collect())
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    offsets = spark.createDataFrame(base, "__part int, __base long")
    local = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*names)) - 1)
    return local.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__row") + F.col("__base")).cast("long").alias("rank"))


def cursor(df: DataFrame, leading: Sequence = (), seek: Sequence | None = None, perm: Sequence[int] | None = None) -> DataFrame:
    """Tuples in ascending order, from seek on if given."""
    names = _columns(df, perm)
    out = within(df, leading)
    if seek is not None:
        values = [seek[df.columns.index(n)] for n in names if df.columns.index(n) < len(seek)]
        known = [n for n in names if df.columns.index(n) < len(seek)]
        out = out.where(~before(known, values))
    return out.orderBy(*names)


def iterate(df: DataFrame, **options) -> Iterator:
    """Rows of the cursor, one partition at a time at the driver."""
    return cursor(df, **options).toLocalIterator()


def merge_join(left: DataFrame, right: DataFrame, on: int, how_sorted: bool = True) -> DataFrame:
    """Pairs of tuples that agree in their first `on` columns, by a sort-merge join, in order; (l0.., r0..)."""
    if not 0 < on <= min(len(left.columns), len(right.columns)):
        raise ValueError("join columns must be leading columns of both")
    l = left.toDF(*(f"l{i}" for i in range(len(left.columns))))  # noqa: E741
    r = right.toDF(*(f"r{i}" for i in range(len(right.columns))))
    out = l.join(r.hint("merge"), reduce(lambda a, b: a & b, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(on)]))
    return out.orderBy(*out.columns) if how_sorted else out
