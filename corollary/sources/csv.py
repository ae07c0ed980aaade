"""Headerless CSV: digits are integers, everything else strings; quotes are stripped, without escapes or line breaks inside.

A column is of integers if all of its values are, else of strings. Rows of another width than the
relation's, with no field, or with an integer beyond 2**32 - 1 are skipped, and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import MAX_ARITY


def fields(line: Column) -> Column:
    """The fields of a line, trimmed, without their quotes."""
    # With a separator after the last field too, all fields end alike.
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'\s*("[^"]*"\s*|[^,]*),'), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value")).where(F.trim("value") != "").select(fields(F.col("value")).alias("f"))


def width(spark: SparkSession, path: str) -> int:
    """Fields of the first line that isn't empty."""
    first = _lines(spark, path).first()
    if first is None:
        raise ValueError(f"{path} has no line")
    return len(first[0])


def is_int(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z")


def too_big(c: Column) -> Column:
    digits = F.regexp_replace(c, "^0+(?=.)", "")
    return is_int(c) & ((F.length(digits) > 10) | ((F.length(digits) == 10) & (F.lpad(digits, 10, "0") > F.lit("4294967295"))))


def _typed(rows: DataFrame, n: int) -> DataFrame:
    ints = rows.agg(*(F.coalesce(F.min(is_int(F.get("f", F.lit(i))).cast("int")), F.lit(0)).alias(f"c{i}") for i in range(n))).first()
    return rows.select(*((F.get("f", F.lit(i)).cast("long") if ints[i] else F.get("f", F.lit(i))).alias(f"c{i}") for i in range(n)))


def read_fixed(spark: SparkSession, path: str, arity: int) -> tuple[DataFrame, dict[str, int]]:
    rows = _lines(spark, path)
    good = (F.size("f") == arity) & ~F.exists("f", too_big)
    n = rows.agg(F.count(F.lit(1)), F.count_if(good)).first()
    return _typed(rows.where(good), arity), {"rows": n[0], "skipped": n[0] - n[1]}


def read_variadic(spark: SparkSession, path: str) -> tuple[list[DataFrame], dict[str, int]]:
    rows = _lines(spark, path)
    good = F.size("f").between(1, MAX_ARITY) & ~F.exists("f", too_big)
    n = rows.agg(F.count(F.lit(1)), F.count_if(good)).first()
    widths = sorted(r[0] for r in rows.where(good).select(F.size("f")).distinct().collect())
    return [_typed(rows.where(good & (F.size("f") == w)), w) for w in widths], {"rows": n[0], "skipped": n[0] - n[1]}
