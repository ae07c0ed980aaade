"""Validated loading of typed relations from CSV (with header) and JSON (array of objects).

Every cell is checked by column expressions; rows that fail are reported by file, place and column, and
nothing is loaded then. CSV: line numbers count from 1, the header included. JSON: elements count from 0.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regex
from . import csv
from .schema import ColumnType, TypedRelation

MAX_U32, REPORTED, MOST_ITEMS = (1 << 32) - 1, 20, 64


class LoadError(ValueError):
    """problems: path:place:column: message."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


def _whole(c: Column, low: int, high: int, sign: bool = False) -> tuple[Column, Column]:
    ok = c.rlike(r"\A[+-]?[0-9]+\z" if sign else r"\A[0-9]+\z")
    value = F.when(ok, c.try_cast("decimal(38,0)"))
    inside = value.between(low, high)
    return F.when(inside, value.cast("long")), F.coalesce(ok & inside, F.lit(False))


def _bounded(value: Column, good: Column, number: Column, t: ColumnType) -> tuple[Column, Column]:
    if t.low is not None:
        good = good & F.coalesce(number >= t.low, F.lit(False))
    if t.high is not None:
        good = good & F.coalesce(number <= t.high, F.lit(False))
    return value, good


def value(c: Column, t: ColumnType) -> tuple[Column, Column]:
    """The typed value of a cell, and whether it is one. A null cell is an absent optional value."""
    if t.kind == "Optional":
        v, ok = value(c, ColumnType(t.elem))
        return v, c.isNull() | ok
    if t.kind == "List":
        items = F.from_json(c, "array<string>")
        pairs = F.transform(items, lambda x: F.struct(*(a.alias(n) for a, n in zip(value(x, ColumnType(t.elem)), ("v", "ok"), strict=True))))
        return F.transform(pairs, lambda p: p["v"]), items.isNotNull() & F.forall(pairs, lambda p: p["ok"])
    if t.kind == "Natural":
        v, ok = _whole(c, 0, MAX_U32)
        return _bounded(v, ok, v, t)
    if t.kind == "Timestamp":
        v, ok = _whole(c, 0, MAX_U32)
        return _bounded(v, ok, v, t)
    if t.kind == "Signed":
        v, ok = _whole(c, -(1 << 31), (1 << 31) - 1, True)
        return _bounded(v, ok, v, t)
    if t.kind == "Bool":
        low = F.lower(c)
        return low.isin("true", "1"), F.coalesce(low.isin("true", "false", "0", "1"), F.lit(False))
    if t.kind == "Char":
        ok = F.coalesce(F.length(c) == 1, F.lit(False))
        return _bounded(c, ok, F.ascii(c), t)
    if t.kind == "Date":
        date = F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))
        number = (F.year(date) * 10000 + F.month(date) * 100 + F.day(date)).cast("long")
        return _bounded(number, date.isNotNull(), number, t)
    if t.kind == "Enum":
        return c, F.coalesce(c.isin(*t.values), F.lit(False))
    ok = c.isNotNull()
    return c, ok & F.coalesce(regex.matches(c, t.pattern), F.lit(False)) if t.pattern else ok


def _checked(cells: DataFrame, relation: TypedRelation, path: str) -> DataFrame:
    """cells: (place, cells, error) with one string for each column of the relation."""
    parts = [value(F.get("cells", F.lit(i)), t) for i, (_, t) in enumerate(relation.columns)]
    named = [F.when(~ok, F.concat(F.lit(f"{n}: not a valid {t}: "), F.coalesce(F.get("cells", F.lit(i)), F.lit("nothing")))) for i, ((n, t), (_, ok)) in enumerate(zip(relation.columns, parts, strict=True))]
    rows = cells.withColumn("problem", F.coalesce("error", *named))
    bad = rows.where(F.col("problem").isNotNull()).orderBy("place").limit(REPORTED).select("place", "problem").collect()
    if bad:
        raise LoadError([f"{path}:{r[0]}:{r[1]}" for r in bad])
    return rows.select(*(v.cast(t.sql()).alias(f"c{i}") for i, ((_, t), (v, _)) in enumerate(zip(relation.columns, parts, strict=True)))).distinct()


def _list_cell(c: Column) -> Column:
    """[a,b,'c,d'] as JSON text; null if it isn't of that form."""
    inner = F.regexp_extract(c, r"(?s)\A\s*\[(.*)\]\s*\z", 1)
    items = F.regexp_extract_all(F.concat(inner, F.lit(",")), F.lit(r"\s*('[^']*'\s*|[^,]*),"), F.lit(1))
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"(?s)^'(.*)'$", "$1"))
    return F.when(c.rlike(r"(?s)\A\s*\[.*\]\s*\z"), F.when(F.trim(inner) == "", F.lit("[]")).otherwise(F.to_json(clean)))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, place): the lines of a file with their numbers, read in blocks: those before a block are counted, not read by one task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    before, total = [], 0
    for block, first, n in sorted(lines.groupBy("block").agg(F.min("id"), F.count(F.lit(1))).collect()):
        before.append((block, total - first + 1))
        total += n
    shift = spark.createDataFrame(before, "block long, shift long")
    return lines.join(F.broadcast(shift), "block").select("value", (F.col("id") + F.col("shift")).alias("place"))  # a row for each block of a file


def read_csv(spark: SparkSession, path: str, relation: TypedRelation) -> DataFrame:
    lines = _numbered(spark, path)
    head = lines.where("place = 1").select(csv.fields(F.regexp_replace("value", r"\r$", ""))).first()
    names = [n for n, _ in relation.columns]
    header = list(head[0]) if head else []
    problems = [f"{path}:1:{n}: unknown column" for n in header if n not in names]
    problems += [f"{path}:1:{n}: duplicate column" for n in dict.fromkeys(header) if header.count(n) > 1]
    problems += [f"{path}:1:{n}: missing column" for n in names if n not in header]
    if problems:
        raise LoadError(problems)
    rows = lines.where((F.col("place") > 1) & (F.trim("value") != "")).select("place", csv.fields(F.regexp_replace("value", r"\r$", "")).alias("f"))
    cells = []
    for n, t in relation.columns:
        c = F.get("f", F.lit(header.index(n)))
        cells.append(_list_cell(c) if t.kind == "List" else F.when(c != "", c) if t.kind == "Optional" else c)
    error = F.when(F.size("f") != len(header), F.concat(F.lit("the row has "), F.size("f").cast("string"), F.lit(f" fields, not {len(header)}")))
    return _checked(rows.select("place", F.array(*cells).alias("cells"), error.alias("error")), relation, path)


def _json_cell(x, t: ColumnType) -> tuple[str | None, bool]:
    if t.kind == "Optional":
        return (None, True) if x is None else _json_cell(x, ColumnType(t.elem))
    if t.kind == "List":
        if not isinstance(x, list) or len(x) > MOST_ITEMS:
            return None, False
        items = [_json_cell(i, ColumnType(t.elem)) for i in x]
        return json.dumps([i for i, _ in items]), all(ok for _, ok in items)
    if t.kind == "Bool":
        return str(x).lower(), isinstance(x, bool)
    if t.kind in ("Natural", "Timestamp", "Signed"):
        return str(x), isinstance(x, int) and not isinstance(x, bool)
    return x if isinstance(x, str) else str(x), isinstance(x, str)


def json_rows(text: str, columns: list[tuple[str, ColumnType]]) -> Iterator[tuple[int, list[str | None], str | None]]:
    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ValueError("a key occurs twice")
        return dict(pairs)

    try:
        data = json.loads(text, object_pairs_hook=once)
    except ValueError as e:
        yield 0, [], f"not JSON: {e}"
        return
    if not isinstance(data, list):
        yield 0, [], "not an array of objects"
        return
    names = [n for n, _ in columns]
    for i, x in enumerate(data):
        if not isinstance(x, dict):
            yield i, [], "not an object"
            continue
        odd = [f"{k}: unknown key" for k in x if k not in names] + [f"{n}: missing key" for n in names if n not in x]
        cells = [_json_cell(x.get(n), t) for n, t in columns]
        odd += [f"{n}: not a valid {t}: {json.dumps(x[n])}" for (n, t), (_, ok) in zip(columns, cells, strict=True) if n in x and not ok]
        yield i, [c for c, _ in cells], odd[0] if odd else None


def read_json(spark: SparkSession, path: str, relation: TypedRelation) -> DataFrame:
    """An array of objects is one document, and so one task's; a file of lines (.jsonl), each an object, is read in blocks."""
    columns = list(relation.columns)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p - 1, *next(json_rows(f"[{text}]", columns), (0, [], "not an object"))[1:]) for text, p in zip(f["value"], f["place"], strict=True)]
            yield pd.DataFrame(rows, columns=["place", "cells", "error"]).astype({"place": "int64", "error": object})

    if path.endswith(".jsonl"):
        lines = _numbered(spark, path).where(F.trim("value") != "")
        return _checked(lines.mapInPandas(each, "place long, cells array<string>, error string"), relation, path)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["value"]:
                yield pd.DataFrame(list(json_rows(text, columns)), columns=["place", "cells", "error"]).astype({"place": "int64", "error": object})

    cells = spark.read.text(path, wholetext=True).mapInPandas(parse, "place long, cells array<string>, error string")
    return _checked(cells, relation, path)


def show_value(x, t: ColumnType) -> str:
    """A value as rows are printed: null, [a, b], dates as yyyy-mm-dd."""
    if x is None:
        return "null"
    if t.kind == "List":
        return "[" + ", ".join(show_value(i, ColumnType(t.elem)) for i in x) + "]"
    kind = t.elem or t.kind
    if kind == "Date":
        return datetime.date(x // 10000, x // 100 % 100, x % 100).isoformat()
    return str(x).lower() if kind == "Bool" else str(x)
