"""Base facts: a relation is a kept table, a written delta over it, and a few changes in memory.

Both hold each tuple once, with a sign; a view is the kept rows that neither names, and what they add. So a plan
has the same size after any number of changes. Changes of the memory are written once they are PENDING, a
delta of more than a quarter of its relation is worked into it.

With a folder, kept tables and deltas lie there, and every change is a file of the log before it is made: a
transaction is one file, and so applied as a whole or not at all. Opening reads the state and applies the log.
"""

from __future__ import annotations

import json
import os
import socket
from collections.abc import Iterable, Iterator, MutableMapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import TypingError
from . import scratch
from .snapshots import Files

PENDING, COMPACT = 5000, 0.25


class Locked(RuntimeError):
    """Another database object writes in the folder."""


@dataclass
class Relation:
    kept: DataFrame | None = None
    rows: int | None = None  # of kept, where it was written
    paths: list[str] | None = None
    delta: scratch.Table | None = None
    pending: dict[tuple, int] = field(default_factory=dict)
    view: DataFrame | None = None


def _frozen(x):
    return tuple(map(_frozen, x)) if isinstance(x, (list, tuple)) else x


def _fits(v, t: T.DataType) -> bool:
    if v is None:
        return True
    if isinstance(t, T.ArrayType):
        return isinstance(v, (list, tuple)) and all(_fits(x, t.elementType) for x in v)
    return isinstance(v, bool) if isinstance(t, T.BooleanType) else isinstance(v, str) if isinstance(t, T.StringType) else isinstance(v, int)


class Relations(MutableMapping):
    """Views by key; setting one replaces the relation by a table as it is."""

    def __init__(self, spark: SparkSession, folder: str | None, read_only: bool = False, break_lock: bool = False):
        self.spark, self.own, self.read_only = spark, {}, read_only
        self.files = Files(spark, folder) if folder else None
        self.state: dict = {"log": 0, "relations": {}, "database": {}}
        self.next, self.garbage, self.locked = 1, set(), False
        if self.files:
            if not read_only:
                self._lock(break_lock)
            if self.files.exists("state.json"):
                self.state = json.loads(self.files.read("state.json"))
                for k, m in self.state["relations"].items():
                    schema = T.StructType.fromJson(m["schema"])
                    table = scratch.Table(schema, [self._at(p) for p in m["kept"]], m["rows"])
                    delta = m["delta"] and scratch.Table(T.StructType([*schema.fields, T.StructField("sign", T.IntegerType())]), [self._at(m["delta"])], m["delta_rows"])
                    self.own[k] = Relation(table.df(spark), m["rows"], m["kept"], delta)

    # The folder

    def _at(self, path: str) -> str:
        return f"{self.files.base}/{path}"

    def _lock(self, force: bool) -> None:
        fs, path = self.files.fs(), self.files.path("LOCK")
        fs.mkdirs(self.files.path())
        if force:
            fs.delete(path, False)
        try:
            f = fs.create(path, False)
        except Exception:
            raise Locked(f"{self.files.base} is open for writing: {self.files.read('LOCK')}") from None
        f.write(bytearray(f"{socket.gethostname()} {os.getpid()} {self.spark.sparkContext.applicationId}".encode()))
        f.close()
        fs.deleteOnExit(path)
        self.locked = True

    def close(self) -> None:
        if self.locked:
            self.files.delete("LOCK")
            self.locked = False

    def writable(self) -> None:
        if self.files and not self.locked:
            raise Locked("the database is open for reading, or closed")

    def log(self, entry: dict) -> None:
        """Appends to the log; whole or not at all."""
        self.writable()
        if self.files:
            self.files.write(json.dumps(entry), "log", f"{self.next:012d}.json")
            self.next += 1

    def replay(self) -> Iterator[dict]:
        """The log's entries after the written state, in order."""
        if self.files:
            for name in sorted(n for n in self.files.names("log") if n.endswith(".json")):
                n = int(name[:-5])
                if n > self.state["log"]:
                    yield json.loads(self.files.read("log", name))
                self.next = max(self.next, n + 1)

    def save(self, database: dict) -> None:
        """Writes all that is in memory, and the state that names it; the log before it isn't needed any more."""
        if not self.files:
            return
        self.writable()
        for k in list(self.own):
            self._flush(k)
            r = self.own[k]
            if r.paths is None and r.kept is not None:
                self._keep(r, k, r.kept)
        relations = {
            k: {"schema": json.loads(r.kept.schema.json()), "kept": r.paths, "rows": r.rows, "delta": r.delta and r.delta.paths[0][len(self.files.base) + 1 :], "delta_rows": r.delta and r.delta.rows}
            for k, r in self.own.items() if r.kept is not None
        }
        self.state = {"log": self.next - 1, "relations": relations, "database": database}
        self.files.write(json.dumps(self.state), "state.json")
        for name in self.files.names("log"):
            if name.endswith(".json") and int(name[:-5]) < self.next:
                self.files.delete("log", name)
        used = {p for m in relations.values() for p in (*m["kept"], m["delta"])}
        unused = {name for name in self.files.names("base") if f"base/{name}" not in used}
        for name in unused & self.garbage:  # one save later, since what was read before may still be
            self.files.delete("base", name)
        self.garbage = unused - self.garbage

    def _write(self, df: DataFrame, name: str) -> scratch.Table:
        return scratch.write(df, name.replace("/", "_"), self._at("base") if self.files else None)

    def _keep(self, r: Relation, k: str, df: DataFrame) -> None:
        t = self._write(df, k)
        r.kept, r.rows, r.delta, r.view = t.df(self.spark), t.rows, None, None
        r.paths = [p[len(self.files.base) + 1 :] for p in t.paths] if self.files else t.paths

    # Views

    def __getitem__(self, k: str) -> DataFrame:
        r = self.own[k]
        if r.view is None:
            r.view = r.kept
            for over in (r.delta and r.delta.df(self.spark), self._memory(r)):
                if over is not None:
                    r.view = self._over(r.view, over)
        return r.view

    def schema(self, k: str) -> T.StructType | None:
        return self.own[k].kept.schema if k in self.own else None

    def __setitem__(self, k: str, df: DataFrame) -> None:
        self.writable()
        self.own[k] = Relation(df)
        if self.files:
            self._keep(self.own[k], k, df)

    def __delitem__(self, k: str) -> None:
        del self.own[k]

    def __iter__(self) -> Iterator[str]:
        return iter(self.own)

    def __len__(self) -> int:
        return len(self.own)

    def _memory(self, r: Relation) -> DataFrame | None:
        if not r.pending:
            return None
        schema = T.StructType([*r.kept.schema.fields, T.StructField("sign", T.IntegerType())])
        return self.spark.createDataFrame([(*row, s) for row, s in r.pending.items()], schema)

    @staticmethod
    def _over(df: DataFrame, change: DataFrame) -> DataFrame:
        from ..plans.fixpoint import without

        return without(df, change.select(*df.columns)).unionByName(change.where("sign > 0").select(*df.columns))

    # Changes

    def change(self, k: str, rows: Iterable[tuple], sign: int, schema: T.StructType) -> None:
        """Adds or deletes a few tuples; schema is for a relation that isn't there yet."""
        if k not in self.own:
            self.own[k] = Relation(self.spark.createDataFrame([], schema), 0, [])
        r = self.own[k]
        rows = [_frozen(x) for x in rows]
        for x in rows:
            for v, f in zip(x, r.kept.schema.fields, strict=True):
                if not _fits(v, f.dataType):
                    if sign < 0:
                        break  # it can't be there
                    raise TypingError(f"{k}: {v!r} isn't of type {f.dataType.simpleString()}")
            else:
                r.pending[x] = sign
        r.view = None
        if len(r.pending) > PENDING:
            self._flush(k)

    def change_table(self, k: str, df: DataFrame, sign: int) -> None:
        """Adds or deletes the tuples of a table."""
        if k not in self.own:
            self.own[k] = Relation(self.spark.createDataFrame([], df.schema), 0, [])
        self._flush(k)
        self._merge(k, df.distinct().withColumn("sign", F.lit(sign)))

    def _flush(self, k: str) -> None:
        change = self._memory(self.own[k])
        if change is not None:
            self.own[k].pending = {}
            self._merge(k, change)

    def _merge(self, k: str, change: DataFrame) -> None:
        r = self.own[k]
        cols = r.kept.columns
        change = change.toDF(*cols, "sign")
        if r.delta is not None:
            old = r.delta.df(self.spark)
            rest = old.join(change.select(*(F.col(c).alias(f"k_{c}") for c in cols)), [old[c].eqNullSafe(F.col(f"k_{c}")) for c in cols], "left_anti")
            change = rest.unionByName(change)
        r.delta = self._write(change, f"{k}-delta")
        r.view = None
        if r.rows is None:
            r.rows = r.kept.count()
        if r.delta.rows > COMPACT * r.rows:
            self._keep(r, k, self._over(r.kept, r.delta.df(self.spark)))

    def difference(self, k: str) -> DataFrame | None:
        """What was changed since it was kept: (columns, sign)."""
        self._flush(k)
        delta = self.own[k].delta
        return delta and delta.df(self.spark)

    def mark(self, k: str) -> tuple[DataFrame, dict[tuple, int]] | None:
        """The kept table and all changes over it, if these are few: a relation at a time, to compare with by added()."""
        r = self.own[k]
        if r.kept is None or r.delta is not None and r.delta.rows > PENDING:
            return None
        written = [] if r.delta is None else [_frozen(x) for x in r.delta.df(self.spark).collect()]
        return r.kept, {x[:-1]: x[-1] for x in written} | r.pending

    def added(self, k: str, mark: tuple | None) -> DataFrame | None:
        """What was added since the mark; None if tuples went, or if it isn't known."""
        now = self.mark(k) if mark and k in self.own else None
        if now is None or now[0] is not mark[0]:
            return None
        (kept, then), changes = mark, {x: s for x, s in now[1].items() if mark[1].get(x) != s}
        if any(s < 0 for s in changes.values()):
            return None
        new = list(changes)
        if maybe := [x for x in new if x not in then]:
            few = self.spark.createDataFrame(maybe, kept.schema)
            there = kept.join(F.broadcast(few), [kept[c].eqNullSafe(few[c]) for c in kept.columns], "left_semi").collect()
            new = [x for x in new if x not in {_frozen(y) for y in there}]
        return self.spark.createDataFrame(new, kept.schema)

    def copy(self) -> dict[str, DataFrame]:
        return {k: self[k] for k in self.own}

    def snapshot(self) -> dict[str, Relation]:
        """For a transaction to go back to."""
        return {k: Relation(r.kept, r.rows, r.paths, r.delta, dict(r.pending), r.view) for k, r in self.own.items()}
