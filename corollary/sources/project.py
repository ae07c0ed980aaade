"""Typed projects: a folder with schema.json, data/<relation>.csv or .json, and rules/*.datalog."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import Rule
from ..lang.checks import check_program
from ..lang.parser import parse, parse_goal
from ..lang.typecheck import typecheck
from ..session import Database, select_goal
from . import schema as schemas
from .typed import LoadError, read_csv, read_json, show_value

EMPTY = '{"relations": []}\n'


class Project:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self.schema = schemas.load((self.folder / "schema.json").read_text())

    @staticmethod
    def init(folder: str) -> None:
        for d in ("data", "rules"):
            os.makedirs(Path(folder, d), exist_ok=True)
        if not Path(folder, "schema.json").exists():
            Path(folder, "schema.json").write_text(EMPTY)

    def rules(self) -> list[Rule]:
        return parse("\n".join(p.read_text() for p in sorted((self.folder / "rules").glob("*.datalog"))))

    def data(self) -> dict[str, DataFrame]:
        heads = {r.head.rel for r in self.rules()}
        out: dict[str, DataFrame] = {}
        problems: list[str] = []
        for p in sorted((self.folder / "data").iterdir()):
            if p.suffix not in (".csv", ".json", ".jsonl"):
                continue
            try:
                if p.stem not in self.schema.relations:
                    raise LoadError([f"{p}: no relation {p.stem} in the schema"])
                if p.stem in heads:
                    raise LoadError([f"{p}: {p.stem} is defined by rules"])
                read = read_csv if p.suffix == ".csv" else read_json
                df = read(self.spark, str(p), self.schema.relations[p.stem])
                out[p.stem] = df if p.stem not in out else out[p.stem].union(df).distinct()
            except LoadError as e:
                problems += e.problems
        if problems:
            raise LoadError(problems)
        return out

    def check(self) -> dict[str, DataFrame]:
        """Validates schema, data and rules; raises with all that is wrong in the data, or the first that is in the rules."""
        data = self.data()
        rules = self.rules()
        check_program(rules, {n: len(r.columns) for n, r in self.schema.relations.items()})
        typecheck(rules, self.schema)
        return data

    def build(self) -> int:
        """Checks, evaluates and publishes into .build; returns the version."""
        data = self.check()
        with Database(self.spark, self.published(), null_safe=True) as db:
            db.base.clear()
            db.arity, db.rules = {n: len(r.columns) for n, r in self.schema.relations.items()}, [r for r in self.rules() if r.body]
            for name, df in data.items():
                db.base[name] = df
            return db.publish()

    def published(self) -> str:
        return (self.folder / ".build").resolve().as_uri()

    def database(self) -> Database:
        return Database(self.spark, self.published(), null_safe=True, read_only=True)

    def query(self, goal: str) -> DataFrame:
        atom = parse_goal(goal)
        if atom.rel not in self.schema.relations:
            raise LookupError(f"no relation {atom.rel}")
        db = self.database()
        return select_goal(db.query_version(db.snapshots.current(), atom.rel), atom)

    def lines(self, goal: str) -> list[str]:
        """Matches as text, in order; found or not found for a goal without variables."""
        atom = parse_goal(goal)
        df = self.query(goal)
        if df.columns == ["found"] and not any(getattr(a, "name", None) for a in atom.args):
            return ["found" if df.count() else "not found"]
        types = [t for _, t in self.schema.relations[atom.rel].columns]
        kinds = [types[[getattr(a, "name", None) for a in atom.args].index(c)] for c in df.columns]
        return [" ".join(show_value(x, t) for x, t in zip(r, kinds, strict=True)) for r in df.orderBy(*df.columns).toLocalIterator()]
