"""Typed relations: ten column types, with constraints, from a plain description (JSON or Python).

{"relations": [{"name": "weight", "columns": [{"name": "src", "type": "Text"}, {"name": "w", "type": {"kind": "Natural", "max": 150}}]}]}
kinds: Natural Text Bool Char Date Timestamp Signed, List and Optional (with "elem"), Enum (with "values").
min and max constrain numbers, dates (yyyymmdd) and characters (code points); regex constrains Text, as a whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..functions import regex
from ..lang.ast import MAX_ARITY

FLAT = ("Natural", "Text", "Bool", "Char", "Date", "Timestamp", "Signed")
NUMBERS = ("Natural", "Date", "Timestamp", "Signed")
SQL = {"Natural": "long", "Text": "string", "Bool": "boolean", "Char": "string", "Date": "long", "Timestamp": "long", "Signed": "long", "Enum": "string"}
MOST_VALUES, MOST_BYTES = 8, 32


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class ColumnType:
    kind: str
    elem: str | None = None
    low: int | None = None
    high: int | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.kind}<{self.elem}>" if self.elem else self.kind

    def sql(self) -> str:
        return f"array<{SQL[self.elem]}>" if self.kind == "List" else SQL[self.elem or self.kind]


@dataclass(frozen=True)
class TypedRelation:
    name: str
    columns: tuple[tuple[str, ColumnType], ...]


@dataclass
class Schema:
    relations: dict[str, TypedRelation] = field(default_factory=dict)


def column_type(x: str | dict) -> ColumnType:
    x = {"kind": x} if isinstance(x, str) else dict(x)
    kind = x.pop("kind", None)
    allowed = {"List": {"elem"}, "Optional": {"elem"}, "Enum": {"values"}, "Text": {"regex"}, "Bool": set()}.get(kind, {"min", "max"})
    if kind not in (*FLAT, "List", "Optional", "Enum") or set(x) - allowed:
        raise SchemaError(f"unknown type {kind} {sorted(x)}")
    if "elem" in allowed and x.get("elem") not in FLAT:
        raise SchemaError(f"the elements of {kind} are one of {', '.join(FLAT)}")
    values = tuple(x.get("values", ()))
    if kind == "Enum" and (not 0 < len(values) <= MOST_VALUES or len(set(values)) < len(values) or any(len(v.encode()) > MOST_BYTES for v in values)):
        raise SchemaError(f"an Enum has 1 to {MOST_VALUES} different values of at most {MOST_BYTES} bytes")
    if x.get("regex") is not None:
        try:
            regex.to_java(x["regex"])
        except regex.PatternError as e:
            raise SchemaError(f"regex of a Text column: {e}") from None
    if x.get("min") is not None and x.get("max") is not None and x["min"] > x["max"]:
        raise SchemaError("min is beyond max")
    return ColumnType(kind, x.get("elem"), x.get("min"), x.get("max"), x.get("regex"), values)


def load(source: str | dict) -> Schema:
    described = json.loads(source) if isinstance(source, str) else source
    out = Schema()
    for r in described["relations"]:
        names = [c["name"] for c in r["columns"]]
        if len(set(names)) < len(names) or not 1 <= len(names) <= MAX_ARITY:
            raise SchemaError(f"{r['name']} needs 1 to {MAX_ARITY} columns of different names")
        if r["name"] in out.relations:
            raise SchemaError(f"{r['name']} is described twice")
        out.relations[r["name"]] = TypedRelation(r["name"], tuple((c["name"], column_type(c["type"])) for c in r["columns"]))
    return out
