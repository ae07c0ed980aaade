"""Rules against a typed schema: each variable of a rule has one type, and every head column its own."""

from __future__ import annotations

from ..sources.schema import NUMBERS, ColumnType, Schema
from .ast import Aggregate, Assign, Atom, BinOp, Call, Compare, Const, Equal, ListTerm, Rule, TypingError, Var, variables

NATURAL, TEXT = ColumnType("Natural"), ColumnType("Text")
ORDERED = (*NUMBERS, "Char")


class _Rule:
    def __init__(self, rule: Rule, schema: Schema):
        self.rule, self.schema, self.types = rule, schema, {}

    def fail(self, message: str) -> TypingError:
        return TypingError(message, self.rule.head.line, self.rule.head.column)

    def unify(self, x, t: ColumnType, where: str) -> bool:
        """Gives a term its type; True if something was learnt."""
        if isinstance(x, Const):
            good = t.kind in NUMBERS if isinstance(x.value, int) else t.kind in ("Text", "Enum", "Char") or t.kind == "Optional" and t.elem in ("Text", "Char")
            if isinstance(x.value, int) and t.kind == "Optional":
                good = t.elem in NUMBERS
            if not good:
                raise self.fail(f"{where}: {x.value!r} isn't of type {t}")
            if t.kind == "Enum" and x.value not in t.values:
                raise self.fail(f"{where}: {x.value!r} isn't in the Enum")
            return False
        if isinstance(x, ListTerm):
            if t.kind != "List":
                raise self.fail(f"{where}: a list isn't of type {t}")
            learnt = [self.unify(i, ColumnType(t.elem), where) for i in x.items]
            return any(learnt) | (self.unify(x.tail, ColumnType("List", t.elem), where) if x.tail else False)
        plain = ColumnType(t.kind, t.elem, values=t.values)
        known = self.types.setdefault(x.name, plain)
        if (known.kind, known.elem) != (plain.kind, plain.elem):
            raise self.fail(f"{where}: {x.name} is {known} and {plain}")
        return False

    def of(self, x) -> ColumnType | None:
        if isinstance(x, Var):
            return self.types.get(x.name)
        if isinstance(x, Const):
            return NATURAL if isinstance(x.value, int) else TEXT
        if isinstance(x, ListTerm):
            inner = [t for t in (self.of(i) for i in x.items) if t]
            if inner and inner[0].kind not in ("List", "Optional"):
                return ColumnType("List", "Text" if inner[0].kind == "Enum" else inner[0].kind)
            return self.of(x.tail) if x.tail else None
        return NATURAL

    def numbers(self, e, where: str) -> None:
        if isinstance(e, BinOp):
            self.numbers(e.left, where)
            self.numbers(e.right, where)
        else:
            t = self.of(e)
            if t is not None and t.kind != "Natural":
                raise self.fail(f"{where}: arithmetic is of Natural, not {t}")
            if isinstance(e, Var):
                self.unify(e, NATURAL, where)

    def item(self, x) -> None:
        if isinstance(x, Equal):
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if self.of(a) is not None and not (isinstance(a, Const) and isinstance(b, Const)):
                    self.unify(b, self.of(a), "=")
        elif isinstance(x, Assign):
            self.numbers(x.expr, "=")
            if not (isinstance(x.expr, Const) and self.of(x.var) is not None and self.of(x.var).kind in NUMBERS):
                self.unify(x.var, NATURAL, "=")
        elif isinstance(x, Compare):
            a, b = self.of(x.left), self.of(x.right)
            if a is not None and not isinstance(x.left, Const):
                self.unify(x.right, a, x.op)
            elif b is not None and not isinstance(x.right, Const):
                self.unify(x.left, b, x.op)
            t = a if not isinstance(x.left, Const) else b
            if x.op != "!=" and t is not None and t.kind not in ORDERED:
                raise self.fail(f"{x.op}: {t} has no order")
        elif isinstance(x, Call):
            self.call(x)

    def element(self, source) -> ColumnType | None:
        t = self.of(source)
        if t is None:
            return None
        if t.kind != "List":
            raise self.fail(f"a list is needed, not {t}")
        return ColumnType(t.elem)

    def call(self, x: Call) -> None:
        n = x.name
        if n in ("concat", "lower", "upper", "prefix", "suffix", "contains"):
            for a in x.args:
                self.unify(a, TEXT, n)
            if x.result:
                self.unify(x.result, TEXT, n)
        elif n == "length":
            t = self.of(x.args[0])
            if t is not None and t.kind not in ("Text", "List"):
                raise self.fail(f"length is of Text or a List, not {t}")
            self.unify(x.result, NATURAL, n)
        elif n == "member":
            e = self.element(x.args[1])
            if e is not None:
                self.unify(x.args[0], e, n)
        elif n == "car":
            e = self.element(x.args[0])
            if e is not None:
                self.unify(x.result, e, n)
        elif n == "cdr":
            if self.element(x.args[0]) is not None:
                self.unify(x.result, self.of(x.args[0]), n)
        elif n == "cons":
            t = self.of(x.args[1]) or (ColumnType("List", self.of(x.args[0]).kind) if self.of(x.args[0]) else None)
            if t is not None:
                if t.kind != "List":
                    raise self.fail(f"cons needs a list, not {t}")
                self.unify(x.args[0], ColumnType(t.elem), n)
                self.unify(x.result, t, n)
        elif n == "append":
            t = self.of(x.args[0]) or self.of(x.args[1])
            if t is not None:
                for a in (*x.args, x.result):
                    self.unify(a, t, n)
        elif n == "range":
            rel = self.schema.relations.get(x.args[1].value)
            if rel is None:
                raise self.fail(f"range reads an unknown relation {x.args[1].value}")
            t = rel.columns[0][1]
            if t.kind not in ORDERED:
                raise self.fail(f"range: {t} has no order")
            for a in (x.args[0], x.args[2], x.args[3]):
                self.unify(a, t, n)

    def check(self) -> None:
        rule = self.rule
        for a in (x for x in rule.body if isinstance(x, Atom)):
            self.atom(a)
        for _ in range(len(rule.body) + 1):  # builtins learn from one another
            for x in rule.body:
                if not isinstance(x, (Atom, Aggregate)):
                    self.item(x)
        agg = rule.aggregate()
        if agg:
            if agg.source and self.of(agg.source) not in (None, NATURAL) and agg.fn == "sum":
                raise self.fail(f"sum is of Natural, not {self.of(agg.source)}")
            if agg.source and self.of(agg.source) is not None and self.of(agg.source).kind not in ORDERED:
                raise self.fail(f"{agg.fn}: {self.of(agg.source)} has no order")
            self.unify(agg.var, NATURAL if agg.fn in ("count", "sum") else self.of(agg.source) or NATURAL, agg.fn)
        self.atom(rule.head)
        unknown = [v for v in dict.fromkeys(v for x in (rule.head, *rule.body) for v in variables(x)) if v not in self.types]
        if unknown:
            raise self.fail(f"{unknown[0]} has no type")

    def atom(self, a: Atom) -> None:
        rel = self.schema.relations.get(a.rel)
        if rel is None:
            raise self.fail(f"{a.rel} isn't in the schema")
        if len(rel.columns) != len(a.args):
            raise self.fail(f"{a.rel} has {len(rel.columns)} columns")
        for x, (n, t) in zip(a.args, rel.columns, strict=True):
            self.unify(x, t, f"{a.rel}.{n}")
        if a.pattern and rel.columns[a.pattern[0]][1].kind not in ("Text", "Enum", "Char"):
            raise self.fail(f"{a.rel}: a pattern is of Text")


def typecheck(rules: list[Rule], schema: Schema) -> None:
    for r in rules:
        _Rule(r, schema).check()
