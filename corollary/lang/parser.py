"""Text to rules, by recursive descent over a token list."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .ast import AGGREGATES, BUILTINS, FILTERS, GENERATORS, MAX_ARITY, PRODUCERS, Aggregate, ArityError, Assign, Atom, BinOp, Call, Compare, Const, Equal, ListTerm, ParseError, Rule, Var

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
      | (?P<var>[A-Z_][A-Za-z0-9_]*)
      | (?P<ident>[a-z][A-Za-z0-9_]*)
      | (?P<int>[0-9]+)
      | "(?P<symbol>[^"]*)"
      | '(?P<string>[^']*)'
      | (?P<op>:-|<=|>=|!=|[(),.\[\]|!~=<>+*/%-])""",
    re.X,
)
MAX_INT = (1 << 31) - 1


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    line: int
    column: int
    offset: int


def tokenize(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r}", line, at - start + 1)
        kind = m.lastgroup or ""
        if kind != "space":
            out.append(Token(kind, m.group(kind), line, at - start + 1, at))
        lines = m.group().count("\n")
        if lines:
            line += lines
            start = at + m.group().rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", line, at - start + 1, at))
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self, message: str) -> ParseError:
        t = self.now
        return ParseError(f"{message}, found {t.value!r}" if t.kind != "end" else f"{message}, found the end", t.line, t.column)

    def op(self, value: str) -> bool:
        if self.now.kind == "op" and self.now.value == value:
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.op(value):
            raise self.fail(f"expected {value!r}")

    def take(self, kind: str) -> str:
        if self.now.kind != kind:
            raise self.fail(f"expected {kind}")
        self.at += 1
        return self.tokens[self.at - 1].value

    def program(self) -> list[Rule]:
        out = []
        while self.now.kind != "end":
            out.append(self.clause())
        return out

    def clause(self) -> Rule:
        if self.now.kind != "ident":
            raise self.fail("expected a relation name")
        if self.now.value in BUILTINS or self.now.value in AGGREGATES:
            raise self.fail("a builtin can't be a head")
        head = self.atom()
        body: list = []
        if self.op(":-"):
            body.append(self.item())
            while self.op(","):
                body.append(self.item())
        self.expect(".")
        return Rule(head, tuple(body))

    def atom(self, negated: bool = False) -> Atom:
        t = self.now
        name = self.take("ident")
        self.expect("(")
        args = []
        if not self.op(")"):
            args.append(self.argument())
            while self.op(","):
                args.append(self.argument())
            self.expect(")")
        if len(args) > MAX_ARITY or not args:
            raise ArityError(f"{name} has {len(args)} columns; 1 to {MAX_ARITY} are possible", t.line, t.column)
        return Atom(name, tuple(args), negated, None, t.line, t.column)

    def argument(self):
        t = self.now
        if t.kind == "op" and t.value == "[":
            return self.list_term()
        if t.kind == "var":
            self.at += 1
            return Var(t.value)
        if t.kind in ("ident", "symbol"):
            self.at += 1
            return Const(t.value)
        if t.kind == "int":
            return Const(self.integer())
        raise self.fail("expected a variable or a constant")

    def integer(self) -> int:
        t = self.now
        value = int(self.take("int"))
        if value > MAX_INT:
            raise ParseError(f"{value} is beyond {MAX_INT}", t.line, t.column)
        return value

    def list_term(self) -> ListTerm:
        self.expect("[")
        items, tail = [], None
        if self.op("]"):
            return ListTerm(())
        while True:
            if self.now.kind == "string":
                items.append(Const(self.take("string")))
            else:
                items.append(self.argument())
            if self.op(","):
                continue
            if self.op("|"):
                if self.now.kind != "var":
                    raise self.fail("a list's tail must be a variable")
                tail = Var(self.take("var"))
            self.expect("]")
            return ListTerm(tuple(items), tail)

    def item(self):
        t = self.now
        if self.op("!"):
            if self.now.kind == "var":
                raise self.fail("only an atom can be negated")
            if self.now.kind == "ident" and self.now.value in BUILTINS:
                raise self.fail("a builtin can't be negated")
            return self.patterned(self.atom(True))
        if t.kind == "op" and t.value == "[":
            left = self.list_term()
            self.expect("=")
            right = self.list_term() if self.now.value == "[" and self.now.kind == "op" else Const(self.take("string")) if self.now.kind == "string" else self.argument()
            return Equal(left, right)
        if t.kind == "ident" and t.value in BUILTINS:
            return self.builtin()
        if t.kind == "ident":
            return self.patterned(self.atom())
        if t.kind == "var" and self.ahead().kind == "op" and self.ahead().value == "=":
            return self.binding()
        if t.kind in ("var", "int"):
            left = Var(self.take("var")) if t.kind == "var" else Const(self.integer())
            return self.comparison(left)
        raise self.fail("expected an atom, a comparison or a builtin")

    def comparison(self, left):
        op = next((o for o in ("<=", ">=", "<", ">", "!=", "=") if self.op(o)), None)
        if op is None:
            raise self.fail("expected a comparison")
        if op == "=":
            if not isinstance(left, Const):
                raise self.fail("expected a comparison")
            return Assign(Var(self.take("var")), left)
        if self.now.kind == "var":
            return Compare(op, left, Var(self.take("var")))
        if self.now.kind == "int":
            return Compare(op, left, Const(self.integer()))
        if op == "!=" and self.now.kind in ("ident", "symbol", "string"):
            self.at += 1
            return Compare(op, left, Const(self.tokens[self.at - 1].value))
        raise self.fail("expected a variable or an integer")

    def patterned(self, atom: Atom) -> Atom:
        if not self.op("~"):
            return atom
        column = self.integer() if self.now.kind == "int" else 0
        pattern = self.take("string")
        return Atom(atom.rel, atom.args, atom.negated, (column, pattern), atom.line, atom.column)

    def binding(self):
        var = Var(self.take("var"))
        self.expect("=")
        t = self.now
        if t.kind == "op" and t.value == "[":
            return Equal(var, self.list_term())
        if t.kind == "ident" and self.ahead().value == "(" and self.ahead().kind == "op":
            if t.value in AGGREGATES:
                self.at += 2
                source = Var(self.take("var")) if self.now.kind == "var" else None
                if not self.op(")"):
                    raise self.fail(f"{t.value} takes one variable at most")
                if (t.value == "count") != (source is None):
                    raise ParseError("count takes no argument; sum, min and max take one variable", t.line, t.column)
                return Aggregate(var, t.value, source)
            if t.value in PRODUCERS:
                self.at += 2
                return self.call(t.value, self.operands(), var)
        if t.kind == "var" and not (self.ahead().kind == "op" and self.ahead().value in ("+", "-", "*", "/", "%")):
            self.at += 1
            return Equal(var, Var(t.value))
        return Assign(var, self.expression())

    def operands(self) -> list:
        args = []
        while True:
            args.append(Const(self.take("string")) if self.now.kind == "string" else self.argument())
            if not self.op(","):
                self.expect(")")
                return args

    def call(self, name: str, args: list, result: Var | None) -> Call:
        t = self.tokens[self.at - 1]
        need = {**PRODUCERS, **FILTERS, **GENERATORS}[name]
        if name in PRODUCERS and result is None and len(args) == need + 1:
            if not isinstance(args[0], Var):
                raise ParseError(f"the result of {name} must be a variable", t.line, t.column)
            result, args = args[0], args[1:]
        if len(args) != need or (name in PRODUCERS) != (result is not None):
            raise ParseError(f"{name} takes {need} operand(s)", t.line, t.column)
        if name in ("concat", "lower", "upper", *FILTERS) and any(isinstance(a, Const) and isinstance(a.value, int) for a in args):
            raise ParseError(f"{name} takes strings", t.line, t.column)
        if name == "range" and not (isinstance(args[1], Const) and isinstance(args[1].value, str)):
            raise ParseError("range's second operand is a relation's name", t.line, t.column)
        return Call(name, tuple(args), result)

    def builtin(self) -> Call:
        name = self.take("ident")
        self.expect("(")
        return self.call(name, self.operands(), None)

    def expression(self):
        left = self.term()
        while self.now.kind == "op" and self.now.value in ("+", "-"):
            self.at += 1
            left = BinOp(self.tokens[self.at - 1].value, left, self.term())
        return left

    def term(self):
        left = self.factor()
        while self.now.kind == "op" and self.now.value in ("*", "/", "%"):
            self.at += 1
            left = BinOp(self.tokens[self.at - 1].value, left, self.factor())
        return left

    def factor(self):
        if self.now.kind == "var":
            return Var(self.take("var"))
        if self.now.kind == "int":
            return Const(self.integer())
        if self.op("("):
            inner = self.expression()
            self.expect(")")
            return inner
        raise self.fail("expected a variable, an integer or '('")


def parse(text: str) -> list[Rule]:
    return Parser(text).program()


def parse_goal(text: str) -> Atom:
    """rel(a, X), with or without a final full stop."""
    p = Parser(text)
    goal = p.atom()
    p.op(".")
    if p.now.kind != "end":
        raise p.fail("expected the end of the goal")
    return goal
