"""Rules as data."""

from __future__ import annotations

from dataclasses import dataclass, field


class RuleError(ValueError):
    """A program that is refused; where is (line, column) if known."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{line}:{column}: {message}" if line else message)
        self.message, self.line, self.column = message, line, column


class ParseError(RuleError):
    pass


class SafetyError(RuleError):
    pass


class StratificationError(RuleError):
    pass


class ArityError(RuleError):
    pass


class TypingError(RuleError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: int | str


@dataclass(frozen=True)
class ListTerm:
    """[a, b | tail]; without a tail the list ends there."""

    items: tuple
    tail: Var | None = None


Term = Var | Const | ListTerm


@dataclass(frozen=True)
class BinOp:
    op: str
    left: BinOp | Var | Const
    right: BinOp | Var | Const


@dataclass(frozen=True)
class Atom:
    rel: str
    args: tuple
    negated: bool = False
    pattern: tuple[int, str] | None = None  # column, regular expression
    line: int = field(default=0, compare=False)
    column: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Equal:
    left: Term
    right: Term


@dataclass(frozen=True)
class Assign:
    var: Var
    expr: BinOp | Var | Const


@dataclass(frozen=True)
class Compare:
    op: str
    left: Term
    right: Term


@dataclass(frozen=True)
class Aggregate:
    var: Var
    fn: str
    source: Var | None


@dataclass(frozen=True)
class Call:
    """A builtin; result is None for filters and for member and range, which bind their first argument."""

    name: str
    args: tuple
    result: Var | None = None


Item = Atom | Equal | Assign | Compare | Aggregate | Call


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple = ()

    def atoms(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom)]

    def positive(self) -> list[Atom]:
        return [x for x in self.atoms() if not x.negated]

    def aggregate(self) -> Aggregate | None:
        return next((x for x in self.body if isinstance(x, Aggregate)), None)

    def ranges(self) -> list[str]:
        """Relations that range() reads."""
        return [x.args[1].value for x in self.body if isinstance(x, Call) and x.name == "range"]


#: Builtins that give a value, filters, and generators.
PRODUCERS = {"concat": 2, "length": 1, "lower": 1, "upper": 1, "cons": 2, "car": 1, "cdr": 1, "append": 2}
FILTERS = {"prefix": 2, "suffix": 2, "contains": 2}
GENERATORS = {"member": 2, "range": 4}
BUILTINS = {*PRODUCERS, *FILTERS, *GENERATORS}
AGGREGATES = ("count", "sum", "min", "max")
MAX_ARITY = 8


def variables(x) -> list[str]:
    """Names of the variables in a term, expression or item, in order."""
    if isinstance(x, Var):
        return [x.name]
    if isinstance(x, ListTerm):
        return [v for i in x.items for v in variables(i)] + (variables(x.tail) if x.tail else [])
    if isinstance(x, BinOp):
        return variables(x.left) + variables(x.right)
    if isinstance(x, Atom):
        return [v for a in x.args for v in variables(a)]
    if isinstance(x, (Equal, Compare)):
        return variables(x.left) + variables(x.right)
    if isinstance(x, Assign):
        return [x.var.name, *variables(x.expr)]
    if isinstance(x, Aggregate):
        return [x.var.name, *([x.source.name] if x.source else [])]
    if isinstance(x, Call):
        return [v for a in x.args for v in variables(a)] + ([x.result.name] if x.result else [])
    return []


def show(x) -> str:
    """A term or item as text."""
    if isinstance(x, Var):
        return x.name
    if isinstance(x, Const):
        return str(x.value) if isinstance(x.value, int) else f'"{x.value}"'
    if isinstance(x, ListTerm):
        return "[" + ", ".join(map(show, x.items)) + (f" | {x.tail.name}" if x.tail else "") + "]"
    if isinstance(x, BinOp):
        return f"({show(x.left)} {x.op} {show(x.right)})"
    if isinstance(x, Atom):
        return "!" * x.negated + f"{x.rel}({', '.join(map(show, x.args))})" + (f" ~ {x.pattern[0]} '{x.pattern[1]}'" if x.pattern else "")
    if isinstance(x, Equal):
        return f"{show(x.left)} = {show(x.right)}"
    if isinstance(x, Assign):
        return f"{x.var.name} = {show(x.expr)}"
    if isinstance(x, Compare):
        return f"{show(x.left)} {x.op} {show(x.right)}"
    if isinstance(x, Aggregate):
        return f"{x.var.name} = {x.fn}({x.source.name if x.source else ''})"
    if isinstance(x, Call):
        inner = f"{x.name}({', '.join(map(show, x.args))})"
        return f"{x.result.name} = {inner}" if x.result else inner
    if isinstance(x, Rule):
        return show(x.head) + (" :- " + ", ".join(map(show, x.body)) if x.body else "") + "."
    raise TypeError(x)
