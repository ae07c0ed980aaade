"""Which programs are accepted: arity, safety, aggregate rules, stratification."""

from __future__ import annotations

from dataclasses import dataclass

from .ast import BUILTINS, FILTERS, MAX_ARITY, PRODUCERS, Aggregate, ArityError, Assign, Atom, BinOp, Call, Compare, Const, Equal, ListTerm, Rule, SafetyError, StratificationError, Var, variables

RESERVED = {"rev"}


@dataclass(frozen=True)
class Stratum:
    """Relations that depend on each other (or one that may stand alone) and the rules that define them."""

    relations: tuple[str, ...]
    rules: tuple[Rule, ...]
    recursive: bool


def head_has_list(rule: Rule) -> bool:
    return any(isinstance(a, ListTerm) for a in rule.head.args)


def _zero_divisor(e) -> bool:
    return isinstance(e, BinOp) and (e.op in "/%" and e.right == Const(0) or _zero_divisor(e.left) or _zero_divisor(e.right))


def check_rule(rule: Rule, variadic: set[str] = frozenset()) -> None:
    """Follows the order of evaluation: atoms, negation where it stands, equalities, producers, filters, aggregate, head."""
    where = (rule.head.line, rule.head.column)
    if head_has_list(rule):
        raise SafetyError("a list pattern can't be in a head", *where)
    if rule.head.rel in BUILTINS:
        raise SafetyError(f"{rule.head.rel} is a builtin", *where)
    if rule.head.rel in RESERVED or any(a.rel in RESERVED for a in rule.atoms()):
        raise SafetyError("relation rev is reserved", *where)
    if not rule.body:
        if variables(rule.head):
            raise SafetyError("a fact can't have variables", *where)
        return
    aggregates = [x for x in rule.body if isinstance(x, Aggregate)]
    if len(aggregates) > 1:
        raise SafetyError("one aggregate a rule", *where)
    bound: set[str] = set()
    for x in rule.body:
        if isinstance(x, Atom) and not x.negated:
            bound |= set(variables(x))
            if x.pattern and not 0 <= x.pattern[0] < len(x.args):
                raise SafetyError(f"{x.rel} has no column {x.pattern[0]}", x.line, x.column)
        elif isinstance(x, Atom):
            if any(isinstance(a, ListTerm) for a in x.args):
                raise SafetyError("a list pattern can't be negated", x.line, x.column)
            free = [v for v in variables(x) if v not in bound]
            if free:
                raise SafetyError(f"!{x.rel} needs {free[0]} bound by an earlier atom", x.line, x.column)
    for x in rule.body:
        if isinstance(x, Equal):
            lists = isinstance(x.left, ListTerm) or isinstance(x.right, ListTerm)
            left, right = set(variables(x.left)), set(variables(x.right))
            if not lists and not (left <= bound or right <= bound):
                raise SafetyError("an equality needs a bound side", *where)
            if isinstance(x.left, ListTerm) and isinstance(x.right, Var) and x.right.name not in bound:
                raise SafetyError(f"{x.right.name} isn't bound", *where)
            if isinstance(x.right, ListTerm) and not right <= bound and not (isinstance(x.left, Var) and x.left.name in bound):
                raise SafetyError("a list needs bound items", *where)
            bound |= left | right
    for x in rule.body:
        if isinstance(x, Assign):
            if _zero_divisor(x.expr):
                raise SafetyError("division by 0", *where)
            free = [v for v in variables(x.expr) if v not in bound]
            if free:
                raise SafetyError(f"{free[0]} isn't bound", *where)
            bound.add(x.var.name)
        elif isinstance(x, Call) and x.name not in FILTERS:
            inputs = x.args if x.name in PRODUCERS else x.args[1:]
            free = [v for a in inputs for v in variables(a) if v not in bound]
            if free:
                raise SafetyError(f"{x.name} needs {free[0]} bound", *where)
            if x.name == "member" and not isinstance(x.args[0], (Var, Const)):
                raise SafetyError("member's first operand is a variable or a constant", *where)
            bound |= set(variables(x.result)) if x.result else set(variables(x.args[0]))
    for x in rule.body:
        if isinstance(x, Compare) or isinstance(x, Call) and x.name in FILTERS:
            free = [v for v in variables(x) if v not in bound]
            if free:
                raise SafetyError(f"{free[0]} isn't bound", *where)
    if aggregates:
        a = aggregates[0]
        if a.source and a.source.name not in bound:
            raise SafetyError(f"{a.source.name} isn't bound", *where)
        if any(not isinstance(x, Var) for x in rule.head.args):
            raise SafetyError("an aggregate's head has variables only", *where)
        if a.var.name not in variables(rule.head) or a.var.name in bound:
            raise SafetyError("an aggregate's result is a head variable of its own", *where)
        if len(rule.head.args) > MAX_ARITY:
            raise SafetyError("too many group columns", *where)
        if rule.head.rel in variadic or any(x.rel in variadic for x in rule.atoms()):
            raise SafetyError("an aggregate can't read or define a relation of varying width", *where)
        bound.add(a.var.name)
    free = [v for v in variables(rule.head) if v not in bound]
    if free:
        raise SafetyError(f"head variable {free[0]} isn't bound", *where)


def check_arities(rules: list[Rule], arity: dict[str, int], variadic: set[str]) -> dict[str, int]:
    """Arity of every relation, those declared and those that heads declare."""
    known = dict(arity)
    for x in [r.head for r in rules] + [a for r in rules for a in r.atoms()]:
        if x.rel not in variadic and known.setdefault(x.rel, len(x.args)) != len(x.args):
            raise ArityError(f"{x.rel} has {known[x.rel]} column(s), not {len(x.args)}", x.line, x.column)
    return known


def key(rel: str, arity: int, variadic: set[str]) -> str:
    """Relations of varying width are kept apart by width."""
    return f"{rel}/{arity}" if rel in variadic else rel


def stratify(rules: list[Rule], variadic: set[str] = frozenset()) -> list[Stratum]:
    """Strongly connected relations, in an order in which everything read is there; raises where a strict edge closes a cycle."""
    rules = [r for r in rules if r.body]
    name = lambda a: key(a.rel, len(a.args), variadic)
    heads = {name(r.head) for r in rules}
    edges: dict[str, set[tuple[str, bool]]] = {h: set() for h in heads}
    for r in rules:
        strict = r.aggregate() is not None
        for a in r.atoms():
            edges[name(r.head)].add((name(a), strict or a.negated))
        for s in r.ranges():
            edges[name(r.head)].add((s, True))
    order: list[list[str]] = []
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    for root in sorted(heads):
        if root in index:
            continue
        work = [(root, iter(sorted(edges[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w, _ in it:
                if w not in heads:
                    continue
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(edges[w]))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    own = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        own.append(w)
                        if w == v:
                            break
                    order.append(sorted(own))
    out = []
    for own in order:
        inside = {(a, b) for a in own for b, _ in edges[a] if b in own}
        for a in own:
            for b, strict in edges[a]:
                if strict and b in own:
                    raise StratificationError(f"{a} depends on {b} through negation, an aggregate or range in a cycle")
        out.append(Stratum(tuple(own), tuple(r for r in rules if name(r.head) in own), bool(inside)))
    return out


def check_program(rules: list[Rule], arity: dict[str, int] | None = None, variadic: set[str] = frozenset()) -> tuple[dict[str, int], list[Stratum]]:
    known = check_arities(rules, arity or {}, variadic)
    for r in rules:
        check_rule(r, variadic)
        for s in r.ranges():
            if s in variadic:
                raise SafetyError(f"range can't read {s}, whose width varies", r.head.line, r.head.column)
            if s not in known:
                raise SafetyError(f"range reads an unknown relation {s}", r.head.line, r.head.column)
    return known, stratify(rules, variadic)


def lint(rules: list[Rule]) -> list[str]:
    """Accepted, but perhaps not meant: _ is a variable like any other."""
    out = []
    for r in rules:
        n = sum(variables(x).count("_") for x in (r.head, *r.body))
        if n > 1:
            out.append(f"{r.head.line}:{r.head.column}: '_' occurs {n} times in the rule of {r.head.rel} and means one value")
    return out
