"""Goal-directed evaluation: the magic-sets rewrite.

Relations on which the goal depends are specialised by which of their columns are bound when they are
asked for (an adornment, b and f for each column). Each specialised rule is guarded by the set of bound
values that are asked for; each specialised atom of a body adds to that set what the atoms before it
bind. Relations that are read through negation or aggregates are evaluated in full beforehand.
"""

from __future__ import annotations

from ..lang.ast import Aggregate, Assign, Atom, Call, Compare, Const, Equal, Rule, RuleError, Var, variables

MAX_VARIANTS = 64


class MagicError(RuleError):
    pass


def closure(rules: list[Rule], goal: str) -> set[str]:
    """Derived relations that the goal depends on."""
    heads = {r.head.rel for r in rules}
    seen, todo = set(), [goal]
    while todo:
        p = todo.pop()
        if p in seen or p not in heads:
            continue
        seen.add(p)
        todo += [a.rel for r in rules if r.head.rel == p for a in r.atoms()]
    return seen


def complete_inputs(rules: list[Rule], goal: str) -> set[str]:
    """Derived relations to evaluate in full: those with aggregates or negation, those that such rules read, and what those depend on."""
    own = closure(rules, goal)
    full: set[str] = set()
    for r in rules:
        if r.head.rel in own:
            for a in r.atoms():
                if a.negated:
                    full |= closure(rules, a.rel)
            if r.aggregate() or r.ranges():
                full |= closure(rules, r.head.rel) | {x for s in r.ranges() for x in closure(rules, s)}
    return full


def _ready(x, bound: set[str]) -> bool:
    """Whether a builtin can be evaluated with these variables."""
    if isinstance(x, Assign):
        return set(variables(x.expr)) <= bound
    if isinstance(x, Equal):
        return set(variables(x.left)) <= bound or set(variables(x.right)) <= bound
    if isinstance(x, Call):
        inputs = x.args[1:] if x.name in ("member", "range") else x.args
        return all(set(variables(a)) <= bound for a in inputs)
    return set(variables(x)) <= bound


def order(rule: Rule, bound: set[str], specialised: set[str]) -> list[Atom]:
    """Positive atoms, greedily: most bound arguments, no new variables, base relations first, then as written."""
    left, out, now = rule.positive(), [], set(bound)
    while left:
        best = min(
            range(len(left)),
            key=lambda i: (-sum(isinstance(a, Const) or isinstance(a, Var) and a.name in now for a in left[i].args), len(set(variables(left[i])) - now), left[i].rel in specialised, i),
        )
        out.append(left.pop(best))
        now |= set(variables(out[-1]))
    return out


def _name(rel: str, adornment: str) -> str:
    return f"{rel}__{adornment}"


def _magic(rel: str, adornment: str) -> str:
    return f"magic__{rel}__{adornment}"


def rewrite(rules: list[Rule], goal: str, adornment: str, base: set[str]) -> tuple[list[Rule], str, str]:
    """Rules, the specialised goal and the relation for the seed (one row of the bound values)."""
    own = closure(rules, goal)
    full = complete_inputs(rules, goal)
    if goal in full:
        raise MagicError(f"{goal} has to be evaluated in full")
    special = own - full
    out: list[Rule] = []
    todo, seen = [(goal, adornment)], set()
    while todo:
        rel, ad = todo.pop()
        if (rel, ad) in seen:
            continue
        seen.add((rel, ad))
        if len(seen) > MAX_VARIANTS:
            raise MagicError(f"more than {MAX_VARIANTS} variants")
        if rel in base:  # base facts of a relation that rules define too
            args = tuple(Var(f"B{i}") for i in range(len(ad)))
            guard = Atom(_magic(rel, ad), tuple(a for a, x in zip(args, ad, strict=True) if x == "b"))
            out.append(Rule(Atom(_name(rel, ad), args), (*((guard,) if "b" in ad else ()), Atom(f"{rel}__base", args))))
        for r in (r for r in rules if r.head.rel == rel):
            guard_args = tuple(a for a, x in zip(r.head.args, ad, strict=True) if x == "b")
            guard = (Atom(_magic(rel, ad), guard_args),) if guard_args else ()
            bound = {v for a in guard_args for v in variables(a)}
            body: list = list(guard)
            waiting = [x for x in r.body if not isinstance(x, (Atom, Aggregate, Compare))]
            for a in order(r, bound, special):
                # What can be computed already narrows what is asked for; the rule itself computes it again.
                prior = list(body)
                now = set(bound)
                moved = True
                while moved:
                    moved = False
                    for x in waiting:
                        if x not in prior and _ready(x, now):
                            prior.append(x)
                            now |= set(variables(x))
                            moved = True
                prior += [x for x in r.body if isinstance(x, Compare) and set(variables(x)) <= now]
                if a.rel in special:
                    sub = "".join("b" if isinstance(t, Const) or isinstance(t, Var) and t.name in now else "f" for t in a.args)
                    if "b" in sub:
                        asked = Atom(_magic(a.rel, sub), tuple(t for t, x in zip(a.args, sub, strict=True) if x == "b"))
                        if not (len(prior) == 1 and prior[0] == asked):
                            out.append(Rule(asked, tuple(prior) or (Assign(Var("One"), Const(1)),)))
                    todo.append((a.rel, sub))
                    body.append(Atom(_name(a.rel, sub), a.args, False, a.pattern))
                else:
                    body.append(a)
                bound |= set(variables(a))
            body += [x for x in r.body if not (isinstance(x, Atom) and not x.negated)]
            out.append(Rule(Atom(_name(rel, ad), r.head.args), tuple(body)))
    return out, _name(goal, adornment), _magic(goal, adornment)
