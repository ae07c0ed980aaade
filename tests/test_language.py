"""What parses, what is refused, and why."""

import pytest

from corollary.functions.regex import PatternError, to_java
from corollary.lang.ast import ArityError, ParseError, RuleError, SafetyError, StratificationError, show
from corollary.lang.checks import check_program, lint, stratify
from corollary.lang.parser import parse, parse_goal
from corollary.plans.magic import MagicError, rewrite

REFUSED = [
    ("p(X) :- q(X), !p(X).", StratificationError),
    ("p(X) :- q(X), !r(X). r(X) :- q(X), p(X).", StratificationError),
    ("a(X) :- !blocked(X), q(X).", SafetyError),
    ("a(X) :- q(X), !blocked(Y).", SafetyError),
    ("a(X) :- q(X), Y = X, !blocked(Y).", SafetyError),
    ("p(X, N) :- p(X, Y), N = count().", StratificationError),
    ("p(X, N, M) :- q(X, Y), N = count(), M = sum(Y).", SafetyError),
    ("p(X, N) :- q(X, Y), N = min().", ParseError),
    ("p(X, N) :- q(X, Y), N = count(Y).", ParseError),
    ("p(1, N) :- q(X, Y), N = count().", SafetyError),
    ("p(X, N) :- q(X, Y), N = sum(Z).", SafetyError),
    ("r(X) :- pair(X, Y), Z = (A+B*C.", ParseError),
    ("r(X) :- pair(X, Y), X < foo.", ParseError),
    ("r(X) :- pair(X, Y), Z = X + foo.", ParseError),
    ("r(X) :- pair(X, Y), !X < Y.", ParseError),
    ("r(Z) :- pair(X, Y), Z = X / 0.", SafetyError),
    ("r(Z) :- pair(X, Y), Z = X % 0.", SafetyError),
    ("r(X) :- val(X), X < Y.", SafetyError),
    ("r(Z) :- val(X), Z = Y + 1.", SafetyError),
    ("r(Z) :- val(Y), Z = W + 1, W = Y + 1.", SafetyError),
    ("member(1, 2).", ParseError),
    ("p([X | T]) :- q(X, T).", SafetyError),
    ("p(X) :- q(X), !r([X]).", SafetyError),
    ("p([X | 3]) :- q(X).", ParseError),
    ("p(X) :- q(X), !member(X, [1]).", ParseError),
    ("p(X) :- range(X, p, 1, 5).", StratificationError),
    ("p(X) :- range(X, nowhere, 1, 5).", SafetyError),
    ("p(X) :- q(X), range(Y, q, Z, 5).", SafetyError),
    ("p(X) :- q(X). p(X, Y) :- q(X), q(Y).", ArityError),
    ("p(A,B,C,D,E,F,G,H,I) :- q(A,B,C,D,E,F,G,H,I).", ArityError),
    ("p(X) :- rev(X, Y).", SafetyError),
    ("rev(X, Y) :- q(X), q(Y).", SafetyError),
    ("p(X) :- q(Y).", SafetyError),
    ("p(X) :- q(Y), X = Z.", SafetyError),
    ("p(2147483648).", ParseError),
    ('p(C) :- q(X), C = concat(X, 3).', ParseError),
    ("p(X) :- q(X)", ParseError),
    ("p(X) :- q(X), ?", ParseError),
    ("p(X) :- q(X) ~ 1 'a'.", SafetyError),
]


@pytest.mark.parametrize(("text", "error"), REFUSED)
def test_refused(text, error):
    with pytest.raises(error):
        check_program(parse(text))


def test_positions():
    with pytest.raises(ParseError) as e:
        parse("p(X) :- q(X).\np(X) :- q(X), .\n")
    assert (e.value.line, e.value.column) == (2, 15)


def test_show_round_trip():
    text = "p(X, S) :- q(X, [1, Y | T]), !r(X, 2), Z = ((X + 2) * 3), S = concat(Y, \"ab\"), X < 5, q(Y, T) ~ 1 'a.*'."
    rule = parse(text)[0]
    assert parse(show(rule))[0] == rule


def test_accepts_more():
    check_program(parse("p(1). p(X) :- q(X), 5 < X. # remark\np(X) :- q(X), X != foo, X != \"a b\"."))
    assert lint(parse("p(X) :- q(X, _), r(_, X).")) != []


def test_strata_order():
    s = stratify(parse("c(X) :- b(X), !a(X). b(X) :- a(X). a(X) :- e(X, Y), a(Y). a(X) :- e(X, X)."))
    assert [(x.relations, x.recursive) for x in s] == [(("a",), True), (("b",), False), (("c",), False)]


def test_goal():
    assert show(parse_goal("tc(alice, X).")) == 'tc("alice", X)'
    with pytest.raises(ParseError):
        parse_goal("tc(X) :- q(X)")


def test_magic_refusals():
    counted = parse("n(X, N) :- e(X, Y), N = count().")
    with pytest.raises(MagicError):
        rewrite(counted, "n", "bf", {"e"})
    assert issubclass(MagicError, RuleError)


def test_pattern_translation():
    assert to_java("a.") == r"(?s)\A(?:\x{61}.)\z"
    for bad in ("", "(", "[a", "*a", "a)", "\\", "\\x1", "[b-a]"):
        with pytest.raises(PatternError):
            to_java(bad)
