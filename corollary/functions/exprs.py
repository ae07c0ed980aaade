"""Unsigned 32-bit arithmetic, byte strings and lists, all inside whole-stage code generation."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
MAX_STRING = 4096


def u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def add(a: Column, b: Column) -> Column:
    """Operands count modulo 2**32 (a base column may hold any long), so nothing overflows here or below."""
    return u32(u32(a) + u32(b))


def sub(a: Column, b: Column) -> Column:
    return u32(u32(a) - u32(b))


def mul(a: Column, b: Column) -> Column:
    """By halves: no product exceeds 2**49, so nothing overflows a long."""
    a, b = u32(a), u32(b)
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * b, F.shiftright(a, 16) * b
    return u32(low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16))


def div(a: Column, b: Column) -> Column:
    """Floor; null (no tuple) for a divisor of 0. The guard is in the expression: plans may move filters."""
    safe = F.when(b != 0, b)
    return F.floor((a - F.try_mod(a, safe)) / safe).cast("long")


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, F.when(b != 0, b))


ARITHMETIC = {"+": add, "-": sub, "*": mul, "/": div, "%": mod}


def concat(a: Column, b: Column) -> Column:
    """Null (no tuple) beyond 4096 bytes."""
    return F.when(F.octet_length(a) + F.octet_length(b) <= MAX_STRING, F.concat(a, b))


def lower(s: Column) -> Column:
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def upper(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def string_length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def list_length(x: Column) -> Column:
    return F.size(x).cast("long")


def cons(h: Column, t: Column) -> Column:
    return F.when(t.isNotNull(), F.concat(F.array(h), t))


def car(x: Column) -> Column:
    """Null (no tuple) for an empty list."""
    return F.get(x, F.lit(0))


def cdr(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def sum_u32(c: Column) -> Column:
    """Modulo 2**32; in decimals, since a group may have more than 2**31 rows."""
    return F.pmod(F.sum(c.cast("decimal(20,0)")), F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
