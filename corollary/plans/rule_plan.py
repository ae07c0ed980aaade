"""One rule as one DataFrame expression; Catalyst picks joins, pushes filters and prunes columns.

Variables are columns v0, v1, ... in order of first use (names of variables may differ in case only,
which column names may not). A relation of which nothing is known, not even types, is None: a rule that
reads it gives nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs, regex
from ..lang.ast import PRODUCERS, Aggregate, Assign, Atom, BinOp, Call, Compare, Const, Equal, ListTerm, Rule, TypingError, Var, variables

Relations = Mapping[str, DataFrame | None]


def columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def literal(value: int | str) -> Column:
    return F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)


def kind(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, T.StringType):
        return "string"
    return "int" if isinstance(t, (T.IntegralType,)) else t.typeName()


def same_tuple(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Null-safe equality, which hashes like the plain one: an absent optional value equals another."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's estimate of the size is within its own limit for a broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def dyadic_join(df: DataFrame, values: DataFrame, low: Column, high: Column, bits: int = 32) -> DataFrame:
    """df with each __value of values in [low, high), as an equi-join.

    An interval is made of at most two aligned blocks of each size 2**level, and a value lies in one block of
    each size: they meet in exactly one. So work follows rows and results, never rows times values.
    """
    down, up = (lambda c, k, f=f: F.call_function(f, c, k) for f in ("shiftright", "shiftleft"))
    level = lambda k: down(F.col("__lo") + (up(F.lit(1).cast("long"), k) - 1), k)

    def blocks(k: Column) -> Column:
        a, b = level(k), down(F.col("__hi"), k)
        left = F.when((a < b) & (a % 2 == 1), a)
        right = F.when((a < b) & (b % 2 == 1) & ((b - 1 > a) | (a % 2 == 0)), b - 1)
        return F.array(F.struct(k.alias("__level"), left.alias("__block")), F.struct(k.alias("__level"), right.alias("__block")))

    levels = F.sequence(F.lit(0), F.lit(bits))
    top = F.lit(1 << bits)
    inside = df.withColumn("__lo", F.greatest(low, F.lit(0))).withColumn("__hi", F.least(high, top)).where("__lo < __hi")
    inside = inside.withColumn("__at", F.explode(F.flatten(F.transform(levels, blocks)))).where("__at.__block is not null")
    own = values.select("__value", F.explode(F.transform(levels, lambda k: F.struct(k.alias("__level"), down(F.col("__value"), k).alias("__block")))).alias("__at"))
    return inside.join(own, "__at").drop("__at", "__lo", "__hi")


class RulePlan:
    def __init__(self, spark: SparkSession, rule: Rule, read: Callable[[int, Atom], DataFrame | None], ranges: Relations, null_safe: bool = False):
        """read(i, atom) gives the relation for the i-th atom of the body, negated ones counted too."""
        self.spark, self.rule, self.read, self.ranges, self.null_safe = spark, rule, read, ranges, null_safe
        self.names: dict[str, str] = {}
        self.bound: set[str] = set()
        self.df: DataFrame | None = None

    def col(self, name: str) -> Column:
        return F.col(self.name(name))

    def name(self, var: str) -> str:
        return self.names.setdefault(var, f"v{len(self.names)}")

    def type_of(self, var: str) -> T.DataType:
        return self.df.schema[self.name(var)].dataType

    # Terms

    def term(self, x, like: T.DataType | None = None) -> Column:
        if isinstance(x, Var):
            return self.col(x.name)
        if isinstance(x, Const):
            return literal(x.value)
        if x.tail is not None:
            return exprs.append(self.array(x.items, like), self.col(x.tail.name))
        return self.array(x.items, like)

    def array(self, items: tuple, like: T.DataType | None = None) -> Column:
        if not items:
            return F.array().cast(like if isinstance(like, T.ArrayType) else "array<long>")
        if len({type(i.value) for i in items if isinstance(i, Const)}) > 1:
            raise TypingError("the items of a list are of one type")
        return F.array(*(self.term(i) for i in items))

    def expr(self, e) -> Column:
        if isinstance(e, BinOp):
            return exprs.ARITHMETIC[e.op](self.expr(e.left), self.expr(e.right))
        if isinstance(e, Var) and kind(self.type_of(e.name)) != "int":
            raise TypingError(f"{e.name} isn't a number")
        return self.term(e)

    # Steps

    def filter(self, condition: Column) -> None:
        self.df = self.df.where(condition)

    def bind(self, var: str, value: Column, partial: bool = False) -> None:
        """Binds, or filters if already bound; partial: a null value is no tuple."""
        if var in self.bound:
            # A null-safe match of a null result must not happen either.
            self.filter((self.col(var) == value) if partial or not self.null_safe else self.col(var).eqNullSafe(value))
            return
        self.df = self.df.withColumn(self.name(var), value)
        self.bound.add(var)
        if partial:
            self.filter(self.col(var).isNotNull())

    def relation(self, atom: Atom, df: DataFrame) -> DataFrame:
        """The atom's matches, with a column for each of its variables."""
        conditions: list[Column] = []
        out: dict[str, Column] = {}

        def match(x, c: Column, t: T.DataType) -> None:
            if isinstance(x, Const):
                value_kind = "int" if isinstance(x.value, int) else "string"
                conditions.append(c == literal(x.value) if kind(t) == value_kind or kind(t) not in ("int", "string", "list") else F.lit(False))
            elif isinstance(x, Var):
                if x.name in out:
                    conditions.append(out[x.name].eqNullSafe(c) if self.null_safe else out[x.name] == c)
                else:
                    out[x.name] = c
            elif not isinstance(t, T.ArrayType):
                conditions.append(F.lit(False))
                for v in variables(x):
                    out.setdefault(v, F.lit(None).cast("long"))
            else:
                n = len(x.items)
                conditions.append(F.size(c) >= n if x.tail else F.size(c) == n)
                for i, item in enumerate(x.items):
                    match(item, F.get(c, F.lit(i)), t.elementType)
                if x.tail:
                    match(x.tail, F.slice(c, F.lit(n + 1), F.greatest(F.size(c) - n, F.lit(0))), t)

        for i, a in enumerate(atom.args):
            match(a, F.col(f"c{i}"), df.schema[f"c{i}"].dataType)
        if atom.pattern:
            k, pattern = atom.pattern
            is_text = isinstance(df.schema[f"c{k}"].dataType, T.StringType)
            conditions.append(regex.matches(F.col(f"c{k}"), pattern) if is_text else F.lit(False))
        for c in conditions:
            df = df.where(c)
        return df.select(*(c.alias(self.name(v)) for v, c in out.items())) if out else df.select(F.lit(1).alias("__one")).distinct()

    def join(self, right: DataFrame, shared: list[str], how: str = "inner") -> None:
        names = [self.name(v) for v in shared]
        if not names:
            self.df = self.df.crossJoin(right) if how == "inner" else self.df.join(right, F.lit(True), how)
        elif not self.null_safe:
            self.df = self.df.join(right, names, how)
        else:
            for n in names:
                right = right.withColumnRenamed(n, f"r_{n}")
            on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"r_{n}")) for n in names])
            joined = self.df.join(right, on, how)
            self.df = joined.drop(*(f"r_{n}" for n in names)) if how == "inner" else joined

    def atoms(self, first: int | None) -> bool:
        """Joins the positive atoms, connected ones next to each other, then takes the negated ones away. False: nothing can match."""
        numbered = [(i, x) for i, x in enumerate(self.rule.atoms())]
        left = []
        for i, x in numbered:
            if not x.negated:
                df = self.read(i, x)
                if df is None:
                    return False
                left.append((i, x, self.relation(x, df)))
        # Constants and patterns narrow an atom; a delta, if there is one, leads.
        left.sort(key=lambda t: (t[0] != first, -sum(isinstance(a, Const) for a in t[1].args) - (t[1].pattern is not None), t[0]))
        while left:
            k = max(range(len(left)), key=lambda k: (len(self.bound & set(variables(left[k][1]))), -k)) if self.df is not None else 0
            _, x, df = left.pop(k)
            own = list(dict.fromkeys(variables(x)))
            shared = [v for v in own if v in self.bound]
            if self.df is None:
                self.df = df
            elif self.rule.aggregate() is None and not (set(own) - self.bound) & self.read_later(x, [y for _, y, _ in left]):
                # Nothing of it is needed but that it is there; an aggregate would count its tuples.
                self.join(df.select(*(self.name(v) for v in shared)) if shared else df, shared, "left_semi")
                own = shared
            else:
                self.join(df, shared)
            self.bound |= set(own)
        if self.df is None:
            self.df = self.spark.range(1).select(F.lit(1).alias("__one"))
        elif "__one" in self.df.columns and len(self.df.columns) > 1:
            self.df = self.df.drop("__one")
        for i, x in numbered:
            if x.negated:
                df = self.read(i, x)
                if df is not None:
                    own = list(dict.fromkeys(variables(x)))
                    self.join(self.relation(x, df), own, "left_anti")
        return True

    def read_later(self, atom: Atom, left: list[Atom]) -> set[str]:
        """Variables of the head, of the atoms still to be joined, and of everything but positive atoms."""
        others = [x for x in self.rule.body if not isinstance(x, Atom) or x.negated]
        return {v for x in (self.rule.head, *left, *others) for v in variables(x)}

    def equality(self, x: Equal) -> None:
        a, b = x.left, x.right
        if isinstance(a, ListTerm) and not set(variables(a)) <= self.bound:
            value = self.term(b)
            probe = "__list"
            self.df = self.df.withColumn(probe, value)
            t = self.df.schema[probe].dataType
            if not isinstance(t, T.ArrayType):
                self.filter(F.lit(False))
                return
            n = len(a.items)
            self.filter(F.size(probe) >= n if a.tail else F.size(probe) == n)
            for i, item in enumerate(a.items):
                got = F.get(F.col(probe), F.lit(i))
                if isinstance(item, Var):
                    self.bind(item.name, got)
                elif isinstance(item, Const):
                    self.filter(got == literal(item.value))
                else:
                    self.filter(got == self.term(item, t.elementType))
            if a.tail:
                self.bind(a.tail.name, F.slice(F.col(probe), F.lit(n + 1), F.greatest(F.size(probe) - n, F.lit(0))))
            self.df = self.df.drop(probe)
        elif isinstance(a, Var) and a.name not in self.bound:
            self.bind(a.name, self.term(b))
        elif isinstance(b, Var) and b.name not in self.bound:
            self.bind(b.name, self.term(a))
        else:
            like = self.type_of(a.name) if isinstance(a, Var) else None
            left, right = self.term(a), self.term(b, like)
            self.filter(left.eqNullSafe(right) if self.null_safe else left == right)

    def kind_of(self, x) -> str:
        if isinstance(x, Var):
            return kind(self.type_of(x.name))
        return "list" if isinstance(x, ListTerm) else "int" if isinstance(x.value, int) else "string"

    def producer(self, x: Call) -> None:
        if x.name in ("member", "range"):
            (self.member if x.name == "member" else self.range)(x)
            return
        kinds = [self.kind_of(a) for a in x.args]
        values = [self.term(a) for a in x.args]
        want = {"concat": ("string", "string"), "lower": ("string",), "upper": ("string",), "car": ("list",), "cdr": ("list",), "append": ("list", "list"), "cons": (None, "list")}.get(x.name)
        if want and any(w and w != k for w, k in zip(want, kinds, strict=True)):
            self.nothing(x.result)  # a value of another kind: no tuple
            return
        if x.name == "length":
            value = exprs.list_length(values[0]) if kinds[0] == "list" else exprs.string_length(values[0]) if kinds[0] == "string" else None
            if value is None:
                self.nothing(x.result)
                return
        else:
            value = getattr(exprs, x.name)(*values)
        self.bind(x.result.name, value, partial=True)

    def nothing(self, result: Var | None) -> None:
        self.filter(F.lit(False))
        if result and result.name not in self.bound:
            self.bind(result.name, F.lit(None).cast("long"))

    def member(self, x: Call) -> None:
        item, source = x.args
        if self.kind_of(source) != "list":
            self.nothing(item if isinstance(item, Var) else None)
            return
        value = self.term(source)
        if isinstance(item, Var) and item.name not in self.bound:
            self.df = self.df.withColumn(self.name(item.name), F.explode(value))
            self.bound.add(item.name)
        else:
            self.filter(F.array_contains(value, self.term(item)))

    def range(self, x: Call) -> None:
        item, rel, lo, hi = x.args
        df = self.ranges.get(rel.value)
        low, high = self.term(lo), self.term(hi)
        if df is None:
            self.nothing(item if isinstance(item, Var) else None)
            return
        values = df.select(F.col("c0").alias("__value")).distinct()
        v = F.col("__value")
        # Constant bounds go to the scan.
        for bound, keep in ((lo, lambda b: v >= b), (hi, lambda b: v < b)):
            if isinstance(bound, Const):
                values = values.where(keep(literal(bound.value)))
        inside = (v >= low) & (v < high)
        if isinstance(item, Var) and item.name not in self.bound:
            variable = not (isinstance(lo, Const) and isinstance(hi, Const))
            if variable and isinstance(values.schema["__value"].dataType, T.LongType) and not fits_broadcast(values):
                self.df = dyadic_join(self.df, values, low, high).withColumnRenamed("__value", self.name(item.name))
                self.bound.add(item.name)
                return
            self.df = self.df.join(values, inside).withColumnRenamed("__value", self.name(item.name))
            self.bound.add(item.name)
        else:
            self.df = self.df.join(values, (v == self.term(item)) & inside, "left_semi")

    def comparison(self, x: Compare) -> None:
        left, right = self.kind_of(x.left), self.kind_of(x.right)
        a, b = self.term(x.left), self.term(x.right)
        if x.op == "!=":
            self.filter(F.lit(True) if left != right else ~a.eqNullSafe(b))
            return
        if "string" in (left, right) or "list" in (left, right):
            raise TypingError("only numbers have an order in rules")
        self.filter({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op])

    def string_filter(self, x: Call) -> None:
        if any(self.kind_of(a) != "string" for a in x.args):
            self.filter(F.lit(False))
            return
        s, p = (self.term(a) for a in x.args)
        self.filter({"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains}[x.name](s, p))

    def bindings(self, first: int | None = None) -> DataFrame | None:
        """All bindings of the body, one row each; None if a relation that is read has nothing."""
        if not self.atoms(first):
            return None
        body = self.rule.body
        for x in body:
            if isinstance(x, Equal):
                self.equality(x)
        for x in body:
            if isinstance(x, Assign):
                self.bind(x.var.name, self.expr(x.expr), partial=True)
            elif isinstance(x, Call) and (x.name in PRODUCERS or x.name in ("member", "range")):
                self.producer(x)
        for x in body:
            if isinstance(x, Compare):
                self.comparison(x)
            elif isinstance(x, Call) and x.name in ("prefix", "suffix", "contains"):
                self.string_filter(x)
        return self.df

    def keys(self) -> list[str]:
        """Columns of the group of an aggregate rule, in the order of the head."""
        a = self.rule.aggregate()
        return [self.name(v.name) for v in self.rule.head.args if v.name != a.var.name]

    def head(self, distinct: bool = True, restrict: DataFrame | None = None) -> DataFrame | None:
        """Tuples of the head as c0, c1, ...; restrict: groups (columns g0, g1, ...) that an aggregate is wanted of."""
        df = self.bindings()
        return None if df is None else self.project(df, distinct, restrict)

    def project(self, df: DataFrame, distinct: bool = True, restrict: DataFrame | None = None) -> DataFrame:
        a = self.rule.aggregate()
        if a is None:
            out = df.select(*(self.head_value(x).alias(f"c{i}") for i, x in enumerate(self.rule.head.args)))
            return out.distinct() if distinct else out
        keys = list(dict.fromkeys(self.keys()))
        if restrict is not None and keys:
            on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"g{i}")) for i, k in enumerate(keys)])
            df = df.join(restrict, on, "left_semi")
        if a.fn == "count":
            value = F.count(F.lit(1))
        else:
            if kind(self.type_of(a.source.name)) != "int":
                raise TypingError(f"{a.fn} is of numbers")
            source = self.col(a.source.name)
            value = exprs.sum_u32(source) if a.fn == "sum" else F.min(source) if a.fn == "min" else F.max(source)
        grouped = df.groupBy(*keys).agg(value.alias("__value"), F.count(F.lit(1)).alias("__n")).where("__n > 0")
        return grouped.select(*(F.col("__value" if x.name == a.var.name else self.name(x.name)).alias(f"c{i}") for i, x in enumerate(self.rule.head.args)))

    def head_value(self, x) -> Column:
        return self.term(x)


#: If two joined atoms have more bindings than the square, each key's rows are cut into parts of so many, and each pair of parts is a piece of work.
SIDE = 2_000


def pairs(spark: SparkSession, rule: Rule, read: Callable[[int, Atom], DataFrame | None]) -> DataFrame | None:
    """A rule of two atoms whose head drops what they share and keeps all else, if its bindings are many; else None.

    Bindings are counted by key. A key's rows are cut into parts by hash, on either side, and each part meets each of the other side.
    A pair is there twice only if its left row has more than one key, so only pairs of such rows are made distinct:
    the others, which are the result, aren't shuffled. Comparisons take rows away only, and stay where they were.
    """
    atoms = list(rule.positive())
    if len(atoms) != 2 or any(isinstance(x, Atom) and x.negated or not isinstance(x, (Atom, Compare)) for x in rule.body):
        return None
    own = [set(variables(a)) for a in atoms]
    shared, head = own[0] & own[1], set(variables(rule.head))
    drop = shared - head
    if not drop or not (own[0] ^ own[1]) <= head or not (own[0] - shared and own[1] - shared) or any(not isinstance(x, (Var, Const)) for x in rule.head.args):
        return None
    plan = RulePlan(spark, rule, read, {})
    given = [read(i, a) for i, a in enumerate(rule.atoms())]
    if any(df is None for df in given):
        return None
    left, right = (plan.relation(a, df) for a, df in zip(atoms, given, strict=True))
    names = sorted(plan.name(v) for v in shared)
    counted = left.groupBy(*names).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(*names).agg(F.count(F.lit(1)).alias("r")), names)
    many = counted.agg(F.sum(F.col("l").cast("double") * F.col("r"))).first()[0] or 0
    if many <= SIDE**2:
        return None
    size = lambda c: F.ceil(F.col(c) / SIDE).cast("int")
    cut = counted.select(*names, size("l").alias("__ls"), size("r").alias("__rs"))

    def spread(df: DataFrame, by: list[str], mine: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*by), F.col(f"__{mine}s")).cast("int")
        parts = df.join(cut, names).withColumn(f"__{mine}", part).withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__{other}s") - 1)))
        # A number that is given isn't coalesced: the rows of a part are few, what they give isn't.
        return parts.drop("__ls", "__rs").repartition(n, *on)

    on, n = [*names, "__l", "__r"], int(min(10_000, 2 * many // SIDE**2 + 1))
    rest = lambda df: [c for c in df.columns if c not in {plan.name(v) for v in drop}]
    keys = left.groupBy(*rest(left)).agg((F.count(F.lit(1)) == 1).alias("__single"))
    lefts, rights = spread(left.join(keys, rest(left)), rest(left), "l", "r"), spread(right, rest(right), "r", "l")

    def half(some: DataFrame, distinct: bool) -> DataFrame:
        plan.df, plan.bound = some.drop("__single").join(rights, on).drop("__l", "__r"), own[0] | own[1]
        for x in rule.body:
            if isinstance(x, Compare):
                plan.comparison(x)
        return plan.project(plan.df, distinct)

    return half(lefts.where("__single"), False).unionByName(half(lefts.where("not __single"), True))


#: Beyond so many bytes, by Spark's estimate, the items of lists are counted; if they hardly repeat, they are made distinct in parts of so many rows.
#: Spark writes as many as PARTS without sorting what a task reads in its memory: parts grow to five times the rows before there are more.
BYTES, ROWS, PARTS = 4_000_000, 500_000, 200


def generates(rule: Rule) -> bool:
    """Whether it makes several rows of one of a relation's, by the items of a list."""
    return len(rule.atoms()) == 1 and any(isinstance(x, Call) and x.name == "member" for x in rule.body)


def parts(many: int) -> int:
    return min(10_000, max(min(PARTS, many // ROWS + 1), many // (5 * ROWS) + 1))


def apart(df: DataFrame) -> DataFrame:
    """Each row once. A task that reads rows which hardly repeat would hold all of them before the shuffle, for nothing:
    they are shuffled as they are, into as many parts as their number asks for."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BYTES:
        return df.distinct()
    many, own = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*df.columns))).first()
    if many <= ROWS or own < many / 4:
        return df.distinct()
    return df.repartition(parts(many), *df.columns).distinct()


def evaluate(spark: SparkSession, rule: Rule, read: Callable[[int, Atom], DataFrame | None], ranges: Relations, distinct: bool = True, null_safe: bool = False, first: int | None = None) -> DataFrame | None:
    if distinct and not null_safe and first is None and (df := pairs(spark, rule, read)) is not None:
        return df
    plan = RulePlan(spark, rule, read, ranges, null_safe)
    df = plan.bindings(first)
    if df is not None and distinct and rule.aggregate() is None and generates(rule):
        return apart(plan.project(df, False))
    return None if df is None else plan.project(df, distinct)


def has_aggregate(rule: Rule) -> bool:
    return any(isinstance(x, Aggregate) for x in rule.body)
