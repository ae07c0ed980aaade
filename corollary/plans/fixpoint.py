"""Strata in order; inside a recursive one, a semi-naive loop over written deltas.

A round joins each recursive rule once for each of its recursive atoms, with the last round's new
tuples in its place, takes away what is known and writes the rest. Rounds are what costs, so a
transitive closure (recognised by its rules) is doubled: what is known is joined with the pairs of the last
round's greatest distance, which takes as many rounds as the path length has binary digits. Rules of strata without recursion stay lazy: a query
that needs no loop is one Catalyst plan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import Atom, Rule, TypingError, Var
from ..lang.checks import Stratum, key, stratify
from ..store import scratch
from . import rule_plan

MAX_ROUNDS = 10_000_000
COMPACT_PARTS = 12


def union(parts: Iterable[DataFrame | None]) -> DataFrame | None:
    own = [p for p in parts if p is not None]
    if not own:
        return None
    kinds = {tuple(rule_plan.kind(f.dataType) for f in p.schema.fields) for p in own}
    if len(kinds) > 1:
        raise TypingError(f"rules of one relation differ in their columns' types: {sorted(kinds)}")
    return reduce(DataFrame.unionByName, own)


def without(df: DataFrame, known: DataFrame) -> DataFrame:
    known = known.select(*(known[c].alias(f"k_{c}") for c in known.columns))
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(known[f"k_{c}"]) for c in df.columns])
    return df.join(known, on, "left_anti")


def closure_of(stratum: Stratum, base: dict[str, DataFrame]) -> Atom | None:
    """The edge atom if the stratum is p = edge | edge p (or p edge, or p p), else None."""
    if len(stratum.relations) != 1 or len(stratum.rules) != 2 or stratum.relations[0] in base:
        return None
    p = stratum.relations[0]
    exits = [r for r in stratum.rules if all(a.rel != p for a in r.atoms())]
    steps = [r for r in stratum.rules if any(a.rel == p for a in r.atoms())]
    if len(exits) != 1 or len(steps) != 1 or len(exits[0].body) != 1 or len(steps[0].body) != 2:
        return None
    out, step = exits[0], steps[0]
    plain = lambda a: isinstance(a, Atom) and not a.negated and a.pattern is None and len(a.args) == 2 and all(isinstance(x, Var) for x in a.args)
    if not all(plain(a) for a in (out.head, step.head, *out.body, *step.body)) or out.head.args != out.body[0].args or len(set(out.head.args)) < 2:
        return None
    edge = out.body[0]
    x, y = step.head.args
    for a, b in (step.body, step.body[::-1]):
        chained = a.args[0] == x and a.args[1] == b.args[0] and b.args[1] == y and len({x, y, a.args[1]}) == 3
        if chained and {a.rel, b.rel} <= {p, edge.rel} and p in (a.rel, b.rel):
            return edge
    return None


#: So many edges of two columns are searched at the driver; so many tuples of a round stay there instead of being written.
DRIVER_EDGES, SMALL = 1_000_000, 5_000


def reached(edges: DataFrame, start, forward: bool) -> DataFrame:
    """(c0, c1): pairs of the closure of edges (c0, c1) whose first (else second) member is start.

    A frontier, not pairs: a counted edge table of at most DRIVER_EDGES rows is searched at the driver, others
    by joins, one a step, over written frontiers.
    """
    spark = edges.sparkSession
    src, dst = ("c0", "c1") if forward else ("c1", "c0")
    kind = edges.schema[src].dataType
    own = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    schema = T.StructType([T.StructField("b", kind)])
    if own.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES:
        table = own.toArrow()
        names, code = np.unique(np.concatenate([table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]), return_inverse=True)
        n = table.num_rows
        order = np.argsort(code[:n], kind="stable")
        to, at = code[n:][order], np.searchsorted(code[:n][order], np.arange(len(names) + 1))
        i = int(np.searchsorted(names, start)) if len(names) else 0
        seen, front = np.zeros(len(names), bool), np.array([i] if i < len(names) and names[i] == start else [], np.int64)
        while len(front):
            many = at[front + 1] - at[front]
            new = np.unique(to[np.repeat(at[front] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])
            front = new[~seen[new]]
            seen[front] = True
        found = spark.createDataFrame([(x,) for x in names[seen].tolist()], schema)
    else:
        known = front = scratch.write(own.where(F.col("a") == F.lit(start).cast(kind)).select("b").distinct(), "front")
        while front.rows:
            step = own.join(front.df(spark).withColumnRenamed("b", "a"), "a", "left_semi").select("b").distinct()
            front = scratch.write(step.join(known.df(spark), "b", "left_anti"), "front")
            known = known.plus(front) if front.rows else known
        found = known.df(spark)
    ends = (F.lit(start).cast(kind), F.col("b")) if forward else (F.col("b"), F.lit(start).cast(kind))
    return found.select(ends[0].alias("c0"), ends[1].alias("c1"))


@dataclass
class Held:
    """A small relation at the driver, in the place of a written one."""

    schema: object
    table: pa.Table

    @property
    def rows(self) -> int:
        return self.table.num_rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.table, self.schema)


@dataclass
class Sum:
    """A written relation and a small one that goes on from it."""

    written: scratch.Table | None
    held: Held | None

    @property
    def schema(self) -> object:
        return (self.written or self.held).schema

    @property
    def rows(self) -> int:
        return sum(x.rows for x in (self.written, self.held) if x)

    @property
    def paths(self) -> list[str]:
        return self.written.paths if self.written else []

    def df(self, spark: SparkSession) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.df(spark) for x in (self.written, self.held) if x])


def put(df: DataFrame, name: str, small: bool) -> scratch.Table | Held:
    """The tuples of a round: at the driver if they are expected to be few and are, else written."""
    if small:
        table = df.limit(SMALL + 1).toArrow()
        if table.num_rows <= SMALL:
            return Held(df.schema, table)
    return scratch.write(df, name)


class Evaluator:
    """views holds every relation that is known: base and, once run, derived ones."""

    def __init__(self, spark: SparkSession, rules: list[Rule], base: dict[str, DataFrame], variadic: set[str] = frozenset(), null_safe: bool = False, counters: Counter | None = None, doubling: bool = True, bags: dict[str, DataFrame] | None = None):
        self.spark, self.rules, self.base, self.variadic, self.null_safe, self.doubling = spark, [r for r in rules if r.body], base, variadic, null_safe, doubling
        self.counters = Counter() if counters is None else counters
        self.views: dict[str, DataFrame | None] = dict(base)
        self.bags = {**(bags or {})}  # relations with repeats, from which their views are made
        self.single: dict[str, Rule] = {}  # rules that a bag can be made by
        self.kept: dict[str, DataFrame] = {}
        self.tables: dict[str, scratch.Table] = {}  # closures as they were written
        self.added: dict[str, list] = {}  # what a seeded loop found, by round

    def key(self, atom: Atom) -> str:
        return key(atom.rel, len(atom.args), self.variadic)

    def read(self, atom: Atom) -> DataFrame | None:
        return self.views.get(self.key(atom))

    def kept_view(self, name: str) -> DataFrame | None:
        """The view, written once if it isn't a table already: a loop reads it in every round."""
        if name not in self.kept:
            df = self.views.get(name)
            if df is None:
                return None
            plan = df._jdf.queryExecution().optimizedPlan()
            self.kept[name] = df if plan.getClass().getSimpleName() == "LogicalRelation" else scratch.write(df, "edb").df(self.spark)
        return self.kept[name]

    def bag(self, _: int, atom: Atom) -> DataFrame | None:
        """The atom's relation, with repeats if it would be made distinct first."""
        name = self.key(atom)
        if name not in self.bags and name in self.single:
            self.bags[name] = self.rule(self.single[name], self.bag, distinct=False)
        return self.bags[name] if name in self.bags else self.read(atom)

    @staticmethod
    def repeats(rule: Rule) -> bool:
        """Whether repeats in what it reads only repeat its tuples: it joins and counts nothing."""
        return len(rule.atoms()) == len(rule.positive()) == 1 and rule.aggregate() is None and not rule.ranges()

    def rule(self, rule: Rule, read=None, distinct: bool = True, first: int | None = None) -> DataFrame | None:
        return rule_plan.evaluate(self.spark, rule, read or (lambda _, a: self.read(a)), self.views, distinct, self.null_safe, first)

    def needed(self, goals: Iterable[str] | None) -> list[Stratum]:
        strata = stratify(self.rules, self.variadic)
        if goals is None:
            return strata
        want, out = set(goals), []
        for s in reversed(strata):
            if want & set(s.relations):
                out.append(s)
                for r in s.rules:
                    want |= {self.key(a) for a in r.atoms()} | set(r.ranges())
        return out[::-1]

    def run(self, goals: Iterable[str] | None = None) -> dict[str, DataFrame | None]:
        for s in self.needed(goals):
            self.views.update(self.stratum(s))
        return self.views

    def stratum(self, s: Stratum) -> dict[str, DataFrame | None]:
        if not s.recursive:
            name = s.relations[0]
            self.counters["strata"] += 1
            # What is made distinct in the end needn't be so before.
            read = lambda r: self.bag if self.repeats(r) else None
            if len(s.rules) == 1 and name not in self.base:
                if self.repeats(s.rules[0]):
                    self.single[name] = s.rules[0]
                return {name: self.rule(s.rules[0], read(s.rules[0]))}
            df = union([self.base.get(name), *(self.rule(r, read(r), distinct=False) for r in s.rules)])
            return {name: None if df is None else rule_plan.apart(df) if any(map(rule_plan.generates, s.rules)) else df.distinct()}
        edge = closure_of(s, self.base) if self.doubling else None
        return self.closure(s, edge) if edge is not None else self.loop(s)

    def closure(self, s: Stratum, edge: Atom) -> dict[str, DataFrame | None]:
        """In round k all pairs of a distance up to 2**k are known; those of exactly 2**k ("last") go on from the others.

        A pair of a distance beyond that, up to twice of it, is made of one of exactly 2**k and one that is known, so
        a pair with one path is found once, and not once for each way to cut it.
        """
        name = s.relations[0]
        start = self.kept_view(self.key(edge))
        if start is None:
            return {name: None}
        self.counters["closures"] += 1
        start = start.toDF("c0", "c1")
        total = scratch.write(start.distinct(), name)
        delta, older = total, None
        # The known pairs are grouped by the end at which fewer edges meet: there they are few to a key.
        fan = lambda c: total.df(self.spark).groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        forward = fan("c0") <= fan("c1")
        while delta.rows:
            self.counters["rounds"] += 1
            fresh = delta.df(self.spark) if older is not None else delta.df(self.spark).withColumn("last", F.lit(True))
            last = fresh.where("last").drop("last")
            known = fresh if older is None else fresh.unionByName(older.df(self.spark).withColumn("last", F.lit(False)))
            if forward:
                left, right = last.toDF("c0", "m"), known.toDF("m", "c1", "last")
            else:
                left, right = known.toDF("c0", "m", "last"), last.toDF("m", "c1")
            new = self.spread(left, right, known, total.rows, forward) if total.rows > rule_plan.ROWS else None
            if new is None:
                cand = left.join(right, "m").groupBy("c0", "c1").agg(F.min("last").alias("last"))
                old = known.select(F.col("c0").alias("k_c0"), F.col("c1").alias("k_c1"))
                new = cand.join(old, F.col("c0").eqNullSafe(F.col("k_c0")) & F.col("c1").eqNullSafe(F.col("k_c1")), "left_anti")
            delta, older = scratch.write(new, name), total
            if delta.rows:
                total = total.plus(delta)
        self.tables[name] = total
        return {name: total.df(self.spark)}

    @staticmethod
    def spread(left: DataFrame, right: DataFrame, known: DataFrame, rows: int, forward: bool) -> DataFrame | None:
        """A round's new pairs, in parts by the number of rows, which is given and so isn't coalesced.

        Bindings are counted by key; without any there is nothing new. None if they are more than four times what is
        known, when it is better to make them distinct before the shuffle, or if a key alone has more rows than a part:
        both are left to Spark.
        """
        n = F.count(F.lit(1))
        sides = left.groupBy("m").agg(n.alias("l")).join(right.groupBy("m").agg(n.alias("r")), ["m"], "full")
        many, *most = sides.agg(F.sum(F.col("l").cast("double") * F.col("r")), F.max("l"), F.max("r")).first()
        if many is None:
            return known.limit(0)
        if many > 4 * rows or max(most) > rule_plan.ROWS:
            return None
        at = rule_plan.parts(2 * rows)
        cand = left.repartition(at, "m").join(right.repartition(at, "m").hint("merge"), "m")
        # A node's pairs are at most the square of the most that are known of one: if these are few, they stay together.
        end = ("c0", "c1")[not forward]
        by = [end] if most[forward] ** 2 <= rule_plan.ROWS else ["c0", "c1"]
        both = cand.select("c0", "c1", "last", F.lit(False).alias("old")).unionByName(known.withColumn("old", F.lit(True)))
        both = both.repartition(rule_plan.parts(rows + int(many)), *by)
        return both.groupBy("c0", "c1").agg(F.min("last").alias("last"), F.max("old").alias("old")).where("not old").drop("old")

    def grow(self, total, new: DataFrame, name: str, small: bool = False) -> tuple:
        """What is known with what is new, and the latter. Small rounds stay at the driver until they are many."""
        delta = put(new, name, small)
        if not delta.rows:
            return total, delta
        written, held = (total.written, total.held) if isinstance(total, Sum) else (None, total) if isinstance(total, Held) else (total, None)
        if isinstance(delta, Held):
            held = Held(delta.schema, pa.concat_tables([held.table, delta.table.cast(held.table.schema)])) if held else delta
            if held.rows > SMALL:
                own = scratch.write(held.df(self.spark), name)
                written, held = own if written is None else written.plus(own), None
        else:
            written = delta if written is None else written.plus(delta)
        if written is not None and len(written.paths) > COMPACT_PARTS:
            written = scratch.write(written.df(self.spark), name)
        return Sum(written, held), delta

    def loop(self, s: Stratum, seeds: dict[str, tuple[scratch.Table, scratch.Table]] | None = None) -> dict[str, DataFrame | None]:
        """seeds: for a start that isn't from nothing, what is known and what of it is new."""
        inside = set(s.relations)
        for r in s.rules:
            for n in {self.key(a) for a in r.atoms()} - inside:
                self.kept_view(n)
        recursive = [r for r in s.rules if any(self.key(a) in inside for a in r.positive())]
        total: dict[str, scratch.Table] = {}
        delta: dict[str, scratch.Table] = {}
        outer = lambda a: self.kept_view(self.key(a))
        if seeds is None:
            for n in s.relations:
                own = [r for r in s.rules if self.key(r.head) == n and r not in recursive]
                df = union([self.base.get(n), *(self.rule(r, lambda _, a: outer(a), distinct=False) for r in own)])
                if df is not None:
                    total[n] = delta[n] = put(df.distinct(), n.replace("/", "_"), True)
        else:
            total, delta = {n: t for n, (t, _) in seeds.items()}, {n: d for n, (_, d) in seeds.items()}
            self.added = {n: [d] for n, d in delta.items() if d.rows}
        for _ in range(MAX_ROUNDS):
            if not any(d.rows for d in delta.values()):
                return {n: total[n].df(self.spark) if n in total else None for n in s.relations}
            self.counters["rounds"] += 1
            found: dict[str, list[DataFrame]] = {}
            for r in recursive:
                for i, a in enumerate(r.atoms()):
                    if a.negated or self.key(a) not in inside or not delta.get(self.key(a)) or not delta[self.key(a)].rows:
                        continue

                    def read(j: int, b: Atom, i: int = i) -> DataFrame | None:
                        k = self.key(b)
                        if k not in inside:
                            return outer(b)
                        t = delta.get(k) if i == j else total.get(k)
                        return None if t is None else t.df(self.spark)

                    df = self.rule(r, read, distinct=False, first=i)
                    if df is not None:
                        found.setdefault(self.key(r.head), []).append(df)
            fresh: dict[str, scratch.Table] = {}
            grown = dict(total)
            for n, parts in found.items():
                cand = union([*parts, *([total[n].df(self.spark).limit(0)] if n in total else [])]).distinct()
                few = all(d.rows <= SMALL for d in delta.values())
                if n in total:
                    grown[n], fresh[n] = self.grow(total[n], without(cand, total[n].df(self.spark)), n.replace("/", "_"), few)
                else:
                    grown[n] = fresh[n] = put(cand, n.replace("/", "_"), few)
            total, delta = grown, fresh
            for n, d in fresh.items():
                if d.rows:
                    self.added.setdefault(n, []).append(d)
        raise RuntimeError(f"{s.relations} don't come to an end")
