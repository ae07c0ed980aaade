"""Incremental maintenance of derived relations.

Strata are taken in order, each with the additions and deletions of what it reads:
  additions to positive rules are joined with the rest, recursive strata go on from what they have;
  deletions from positive rules over-delete what they had a part in (in a loop where there is recursion),
  and put back what other facts still give;
  aggregates are computed anew for the groups that changed;
  anything else is evaluated in full, and the difference goes on.
Each way is counted, so that a test can tell which one was taken. Results equal a full evaluation.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import Atom, Rule, Var
from ..lang.checks import Stratum, stratify
from ..plans.fixpoint import Evaluator, union, without
from ..plans.rule_plan import RulePlan
from ..store import scratch
from ..store.relations import Relations

if TYPE_CHECKING:
    from ..session import Database

Change = tuple[scratch.Table | None, scratch.Table | None]


class Maintainer:
    def __init__(self, db: Database):
        self.db = db
        self.since = 0  # the version that holds the views
        self.start()

    def start(self) -> None:
        """Evaluates everything. Base relations that no rule defines aren't copied."""
        db = self.db
        self.rules, self.base, self.noted = list(db.rules), dict(db.base), Relations(db.spark, None)
        heads = {db.key(r.head.rel, len(r.head.args)) for r in self.rules}
        e = db.evaluator()
        self.views = {k: e.tables.get(k) or self.keep(v, k) if k in heads else scratch.Given(v) for k, v in e.run().items() if v is not None}
        self.changes: dict[str, Change] = {}

    @staticmethod
    def keep(df: DataFrame, name: str) -> scratch.Table:
        return scratch.write(df, name.replace("/", "_"))

    def noted_in(self, name: str, schema: T.StructType) -> Relations:
        if name not in self.noted:
            self.noted[name] = self.db.spark.createDataFrame([], schema)
            self.noted.own[name].rows = 1 << 60  # its changes are never worked in
        return self.noted

    def note(self, name: str, rows: list[tuple], sign: int) -> None:
        """Changes of the base; a later one of the same tuple overrides an earlier one."""
        schema = self.db.base.schema(name)
        self.noted_in(name, schema).change(name, rows, sign, schema)

    def note_table(self, name: str, df: DataFrame, sign: int) -> None:
        self.noted_in(name, self.db.base.schema(name)).change_table(name, df, sign)

    def publish(self) -> dict[str, DataFrame]:
        spark, db = self.db.spark, self.db
        if self.rules != db.rules:
            db.counters["maintain_full"] += 1
            self.start()
            self.since = 0
            return {k: t.df(spark) for k, t in self.views.items()}
        old = dict(self.views)
        changes: dict[str, Change] = {}
        heads = {db.key(r.head.rel, len(r.head.args)) for r in self.rules}
        base_changes: dict[str, Change] = {}
        for name in list(self.noted):
            was, noted = self.base.get(name), self.noted.difference(name)
            if noted is None:
                continue
            up, down = (noted.where(f"sign {s} 0").drop("sign") for s in "><")
            up = self.keep(up if was is None else without(up, was), "plus")
            down = None if was is None else self.keep(down.join(was, [down[c].eqNullSafe(was[c]) for c in was.columns], "left_semi"), "minus")
            base_changes[name] = (up if up.rows else None, down if down and down.rows else None)
            if name not in heads:
                self.settle(name, base_changes[name], old, changes)
        for s in stratify(self.rules, db.variadic):
            self.stratum(s, old, changes, base_changes)
        self.noted, self.base, self.changes = Relations(spark, None), dict(db.base), changes
        return {k: t.df(spark) for k, t in self.views.items()}

    def unchanged(self) -> set[str]:
        """Views that the last publication left as they were."""
        return {n for n in self.views if not any(self.changes.get(n, (None, None)))}

    def grown(self) -> dict[str, DataFrame]:
        """What the last publication added to views that lost nothing."""
        return {n: up.df(self.db.spark) for n, (up, down) in self.changes.items() if up and not down}

    def settle(self, name: str, change: Change, old: dict[str, scratch.Table], changes: dict[str, Change]) -> None:
        up, down = change
        if up is None and down is None:
            return
        self.views[name], changes[name] = scratch.Given(self.db.base[name]), (up, down)

    def evaluator(self, views: dict[str, scratch.Table]) -> Evaluator:
        e = Evaluator(self.db.spark, self.rules, dict(self.db.base), self.db.variadic, self.db.null_safe, self.db.counters, self.db.doubling)
        e.views = {k: t.df(self.db.spark) for k, t in views.items()}
        e.kept = dict(e.views)
        return e

    def stratum(self, s: Stratum, old: dict, changes: dict[str, Change], base_changes: dict[str, Change]) -> None:
        db, key = self.db, lambda a: self.db.key(a.rel, len(a.args))
        reads = {key(a) for r in s.rules for a in r.atoms()} | {n for r in s.rules for n in r.ranges()}
        touched = [n for n in reads if n in changes]
        own = {n: base_changes[n] for n in s.relations if n in base_changes}
        if not touched and not own:
            return
        positive = all(not a.negated for r in s.rules for a in r.atoms()) and not any(r.aggregate() or r.ranges() for r in s.rules)
        losing = any(changes[n][1] for n in touched) or any(c[1] for c in own.values())
        if positive and not losing:
            self.insert(s, old, changes, own)
        elif positive and not s.recursive and not own:
            self.delete(s, old, changes)
        elif positive and s.recursive:
            self.delete_recursive(s, old, changes, own)
        elif len(s.rules) == 1 and s.rules[0].aggregate() and not s.recursive and not own and not s.rules[0].ranges() and all(not a.negated for a in s.rules[0].atoms()):
            self.regroup(s, old, changes)
        else:
            db.counters["maintain_recompute"] += 1
            views = self.evaluator(self.views).stratum(s)
            for n, df in views.items():
                if df is None:
                    continue
                now = self.keep(df, n)
                was = old.get(n)
                up = now if was is None else self.keep(without(now.df(db.spark), was.df(db.spark)), "plus")
                down = None if was is None else self.keep(without(was.df(db.spark), now.df(db.spark)), "minus")
                self.views[n], changes[n] = now, (up if up.rows else None, down if down and down.rows else None)

    def parts(self, s: Stratum, views: Evaluator, changes: dict[str, Change], which: int) -> dict[str, list[DataFrame]]:
        """For each head, tuples that a rule gives with a changed tuple in the place of one of its atoms."""
        out: dict[str, list[DataFrame]] = {}
        for r in s.rules:
            for i, a in enumerate(r.atoms()):
                change = changes.get(self.db.key(a.rel, len(a.args)))
                if not change or change[which] is None:
                    continue

                def read(j: int, b: Atom, i: int = i, t: scratch.Table = change[which]) -> DataFrame | None:
                    return t.df(self.db.spark) if i == j else views.read(b)

                df = views.rule(r, read, distinct=False, first=i)
                if df is not None:
                    out.setdefault(self.db.key(r.head.rel, len(r.head.args)), []).append(df)
        return out

    def insert(self, s: Stratum, old: dict, changes: dict[str, Change], own: dict[str, Change]) -> None:
        db = self.db
        db.counters["maintain_insert_recursive" if s.recursive else "maintain_insert"] += 1
        found = self.parts(s, self.evaluator(self.views), changes, 0)
        for n, (up, _) in own.items():
            if up:
                found.setdefault(n, []).append(up.df(db.spark))
        seeds = {}
        for n in s.relations:
            was = old.get(n)
            cand = union(found.get(n, []))
            if cand is None:
                if was is not None:
                    seeds[n] = (was, scratch.Table(was.schema, [], 0))
                continue
            new = self.keep(cand.distinct() if was is None else without(cand.distinct(), was.df(db.spark)), n)
            seeds[n] = (new if was is None else was.plus(new), new)
        if s.recursive:
            views = self.evaluator(self.views).loop(s, seeds)
            for n, df in views.items():
                if df is not None:
                    was = old.get(n)
                    now = self.keep(df, n)
                    up = now if was is None else self.keep(without(now.df(db.spark), was.df(db.spark)), "plus")
                    self.views[n], changes[n] = now, (up if up.rows else None, None)
        else:
            for n, (total, new) in seeds.items():
                self.views[n], changes[n] = total, (new if new.rows else None, None)

    def delete(self, s: Stratum, old: dict, changes: dict[str, Change]) -> None:
        """Over-delete, then put back what is still derivable, then add."""
        db, n = self.db, s.relations[0]
        db.counters["maintain_delete"] += 1
        before, now = self.evaluator(old), self.evaluator(self.views)
        lost = union(self.parts(s, before, changes, 1).get(n, []))
        was = old[n].df(db.spark) if n in old else None
        down = None
        if lost is not None and was is not None:
            over = self.keep(lost.distinct().join(was, was.columns, "left_semi"), "over")
            again = []
            for r in s.rules:
                df = now.rule(r, distinct=False)
                if df is not None:
                    again.append(df.join(over.df(db.spark), df.columns, "left_semi"))
            if n in db.base:
                again.append(db.base[n].join(over.df(db.spark), was.columns, "left_semi"))
            back = union(again)
            down = over if back is None else self.keep(without(over.df(db.spark), back), "minus")
        rest = was if down is None or not down.rows else without(was, down.df(db.spark))
        found = union(self.parts(s, now, changes, 0).get(n, []))
        up = None
        if found is not None:
            up = self.keep(found.distinct() if rest is None else without(found.distinct(), rest), "plus")
        total = union([rest, None if up is None else up.df(db.spark)])
        if total is not None:
            self.views[n] = self.keep(total, n)
            changes[n] = (up if up and up.rows else None, down if down and down.rows else None)

    def delete_recursive(self, s: Stratum, old: dict, changes: dict[str, Change], own: dict[str, Change]) -> None:
        """Over-deletes in a loop all that a lost tuple had a part in, puts back what is still given in one step, and goes on from there."""
        db, spark = self.db, self.db.spark
        db.counters["maintain_delete_recursive"] += 1
        before = self.evaluator(old)
        gone: dict[str, scratch.Table] = {}
        front = {n: c for n, c in changes.items() if c[1] is not None}
        lost = {n: [c[1].df(spark)] for n, c in own.items() if c[1] is not None}
        while front or lost:
            for n, parts in self.parts(s, before, front, 1).items():
                lost.setdefault(n, []).extend(parts)
            front = {}
            for n, parts in lost.items():
                if n not in old:
                    continue
                # All of it is in the old view, which holds what its rules give from old tuples.
                df = union(parts).distinct()
                new = self.keep(df if n not in gone else without(df, gone[n].df(spark)), "over")
                if new.rows:
                    gone[n] = new if n not in gone else gone[n].plus(new)
                    front[n] = (None, new)
            lost = {}
        rest = {n: self.keep(without(old[n].df(spark), gone[n].df(spark)), n) if n in gone else old.get(n) for n in s.relations}
        now = self.evaluator(self.views | {n: t for n, t in rest.items() if t is not None})
        again: dict[str, list[DataFrame]] = {n: [up.df(spark)] for n, (up, _) in own.items() if up}
        for n, parts in self.parts(s, now, changes, 0).items():
            again.setdefault(n, []).extend(parts)
        for n, t in gone.items():
            over = t.df(spark)
            for r in (r for r in s.rules if db.key(r.head.rel, len(r.head.args)) == n):
                df = self.again(now, r, over)
                if df is not None:
                    again.setdefault(n, []).append(df.join(over, [df[c].eqNullSafe(over[c]) for c in over.columns], "left_semi"))
            if n in db.base:
                kept = db.base[n]
                again.setdefault(n, []).append(kept.join(over, [kept[c].eqNullSafe(over[c]) for c in over.columns], "left_semi"))
        seeds = {}
        for n in s.relations:
            have, found = rest[n], union(again.get(n, []))
            if found is None:
                if have is not None:
                    seeds[n] = (have, scratch.Table(have.schema, [], 0))
                continue
            new = self.keep(found.distinct() if have is None else without(found.distinct(), have.df(spark)), n)
            seeds[n] = (new if have is None else have.plus(new), new)
        e = self.evaluator(self.views)
        for n, df in e.loop(s, seeds).items():
            if df is None:
                continue
            found = union([d.df(spark) for d in e.added.get(n, [])])
            view, lost = seeds[n][0] if found is None else self.keep(df, n), gone.get(n)
            # The rest was there and is: what was found differs from what was lost, and nothing else does.
            up = None if found is None else self.keep(found if lost is None else without(found, lost.df(spark)), "plus")
            down = lost if lost is None or found is None else self.keep(without(lost.df(spark), found), "minus")
            self.views[n], changes[n] = view, (up if up and up.rows else None, down if down and down.rows else None)

    def again(self, now: Evaluator, rule: Rule, over: DataFrame) -> DataFrame | None:
        """What the rule still gives of over: with plain variables in its head, over is one more atom of its body, and leads."""
        if len(set(rule.head.args)) < len(rule.head.args) or not all(isinstance(x, Var) for x in rule.head.args) or any(not isinstance(x, Atom) for x in rule.body):
            return now.rule(rule, distinct=False)
        own = Rule(rule.head, (Atom("__over", rule.head.args), *rule.body))
        return now.rule(own, lambda i, a: over if i == 0 else now.read(a), distinct=False, first=0)

    def regroup(self, s: Stratum, old: dict, changes: dict[str, Change]) -> None:
        db, n, rule = self.db, s.relations[0], s.rules[0]
        db.counters["maintain_groups"] += 1
        before, now = self.evaluator(old), self.evaluator(self.views)
        keys = union([self.groups(rule, before, changes, 1), self.groups(rule, now, changes, 0)])
        if keys is None:
            return
        touched = self.keep(keys.distinct(), "groups")
        if not touched.rows:
            return
        plan = RulePlan(db.spark, rule, lambda _, a: now.read(a), now.views, db.null_safe)
        fresh = plan.head(restrict=touched.df(db.spark))
        was = old[n].df(db.spark) if n in old else None
        a = rule.aggregate()
        places = list(dict.fromkeys(f"c{[v.name for v in rule.head.args].index(v.name)}" for v in rule.head.args if v.name != a.var.name))
        gone = None
        if was is not None:
            mine = touched.df(db.spark)
            gone = was.join(mine, [was[c].eqNullSafe(mine[f"g{i}"]) for i, c in enumerate(places)], "left_semi") if places else was
        rows = fresh if fresh is not None else was.limit(0)
        after = self.keep(rows, "regrouped")
        up = after if gone is None else self.keep(without(after.df(db.spark), gone), "plus")
        down = None if gone is None else self.keep(without(gone, after.df(db.spark)), "minus")
        rest = was if down is None or not down.rows else without(was, down.df(db.spark))
        self.views[n] = self.keep(union([rest, up.df(db.spark)]), n)
        changes[n] = (up if up.rows else None, down if down and down.rows else None)

    def groups(self, rule: Rule, views: Evaluator, changes: dict[str, Change], which: int) -> DataFrame | None:
        """Groups (g0, g1, ...) with a binding that has a changed tuple."""
        out = []
        for i, a in enumerate(rule.atoms()):
            change = changes.get(self.db.key(a.rel, len(a.args)))
            if change and change[which] is not None:
                plan = RulePlan(self.db.spark, rule, lambda j, b, i=i, t=change[which]: t.df(self.db.spark) if i == j else views.read(b), views.views, self.db.null_safe)
                df = plan.bindings(i)
                if df is not None:
                    keys = list(dict.fromkeys(plan.keys()))
                    out.append(df.select(*(F.col(k).alias(f"g{j}") for j, k in enumerate(keys))) if keys else df.select(F.lit(1).alias("g0")))
        return union(out)


def ingest(stream: DataFrame, db: Database, name: str, checkpoint: str, sign: int = 1):
    """Structured Streaming into a relation: each micro-batch is a change, published incrementally. Returns the started query."""
    db.maintain()

    def batch(df: DataFrame, _: int) -> None:
        rows = scratch.write(df.toDF(*(f"c{i}" for i in range(len(df.columns)))).na.drop().distinct(), "batch")
        if rows.rows:
            db.apply_table(db.key(name, len(df.columns)), rows.df(db.spark), sign)
            db.publish()
        scratch.drop(db.spark, *rows.paths)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
