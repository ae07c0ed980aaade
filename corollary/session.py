"""A database of relations and rules: load, change, ask, publish."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import regex
from .lang.ast import MAX_ARITY, ArityError, Const, Rule, RuleError, SafetyError, Var, show
from .lang.checks import RESERVED, check_program, key, lint, stratify
from .lang.parser import parse, parse_goal
from .operators import fulltext, graph, orderstats, vector
from .plans import magic
from .plans.fixpoint import Evaluator, closure_of, reached, union
from .sources import csv
from .store import scratch
from .store.relations import Relations
from .store.snapshots import MOST_TABLES, Snapshots
from .store.transactions import Transactions
from .streaming.maintain import Maintainer


class UnknownRelation(LookupError):
    pass


class Database:
    """Live relations (base facts), rules, and published versions.

    Like relations of the rule language, base relations are sets with columns c0, c1, ... of longs,
    strings or lists. Reads named query*, asof*, rank, select, count and iterate go to the published
    version once there is one; lookup, prefix, search and traverse see the live state.

    A folder holds all of it, and opening it again finds relations, rules, revisions and versions as they
    were after the last call that returned. One object writes in a folder at a time (Locked otherwise);
    read_only ones see the state as it was when they opened it. break_lock is for a lock whose owner died.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, null_safe: bool = False, doubling: bool = True, read_only: bool = False, break_lock: bool = False):
        self.spark, self.null_safe, self.doubling = spark, null_safe, doubling
        self.base = Relations(spark, folder, read_only, break_lock)
        known = self.base.state["database"]
        self.arity: dict[str, int] = known.get("arity", {})
        self.variadic: set[str] = set(known.get("variadic", ()))
        self.rules: list[Rule] = parse("\n".join(known.get("rules", ())))
        self.perms: dict[str, list[tuple[int, ...]]] = {k: [tuple(x) for x in v] for k, v in known.get("perms", {}).items()}
        self.bags: dict[str, tuple[DataFrame, DataFrame]] = {}  # a view and its table, of which it is made by distinct
        self.counters: Counter = Counter()
        self.snapshots = Snapshots(spark, folder)
        self.snapshots.retain = known.get("retain", 0)
        self.transactions = Transactions(self)
        self.transactions.revisions = dict(known.get("revisions", {}))
        self.maintainer: Maintainer | None = None
        self.index: fulltext.Index | None = None
        self.index_mark: tuple | None = None  # the observations that it holds
        self.marks: tuple[int, dict[str, tuple | None]] = (0, {})  # the version that was published last, and the base as it was
        self.vector_index: dict[str, DataFrame] = {}
        self.indexed: dict[str, DataFrame] = {}  # as they were published last
        for entry in self.base.replay():
            self.redo(entry)

    def redo(self, entry: dict) -> None:
        for name, arity in entry.get("declared", ()):
            self._declare(name, arity)
        self.rules += parse("\n".join(entry.get("rules", ())))
        for name, perm in entry.get("perms", ()):
            self.perms.setdefault(name, []).append(tuple(perm))
        self.apply([(name, tuple(values), sign) for name, values, sign in entry.get("changes", ())])
        self.transactions.revisions |= entry.get("revisions", {})

    def save(self) -> None:
        """Writes what the log holds into the folder's tables."""
        self.base.save({"arity": self.arity, "variadic": sorted(self.variadic), "rules": [show(r) for r in self.rules], "perms": self.perms, "revisions": self.transactions.revisions, "retain": self.snapshots.retain})

    def close(self) -> None:
        """Saves and lets another writer in; nothing can be changed through this object any more."""
        self.transactions.forbid("closing")
        if self.base.locked:
            self.save()
        self.base.close()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.base.close()

    # Relations

    def declare(self, name: str, arity: int) -> None:
        """arity 0: facts of any width up to 8."""
        new = name not in self.arity and name not in self.variadic
        self._declare(name, arity)
        if new:
            self.base.log({"declared": [[name, arity]]})

    def _declare(self, name: str, arity: int) -> None:
        if name in RESERVED:
            raise SafetyError(f"relation {name} is reserved")
        if arity == 0:
            if name in self.arity:
                raise ArityError(f"{name} has {self.arity[name]} columns")
            self.variadic.add(name)
            return
        if not 1 <= arity <= MAX_ARITY:
            raise ArityError(f"1 to {MAX_ARITY} columns are possible")
        if name in self.variadic or self.arity.setdefault(name, arity) != arity:
            raise ArityError(f"{name} is declared otherwise")

    def key(self, name: str, arity: int) -> str:
        return key(name, arity, self.variadic)

    def set_relation(self, name: str, df: DataFrame, distinct: bool = False) -> None:
        """Adds a table's rows as base facts; distinct: they are known to be a set already. Integers become longs."""
        self.base.writable()
        n = len(df.columns)
        if name not in self.variadic:
            self._declare(name, n)
        cols = [F.col(f"`{c}`").cast("long").alias(f"c{i}") if isinstance(df.schema[c].dataType, T.IntegralType) else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
        new = df.select(*cols)
        if not self.null_safe:
            new = new.na.drop() if any(f.nullable for f in new.schema.fields) else new
        k = self.key(name, n)
        first = k not in self.base
        view = (new if distinct else new.distinct()) if first else union([self.base[k], new]).distinct()
        self.base[k] = view
        if first and not distinct:
            self.bags[k] = view, new
        self.save()

    def load_csv(self, name: str, path: str, arity: int | None = None) -> dict[str, int]:
        """Headerless CSV; returns counts of rows read, skipped and (after removing repeated ones) held."""
        self.transactions.forbid("bulk load")
        if name not in self.arity and name not in self.variadic:
            self._declare(name, arity if arity is not None else csv.width(self.spark, path))
        counts = {}
        if name in self.variadic:
            parts, counts = csv.read_variadic(self.spark, path)
            for df in parts:
                self.set_relation(name, df)
        else:
            df, counts = csv.read_fixed(self.spark, path, self.arity[name])
            self.set_relation(name, df)
        return counts

    def facts(self, name: str, rows: Sequence[Sequence], kinds: Sequence[str] | None = None) -> None:
        """Base facts from Python values."""
        by_width: dict[int, list] = {}
        for r in rows:
            by_width.setdefault(len(r), []).append(tuple(r))
        for own in by_width.values():
            self.set_relation(name, self.rows(own, kinds))

    def rows(self, rows: list[tuple], kinds: Sequence[str] | None = None) -> DataFrame:
        def kind(v) -> str:
            return "long" if isinstance(v, int) else "string" if isinstance(v, str) else f"array<{kind(v[0]) if len(v) else 'long'}>"

        if kinds is None:
            kinds = [kind(next((r[i] for r in rows if not isinstance(r[i], (list, tuple)) or r[i]), rows[0][i])) for i in range(len(rows[0]))]
        return self.spark.createDataFrame(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))

    def add_fact(self, name: str, *values) -> int:
        """1 if it was added, 0 if it was there."""
        if self.lookup(name, *values):
            return 0
        self.change(name, [values], [])
        return 1

    def delete_fact(self, name: str, *values) -> int:
        """1 if a base fact was deleted, 0 if there was none."""
        if not self.lookup(name, *values):
            return 0
        self.change(name, [], [values])
        return 1

    def change(self, name: str, plus: list[tuple], minus: list[tuple]) -> None:
        """Many additions and deletions at once; they are remembered for the next incremental publication."""
        self.transactions.forbid("direct change")
        changes = [(name, tuple(r), sign) for rows, sign in ((plus, 1), (minus, -1)) for r in rows]
        before = self.base.snapshot()
        try:
            self.apply(changes, note=False)
            self.base.log({"changes": changes})
        except Exception:
            self.base.own = before
            raise
        self.note(changes)

    def change_all(self, changes: list[tuple[str, tuple, int]]) -> None:
        for name in dict.fromkeys(n for n, _, _ in changes):
            self.change(name, [v for n, v, s in changes if n == name and s > 0], [v for n, v, s in changes if n == name and s < 0])

    def grouped(self, changes: list[tuple[str, tuple, int]]) -> Iterator[tuple[str, list[tuple], int]]:
        """The changes by relation and sign, in order."""
        held: dict[tuple[str, int], list[tuple]] = {}
        for name, values, sign in changes:
            if name not in self.variadic:
                self._declare(name, len(values))
            held.setdefault((self.key(name, len(values)), sign), []).append(values)
        for (k, sign), rows in held.items():
            yield k, rows, sign

    def apply(self, changes: list[tuple[str, tuple, int]], note: bool = True) -> None:
        for k, rows, sign in self.grouped(changes):
            self.base.change(k, rows, sign, self.base.schema(k) or self.rows(rows).schema)
        if note:
            self.note(changes)

    def note(self, changes: list[tuple[str, tuple, int]]) -> None:
        if self.maintainer:
            for k, rows, sign in self.grouped(changes):
                self.maintainer.note(k, rows, sign)

    def apply_table(self, k: str, df: DataFrame, sign: int) -> None:
        """A table's rows as additions or deletions; written at once."""
        self.base.writable()
        self.base.change_table(k, df, sign)
        if self.maintainer:
            self.maintainer.note_table(k, df, sign)
        self.save()

    def live(self, name: str, arity: int | None = None) -> DataFrame:
        k = name if name not in self.variadic else f"{name}/{arity}"
        if k not in self.base:
            if name not in self.arity and name not in self.variadic:
                raise UnknownRelation(name)
            n = self.arity.get(name, arity or 1)
            return self.spark.createDataFrame([], ", ".join(f"c{i} long" for i in range(n)))
        return self.base[k]

    def widths(self, name: str) -> list[int]:
        return sorted(int(k.partition("/")[2]) for k in self.base if k.partition("/")[0] == name and "/" in k)

    def lookup(self, name: str, *values) -> bool:
        if name in self.variadic:
            return len(values) in self.widths(name) and not self.prefix_of(self.live(name, len(values)), values).isEmpty()
        if self.arity.get(name) != len(values) or name not in self.base:
            return False
        return not self.prefix_of(self.live(name), values).isEmpty()

    @staticmethod
    def prefix_of(df: DataFrame, values: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows with the values in the columns (the leading ones unless given); comparisons are typed, and so reach the scan."""
        for c, v in zip(columns or df.columns, values, strict=False):
            t = df.schema[c].dataType
            if isinstance(t, T.BooleanType) and v in ("true", "false"):
                v, t = v == "true", None
            if t is not None and (isinstance(v, str) != isinstance(t, T.StringType) or isinstance(t, (T.ArrayType, T.BooleanType))):
                return df.limit(0)
            df = df.where(F.col(c) == (F.lit(v) if isinstance(v, (str, bool)) else F.lit(v).cast("long")))
        return df

    def prefix(self, name: str, *values) -> DataFrame | dict[int, DataFrame]:
        """Facts that begin with the values; of a relation of varying width, by width."""
        if name in self.variadic:
            return {n: self.prefix_of(self.live(name, n), values) for n in self.widths(name) if n >= len(values)}
        return self.prefix_of(self.live(name), values)

    # Rules

    def load_rules(self, text: str) -> list[str]:
        """Adds rules (facts too); returns remarks on what is accepted but perhaps not meant."""
        new = parse(text)
        rules = [r for r in new if r.body]
        facts = [r for r in new if not r.body]
        for r in facts:
            if any(not isinstance(a, Const) for a in r.head.args):
                raise SafetyError("a fact has constants only", r.head.line, r.head.column)
        known, _ = check_program([*self.rules, *new], self.arity, self.variadic)
        self.arity = known
        self.rules += rules
        self.base.log({"rules": [show(r) for r in rules]})
        if facts:
            self.change_all([(r.head.rel, tuple(a.value for a in r.head.args), 1) for r in facts])
        return lint(rules)

    def evaluator(self, rules: list[Rule] | None = None, base: dict[str, DataFrame] | None = None) -> Evaluator:
        own = dict(self.base if base is None else base)
        bags = {k: bag for k, (view, bag) in self.bags.items() if own.get(k) is view}
        return Evaluator(self.spark, self.rules if rules is None else rules, own, self.variadic, self.null_safe, self.counters, self.doubling, bags)

    def derive(self, *names: str) -> DataFrame:
        """A relation's view, from the live base and all rules that it depends on."""
        name = names[0]
        return self.typed(name, self.evaluator().run(names).get(name))

    def typed(self, name: str, df: DataFrame | None) -> DataFrame:
        if df is not None:
            return df
        plain, _, width = name.partition("/")
        if plain not in self.arity and plain not in self.variadic:
            raise UnknownRelation(name)
        n = int(width) if width else self.arity.get(plain, 1)
        return self.spark.createDataFrame([], ", ".join(f"c{i} long" for i in range(n)))

    # Questions

    def view(self, name: str) -> DataFrame:
        v = self.snapshots.current()
        return self.snapshots.read(v, name) if v and name in self.snapshots.relations(v) else self.derive(name)

    def query(self, goal: str) -> DataFrame:
        """rel, or rel(a, X): the free columns of the matches; of a goal without free columns, found (one row or none)."""
        if "(" not in goal:
            return self.view(goal)
        atom = parse_goal(goal)
        df = self.view(self.key(atom.rel, len(atom.args)))
        if len(df.columns) != len(atom.args):
            raise ArityError(f"{atom.rel} has {len(df.columns)} columns")
        return select_goal(df, atom)

    def query_bound(self, name: str, *values) -> DataFrame:
        return self.prefix_of(self.view(name), values)

    def query_magic(self, name: str, adornment: str, *values) -> DataFrame:
        """Tuples that agree with values in the columns marked b, found goal-directed; the same rows as the filtered view."""
        arity = self.arity.get(name)
        if arity is None:
            raise UnknownRelation(name)
        if len(adornment) != arity or set(adornment) - set("bf") or adornment.count("b") != len(values):
            raise ValueError("one of b and f for each column, and a value for each b")

        def narrow(df: DataFrame) -> DataFrame:
            it = iter(values)
            for i, x in enumerate(adornment):
                if x == "b":
                    v = next(it)
                    if isinstance(v, str) != isinstance(df.schema[f"c{i}"].dataType, T.StringType):
                        return df.limit(0)
                    df = df.where(F.col(f"c{i}") == F.lit(v))
            return df

        if "b" not in adornment or not any(r.head.rel == name for r in self.rules):
            return narrow(self.derive(name))
        own = next((s for s in stratify(self.rules, self.variadic) if name in s.relations), None)
        edge = closure_of(own, self.base) if own and own.recursive and self.doubling and not self.null_safe else None
        if edge is not None:
            # A closure needs a frontier from the bound end, not pairs.
            edges = self.evaluator().run([self.key(edge.rel, 2)]).get(self.key(edge.rel, 2))
            if edges is None:
                return self.typed(name, None)
            self.counters["frontier"] += 1
            forward = adornment[0] == "b"
            start, t = values[0], edges.schema["c0" if forward else "c1"].dataType
            if isinstance(start, str) != isinstance(t, T.StringType) or isinstance(t, T.ArrayType):
                return narrow(edges.limit(0))
            return narrow(reached(edges, start, forward))
        rules, goal, seed = magic.rewrite(self.rules, name, adornment, set(self.base))
        full = magic.complete_inputs(self.rules, name)
        base = dict(self.base)
        if full:
            views = self.evaluator([r for r in self.rules if r.head.rel in full]).run()
            base |= {k: v for k, v in views.items() if v is not None}
        base |= {f"{k}__base": v for k, v in self.base.items()}
        base[seed] = self.rows([tuple(values)])
        self.counters["magic"] += 1
        return narrow(self.typed(name, self.evaluator(rules, base).run([goal]).get(goal)))

    #: Top-down evaluation asks for the same tuples and gives the same rows.
    query_topdown = query_magic

    def pattern(self, name: str, column: int, pattern: str) -> DataFrame:
        df = self.view(name)
        if not 0 <= column < len(df.columns) or not isinstance(df.schema[f"c{column}"].dataType, T.StringType):
            regex.to_java(pattern)
            return df.limit(0)
        return df.where(regex.matches(F.col(f"c{column}"), pattern))

    # Versions

    def publish(self) -> int:
        """Evaluates (incrementally if that was begun) and writes a version."""
        self.transactions.forbid("publication")
        self.save()
        same: set[str] = set()
        grown: dict[str, DataFrame] = {}
        if self.maintainer:
            views = self.maintainer.publish()
            if self.maintainer.since == self.snapshots.current() > 0:
                same, grown = self.maintainer.unchanged(), self.maintainer.grown()
        else:
            views = self.evaluator().run()
        relations = {k: v for k, v in views.items() if v is not None and not k.startswith("rev")} | {n: self.typed(n, None) for n in self.arity if views.get(n) is None}
        marks: dict[str, tuple | None] = {}
        if not self.maintainer:
            heads = {self.key(r.head.rel, len(r.head.args)) for r in self.rules}
            plain = [n for n in self.base if n in relations and n not in heads]
            if self.marks[0] == self.snapshots.current() > 0:
                grown = {n: df for n in plain for df in [self.base.added(n, self.marks[1].get(n))] if df is not None}
                same = {n for n, df in grown.items() if df.isEmpty()}
            marks = {n: self.base.mark(n) for n in plain}
        indexes = self.indexes()
        same |= {n for n, df in indexes.items() if self.indexed.get(n) is df}
        folder = f"{self.snapshots.folder}/"
        placed = {n: [p.removeprefix(folder) for p in at] for n, at in (self.index.paths if self.index else {}).items() if all(p.startswith(folder) for p in at)}
        mark = marks.get("observation")
        if "__contents__" in placed and "observation" not in grown and mark and self.index_mark and mark[0] is self.index_mark[0] and mark[1] == self.index_mark[1]:
            placed["observation"] = placed["__contents__"]  # they are as the index has them
        version = self.snapshots.publish(relations | indexes, same, grown, placed)
        self.indexed, self.marks = indexes, (version, marks)
        if self.maintainer:
            self.maintainer.since = version
        return version

    def indexes(self) -> dict[str, DataFrame]:
        """What text and vector search read, as relations of a version."""
        return ({} if self.index is None else self.index.relations()) | self.vector_index

    def maintain(self) -> Maintainer:
        """From here on, publications evaluate changes only, where that is possible."""
        self.maintainer = self.maintainer or Maintainer(self)
        return self.maintainer

    def versions(self) -> list[int]:
        return self.snapshots.versions()

    def set_retain(self, n: int) -> None:
        self.snapshots.retain = n

    def query_version(self, version: int, name: str) -> DataFrame:
        return self.snapshots.read(version, name)

    def query_bound_version(self, version: int, name: str, *values) -> DataFrame:
        return self.prefix_of(self.snapshots.read(version, name), values)

    # Order

    def fixed(self, name: str, live: bool = False) -> DataFrame:
        if name in self.variadic or name not in self.arity:
            raise UnknownRelation(f"{name} is unknown, or its width varies")
        return self.live(name) if live else self.view(name)

    def rank(self, name: str, *tuple_, leading: Sequence = (), perm: int | None = None) -> int:
        return orderstats.rank(self.fixed(name, bool(leading) or perm is not None), tuple_, leading, self.perm(name, perm)).first()[0]

    def select(self, name: str, k: int, leading: Sequence = (), perm: int | None = None) -> tuple:
        return tuple(orderstats.select(self.fixed(name, bool(leading) or perm is not None), k, leading, self.perm(name, perm)).first())

    def range_count(self, name: str, low: Sequence, high: Sequence, leading: Sequence = (), perm: int | None = None) -> int:
        return orderstats.range_count(self.fixed(name, bool(leading) or perm is not None), low, high, leading, self.perm(name, perm)).first()[0]

    def count(self, name: str, leading: Sequence = ()) -> int:
        return orderstats.count(self.fixed(name, bool(leading)), leading).first()[0]

    def iterate(self, name: str, leading: Sequence = (), seek: Sequence | None = None) -> Iterator:
        return orderstats.iterate(self.fixed(name), leading=leading, seek=seek)

    def merge_join(self, left: str, right: str, on: int) -> DataFrame:
        return orderstats.merge_join(self.fixed(left), self.fixed(right), on)

    def declare_perm(self, name: str, perm: Sequence[int]) -> int:
        """A number for another order of the columns; the same order keeps its number."""
        if name in self.variadic or sorted(perm) != list(range(self.arity.get(name, -1))):
            raise ValueError(f"{list(perm)} isn't an order of {name}'s columns")
        own = self.perms.setdefault(name, [])
        if tuple(perm) not in own:
            self.base.log({"perms": [[name, list(perm)]]})
            own.append(tuple(perm))
        return own.index(tuple(perm))

    def find_perm(self, name: str, perm: Sequence[int]) -> int | None:
        own = self.perms.get(name, [])
        return own.index(tuple(perm)) if tuple(perm) in own else None

    def perm_count(self) -> int:
        return sum(map(len, self.perms.values()))

    def perm(self, name: str, number: int | None) -> tuple[int, ...] | None:
        return None if number is None else self.perms[name][number]

    # Transactions

    def rev_get(self, entity: str) -> int:
        return self.transactions.revision(entity)

    def cas_revision(self, entity: str, expected: int, new: int) -> None:
        """Raises Conflict unless the revision is as expected (0 if there is none)."""
        self.transactions.forbid("direct compare-and-set")
        self.transactions.compare_and_set(entity, expected, new)

    def begin(self) -> Transactions:
        return self.transactions.begin()

    # Graph and text

    def traverse(self, start, depth: int = graph.MAX_DEPTH, max_nodes: int | None = None) -> DataFrame:
        return graph.traverse(self.live("edge"), start, depth, max_nodes)

    def node_observations(self, node, most: int | None = None) -> DataFrame:
        return graph.node_observations(self.live("observation"), node, most)

    def build_index(self) -> fulltext.Index:
        """Writes contents and postings of all observations, or of those added since it was built; published with the next version, where the tables are then."""
        rows, more = self.live("observation"), None
        if self.index and len(self.index.paths["__postings__"]) < MOST_TABLES:
            more = self.base.added("observation", self.index_mark)
        mark = self.base.mark("observation") if "observation" in self.base else None
        if more is None or not more.isEmpty():
            folder = None if self.base.files and not self.base.locked else f"{self.snapshots.folder}/tables"
            self.index = fulltext.write_postings(rows if more is None else more, folder, None if more is None else self.index, whole=True)
        self.index_mark = mark
        return self.index

    def search(self, query: str, top: int | None = None, version: int | None = None) -> DataFrame:
        """(content, score); of a version if one is given, else of the index as it was last built."""
        if version is None and self.index is None and self.snapshots.current() and "__postings__" in self.snapshots.relations(self.snapshots.current()):
            version = self.snapshots.current()
        if version is None:
            return fulltext.search(self.index, query, top)
        postings = self.snapshots.read(version, "__postings__")
        return fulltext.search(fulltext.Index(postings, self.snapshots.read(version, "__contents__")) if "id" in postings.columns else postings, query, top)

    def build_vectors(self, vectors: DataFrame, bits: int = 64) -> DataFrame:
        """Fits the basis on all rows (entity, vector) and writes bands and int8 forms; published with the next version."""
        entity, column = vectors.columns[:2]
        basis = vector.fit_basis(vectors, column, bits)
        encoded = scratch.write(vector.encode(vectors, entity, column, basis), "vectors").df(self.spark)
        self.vector_index = {"__vectors__": encoded, "__bands__": vector.band_table(encoded), "__basis__": vector.basis_table(self.spark, basis)}
        return encoded

    def search_vectors(self, query: Sequence[float], k: int, radius: int = 24, version: int | None = None, entities: DataFrame | None = None) -> DataFrame:
        """(entity, dot) of the nearest, of a version if one is given; entities narrows them (a lexical search's owners: a hybrid search)."""
        if version is None and not self.vector_index:
            version = self.snapshots.current()
            if not version or "__basis__" not in self.snapshots.relations(version):
                raise fulltext.IndexMissing("there is no vector index; build it first")
        read = self.vector_index.__getitem__ if version is None else lambda n: self.snapshots.read(version, n)
        basis = vector.read_basis(read("__basis__"))
        own = self.spark.createDataFrame([([float(x) for x in query],)], "v array<double>").withColumn("entity", F.lit(0))
        q = vector.encode(own, "entity", "v", basis).first()
        return vector.rerank(read("__vectors__"), q.q, vector.candidates(read("__bands__"), q.bands, None, radius, entities), k)

    def search_hybrid(self, text: str, query: Sequence[float], k: int, radius: int = 24) -> DataFrame:
        """(entity, dot): vector candidates among the owners of the contents that a lexical search finds."""
        own = fulltext.owners(self.live("observation"), self.search(text), every=True)
        return self.search_vectors(query, k, radius, None, own.select("entity"))

    def check(self, text: str) -> list[str]:
        """Diagnostics of rule text: errors (line:column: message) first, then remarks."""
        try:
            new = parse(text)
            check_program([*self.rules, *new], self.arity, self.variadic)
        except RuleError as e:
            return [str(e)]
        return lint(new)


def select_goal(df: DataFrame, atom) -> DataFrame:
    """Free columns of the tuples that match a goal, named by its variables; none free: one row (found) or none."""
    first: dict[str, str] = {}
    for c, a in zip(df.columns, atom.args, strict=True):
        if isinstance(a, Const):
            df = Database.prefix_of(df, [a.value], [c])
        elif isinstance(a, Var):
            if a.name in first:
                df = df.where(F.col(c).eqNullSafe(F.col(first[a.name])))
            else:
                first[a.name] = c
    if not first:
        return df.limit(1).select(F.lit(True).alias("found"))
    return df.select(*(F.col(c).alias(v) for v, c in first.items())).distinct()
