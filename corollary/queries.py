"""Queries of the driver contract: each over its whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import regex
from .operators import fulltext, graph, orderstats, vector
from .session import Database
from .sources import schema as schemas
from .sources import typed
from .sources.project import Project
from .store import scratch
from .store.transactions import Conflict

Query = Callable[[SparkSession, str], DataFrame]

#: Relations: table, columns as Spark SQL, columns as DuckDB SQL if these differ, whether they hold a key (and so are sets).
RELATIONS: dict[str, tuple[str, list[str], list[str] | None, bool]] = {
    "tree": ("part", ["p_partkey", "p_partkey div 2"], ["p_partkey", "p_partkey // 2"], True),
    "nedge": ("supplier", ["s_nationkey", "(s_nationkey * 3 + 1) % 25"], None, False),
    "cust": ("customer", ["c_custkey", "c_nationkey"], None, True),
    "cseg": ("customer", ["c_custkey", "c_mktsegment"], None, True),
    "cname": ("customer", ["c_custkey", "c_name"], None, True),
    "nat": ("nation", ["n_nationkey", "n_regionkey"], None, True),
    "nname": ("nation", ["n_nationkey", "n_name"], None, True),
    "rname": ("region", ["r_regionkey", "r_name"], None, True),
    "supp": ("supplier", ["s_suppkey", "s_nationkey"], None, True),
    "ord": ("orders", ["o_orderkey", "o_custkey"], None, True),
    "opri": ("orders", ["o_orderkey", "o_orderpriority"], None, True),
    "sale": ("orders", ["o_orderkey", "o_custkey", "cast(round(o_totalprice * 100) as bigint)"], None, True),
    "li": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], None, False),
    "ps": ("lineitem", ["l_partkey", "l_suppkey"], None, False),
    "part3": ("part", ["p_partkey", "p_type", "p_size"], None, True),
    "pname": ("part", ["p_partkey", "p_name"], None, True),
    "psize": ("part", ["p_partkey", "p_size"], None, True),
    "ev": ("events", ["event_id", "user_id"], None, True),
    "evtype": ("events", ["user_id", "event_type"], None, False),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, cols, _, _ = RELATIONS[name]
    df = table(spark, sf_dir, source).selectExpr(*(f"{c} as c{i}" for i, c in enumerate(cols)))
    return df.select(*(F.col(f.name).cast("long") if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name) for f in df.schema.fields))


def _sql_relation(name: str) -> str:
    source, cols, other, is_set = RELATIONS[name]
    texts = {"p_type", "p_name", "c_mktsegment", "c_name", "n_name", "r_name", "event_type", "o_orderpriority"}
    own = ", ".join(f"{c if c in texts else f'cast({c} as bigint)'} AS c{i}" for i, c in enumerate(other or cols))
    return f"(SELECT {'' if is_set else 'DISTINCT '}{own} FROM {source})"


class _Sql(dict):
    def __missing__(self, key: str) -> str:
        return _sql_relation(key)


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = Database(spark)
    for n in names:
        db.set_relation(n, relation(spark, sf_dir, n), distinct=RELATIONS[n][3])
    return db


def _relations(text: str) -> list[str]:
    import re

    return [n for n in RELATIONS if re.search(rf"\b{n}\b", text)]


def rules(name: str, text: str, goal: str, cols: str, sql: str | None) -> None:
    """A query that derives goal by rules over the relations they name; {name} in sql stands for a relation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *_relations(text))
        db.load_rules(text)
        return db.derive(goal).toDF(*cols.split())

    add(name, run, sql)


def add(name: str, run: Query, sql: str | None) -> None:
    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql.format_map(_Sql())


def on(names: str, cols: str, make: Callable[..., DataFrame]) -> Query:
    """A query of operators on relations."""
    return lambda spark, sf_dir: make(*(r if RELATIONS[n][3] else r.distinct() for n in names.split() for r in [relation(spark, sf_dir, n)])).toDF(*cols.split())


# Scans and lookups

add("scan_all", on("li", "order_key part_key supp_key line", lambda li: li), "SELECT c0 AS order_key, c1 AS part_key, c2 AS supp_key, c3 AS line FROM {li}")
add("prefix_lookup", on("li", "order_key part_key supp_key line", lambda li: orderstats.within(li, [100])), "SELECT c0 AS order_key, c1 AS part_key, c2 AS supp_key, c3 AS line FROM {li} WHERE c0 = 100")
add("exact_lookup", on("cseg", "cust seg", lambda c: orderstats.within(c, [1, "MACHINERY"])), "SELECT c0 AS cust, c1 AS seg FROM {cseg} WHERE c0 = 1 AND c1 = 'MACHINERY'")
add("nonleading_lookup", on("li", "order_key part_key supp_key line", lambda li: li.where("c2 = 3")), "SELECT c0 AS order_key, c1 AS part_key, c2 AS supp_key, c3 AS line FROM {li} WHERE c2 = 3")
add("sorted_cursor", on("ord", "order_key cust", lambda o: orderstats.cursor(o, seek=[50])), "SELECT c0 AS order_key, c1 AS cust FROM {ord} WHERE c0 >= 50 ORDER BY 1, 2")

# Rules without recursion

rules("join_two_hop", "r(C, R) :- cust(C, N), nat(N, R).", "r", "cust region", "SELECT DISTINCT c.c0 AS cust, n.c1 AS region FROM {cust} c JOIN {nat} n ON c.c1 = n.c0")
rules("join_three_way", "r(O, N, S) :- ord(O, C), cust(C, N), li(O, P, S, L), supp(S, N).", "r", "order_key nation supp_key", "SELECT DISTINCT o.c0 AS order_key, c.c1 AS nation, l.c2 AS supp_key FROM {ord} o JOIN {cust} c ON o.c1 = c.c0 JOIN {li} l ON l.c0 = o.c0 JOIN {supp} s ON s.c0 = l.c2 AND s.c1 = c.c1")
rules("self_join_repeated_var", "r(A, B) :- supp(A, N), supp(B, N).", "r", "a b", "SELECT DISTINCT a.c0 AS a, b.c0 AS b FROM {supp} a JOIN {supp} b ON a.c1 = b.c1")
rules("repeated_var_in_atom", "r(X) :- nedge(X, X).", "r", "node", "SELECT DISTINCT c0 AS node FROM {nedge} WHERE c0 = c1")
rules("const_filter", 'r(C) :- cseg(C, "BUILDING").', "r", "cust", "SELECT c0 AS cust FROM {cseg} WHERE c1 = 'BUILDING'")
rules("head_const", "r(N, 7, big) :- cust(C, N).", "r", "nation seven word", "SELECT DISTINCT c1 AS nation, cast(7 as bigint) AS seven, 'big' AS word FROM {cust}")
rules("equality_bind", "r(C, M) :- cust(C, N), M = N, C = N.", "r", "cust nation", "SELECT DISTINCT c0 AS cust, c1 AS nation FROM {cust} WHERE c0 = c1")
rules("cmp_lt_le_gt_ge_ne", "r(P, S) :- psize(P, S), S > 5, S <= 40, P >= S, S < P, S != 17.", "r", "part_key size", "SELECT c0 AS part_key, c1 AS size FROM {psize} WHERE c1 > 5 AND c1 <= 40 AND c0 > c1 AND c1 <> 17")
rules("equality_const", "r(P, S, X) :- psize(P, S), X = 7, S = 9.", "r", "part_key size x", "SELECT c0 AS part_key, c1 AS size, cast(7 as bigint) AS x FROM {psize} WHERE c1 = 9")
rules("theta_join", "r(A, B) :- nat(A, R), nat(B, R), A < B.", "r", "a b", "SELECT DISTINCT a.c0 AS a, b.c0 AS b FROM {nat} a JOIN {nat} b ON a.c1 = b.c1 AND a.c0 < b.c0")
rules("cross_product", "r(A, B) :- nat(A, X), rname(B, Y).", "r", "a b", "SELECT DISTINCT a.c0 AS a, b.c0 AS b FROM {nat} a, {rname} b")
rules("union_heads", "r(N) :- cust(C, N). r(N) :- supp(S, N). r(N) :- nat(N, X).", "r", "nation", "SELECT c1 AS nation FROM {cust} UNION SELECT c1 FROM {supp} UNION SELECT c0 FROM {nat}")
rules("intersect_rules", 'a(U) :- evtype(U, "error"). b(U) :- evtype(U, "click"). r(U) :- a(U), b(U).', "r", "user_id", "SELECT c0 AS user_id FROM {evtype} WHERE c1 = 'error' INTERSECT SELECT c0 FROM {evtype} WHERE c1 = 'click'")
rules("negation_anti", "r(C) :- cust(C, N), !has(C). has(C) :- ord(O, C).", "r", "cust", "SELECT c0 AS cust FROM {cust} WHERE c0 NOT IN (SELECT c1 FROM {ord})")
rules("semi_join_head", "r(C, N) :- cust(C, N), ord(O, C).", "r", "cust nation", "SELECT c0 AS cust, c1 AS nation FROM {cust} WHERE c0 IN (SELECT c1 FROM {ord})")
rules("bushy_four_atoms", "r(R, T) :- li(O, P, S, L), part3(P, T, Z), supp(S, N), nat(N, R).", "r", "region part_type", "SELECT DISTINCT n.c1 AS region, p.c1 AS part_type FROM {li} l JOIN {part3} p ON l.c1 = p.c0 JOIN {supp} s ON l.c2 = s.c0 JOIN {nat} n ON s.c1 = n.c0")

# Recursion

_TC = "tc(X, Y) :- {e}(X, Y). tc(X, Y) :- {e}(X, Z), tc(Z, Y)."
_TC_SQL = "WITH RECURSIVE e AS {{{e}}}, tc AS (SELECT c0, c1 FROM e UNION SELECT e.c0, tc.c1 FROM e JOIN tc ON e.c1 = tc.c0)"
_TREE, _NEDGE = _TC_SQL.format(e="tree"), _TC_SQL.format(e="nedge")
rules("tc_linear", _TC.format(e="tree"), "tc", "src dst", _TREE + " SELECT c0 AS src, c1 AS dst FROM tc")
rules("tc_cyclic", _TC.format(e="nedge"), "tc", "src dst", _NEDGE + " SELECT c0 AS src, c1 AS dst FROM tc")
rules("tc_nonlinear", "tc(X, Y) :- nedge(X, Y). tc(X, Y) :- tc(X, Z), tc(Z, Y).", "tc", "src dst", _NEDGE + " SELECT c0 AS src, c1 AS dst FROM tc")
rules("same_generation", "sg(X, Y) :- nat(X, R), nat(Y, R). sg(X, Y) :- nedge(A, X), sg(A, B), nedge(B, Y).", "sg", "a b", "WITH RECURSIVE e AS {nedge}, sg AS (SELECT a.c0 AS a, b.c0 AS b FROM {nat} a JOIN {nat} b ON a.c1 = b.c1 UNION SELECT x.c1, y.c1 FROM sg JOIN e x ON x.c0 = sg.a JOIN e y ON y.c0 = sg.b) SELECT a, b FROM sg")
rules("mutual_even_odd", "odd(X, Y) :- nedge(X, Y). odd(X, Y) :- even(X, Z), nedge(Z, Y). even(X, Y) :- odd(X, Z), nedge(Z, Y).", "even", "src dst", "WITH RECURSIVE e AS {nedge}, w AS (SELECT c0 AS a, c1 AS b, 1 AS k FROM e UNION SELECT w.a, e.c1, 1 - w.k FROM w JOIN e ON w.b = e.c0) SELECT a AS src, b AS dst FROM w WHERE k = 0")
rules("negation_above_recursion", _TC.format(e="nedge") + " r(X, Y) :- nat(X, A), nat(Y, B), !tc(X, Y).", "r", "src dst", _NEDGE + " SELECT a.c0 AS src, b.c0 AS dst FROM {nat} a, {nat} b WHERE (a.c0, b.c0) NOT IN (SELECT (c0, c1) FROM tc)")
rules("recursive_arith_bounded", "p(X) :- rname(X, N). p(X) :- p(Y), X = Y + 3, X < 200.", "p", "x", "WITH RECURSIVE p AS (SELECT c0 AS x FROM {rname} UNION SELECT x + 3 FROM p WHERE x + 3 < 200) SELECT x FROM p")

# Aggregates

rules("agg_count", "r(C, N) :- sale(O, C, V), N = count().", "r", "cust n", "SELECT c1 AS cust, count(*) AS n FROM {sale} GROUP BY 1")
rules("agg_sum_wrap", "r(C, S) :- sale(O, C, V), S = sum(V).", "r", "cust total", "SELECT c1 AS cust, cast(sum(c2) % 4294967296 as bigint) AS total FROM {sale} GROUP BY 1")
rules("agg_min", "r(C, M) :- sale(O, C, V), M = min(V).", "r", "cust least", "SELECT c1 AS cust, min(c2) AS least FROM {sale} GROUP BY 1")
rules("agg_max", "r(C, M) :- sale(O, C, V), M = max(V).", "r", "cust most", "SELECT c1 AS cust, max(c2) AS most FROM {sale} GROUP BY 1")
rules("agg_global", "r(N) :- li(O, P, S, L), N = count().", "r", "n", "SELECT count(*) AS n FROM {li} HAVING count(*) > 0")
rules("agg_global_empty", "none(O) :- li(O, P, S, L), O != O. r(N) :- none(O), N = count().", "r", "n", "SELECT count(*) AS n FROM {li} WHERE c0 <> c0 HAVING count(*) > 0")
rules("agg_over_join", "r(R, N) :- sale(O, C, V), cust(C, K), nat(K, R), N = count().", "r", "region n", "SELECT n.c1 AS region, count(*) AS n FROM {sale} s JOIN {cust} c ON s.c1 = c.c0 JOIN {nat} n ON c.c1 = n.c0 GROUP BY 1")
rules("agg_over_recursive_lower_stratum", _TC.format(e="tree") + " r(X, N) :- tc(X, Y), N = count().", "r", "node n", _TREE + " SELECT c0 AS node, count(*) AS n FROM tc GROUP BY 1")
rules("having_second_rule", "n(C, N) :- ord(O, C), N = count(). r(C, N) :- n(C, N), N >= 12.", "r", "cust n", "SELECT c1 AS cust, count(*) AS n FROM {ord} GROUP BY 1 HAVING count(*) >= 12")

# Arithmetic

_M = "& 4294967295"
rules("arith_ops", "r(P, A, B, C, D, E) :- psize(P, S), A = P + S, B = P - S, C = P * S, D = P / S, E = P % S.", "r", "part_key a b c d e", f"SELECT c0 AS part_key, (c0 + c1) {_M} AS a, (c0 - c1) {_M} AS b, (c0 * c1) {_M} AS c, c0 // c1 AS d, c0 % c1 AS e FROM {{psize}}")
rules("arith_precedence", "r(P, A, B) :- psize(P, S), A = P + S * 3, B = (P + S) * 3.", "r", "part_key a b", "SELECT c0 AS part_key, c0 + c1 * 3 AS a, (c0 + c1) * 3 AS b FROM {psize}")
rules("arith_wrap", "r(O, A, B, D) :- sale(O, C, V), A = 0 - V - 1, B = V * V, D = A * A.", "r", "order_key a b d", f"SELECT c0 AS order_key, (-c2 - 1) {_M} AS a, cast((c2::hugeint * c2) % 4294967296 as bigint) AS b, cast((((-c2 - 1) {_M})::hugeint * ((-c2 - 1) {_M})) % 4294967296 as bigint) AS d FROM {{sale}}")
rules("arith_div_zero", "r(P, A, B) :- psize(P, S), D = S % 5, A = P / D, B = P % D.", "r", "part_key a b", "SELECT c0 AS part_key, c0 // (c1 % 5) AS a, c0 % (c1 % 5) AS b FROM {psize} WHERE c1 % 5 <> 0")

# Strings

rules("str_concat", "r(P, C) :- part3(P, T, S), pname(P, N), C = concat(N, T).", "r", "part_key word", "SELECT a.c0 AS part_key, concat(b.c1, a.c1) AS word FROM {part3} a JOIN {pname} b ON a.c0 = b.c0")
add("str_length_bytes", lambda s, d: _text_rules(s, d, "r(D, N) :- observation(D, T), N = length(T).").toDF("doc", "n"), "SELECT doc_id::varchar AS doc, cast(strlen(text) as bigint) AS n FROM documents")
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
add("str_lower_ascii", lambda s, d: _text_rules(s, d, "r(D, L, U) :- observation(D, T), L = lower(T), U = upper(T).").toDF("doc", "low", "up"), f"SELECT doc_id::varchar AS doc, translate(text, '{_A}', '{_Z}') AS low, translate(text, '{_Z}', '{_A}') AS up FROM documents")
rules("str_prefix", 'r(P, N) :- pname(P, N), prefix(N, "red").', "r", "part_key name", "SELECT c0 AS part_key, c1 AS name FROM {pname} WHERE starts_with(c1, 'red')")
rules("str_suffix", 'r(P, N) :- pname(P, N), suffix(N, "gear").', "r", "part_key name", "SELECT c0 AS part_key, c1 AS name FROM {pname} WHERE suffix(c1, 'gear')")
rules("str_contains", 'r(P, N) :- pname(P, N), contains(N, "e b").', "r", "part_key name", "SELECT c0 AS part_key, c1 AS name FROM {pname} WHERE contains(c1, 'e b')")
rules("regex_col", "r(P, N) :- pname(P, N) ~ 1 '(red|blue) [b-r]+.*'.", "r", "part_key name", "SELECT c0 AS part_key, c1 AS name FROM {pname} WHERE regexp_full_match(c1, '(red|blue) [b-r]+.*', 's')")
add("pattern_query", on("cname", "cust name", lambda c: c.where(regex.matches(F.col("c1"), r"Customer\x230*[1-4][05]?"))), "SELECT c0 AS cust, c1 AS name FROM {cname} WHERE regexp_full_match(c1, 'Customer#0*[1-4][05]?')")


def _text_rules(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    db = Database(spark)
    db.set_relation("observation", observation(spark, sf_dir), distinct=True)
    db.load_rules(text)
    return db.derive("r")


# Lists

rules("list_cons_car_cdr", "l(O, L) :- li(O, P, S, N), A = append([P, S], [N]), L = cons(O, A). t(O, H, T) :- l(O, L), H = car(L), T = cdr(L). r(O, H, S, N) :- t(O, H, [P, S, N]).", "r", "order_key head supp_key line", "SELECT DISTINCT c0 AS order_key, c0 AS head, c2 AS supp_key, c3 AS line FROM {li}")
rules("list_append", "r(P, L) :- ps(P, S), A = cons(P, []), B = cons(S, []), L = append(A, B).", "r", "part_key pair", "SELECT DISTINCT c0 AS part_key, [c0, c1] AS pair FROM {ps}")
rules("list_member_gen", "l(O, L) :- li(O, P, S, N), A = cons(P, []), L = cons(S, A). r(O, X) :- l(O, L), member(X, L).", "r", "order_key x", "SELECT DISTINCT c0 AS order_key, unnest([c1, c2]) AS x FROM {li}")
rules("list_member_filter", "r(P, S) :- psize(P, S), member(S, [3, 7, 11, 50]).", "r", "part_key size", "SELECT c0 AS part_key, c1 AS size FROM {psize} WHERE c1 IN (3, 7, 11, 50)")
rules("list_member_count", "l(P, L) :- psize(P, S), A = cons(S, []), L = cons(S, A). r(P, N) :- l(P, L), member(X, L), N = count().", "r", "part_key n", "SELECT c0 AS part_key, cast(2 as bigint) AS n FROM {psize}")
rules("list_pattern", "l(P, L) :- part3(P, T, S), A = cons(S, []), L = cons(P, A). r(P, S) :- l(P, [P | T]), [S] = T.", "r", "part_key size", "SELECT c0 AS part_key, c2 AS size FROM {part3}")
rules("list_equality", "l(P, L) :- psize(P, S), A = cons(S, []), L = cons(9, A). r(P) :- l(P, L), L = [9, 9].", "r", "part_key", "SELECT c0 AS part_key FROM {psize} WHERE c1 = 9")
rules("list_length", "l(P, L) :- ps(P, S), A = cons(S, []), L = cons(P, A). r(P, N) :- l(P, L), N = length(L).", "r", "part_key n", "SELECT DISTINCT c0 AS part_key, cast(2 as bigint) AS n FROM {ps}")

# Range and relations of varying width

_ENDS = " low(M) :- cust(X, N), M = min(X). high(M) :- cust(X, N), M = max(X)."
_ENDS_SQL = "c0 >= (SELECT min(c0) FROM {cust}) + 3 AND c0 < (SELECT max(c0) FROM {cust}) - 3"
rules("range_gen", "r(X) :- low(A), high(B), L = A + 3, H = B - 3, range(X, ord, L, H)." + _ENDS, "r", "x", "SELECT DISTINCT c0 AS x FROM {ord} WHERE " + _ENDS_SQL)
rules("range_filter", "r(C, N) :- cust(C, N), low(A), high(B), L = A + 3, H = B - 3, range(C, ord, L, H)." + _ENDS, "r", "cust nation", "SELECT c0 AS cust, c1 AS nation FROM {cust} WHERE c0 IN (SELECT c0 FROM {ord}) AND " + _ENDS_SQL)
rules("range_var_bounds", "b(N, L, H) :- nat(N, R), L = N * 10, H = L + R + 2. r(N, X) :- b(N, L, H), range(X, cust, L, H).", "r", "nation x", "SELECT DISTINCT n.c0 AS nation, c.c0 AS x FROM {nat} n JOIN {cust} c ON c.c0 >= n.c0 * 10 AND c.c0 < n.c0 * 10 + n.c1 + 2")


def _variadic(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.declare("v", 0)
    for n in ("nat", "supp", "psize"):
        db.set_relation("v", relation(spark, sf_dir, n), distinct=RELATIONS[n][3])
    db.set_relation("v", relation(spark, sf_dir, "sale"), distinct=True)
    db.load_rules("r(X) :- v(X, Y). r(X) :- v(X, Y, Z).")
    return db.derive("r").toDF("x")


add("variadic_union", _variadic, "SELECT c0 AS x FROM {nat} UNION SELECT c0 FROM {supp} UNION SELECT c0 FROM {psize} UNION SELECT c0 FROM {sale}")

# Order statistics

_LI = "l.c0 AS order_key, l.c1 AS part_key, l.c2 AS supp_key, l.c3 AS line"
add("rank_all", on("li", "order_key part_key supp_key line rank", lambda li: orderstats.with_rank(li)), f"SELECT {_LI}, row_number() OVER (ORDER BY c0, c1, c2, c3) - 1 AS rank FROM {{li}} l")
add("rank_one", on("li", "rank", lambda li: orderstats.rank(li, [500, 3, 0, 0])), "SELECT count(*) AS rank FROM {li} WHERE (c0, c1, c2, c3) < (500, 3, 0, 0)")
add("select_kth", on("li", "order_key part_key supp_key line", lambda li: orderstats.select(li, 1234)), f"SELECT {_LI} FROM {{li}} l ORDER BY c0, c1, c2, c3 LIMIT 1 OFFSET 1234")
add("range_count", on("li", "n", lambda li: orderstats.range_count(li, [100, 0, 0, 0], [900, 50, 0, 0])), "SELECT count(*) FILTER ((c0, c1, c2, c3) < (900, 50, 0, 0)) - count(*) FILTER ((c0, c1, c2, c3) < (100, 0, 0, 0)) AS n FROM {li}")
add("count_relation", on("li", "n", lambda li: orderstats.count(li)), "SELECT count(*) AS n FROM {li}")
add("rank_bound", on("li", "order_key part_key supp_key line rank", lambda li: orderstats.with_rank(li, by=["c0"])), f"SELECT {_LI}, row_number() OVER (PARTITION BY c0 ORDER BY c1, c2, c3) - 1 AS rank FROM {{li}} l")
add("rank_perm", on("li", "order_key part_key supp_key line rank", lambda li: orderstats.with_rank(li, perm=[2, 1, 0, 3])), f"SELECT {_LI}, row_number() OVER (ORDER BY c2, c1, c0, c3) - 1 AS rank FROM {{li}} l")
add("merge_join", on("ord cust", "order_key l_cust r_cust nation", lambda o, c: orderstats.merge_join(o.selectExpr("c1", "c0"), c, 1).selectExpr("l1", "l0", "r0", "r1")), "SELECT o.c0 AS order_key, o.c1 AS l_cust, c.c0 AS r_cust, c.c1 AS nation FROM {ord} o JOIN {cust} c ON o.c1 = c.c0")

add("select_deep", on("li", "order_key part_key supp_key line", lambda li: orderstats.select(li, li.count() * 3 // 4)), f"SELECT {_LI} FROM {{li}} l ORDER BY c0, c1, c2, c3 LIMIT 1 OFFSET (SELECT count(*) * 3 // 4 FROM {{li}})")


def _perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of a relation, found by their numbers: how many there are, and the rank of a tuple in either."""
    db = database(spark, sf_dir, "li")
    a, b = db.declare_perm("li", [2, 1, 0, 3]), db.declare_perm("li", [3, 2, 1, 0])
    t = (500, 3, 0, 0)
    found = [(db.perm_count(), db.find_perm("li", p), db.rank("li", *t, perm=n)) for p, n in (((2, 1, 0, 3), a), ((3, 2, 1, 0), b))]
    return spark.createDataFrame(found, "perms long, perm long, rank long")


add("perm_declare", _perm, "SELECT 2 AS perms, 0 AS perm, (SELECT count(*) FROM {li} WHERE (c2, c1, c0, c3) < (0, 3, 500, 0)) AS rank UNION ALL SELECT 2, 1, (SELECT count(*) FROM {li} WHERE (c3, c2, c1, c0) < (0, 0, 3, 500))")

# Goal-directed


def _goal(goal: str, cols: str, text: str = "r(C, N, R) :- cust(C, N), nat(N, R).") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *_relations(text))
        db.load_rules(text)
        return db.query(goal).toDF(*cols.split())

    return run


add("goal_bound", _goal("r(X, 4, Y)", "cust region"), "SELECT DISTINCT c.c0 AS cust, n.c1 AS region FROM {cust} c JOIN {nat} n ON c.c1 = n.c0 WHERE c.c1 = 4")
add("goal_repeated", _goal("r(X, Y, Y)", "cust nation"), "SELECT DISTINCT c.c0 AS cust, c.c1 AS nation FROM {cust} c JOIN {nat} n ON c.c1 = n.c0 WHERE n.c1 = n.c0")
add("goal_ground", _goal('cseg(1, "MACHINERY")', "found", 'x(C) :- cseg(C, "MACHINERY").'), "SELECT true AS found FROM {cseg} WHERE c0 = 1 AND c1 = 'MACHINERY'")

_GOAL = _TC.format(e="tree")


def _magic(adornment: str, *values, text: str = _GOAL, goal: str = "tc", topdown: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *_relations(text))
        db.load_rules(text)
        ask = db.query_topdown if topdown else db.query_magic
        return ask(goal, adornment, *values).toDF("src", "dst")

    return run


add("magic_bf", _magic("bf", 777), _TREE + " SELECT c0 AS src, c1 AS dst FROM tc WHERE c0 = 777")
add("magic_fb", _magic("fb", 25), _TREE + " SELECT c0 AS src, c1 AS dst FROM tc WHERE c1 = 25")
add("magic_bb", _magic("bb", 777, 3), _TREE + " SELECT c0 AS src, c1 AS dst FROM tc WHERE c0 = 777 AND c1 = 3")
add("magic_multi_adorn", _magic("bf", 4, text="sg(X, Y) :- nat(X, R), nat(Y, R). sg(X, Y) :- nedge(A, X), sg(A, B), nedge(B, Y).", goal="sg"), ORACLE_SQL["same_generation"].replace("SELECT a, b FROM sg", "SELECT a AS src, b AS dst FROM sg WHERE a = 4"))
add("topdown_bf", _magic("bf", 1023, topdown=True), _TREE + " SELECT c0 AS src, c1 AS dst FROM tc WHERE c0 = 1023")

# Maintenance: the result is that of the final base


def _ivm(text: str, goal: str, cols: str, names: str, plus: dict, minus: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *names.split())
        db.load_rules(text)
        m = db.maintain()
        for name in {*plus, *minus}:
            db.change(name, plus.get(name, []), minus.get(name, []))
        return m.publish()[goal].toDF(*cols.split())

    return run


add("ivm_insert", _ivm("r(C, R) :- cust(C, N), nat(N, R).", "r", "cust region", "cust nat", {"cust": [(999_999_999, 3)], "nat": [(77, 1)]}, {}), "SELECT DISTINCT c.c0 AS cust, n.c1 AS region FROM (SELECT * FROM {cust} UNION SELECT 999999999, 3) c JOIN (SELECT * FROM {nat} UNION SELECT 77, 1) n ON c.c1 = n.c0")
add("ivm_recursive_insert", _ivm(_TC.format(e="nedge"), "tc", "src dst", "nedge", {"nedge": [(30, 0), (24, 31), (31, 30)]}, {}), "WITH RECURSIVE e AS (SELECT * FROM {nedge} UNION SELECT 30, 0 UNION SELECT 24, 31 UNION SELECT 31, 30), tc AS (SELECT c0, c1 FROM e UNION SELECT e.c0, tc.c1 FROM e JOIN tc ON e.c1 = tc.c0) SELECT c0 AS src, c1 AS dst FROM tc")
add("ivm_delete", _ivm("r(N) :- cust(C, N). r(N) :- supp(S, N). q(N, R) :- r(N), nat(N, R).", "q", "nation region", "cust supp nat", {}, {"nat": [(4, 4), (6, 1)], "cust": [(0, 2)]}), "SELECT DISTINCT n.c0 AS nation, n.c1 AS region FROM (SELECT c1 FROM {cust} WHERE (c0, c1) <> (0, 2) UNION SELECT c1 FROM {supp}) r JOIN {nat} n ON n.c0 = r.c1 WHERE (n.c0, n.c1) <> (4, 4) AND (n.c0, n.c1) <> (6, 1)")
add("ivm_aggregate", _ivm("r(C, N, S) :- t(C, S), n(C, N). n(C, N) :- sale(O, C, V), N = count(). t(C, S) :- sale(O, C, V), S = sum(V).", "r", "cust n total", "sale", {"sale": [(999_999_999, 1, 500), (999_999_998, 1, 700), (999_999_997, 999_999_999, 5)]}, {}), "SELECT c1 AS cust, count(*) AS n, cast(sum(c2) % 4294967296 as bigint) AS total FROM (SELECT * FROM {sale} UNION ALL SELECT 999999999, 1, 500 UNION ALL SELECT 999999998, 1, 700 UNION ALL SELECT 999999997, 999999999, 5) GROUP BY 1")

add("ivm_recursive_delete", _ivm(_TC.format(e="tree"), "tc", "src dst", "tree", {}, {"tree": [(2, 1), (9, 4), (16, 8)]}), "WITH RECURSIVE e AS (SELECT * FROM {tree} WHERE (c0, c1) NOT IN ((2, 1), (9, 4), (16, 8))), tc AS (SELECT c0, c1 FROM e UNION SELECT e.c0, tc.c1 FROM e JOIN tc ON e.c1 = tc.c0) SELECT c0 AS src, c1 AS dst FROM tc")


def _facts_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 facts added one by one, 50 of them and 20 others deleted again."""
    db = database(spark, sf_dir, "nat")
    for i in range(200):
        db.change("nat", [(1000 + i, i % 5)], [])
    for i in range(50):
        db.change("nat", [], [(1000 + i, i % 5)])
    db.change("nat", [], [(i, j) for i in range(4) for j in range(5)])
    assert db.add_fact("nat", 1100, 0) == 0 and db.delete_fact("nat", 1000, 0) == 0
    return db.live("nat").toDF("nation", "region")


add("facts_many", _facts_many, "SELECT c0 AS nation, c1 AS region FROM {nat} WHERE c0 >= 4 UNION ALL SELECT 1000 + i, i % 5 FROM range(50, 200) t(i)")

# Versions


def _folder(spark: SparkSession) -> str:
    return f"{scratch.root(spark)}/db-{uuid.uuid4().hex}"


def _reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, base facts and later changes are there when the folder is opened again; an older version stays as it was."""
    folder = _folder(spark)
    with Database(spark, folder) as db:
        db.set_relation("nedge", relation(spark, sf_dir, "nedge"))
        db.load_rules(_TC.format(e="nedge"))
        db.publish()
        db.change("nedge", [(30, 0), (0, 31)], [])
        db.delete_fact("nedge", *relation(spark, sf_dir, "nedge").orderBy("c0", "c1").first())
    db = Database(spark, folder)
    version = db.publish()
    return db.query_version(version, "tc").toDF("src", "dst")


def _cas_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A committed transaction and its revision outlive the session; one that met a conflict leaves nothing."""
    folder = _folder(spark)
    with Database(spark, folder) as db:
        db.set_relation("nat", relation(spark, sf_dir, "nat"), distinct=True)
        for expected, row in ((0, (77, 1)), (5, (88, 1))):
            t = db.begin()
            t.cas("nations", expected, expected + 1)
            t.add("nat", *row)
            try:
                t.commit()
            except Conflict:
                pass
    with Database(spark, folder) as db:
        return db.live("nat").select("c0", "c1", F.lit(db.rev_get("nations")).cast("long")).toDF("nation", "region", "revision")


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "nat")
    db.set_retain(2)
    for i in range(4):
        db.change("nat", [(100 + i, i)], [])
        db.publish()
    found = [(v, db.query_version(v, "nat").count()) for v in db.versions()]
    return spark.createDataFrame(found, "version long, n long")


add("reopen_state", _reopen, "WITH RECURSIVE e AS (SELECT * FROM {nedge} WHERE (c0, c1) <> (SELECT (c0, c1) FROM {nedge} ORDER BY c0, c1 LIMIT 1) UNION SELECT 30, 0 UNION SELECT 0, 31), tc AS (SELECT c0, c1 FROM e UNION SELECT e.c0, tc.c1 FROM e JOIN tc ON e.c1 = tc.c0) SELECT c0 AS src, c1 AS dst FROM tc")
add("cas_reopen", _cas_reopen, "SELECT c0 AS nation, c1 AS region, cast(1 as bigint) AS revision FROM {nat} UNION ALL SELECT 77, 1, 1")
add("retention", _retention, "SELECT v AS version, (SELECT count(*) FROM {nat}) + v AS n FROM range(3, 5) t(v)")

# Files


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch.root(spark)}/csv-{uuid.uuid4().hex}"
    df = relation(spark, sf_dir, "pname").join(relation(spark, sf_dir, "psize").withColumnRenamed("c1", "c2"), "c0")
    df.select(F.format_string('%d,"%s, %s",%d', "c0", "c1", "c1", "c2")).unionByName(spark.createDataFrame([("1,narrow",), ("4294967296,beyond,1",), ("",)], "s string").toDF(df.select(F.format_string('%d,"%s, %s",%d', "c0", "c1", "c1", "c2")).columns[0])).write.text(path)
    db = Database(spark)
    counts = db.load_csv("t", path, 3)
    assert counts["skipped"] == 2
    return db.live("t").toDF("part_key", "names", "size")


def _csv_variadic(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch.root(spark)}/csv-{uuid.uuid4().hex}"
    pairs, triples = relation(spark, sf_dir, "cust"), relation(spark, sf_dir, "part3")
    pairs.select(F.concat_ws(",", "c0", "c1")).toDF("s").union(triples.select(F.concat_ws(",", "c0", "c1", "c2"))).write.text(path)
    db = Database(spark)
    db.declare("v", 0)
    db.load_csv("v", path)
    db.load_rules("r(X, N) :- v(X, N). w(X) :- v(X, T, S).")
    return db.derive("r").select(F.lit(2).alias("width"), F.col("c0").alias("x")).union(db.derive("w").select(F.lit(3), "c0"))


add("csv_fixed", _csv, "SELECT a.c0 AS part_key, concat(a.c1, ', ', a.c1) AS names, b.c1 AS size FROM {pname} a JOIN {psize} b ON a.c0 = b.c0")
add("csv_variadic", _csv_variadic, "SELECT 2 AS width, c0 AS x FROM {cust} UNION ALL SELECT 3, c0 FROM {part3}")

_TYPED = schemas.load({"relations": [{"name": "part", "columns": [{"name": "id", "type": "Natural"}, {"name": "kind", "type": "Text"}, {"name": "size", "type": {"kind": "Natural", "max": 50}}]}]}).relations["part"]
_TYPED_SQL = "SELECT c0 AS id, c1 AS kind, c2 AS size FROM {part3}"


def _typed(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch.root(spark)}/typed-{uuid.uuid4().hex}.{kind}"
        own = relation(spark, sf_dir, "part3").toDF("id", "kind", "size")
        if kind == "csv":
            text = own.select(F.concat_ws(",", "size", "id", F.format_string('"%s"', "kind")).alias("s"))
            # One file, header first: parts in order below one name.
            lines = spark.createDataFrame([("size,id,kind",)], "s string").union(text.coalesce(1)).coalesce(1)
        else:
            lines = own.select(F.to_json(F.struct("*")).alias("s")).coalesce(1)
        lines.write.text(path)
        read = typed.read_csv if kind == "csv" else typed.read_json
        return read(spark, path, _TYPED).toDF("id", "kind", "size")

    return run


add("typed_csv_valid", _typed("csv"), _TYPED_SQL)
add("typed_json_valid", _typed("jsonl"), _TYPED_SQL)


def _typed_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed project: schema, data and rules in a folder, built and asked."""
    folder = tempfile.mkdtemp(prefix="corollary-project-")  # small, and the driver's alone
    text = [{"name": "id", "type": "Natural"}, {"name": "region", "type": "Natural"}]
    Project.init(folder)
    Path(folder, "schema.json").write_text(json.dumps({"relations": [{"name": n, "columns": text} for n in ("nation", "near")]}))
    rows = sorted(tuple(r) for r in relation(spark, sf_dir, "nat").collect())
    Path(folder, "data", "nation.csv").write_text("region,id\n" + "".join(f"{r},{n}\n" for n, r in rows))
    Path(folder, "rules", "near.datalog").write_text("near(A, B) :- nation(A, R), nation(B, R), A != B.")
    p = Project(spark, folder)
    p.build()
    out = p.query("near(3, X)").collect()
    shutil.rmtree(folder)
    return spark.createDataFrame([tuple(r) for r in out], "nation long")


add("typed_goal", _typed_goal, "SELECT b.c0 AS nation FROM {nat} a JOIN {nat} b ON a.c1 = b.c1 WHERE a.c0 = 3 AND b.c0 <> 3")


def _asof(spark: SparkSession, sf_dir: str, bound: tuple = ()) -> DataFrame:
    db = database(spark, sf_dir, "nedge")
    db.load_rules(_TC.format(e="nedge"))
    first = db.publish()
    db.change("nedge", [(30, 0), (0, 31)], [])
    db.publish()
    return db.query_bound_version(first, "tc", *bound).toDF("src", "dst")


add("asof_v1", _asof, _NEDGE + " SELECT c0 AS src, c1 AS dst FROM tc")
add("asof_prefix", lambda s, d: _asof(s, d, (1,)), _NEDGE + " SELECT c0 AS src, c1 AS dst FROM tc WHERE c0 = 1")


def _cas_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "nat")
    t = db.begin()
    t.cas("nations", 0, 1)
    t.add("nat", 77, 1)
    t.delete("nat", 4, 4)
    t.commit()
    return db.live("nat").toDF("nation", "region")


add("cas_txn", _cas_txn, "SELECT c0 AS nation, c1 AS region FROM {nat} WHERE (c0, c1) <> (4, 4) UNION ALL SELECT 77, 1")

# Graph and search


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("c0"), F.col("text").alias("c1"))


_BOTH = "WITH e AS {nedge}, b AS (SELECT c0 AS x, c1 AS y FROM e UNION SELECT c1, c0 FROM e), h1 AS (SELECT y FROM b WHERE x = 2), h2 AS (SELECT b.y FROM b JOIN h1 ON b.x = h1.y), h3 AS (SELECT b.y FROM b JOIN h2 ON b.x = h2.y)"
add("traverse_bfs3", on("nedge", "node depth", lambda e: graph.traverse(e, 2, 3)), _BOTH + " SELECT node, min(depth) AS depth FROM (SELECT x AS node, 0 AS depth FROM b WHERE x = 2 UNION ALL SELECT y, 1 FROM h1 UNION ALL SELECT y, 2 FROM h2 UNION ALL SELECT y, 3 FROM h3) GROUP BY 1")
add("traverse_max_nodes", on("nedge", "node depth", lambda e: graph.traverse(e, 2, 3, max_nodes=3)), _BOTH + ", d AS (SELECT c0 AS y, min(n) AS n FROM (SELECT c1 AS c0, row_number() OVER (ORDER BY w, c1) AS n FROM (SELECT c1, 0 AS w FROM e WHERE c0 = 2 UNION ALL SELECT c0, 1 FROM e WHERE c1 = 2) WHERE c1 <> 2) GROUP BY 1), f AS (SELECT y, n FROM d ORDER BY n LIMIT 2) SELECT 2 AS node, 0 AS depth UNION ALL SELECT y, 1 FROM f")
add("node_observations", lambda s, d: graph.node_observations(observation(s, d), "7"), "SELECT DISTINCT text AS content FROM documents WHERE doc_id::varchar = '7'")
_TOK = "list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), '{}')"
_FOUND = f"SELECT DISTINCT text AS content, 2 AS score FROM documents WHERE {_TOK.format('the')} AND {_TOK.format('mit')}"
add("fulltext_and", lambda s, d: fulltext.scan_search(observation(s, d), "The MIT"), _FOUND)
add("fulltext_indexed", lambda s, d: fulltext.search(fulltext.write_postings(observation(s, d)), "the mit"), _FOUND)


def _search_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version's index, after a second one was published."""
    db = Database(spark)
    db.set_relation("observation", observation(spark, sf_dir), distinct=True)
    db.build_index()
    first = db.publish()
    db.add_fact("observation", "later", "the MIT of a later version")
    db.build_index()
    db.publish()
    return db.search("the mit", version=first)


add("fulltext_version", _search_version, _FOUND)
add("fulltext_top", lambda s, d: fulltext.search(fulltext.postings(observation(s, d)), "the mit", top=5), _FOUND + " ORDER BY content LIMIT 5")

# Queries are the rows whose vec_id is divisible by 20, against all rows. Bands of 16 bits, 6 of them free: measured recall is in the README.
_BITS, _RADIUS, _K, _EVERY = 64, 24, 10, 20


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The queries, and all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    encoded = vector.encode(vectors, "vec_id", "embedding", vector.fit_basis(vectors, "embedding", _BITS))
    return encoded.where(F.col("entity") % _EVERY == 0), encoded


def _mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, encoded = _encoded(spark, sf_dir)
    return vector.candidate_pairs(queries, _RADIUS, encoded)


def _rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    encoded = vector.encode(vectors, "vec_id", "embedding", vector.scale_only(vectors, "embedding"))
    return vector.search_rows(encoded.where(F.col("entity") % _EVERY == 0), _K, None, encoded)


def _vsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, encoded = _encoded(spark, sf_dir)
    return vector.search_rows(queries, _K, _RADIUS, encoded)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, encoded = _encoded(spark, sf_dir)
    found = fulltext.owners(observation(spark, sf_dir), fulltext.scan_search(observation(spark, sf_dir), "the"), every=True)
    lexical = found.select(F.col("entity").cast("long").alias("entity")).distinct()
    return vector.search_rows(queries, _K, _RADIUS, encoded.join(lexical, "entity", "left_semi"))


# The int8 form needs no fitted basis, and so SQL can say the same: round half away from zero, then floor of the norm.
_INT8_SQL = f"""
    WITH s AS (SELECT 127 / max(abs(x)) AS f FROM (SELECT unnest(embedding)::double AS x FROM embeddings)),
    q AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, cast(round(x::double * s.f) as integer)))) AS v FROM embeddings, s),
    n AS (SELECT vec_id, v, floor(sqrt(list_sum(list_transform(v, lambda x: x * x))::double)) AS norm FROM q),
    d AS (SELECT a.vec_id AS query, b.vec_id AS entity, cast(list_dot_product(a.v::double[], b.v::double[]) as bigint) AS dot, b.norm FROM n a, n b WHERE a.vec_id % {_EVERY} = 0)
    SELECT query, entity, dot FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN norm > 0 THEN dot / norm END DESC NULLS LAST, entity) AS place FROM d) WHERE place <= {_K}
"""

for _name, _run, _sql in (("mih_candidates", _mih, None), ("int8_rerank", _rerank, _INT8_SQL), ("vector_search", _vsearch, None), ("hybrid_search", _hybrid, None)):
    add(_name, _run, _sql)
