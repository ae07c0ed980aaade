"""Facts, versions, transactions, maintenance."""

import random

import pytest

from corollary.lang.ast import ArityError, SafetyError, TypingError
from corollary.session import Database, UnknownRelation
from corollary.store import relations, scratch
from corollary.store.relations import Locked
from corollary.store.snapshots import VersionError
from corollary.store.transactions import Conflict, TransactionError
from corollary.streaming.maintain import ingest

TC = "tc(X,Y) :- edge(X,Y). tc(X,Y) :- edge(X,Z), tc(Z,Y)."


def test_facts(spark, rows):
    db = Database(spark)
    db.declare("e", 2)
    assert db.add_fact("e", 1, 2) == 1 and db.add_fact("e", 1, 2) == 0
    assert db.lookup("e", 1, 2) and not db.lookup("e", 2, 1) and not db.lookup("e", 1) and not db.lookup("none", 1)
    assert db.delete_fact("e", 1, 2) == 1 and db.delete_fact("e", 1, 2) == 0
    with pytest.raises(ArityError):
        db.declare("e", 3)
    with pytest.raises(SafetyError):
        db.declare("rev", 2)
    with pytest.raises(UnknownRelation):
        db.derive("nothing")


def test_variadic(spark, rows):
    db = Database(spark)
    db.declare("v", 0)
    db.facts("v", [(7,), (7, 8), (8, 7), (7, 8, 9), (7, 9, 8), (1, 2, 3, 4)])
    count = lambda *p: sum(df.count() for df in db.prefix("v", *p).values())
    assert [count(), count(7), count(7, 8), count(*range(8))] == [6, 4, 2, 0]
    db.load_rules("two(X,Y) :- v(X,Y). none(X) :- v(X,A,B,C,D).")
    assert rows(db.derive("two")) == [(7, 8), (8, 7)] and rows(db.derive("none")) == []


def test_csv(spark, rows, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('1,abc\n2,"x, y"\n2,"x, y"\n"3",z\n4\n5,a,b\n4294967296,q\n\n')
    db = Database(spark)
    assert db.load_csv("t", str(p)) == {"rows": 7, "skipped": 3}
    assert rows(db.live("t")) == [(1, "abc"), (2, "x, y"), (3, "z")]
    db.declare("v", 0)
    assert db.load_csv("v", str(p))["skipped"] == 1
    assert db.widths("v") == [1, 2, 3]


def test_versions(spark, rows):
    db = Database(spark)
    db.facts("edge", [(1, 2)])
    db.load_rules(TC)
    v1 = db.publish()
    db.add_fact("edge", 2, 3)
    assert rows(db.query("tc")) == [(1, 2)]  # reads go to what is published
    v2 = db.publish()
    assert rows(db.query_version(v1, "tc")) == [(1, 2)]
    assert rows(db.query_version(v2, "tc")) == [(1, 2), (1, 3), (2, 3)] == rows(db.query("tc"))
    assert rows(db.query_bound_version(v2, "tc", 2)) == [(2, 3)]
    for bad in ((0, "tc"), (9, "tc"), (v1, "nothing")):
        with pytest.raises(VersionError):
            db.query_version(*bad)
    db.set_retain(1)
    v3 = db.publish()
    assert db.versions() == [v3]


def test_transactions(spark, rows):
    db = Database(spark)
    db.facts("e", [(1, 2), (3, 4)])
    t = db.begin()
    t.cas("a", 0, 1)
    t.add("e", 5, 6)
    t.delete("e", 1, 2)
    for bad in (db.publish, db.begin, lambda: db.cas_revision("a", 0, 1), lambda: t.add("rev", 1, 2), lambda: db.add_fact("e", 8, 8)):
        with pytest.raises(TransactionError):
            bad()
    assert rows(db.live("e")) == [(1, 2), (3, 4)]
    t.commit()
    assert rows(db.live("e")) == [(3, 4), (5, 6)] and db.rev_get("a") == 1
    t = db.begin()
    t.add("e", 7, 7)
    t.cas("a", 0, 2)
    with pytest.raises(Conflict):
        t.commit()
    assert rows(db.live("e")) == [(3, 4), (5, 6)] and db.rev_get("a") == 1
    db.begin().rollback()
    db.cas_revision("a", 1, 1)
    with pytest.raises(Conflict):
        db.cas_revision("b", 3, 4)


PROGRAMS = [
    ("r(X,Y) :- edge(X,Z), edge(Z,Y).", "r", "maintain_insert", "maintain_delete"),
    (TC, "tc", "maintain_insert_recursive", "maintain_delete_recursive"),
    ("odd(X,Y) :- edge(X,Y). odd(X,Y) :- even(X,Z), edge(Z,Y). even(X,Y) :- odd(X,Z), edge(Z,Y).", "even", "maintain_insert_recursive", "maintain_delete_recursive"),
    ("n(X,N) :- edge(X,Y), N = count().", "n", "maintain_groups", "maintain_groups"),
    ("s(N) :- edge(X,Y), N = sum(Y).", "s", "maintain_groups", "maintain_groups"),
    ("o(X) :- edge(X,Y), !edge(Y,X).", "o", "maintain_recompute", "maintain_recompute"),
    ("u(X) :- edge(X,Y). u(Y) :- edge(X,Y). w(X,N) :- u(X), edge(X,Y), N = max(Y).", "w", "maintain_groups", "maintain_delete"),
]


@pytest.mark.parametrize(("text", "goal", "on_insert", "on_delete"), PROGRAMS)
def test_maintenance_equals_evaluation(spark, rows, text, goal, on_insert, on_delete):
    rng = random.Random(goal)
    db = Database(spark)
    have = {(rng.randrange(6), rng.randrange(6)) for _ in range(8)}
    db.facts("edge", sorted(have))
    db.load_rules(text)
    m = db.maintain()
    for step in range(3):
        plus = [] if step == 1 else [(rng.randrange(7), rng.randrange(7)) for _ in range(2)]
        minus = [] if step == 0 else rng.sample(sorted(have), 2)
        minus = [t for t in minus if t not in plus]
        have = (have | set(plus)) - set(minus)
        db.change("edge", plus, minus)
        got = rows(m.publish()[goal])
        assert got == rows(db.derive(goal)), (step, plus, minus)
        assert db.counters[on_insert if step == 0 else on_delete]


def test_stream(spark, rows, tmp_path):
    db = Database(spark)
    db.facts("edge", [(1, 2)])
    db.load_rules(TC)
    spark.createDataFrame([(2, 3), (3, 4)], "a long, b long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    ingest(stream, db, "edge", str(tmp_path / "checkpoint")).awaitTermination(120)
    assert (1, 4) in rows(db.query("tc"))


def size_of(df):
    return len(df._jdf.queryExecution().logical().toString())


def test_many_facts_keep_the_plan_small(spark, rows):
    db = Database(spark)
    db.facts("e", [(i, i) for i in range(10)])
    for i in range(10, 14):
        assert db.add_fact("e", i, i) == 1
    first = size_of(db.live("e"))
    for i in range(14, 40):
        db.change("e", [(i, i)], [(i - 10, i - 10)])
    assert size_of(db.live("e")) <= first + 200
    assert rows(db.live("e")) == [(i, i) for i in (*range(4), *range(30, 40))]
    with pytest.raises(TypingError):
        db.change("e", [("x", 1)], [])


def test_changes_are_written_and_worked_in(spark, rows, monkeypatch):
    monkeypatch.setattr(relations, "PENDING", 3)
    rng = random.Random(1)
    db, have = Database(spark), {(i,) for i in range(20)}
    db.facts("e", sorted(have))
    for _ in range(6):
        plus, minus = {(rng.randrange(30),) for _ in range(3)}, {(rng.randrange(30),) for _ in range(3)}
        minus -= plus
        db.change("e", sorted(plus), sorted(minus))
        have = (have | plus) - minus
        assert rows(db.live("e")) == sorted(have)


def test_opening_again(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/db"
    db = Database(spark, folder)
    db.facts("edge", [(1, 2), (2, 3)])
    db.declare("v", 0)
    db.load_rules(TC + " edge(3, 4).")
    assert db.declare_perm("edge", [1, 0]) == 0
    v1 = db.publish()
    db.add_fact("edge", 7, 8)
    db.delete_fact("edge", 1, 2)
    db.cas_revision("a", 0, 3)
    with pytest.raises(Locked):
        Database(spark, folder)
    seen = Database(spark, folder, read_only=True)
    assert seen.lookup("edge", 7, 8)
    with pytest.raises(Locked):
        seen.add_fact("edge", 9, 9)
    db.base.close()  # as if it had died after its last call
    again = Database(spark, folder)
    assert rows(again.live("edge")) == [(2, 3), (3, 4), (7, 8)] and again.rev_get("a") == 3
    assert again.find_perm("edge", [1, 0]) == 0 and "v" in again.variadic and len(again.rules) == 2
    assert rows(again.query_version(v1, "tc")) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    v2 = again.publish()
    assert rows(again.query("tc")) == [(2, 3), (2, 4), (3, 4), (7, 8)] and again.versions() == [v1, v2]
    again.close()
    last = Database(spark, folder)
    assert rows(last.live("edge")) == [(2, 3), (3, 4), (7, 8)] and not last.base.files.names("log")
    last.close()
    with pytest.raises(Locked):
        last.add_fact("edge", 1, 1)


def test_a_transaction_is_logged_whole(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/db"
    with Database(spark, folder) as db:
        db.facts("e", [(1, 2)])
        t = db.begin()
        t.add("e", 5, 6)
        t.delete("e", 1, 2)
        t.cas("x", 0, 1)
        t.commit()
        t = db.begin()
        t.add("e", 8, 8)
        t.cas("x", 0, 2)
        with pytest.raises(Conflict):
            t.commit()
    with Database(spark, folder) as db:
        assert rows(db.live("e")) == [(5, 6)] and db.rev_get("x") == 1
    (tmp_path / "db" / "log" / "000000000099.json.new").write_text('{"changes": [["e", [9')  # a write that was cut off
    with Database(spark, folder, break_lock=True) as db:
        assert rows(db.live("e")) == [(5, 6)]


def test_versions_share_tables(spark, rows, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.facts("edge", [(1, 2), (2, 3)])
    db.facts("other", [(1,)])
    db.load_rules(TC)
    db.maintain()
    versions = [db.publish()]
    for i in range(3, 6):
        db.add_fact("edge", i, i + 1)
        versions.append(db.publish())
    tables = [db.snapshots._manifest(v) for v in versions]
    assert len({str(m["other"]) for m in tables}) == 1  # never written again
    assert [len(m["tc"]["tables"]) for m in tables] == [1, 2, 3, 4]
    assert [db.query_version(v, "tc").count() for v in versions] == [3, 6, 10, 15]
    db.delete_fact("edge", 1, 2)
    versions.append(db.publish())
    assert len(db.snapshots._manifest(versions[-1])["tc"]["tables"]) == 1 and db.query("tc").count() == 10
    db.set_retain(1)
    db.publish()
    assert rows(db.query("tc")) == rows(db.derive("tc")) and len(db.snapshots.files.names("tables")) <= 4
    db.close()


def test_stream_of_many_batches(spark, rows, tmp_path):
    db = Database(spark)
    db.facts("edge", [(0, 1)])
    db.load_rules("two(X,Y) :- edge(X,Z), edge(Z,Y).")
    for i in range(1, 9):
        spark.createDataFrame([(i, i + 1)], "a long, b long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ingest(stream, db, "edge", str(tmp_path / "checkpoint")).awaitTermination(240)
    assert rows(db.query("two")) == [(i, i + 2) for i in range(8)]
    assert size_of(db.live("edge")) < 3000 and len(db.versions()) == 8


def test_search_as_of_a_version(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/db"
    db = Database(spark, folder)
    db.facts("observation", [("a", "red fox"), ("b", "red dog")])
    db.build_index()
    vectors = lambda n: spark.createDataFrame([(i, [float(i == j) + 0.01 * i for j in range(16)]) for i in range(n)], "e long, v array<double>")
    db.build_vectors(vectors(4), 16)
    v1 = db.publish()
    db.add_fact("observation", "c", "red cat")
    db.build_index()
    db.build_vectors(vectors(6), 16)
    v2 = db.publish()
    v3 = db.publish()
    assert db.snapshots._manifest(v2)["__postings__"] == db.snapshots._manifest(v3)["__postings__"]
    query = [float(j == 5) for j in range(16)]
    for d in (db, Database(spark, folder, read_only=True)):
        assert rows(d.search("red", version=v1)) == [("red dog", 1), ("red fox", 1)] and d.search("red").count() == 3
        assert d.search_vectors(query, 1).first()["entity"] == 5
        assert {r.entity for r in d.search_vectors(query, 9, 16, version=v1).collect()} == {0, 1, 2, 3}
    assert [r.entity for r in db.search_vectors(query, 9, 16, entities=spark.createDataFrame([(2,)], "e long")).collect()] == [2]
    db.close()


def test_recursive_deletion_does_not_copy_the_view(spark, rows, monkeypatch):
    db = Database(spark)
    db.facts("edge", [(i, i // 2) for i in range(1, 16)])
    db.load_rules(TC)
    m, seen, write = db.maintain(), [], scratch.write
    db.change("edge", [], [(2, 1), (9, 4)])
    monkeypatch.setattr(scratch, "write", lambda df, name, *more: seen.append(name) or write(df, name, *more))
    got = m.publish()["tc"]
    assert seen.count("tc") == 2 and seen.count("plus") == 1  # the rest, and what is still given of the lost; a change of the base
    assert rows(got) == rows(db.derive("tc"))


@pytest.mark.parametrize("durable", [False, True])
def test_versions_share_observations_and_index(spark, rows, tmp_path, durable):
    db = Database(spark, f"file://{tmp_path}/db" if durable else None)
    db.facts("observation", [("a", "red fox"), ("b", "red dog"), ("c", "red cow"), *((str(i), f"blue {i}") for i in range(20))])
    db.build_index()
    v1 = db.publish()
    db.add_fact("observation", "a", "red fox")
    db.add_fact("observation", "d", "red cat")
    db.build_index()
    v2 = db.publish()
    one, two = db.snapshots._manifest(v1), db.snapshots._manifest(v2)
    for n in ("observation", "__postings__", "__contents__"):
        assert two[n]["tables"][:1] == one[n]["tables"] and len(two[n]["tables"]) == 2
    assert db.query_version(v2, "observation").count() == 24 and db.query_version(v1, "observation").count() == 23
    assert rows(db.search("red", version=v1)) == [("red cow", 1), ("red dog", 1), ("red fox", 1)] and db.search("red").count() == 4 == db.search("red", version=v2).count()
    db.delete_fact("observation", "a", "red fox")
    db.build_index()
    v3 = db.publish()
    assert db.search("fox").count() == 0 == db.search("fox", version=v3).count() and db.search("fox", version=v2).count() == 1
    assert rows(db.query_version(v3, "observation").where("c1 like 'red%'")) == [("b", "red dog"), ("c", "red cow"), ("d", "red cat")]
    db.add_fact("observation", "a", "red fox")
    db.build_index()
    v4 = db.publish()
    assert db.search("fox", version=v4).count() == 1 and db.query_version(v4, "observation").count() == 24
    assert db.snapshots._manifest(db.publish())["observation"] == db.snapshots._manifest(v4)["observation"]
    db.close()


@pytest.mark.parametrize("null_safe", [False, True])
def test_a_version_has_its_observations_once(spark, rows, null_safe):
    db = Database(spark, null_safe=null_safe)
    texts = [("a", "red fox"), ("b", "red fox"), ("b", "blue fox"), *([("c", None)] if null_safe else [])]
    db.set_relation("observation", spark.createDataFrame(texts, "e string, c string"), distinct=True)
    db.build_index()
    v1 = db.publish()
    one = db.snapshots._manifest(v1)
    assert one["observation"]["tables"] == one["__contents__"]["tables"] and len(db.snapshots.files.names("tables")) == 2
    db.add_fact("observation", "d", "red owl")  # after the index was built: it has a table of its own
    v2 = db.publish()
    two = db.snapshots._manifest(v2)
    assert two["__contents__"] == one["__contents__"] and two["observation"]["tables"] != one["observation"]["tables"]
    db.delete_fact("observation", "a", "red fox")
    db.build_index()
    v3 = db.publish()
    at = lambda v: {tuple(r) for r in db.query_version(v, "observation").collect()}
    assert at(v1) == {*texts} and at(v2) == {*texts, ("d", "red owl")} and at(v3) == at(v2) - {("a", "red fox")}
    assert [db.search("red", version=v).count() for v in (v1, v2, v3)] == [1, 1, 2] and db.query_version(v3, "observation").columns == ["c0", "c1"]


def test_scratch_goes(spark):
    import os

    t = scratch.write(spark.range(3).toDF("c0"), "x")
    path = t.paths[0].removeprefix("file://")
    assert os.path.isdir(path)
    scratch.drop(spark, *t.paths)
    assert not os.path.isdir(path)
