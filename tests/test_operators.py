"""Order statistics, traversal, text and vector search against plain Python."""

import re
from pathlib import Path

import numpy as np
import pytest

from corollary.operators import fulltext, graph, orderstats, vector
from corollary.store import scratch


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in range(5) for b in range(a, 9, 2)], "c0 long, c1 long")


def test_order_statistics(spark, pairs):
    data = sorted(tuple(r) for r in pairs.collect())
    for t in (*data[:3], (2, 100), (-1, 0), (9, 9)):
        assert orderstats.rank(pairs, t).first()[0] == sum(x < t for x in data)
        assert orderstats.rank(pairs, t, perm=[1, 0]).first()[0] == sum(x[::-1] < t[::-1] for x in data)
    assert [tuple(orderstats.select(pairs, k).first()) for k in range(len(data))] == data
    assert tuple(orderstats.select(pairs, 0, leading=[3]).first()) == min(x for x in data if x[0] == 3)
    assert orderstats.range_count(pairs, (1, 2), (3, 4)).first()[0] == sum((1, 2) <= x < (3, 4) for x in data)
    for bad in (len(data), -1):
        with pytest.raises(IndexError):
            orderstats.select(pairs, bad)
    ranked = sorted((r["rank"], r[0], r[1]) for r in orderstats.with_rank(pairs, parts=3).collect())
    assert ranked == [(i, *x) for i, x in enumerate(data)]
    assert [tuple(r) for r in orderstats.iterate(pairs, seek=[2])] == [x for x in data if x >= (2,)]
    with pytest.raises(ValueError):
        orderstats.rank(pairs, (1,))


def test_select_deep(spark, monkeypatch):
    monkeypatch.setattr(orderstats, "FEW", 20)
    df = spark.range(3000).selectExpr("(id * 7919) % 3000 % 40 as c0", "(id * 7919) % 3000 as c1").distinct()
    data = sorted(tuple(r) for r in df.collect())
    for k in (0, 17, 1234, 2999):
        got = orderstats.select(df, k)
        assert tuple(got.first()) == data[k]
        limits = [int(x) for x in re.findall(r"limit=(\d+)", got._jdf.queryExecution().executedPlan().toString())]
        assert all(n <= 21 for n in limits)
    assert tuple(orderstats.select(df, 100, perm=[1, 0]).first()) == sorted(data, key=lambda x: x[::-1])[100]


def test_merge_join(spark, rows):
    left = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20), (3, 30), (3, 31)], "c0 long, c1 long")
    right = spark.createDataFrame([(1, 100), (1, 200), (2, 300), (4, 400), (4, 500)], "c0 long, c1 long")
    got = orderstats.merge_join(left, right, 1)
    assert got.count() == 7 and "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_traverse(spark, rows):
    edges = spark.createDataFrame([("A", "B", "next"), ("B", "C", "next"), ("D", "B", "next"), ("C", "E", "x"), ("E", "F", "x")], "f string, t string, k string")
    assert rows(graph.traverse(edges, "A", 2)) == [("A", 0), ("B", 1), ("C", 2), ("D", 2)]
    assert rows(graph.traverse(edges, "A", 9)) == [("A", 0), ("B", 1), ("C", 2), ("D", 2), ("E", 3)]
    assert rows(graph.traverse(edges, "A", 3, max_nodes=3)) == [("A", 0), ("B", 1), ("C", 2)]
    assert rows(graph.traverse(edges, "Z", 2)) == []
    with pytest.raises(ValueError):
        graph.traverse(edges, "A", 0)


def test_full_text(spark, rows):
    obs = spark.createDataFrame([("doc1", "The quick brown fox"), ("doc2", "The lazy dog"), ("doc3", "Quick and lazy"), ("doc4", "Quick and lazy")], "e string, c string")
    index = fulltext.postings(obs)
    assert rows(fulltext.search(index, "quick lazy")) == [("Quick and lazy", 2)] == rows(fulltext.scan_search(obs, "quick lazy"))
    assert rows(fulltext.search(index, "THE the")) == [("The lazy dog", 2), ("The quick brown fox", 2)]
    assert rows(fulltext.search(index, "absent")) == [] == rows(fulltext.search(index, ""))
    with pytest.raises(fulltext.IndexMissing):
        fulltext.search(None, "a")
    assert rows(fulltext.owners(obs, fulltext.search(index, "lazy quick"))) == [("doc3", "Quick and lazy")]
    assert len(rows(fulltext.owners(obs, fulltext.search(index, "lazy quick"), every=True))) == 2


def test_written_index_holds_each_content_once(spark, rows, tmp_path):
    texts = [" ".join(f"w{(i * 31 + j * j) % 997}" for j in range(400)) + (" red fox" if i % 3 == 0 else " red") for i in range(60)]
    obs = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, texts[0], None])], "e string, c string")
    scratch.clear(spark)
    index = fulltext.write_postings(obs)
    folder = scratch.root(spark).removeprefix("file://")
    size = sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    assert size < 3 * sum(map(len, texts))
    assert rows(fulltext.search(index, "red FOX")) == sorted((t, 2) for t in texts[::3]) == rows(fulltext.scan_search(obs, "red fox"))
    assert rows(fulltext.search(index, "absent red")) == [] == rows(fulltext.search(index, ""))
    more = fulltext.write_postings(spark.createDataFrame([("x", "a later red fox")], obs.schema), onto=index)
    assert rows(fulltext.search(more, "later fox")) == [("a later red fox", 2)] and len(rows(fulltext.search(more, "red fox"))) == 21
    assert fulltext.search(more, "red fox", top=2).count() == 2


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1] = x[0] + rng.normal(0, 0.01, 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    basis = vector.fit_basis(df, "v", 32)
    assert np.allclose(basis.matrix.T @ basis.matrix, np.eye(32), atol=1e-8)
    encoded = vector.encode(df, "id", "v", basis)
    rows = {r.entity: r for r in encoded.collect()}
    q = rows[0]
    bits = lambda r: np.array([(b >> k) & 1 for b in r.bands for k in range(16)])
    for radius in (0, 4, 8):
        want = {}
        for e, r in rows.items():
            hit = sum(bin(a ^ b).count("1") <= radius // 2 for a, b in zip(r.bands, q.bands, strict=True))
            if hit:
                want[e] = hit
        assert {r.entity: r.score for r in vector.candidates(vector.band_table(encoded), q.bands, None, radius).collect()} == want
    assert (bits(q) != bits(rows[1])).sum() <= 4
    got = [r.entity for r in vector.rerank(encoded, q.q, encoded.select("entity"), 10).collect()]
    exact = np.argsort(-(x @ x[0]) / np.linalg.norm(x, axis=1))[:10].tolist()
    assert len(set(got) & set(exact)) >= 9 and set(got[:2]) == {0, 1}
    assert vector.vector_search(encoded, q.bands, q.q, 5).first()["entity"] in (0, 1)


def _unit(seed, n, d):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_search_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", (50, 60))  # several blocks
    x = np.concatenate([_unit(5, 150, 32), np.zeros((1, 32), np.float32)])
    x[7] = x[3]
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    encoded = vector.encode(df, "id", "v", vector.fit_basis(df, "v", 32))
    some = encoded.where("entity % 2 = 0")
    for entities in (None, some):
        pairs, found, every = {}, {}, {}
        for r in vector.candidate_pairs(encoded, 8, entities).collect():
            pairs.setdefault(r.query, set()).add((r.entity, r.score))
        for got, radius in ((found, 8), (every, None)):
            for r in vector.search_rows(encoded, 5, radius, entities).collect():
                got.setdefault(r.query, set()).add((r.entity, r.dot))
        assert len(every) == 151
        pool = encoded if entities is None else some
        for r in encoded.where("entity in (0, 9, 21, 300, 450)").collect():
            near = vector.candidates(vector.band_table(pool), r.bands, None, 8)
            assert pairs.get(r.entity, set()) == {tuple(c) for c in near.collect()}
            assert found.get(r.entity, set()) == {tuple(c) for c in vector.rerank(pool, r.q, near, 5).collect()}
            assert every[r.entity] == {tuple(c) for c in vector.rerank(pool, r.q, pool.select("entity"), 5).collect()}


def test_registered_search_finds_the_nearest(spark):
    from corollary.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in data])
    asked = np.flatnonzero(ids % 20 == 0)
    truth = ids[np.argpartition(-(x[asked] @ x.T), 10, axis=1)[:, :10]]
    want = {(int(q), int(e)) for q, own in zip(ids[asked], truth, strict=True) for e in own}
    for name in ("vector_search", "int8_rerank"):
        got = QUERIES[name](spark, sf).collect()
        assert {r.query for r in got} == set(ids[asked].tolist())
        assert len({(r.query, r.entity) for r in got} & want) >= 0.9 * len(want), name


def test_search_keeps_all_candidates(spark):
    # The best match by dot product meets in one band only and so comes after many worse ones by bands matched.
    low = [(i, [0, 0], [1, 0]) for i in range(1, 30)]
    encoded = spark.createDataFrame([(0, [0, 0], [100, 100]), *low, (99, [0, 255], [90, 90])], "entity long, bands array<int>, q array<int>")
    assert [r.entity for r in vector.vector_search(encoded, [0, 0], [100, 100], 2, 0).collect()] == [0, 99]
    lexical = spark.createDataFrame([(99,), (5,)], "entity long")
    assert [r.entity for r in vector.hybrid_search(encoded, lexical, [0, 0], [100, 100], 2, 0).collect()] == [99, 5]


def test_basis_of_all_vectors(spark):
    # Few large vectors among many: a sample of 4096 misses most of them.
    x = _unit(6, 6000, 8).astype(float)
    x[::1000] *= np.arange(2, 8)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    basis = vector.fit_basis(df, "v", 8, rounds=3)
    assert np.isclose(basis.scale, 127 / np.abs(x).max())
    _, vec = np.linalg.eigh(x.T @ x)
    lead = vec[:, ::-1]
    lead = lead * np.where(np.abs(lead).max(axis=0) == lead.max(axis=0), 1, -1)
    turn, _ = np.linalg.qr(np.random.default_rng(42).normal(size=(8, 8)))
    for _ in range(3):
        u, _, w = np.linalg.svd(np.sign(x @ lead @ turn).T @ (x @ lead))
        turn = (u @ w).T
    assert np.allclose(basis.matrix, lead @ turn, atol=1e-6)
