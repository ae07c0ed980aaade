"""Edge cases of the training-data operators: hash clashes, shared ids, many languages, long texts, repeats, ties, empty tables, clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corollary.llm import common, decontaminate, exact_dedup, language_id, licenses, near_dup, packing, pii, suffix_dedup, toxicity, training_order
from corollary.llm.textops import Words
from corollary.llm.tokens import encoder

DOCS = "doc_id long, text string"


def thue_morse(bits):
    out = "a"
    for _ in range(bits):
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def fresh(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def test_words_that_a_polynomial_hash_confuses():
    """Thue-Morse words of 2,048 letters agree in every polynomial hash modulo 2**64."""
    x, y = thue_morse(11)
    w = Words(pa.array([f"{x} {y} {x}"]))
    assert w.h[0] == w.h[2] != w.h[1]
    e = encoder()
    texts = [f"{x} {y}", y, x, x[:60], y[:60], f"{x[:64]} {y[:64]}"]
    for _ in range(2):  # the second time from the table
        ids, n = e.encode(pa.array(texts))
        want = [e.model.encode(t) for t in texts]
        assert ids.tolist() == [i for t in want for i in t] and n.tolist() == list(map(len, want))


def test_ids_are_shared_by_equal_bytes_only(monkeypatch):
    """Even where every word has one hash."""
    from corollary.llm import tokens

    monkeypatch.setattr(tokens, "hash_ranges", lambda data, eight, start, end: np.zeros(len(start), np.uint64))
    e = tokens.Encoder(tokens.TOKENIZER)
    rng = random.Random(3)
    for _ in range(3):
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "a" * 70, "ab"]) for _ in range(9)) for _ in range(40)]
        ids, n = e.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in e.model.encode(t)]


def test_near_duplicates_are_rows(spark):
    """A row goes for its own text: another text under the same doc_id stays."""
    rng = random.Random(1)
    base = fresh(rng, 80).split()
    near = [*base[:40], "other", *base[41:]]
    docs = [(3, " ".join(base)), (7, " ".join(near)), (7, fresh(rng, 50)), (9, " ".join(base)), (9, " ".join(base)), (8, "...")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS d", "2 AS t", "3 AS x", "4 AS kept_doc_id")
    got = sorted(tuple(r) for r in near_dup.near_groups(df).collect())
    assert got == [(7, 3, 1), (9, 3, 1)]
    kept = near_dup.near_dedup(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([docs[0], docs[2], docs[5]])


def test_near_groups_against_all_pairs(spark):
    """Every pair of different texts at J_P well above the threshold is in one group, and every group is held by such pairs."""
    rng = random.Random(4)
    docs = []
    for g in range(12):
        base = fresh(rng, 40).split()
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(40)] = f"c{rng.randrange(9)}"
            docs.append((len(docs) // 2 if g % 4 == 0 else 100 + len(docs), " ".join(own)))
    docs += [docs[0], docs[5], (500, docs[3][1])]
    words = Words(pa.array([t for _, t in docs]))
    doc, g, w = near_dup.weighted_shingles(words)
    side = []
    for i in range(len(docs)):
        order = np.argsort(g[doc == i])
        side.append((g[doc == i][order], w[doc == i][order]))
    up = {r: r for r in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(near_dup.probability_jaccard(side[i], side[j]), docs[i], docs[j]) for i in range(len(docs)) for j in range(i)]
    for p, x, y in pairs:
        if p >= near_dup.THRESHOLD:
            up[max(find(x), find(y))] = min(find(x), find(y))
    df = spark.createDataFrame(docs, DOCS)
    rows = near_dup.grouped_rows(df, rows=1).collect()  # bands of one register: hardly a pair is missed
    texts = {}
    for d, t in docs:
        texts.setdefault(d, set()).add(t)
    hashes = {(r.doc_id, r.th): r.text for r in df.selectExpr("doc_id", "xxhash64(text) AS th", "text").collect()}
    got = {(r.doc_id, hashes[(r.doc_id, r.th)]): r.kept_doc_id for r in rows}
    groups = {}
    for x in set(docs):
        groups.setdefault(find(x), set()).add(x)
    for own in groups.values():
        least = min(d for d, _ in own)
        inside = {x for x in own if x in got}
        assert len(own) - len(inside) == 1 and all(got[x] == least for x in inside)


def boilerplate_docs(n):
    """n texts of which two in five words are one sentence, n // 10 of them with a near copy, which has the sentence too."""
    rng = random.Random(9)
    common_words = fresh(rng, 12)
    docs = [(i, f"{fresh(rng, 18)} {common_words}") for i in range(n)]
    for i in range(n // 10):
        own = docs[7 * i][1].split()
        own[3] = "other"
        docs.append((1000 + i, " ".join(own)))
    return docs


@pytest.mark.parametrize("broadcast", [0, 250_000])
def test_near_pairs_of_a_shared_sentence(spark, monkeypatch, broadcast):
    """A sentence of very many texts fills buckets, but their pairs aren't all compared; what moves doesn't depend on it, nor does the result on joins' kinds."""
    docs = boilerplate_docs(150)
    staged = {}

    def stage(df, name):
        out = common.stage(df, name)
        staged.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_dup, "stage", stage)
    got = sorted(tuple(r) for r in near_dup.near_groups(spark.createDataFrame(docs, DOCS), rows=1).collect())
    assert got == [(1000 + i, 7 * i, 1) for i in range(15)]
    assert sum(staged["pairs"]) < len(docs) * 40  # the first of each bucket with all, and few besides: all pairs are 13,530
    assert sum(staged["pairs"][1:]) < len(docs)


def test_near_rows_of_lone_bands_stay(spark, monkeypatch):
    """Rows of band keys that one text has aren't written, and all that have a partner are."""
    rng = random.Random(10)
    docs = [(i, fresh(rng, 30)) for i in range(200)]
    docs.append((500, docs[4][1] + " more"))
    staged = {}

    def stage(df, name):
        out = common.stage(df, name)
        staged.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dup, "stage", stage)
    df = spark.createDataFrame(docs, DOCS)
    assert [tuple(r) for r in near_dup.near_groups(df).collect()] == [(500, 4, 1)]
    assert staged["bands"][0] < 1000 and staged["members"][0] > 2  # of 8,040


def test_bound_of_pairs_across():
    """No pair at the threshold is held back: the first common shingle of any order comes early enough in both."""
    rng = np.random.default_rng(11)
    for n in range(600):
        size = int(rng.integers(2, 25))
        at = [np.sort(rng.choice(30, size=int(rng.integers(1, size + 1)), replace=False)) for _ in range(2)]
        if n % 3 == 0:
            at[1] = at[0]
        w = [rng.integers(1, 1 + rng.integers(1, 9), len(a)).astype(float) for a in at]
        both, ia, ib = np.intersect1d(*at, assume_unique=True, return_indices=True)
        if not len(both):
            continue
        jp = near_dup.probability_jaccard((at[0], w[0]), (at[1], w[1]))
        p, q = w[0][: ia[0]].sum() / w[0].sum(), w[1][: ib[0]].sum() / w[1].sum()
        assert 1 / (1 - p) + 1 / (1 - q) <= 1 / jp + 1 + 1e-9
        assert min(p, q) <= (1 - jp) / (1 + jp) + 1e-9 and max(p, q) <= 1 - jp + 1e-9


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_joins_by_a_sieve(spark, monkeypatch, how):
    """The same rows as a plain join, null keys and columns of its own names among them; few rows of no partner pass."""
    left = spark.range(5000).selectExpr("nullif(id % 4000, 7) AS k", "id AS key", "id AS page", "id AS words")
    other = spark.range(3500, 9000).selectExpr("id AS k", "id AS v").withColumnRenamed("v", "value")
    want = sorted(map(str, left.join(other, ["k"], how).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert sorted(map(str, common.met(left, other, ["k"], how).collect())) == want
    keyed = left.selectExpr("xxhash64(k) AS h")
    table = common.sieve(other.selectExpr("xxhash64(k) AS h"), 5500)
    assert 500 <= common.sifted(keyed, "h", table, "left_semi").count() < 1200


@pytest.mark.parametrize("most", [0, 10**6])
def test_components(spark, most):
    rng = random.Random(most)
    edges = [((rng.randrange(60), 0), (rng.randrange(60), 0)) for _ in range(40)] + [((100 + i, i), (101 + i, i + 1)) for i in range(17)] + [((0, 0), (0, 1))]
    df = spark.createDataFrame([{"a": dict(zip("dt", a, strict=True)), "b": dict(zip("dt", b, strict=True))} for a, b in edges], f"a {near_dup.TEXT}, b {near_dup.TEXT}")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in up if find(x) != x}
    assert {(tuple(r.node), tuple(r.root)) for r in near_dup.components(df, most).collect()} == want


def test_viterbi_of_many_languages():
    """More labels than a byte holds, and a block length that follows the number of cells."""
    rng = np.random.default_rng(5)
    k, pen = 200, 3.0
    s = rng.normal(0, 2, (120, k))
    label = language_id.viterbi(s, np.array([0, 50, 50, 120]), pen, 16)
    assert label.min() >= 0
    for a, b in ((0, 50), (50, 120)):
        v = s[a].copy()
        for t in range(a + 1, b):
            v = np.maximum(v, v.max() - pen) + s[t]
        own = label[a:b]
        assert abs(s[np.arange(a, b), own].sum() - pen * (np.diff(own) != 0).sum() - v.max()) < 1e-9


def test_private_spans_in_a_long_text():
    """100,000 addresses in one text, in time that follows their number."""
    import time

    text = " ".join(f"u{i}@mail{i}.example.com" for i in range(100_000))
    began = time.process_time()
    found = pii.candidates(text)
    assert sum(k == "email" for k, _, _ in found) == 100_000 and time.process_time() - began < 30
    rng = random.Random(2)
    pieces = ["a@b.example.com", "10.2.3.4", "4111 1111 1111 1111", "123-45-6780", "+1 (415) 555-0100", "token0123456789abcdefghij", "x", "2019"]
    for _ in range(300):
        t = rng.choice([" ", "", ", "]).join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        kept = []
        for kind in pii.KINDS:  # the rule as it is written: a span stands unless one of an earlier kind overlaps it
            kept += [x for x in pii.candidates(t, (kind,)) if not any(x[1] < e and s < x[2] for o, s, e in kept if o != kind)]
        assert pii.candidates(t) == sorted(kept, key=lambda x: x[1])


OPERATORS = {
    "packing": lambda df, spark: packing.pack(df),
    "decontamination": lambda df, spark: decontaminate.contaminated_spans(df, bench(spark)),
    "decontaminate": lambda df, spark: decontaminate.decontaminate(df, bench(spark)),
    "suffix_array": lambda df, spark: suffix_dedup.repeated_passages(df),
    "toxicity": lambda df, spark: toxicity.toxic_documents(df, labels(spark)),
    "reject_toxic": lambda df, spark: toxicity.reject_toxic(df, labels(spark)),
    "exact": lambda df, spark: exact_dedup.exact_copies(df),
    "licenses": lambda df, spark: licenses.scan_licenses(df),
    "training_order": lambda df, spark: training_order.materialise(df, length=64),
    "near": lambda df, spark: near_dup.near_groups(df),
    "pii": lambda df, spark: pii.find_private(df),
    "language": lambda df, spark: language_id.language_spans(df),
}


def bench(spark):
    return spark.createDataFrame([(1, "an item of the test set with more than a dozen words in it to find")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")


def hard_rows():
    rng = random.Random(8)
    long = fresh(rng, 60_000)  # 0.6 MB, above the slices that kernels take
    mail = "write to someone@mail.example.com under the MIT License. Licensed under the MIT License"
    rows = [(i, f"plain words of document {i} " + fresh(rng, 12)) for i in range(6)]
    rows += [(10, None), (11, ""), (12, "   "), (13, "..."), (14, "\u0000퟿"), (None, "no id"), (None, None), (20, long), (20, long), (21, mail), (21, mail), (22, mail), (30, "x" * 300_000), (31, "an item of the test set with more than a dozen words in it to find")]
    return rows


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(spark, name):
    """Nulls in any column, empty, very long and repeated texts, ties, and columns named as the operator names its own."""
    rows = hard_rows()
    df = spark.createDataFrame([(*r, "en" if i % 2 else None) for i, r in enumerate(rows)], f"{DOCS}, lang string")
    clash = df.selectExpr("*", "1 AS score", "2 AS start", "3 AS fp", "4 AS band", "5 AS h", "'z' AS th", "6 AS item_id", "7 AS license", "8 AS shard", "9 AS seq", "10 AS kind", "11 AS n_tokens", "12 AS window_id", "13 AS length", "cast(null AS int) AS n_chars")
    plain = sorted(map(str, OPERATORS[name](df, spark).drop("score", "check").collect()))
    got = OPERATORS[name](clash, spark)
    if name in ("decontaminate", "reject_toxic"):
        assert got.columns == clash.columns
        got = got.select(*df.columns)
    assert sorted(map(str, got.drop("score", "check").collect())) == plain
    if name == "pii":
        assert sum(r.kind == "email" for r in got.collect()) == 3  # repeated rows are reported each
    if name == "licenses":
        assert [r.doc_id for r in got.orderBy("doc_id").collect()] == [21, 21, 22]
    if name == "exact":
        assert {(r.doc_id, r.kept_doc_id, r.n_copies) for r in got.collect()} == {(20, 20, 2), (21, 21, 3), (22, 21, 3)}
    if name == "near":
        assert {(r.doc_id, r.kept_doc_id) for r in got.collect()} == {(22, 21)}
    if name == "decontamination":
        assert [r.doc_id for r in got.collect()] == [31]
    if name == "suffix_array":
        assert [tuple(r) for r in got.collect()] == [(20, 0, 60_000, 60_000)]
    if name == "packing":
        assert sum(p.length for r in got.collect() for p in r.pieces) == sum(r.n_tokens for r in got.collect()) == sum(len(encoder().model.encode(t)) for _, t in rows if t)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    df = spark.createDataFrame([], f"{DOCS}, lang string")
    assert OPERATORS[name](df, spark).count() == 0


def test_empty_side_tables(spark):
    df = spark.createDataFrame([(1, "some text")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxic_documents(df, none).count() == 0 and toxicity.reject_toxic(df, none).count() == 1
    items = bench(spark).where("false")
    assert decontaminate.contaminated_spans(df, items).count() == 0 and decontaminate.decontaminate(df, items).count() == 1


def test_ties(spark):
    """Equal documents, equal scores, equal shares: each has a defined result."""
    df = spark.createDataFrame([(5, "same"), (5, "same"), (4, "same")], DOCS).selectExpr("*", "map('a', 1) AS m")
    assert [r.doc_id for r in exact_dedup.exact_dedup(df).collect()] == [4]
    twice = "Licensed under the MIT License" + " and" * 20 + " Licensed under the MIT License"
    got = [(r.start, r.containment) for r in licenses.scan_licenses(spark.createDataFrame([(1, twice)], DOCS)).collect()]
    assert sorted(got) == [(0, 1.0), (111, 1.0)]
    lang = spark.createDataFrame([(i, "same words here", ["en", "de"][i % 2]) for i in range(8)], "doc_id long, text string, lang string")
    assert {r.lang for r in language_id.language_spans(lang).collect()} == {"de"}
    equal = packing.plan_windows({5: 2, 3: 2, 2: 2}, 10)
    assert sum(n for _, n in equal) == 2
    tox = spark.createDataFrame([(i, "same text") for i in range(20)], DOCS)
    lab = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.toxic_documents(tox, lab).count() in (0, 20)


def test_pipeline_of_nothing(spark, tmp_path):
    for t, schema in (("documents", f"{DOCS}, lang string, source string, n_chars int"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
