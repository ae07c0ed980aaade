"""The training-data operators against brute force on small tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corollary.llm import decontaminate, exact_dedup, language_id, licenses, near_dup, packing, pii, suffix_dedup, toxicity, training_order
from corollary.llm.textops import Words
from corollary.llm.tokens import encoder

DOCS = "doc_id long, text string"


def words_of(text):
    w = Words(pa.array([text]))
    return w.h[w.off[0] : w.off[1]].tolist()


# 1 Packing


@pytest.mark.parametrize("seed", range(4))
def test_best_fill(seed):
    rng = random.Random(seed)
    for _ in range(60):
        counts = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(rng.randint(0, 4))}
        room = rng.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        used = packing.best_fill(counts, room)
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert all(0 < n <= counts[k] for k, n in used.items())


def test_packing_uses_everything_once(spark):
    rng = random.Random(7)
    lengths = [(i // 2, rng.choice([0, 1, 3, 7, 10, 25, 33])) for i in range(300)] + [(None, 5)]
    out = packing.pack_lengths(spark.createDataFrame(lengths, "doc_id long, n_tokens int"), 10).collect()
    assert all(r.n_tokens == sum(p.length for p in r.pieces) <= 10 for r in out)
    placed = Counter()
    for r in out:
        for p in r.pieces:
            placed[(p.doc_id, p.start, p.length)] += 1
    want = Counter()
    for d, n in lengths:
        for s in range(0, n, 10):
            want[(d, s, min(10, n - s))] += 1
    assert placed == want
    assert sorted(r.window_id for r in out) == list(range(len(out)))
    assert len(out) <= -(-sum(n for _, n in lengths) // 10) + 3  # close to the least number of windows


# 2 Decontamination


@pytest.mark.parametrize("seed", range(6))
def test_suffix_automaton(seed):
    rng = random.Random(seed)
    items = [(i, [rng.randrange(3) for _ in range(rng.randint(1, 14))]) for i in range(5)]
    sa = decontaminate.SuffixAutomaton(items)
    min_words, coverage, floor = 6, 0.6, 3
    sa.limits(min_words, coverage, floor)
    text = [rng.randrange(4) for _ in range(60)]
    covered = set()
    for a, e, *_ in sa.stretches(text):
        covered |= set(range(a, e))
    want = set()
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            s = text[i:j]
            holders = [len(w) for _, w in items if any(w[k : k + len(s)] == s for k in range(len(w)))]
            if holders and (len(s) >= min_words or len(s) >= min(floor, *holders) and len(s) >= coverage * min(holders) - 1e-9):
                want |= set(range(i, j))
    assert covered == want


def test_decontamination_cuts_spans(spark):
    item = " ".join(f"Word{i}" for i in range(20))
    docs = [(1, f"Before. {item.lower()}, after"), (2, "clean text of no interest"), (3, item), (4, None), (5, ""), (6, " ".join(f"word{i}" for i in range(5)))]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "length(text) AS n_chars", "'x' AS score")
    bench = spark.createDataFrame([(9, item), (10, item), (11, None), (12, "")], "item_id long, text string")
    spans = {(r.doc_id, r.item_id, docs[r.doc_id - 1][1][r.start : r.end].lower()) for r in decontaminate.contaminated_spans(df, bench).collect()}
    assert spans == {(1, 9, item.lower()), (3, 9, item.lower())}
    left = {r.doc_id: (r.text, r.n_chars, r.score) for r in decontaminate.decontaminate(df, bench).collect()}
    assert left[1] == ("Before. , after", 15, "x") and 3 not in left and set(left) == {1, 2, 4, 5, 6}
    assert decontaminate.contaminated_spans(df, bench.where("false")).count() == 0
    assert decontaminate.decontaminate(df.where("false"), bench).count() == 0


def test_decontamination_of_changed_and_short_items(spark):
    """One word in twelve changed: no stretch has 13 words, all together cover the item. Items of under 8 words count whole."""
    item = [f"w{i}" for i in range(36)]
    changed = [f"new{i}" if i % 12 == 11 else w for i, w in enumerate(item)]
    far = [*item[:11], *(f"x{i}" for i in range(80)), *item[12:23], *(f"y{i}" for i in range(80)), *item[24:35]]
    docs = [(1, "start " + " ".join(changed) + " end"), (2, " ".join(far)), (3, "is red hot iron soft here"), (4, "is red hot"), (5, "yes or no")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "red hot iron soft"), (9, "yes or")], "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    got = {(r.doc_id, r.item_id, docs[r.doc_id - 1][1][r.start : r.end]) for r in decontaminate.contaminated_spans(df, bench).collect()}
    assert got == {(1, 7, " ".join(changed[:35])), (3, 8, "red hot iron soft")}
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench).collect()}
    assert left[1] == f"start  {changed[35]} end" and left[3] == "is  here" and all(left[i] == docs[i - 1][1] for i in (2, 4, 5))


# 3 Suffix arrays


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, *(rng.randint(4, 60) for _ in range(150))]:
        s = [rng.randint(1, letters) for _ in range(n)] + [0]
        sa = suffix_dedup.suffix_array(s)
        assert sa == sorted(range(n + 1), key=lambda i: s[i:])
        lcp = suffix_dedup.lcp_array(s, sa)
        for r in range(1, len(sa)):
            a, b = s[sa[r - 1] :], s[sa[r] :]
            assert lcp[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute_passages(docs, k):
    toks = [(d, words_of(t)) for d, t in docs if t]
    count = Counter(tuple(w[i : i + k]) for _, w in toks for i in range(len(w) - k + 1))
    out = set()
    for d, w in toks:
        merged = []
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = i + k
                else:
                    merged.append([i, i + k])
        out |= {(d, a, b, b - a) for a, b in merged}
    return out


@pytest.mark.parametrize(("k", "q"), [(5, 2), (6, 3), (4, 4), (5, 1)])
def test_repeated_passages(spark, k, q):
    rng = random.Random(k * 10 + q)
    docs = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.randint(0, 50)))) for i in range(30)]
    docs += [(100, docs[3][1]), (101, docs[4][1] + " x " + docs[5][1]), (102, None), (103, "a " * 200)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS h", "'y' AS whole")
    docs.append(docs[4])  # a repeated row is a copy of itself, reported once
    df = df.union(df.where("doc_id = 4"))
    for hot in (suffix_dedup.HOT, 3):  # groups of more than 3 surroundings are counted instead
        got = [tuple(r) for r in suffix_dedup.repeated_passages(df, k, q, hot).collect()]
        assert set(got) == brute_passages(docs, k) and len(got) == len(set(got))
    assert suffix_dedup.repeated_passages(df.where("false"), k, q).count() == 0


def test_passage_between_clean_documents(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(55)
    docs = [(i, f"{fresh(30)} {passage if i < 5 else ''} {fresh(40)}") for i in range(12)]
    got = {tuple(r) for r in suffix_dedup.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(i, 30, 85, 55) for i in range(5)}


# 5 Exact dedup


def test_counting_quotient_filter():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        fp = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        fp = np.concatenate([fp, fp[: n // 3], fp[: n // 5], np.arange(n // 4, dtype=np.uint64)])
        want = Counter(fp.tolist())
        parts = [exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.build(p).to_bytes()) for p in np.array_split(fp, 3)]
        merged = exact_dedup.CountingQuotientFilter.merge(parts)
        keys, counts = merged.items()
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
        for x in [*list(want)[:20], 12345678901]:
            assert merged.get(x) == want.get(x, 0)


def test_exact_dedup(spark):
    docs = [(5, "a"), (2, "a"), (2, "a"), (None, "a"), (1, "b"), (3, ""), (4, ""), (6, None), (7, None)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "doc_id AS fp", "map('k', doc_id) AS row")
    copies = sorted(((r.doc_id is None, r.doc_id or 0, r.kept_doc_id, r.n_copies) for r in exact_dedup.exact_copies(df).collect()))
    assert copies == [(False, 2, 2, 4), (False, 4, 3, 2), (False, 5, 2, 4), (True, 0, 2, 4)]
    kept = sorted((r.doc_id, r.text) for r in exact_dedup.exact_dedup(df).collect() if r.text is not None)
    assert kept == [(1, "b"), (2, "a"), (3, "")]
    assert exact_dedup.exact_dedup(df).count() == 5 and exact_dedup.exact_dedup(df).columns == df.columns
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0 == exact_dedup.exact_copies(df.where("false")).count()


# 6 Licenses


def test_licenses(spark):
    apache = licenses.TEMPLATES[4][1]
    mit = licenses.TEMPLATES[2][1].split()
    docs = [
        (1, "Some text here. Released under the MIT License. More."),
        (2, "filler " * 50 + apache + " filler" * 50),
        (3, " ".join(mit[: int(len(mit) * 0.95)])),
        (4, "the license of this text is unknown and free"),
        (5, None), (6, ""), (7, "two words"), (None, "LICENSED under the apache license,   version 2.0"),
        (8, " ".join(mit[: len(mit) // 2])),
    ]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS license")
    got = {(r.doc_id, r.license, r.template): r for r in licenses.scan_licenses(df).collect()}
    assert set(got) == {(1, "MIT", 0), (2, "Apache-2.0", 4), (3, "MIT", 2), (None, "Apache-2.0", 3)}
    r = got[(1, "MIT", 0)]
    assert docs[0][1][r.start : r.end] == "Released under the MIT License" and r.containment == 1
    with pytest.raises(ValueError):
        licenses.scan_licenses(df, (("X", "too short"),))
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_license_recall():
    """Bands find nearly every place that exact containment finds."""
    rng = random.Random(4)
    classes, _ = licenses.compile_templates()
    found = total = 0
    for c in classes:
        for i, own in c.own:
            for _ in range(20):
                # A window that holds just the share asked for, the rest being foreign.
                n = int(np.ceil(licenses.CONTAINMENT * len(own)))
                g = np.array([*rng.sample(own.tolist(), n), *(rng.getrandbits(63) for _ in range(c.width - n))], np.uint64)
                total += 1
                t = [x for x, _ in c.own].index(i)
                found += bool((c.sketch(g[None, :])[0] == c.keys[t]).any())
    assert found / total > 0.99


# 7 Training order


def test_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        p = training_order.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        assert (training_order.permute(p, n, 7, inverse=True) == np.arange(n)).all()
    assert (training_order.permute(np.arange(1000), 1000, 7) != training_order.permute(np.arange(1000), 1000, 8)).any()


def test_round_trip(spark, tmp_path):
    texts = [f"word{i} " * (i % 37) + "tail é\n" for i in range(150)] + [None, "", "two  spaces", "x " * 3000]
    df = spark.createDataFrame([(i % 140, t) for i, t in enumerate(texts)], DOCS).selectExpr("*", "1 AS shard").repartition(5)
    out = sorted(training_order.materialise(df, f"file://{tmp_path}/s", 64, 20).collect(), key=lambda r: r.seq)
    assert [r.seq for r in out] == list(range(len(out))) == sorted(r.slot for r in out)
    assert all(r.offset == r.slot % 20 * 128 and r.shard == r.slot // 20 for r in out)
    ids = np.concatenate([training_order.read_sequences(f"file://{tmp_path}/s/shard-{r.shard:08d}.bin", r.slot % 20, 1, 64)[0] for r in out])
    got, now = [], []
    for i in ids.tolist():
        if i == training_order.END:
            got.append(now)
            now = []
        else:
            now.append(i)
    assert sorted(x for x in got if x) == sorted(encoder().model.encode(t) for t in texts if t)
    assert training_order.materialise(df.where("false")).count() == 0


def test_tokens_equal_those_of_the_whole_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab \n.éß中ﬁ½　\t🙂 İ▁'") for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    e = encoder()
    ids, n = e.encode(pa.array(texts), 2)
    want = [e.model.encode(t) if t else [] for t in texts]
    assert n.tolist() == [len(w) + 1 for w in want] and ids.tolist() == [i for w in want for i in [*w, 2]]
    assert e.count(pa.array(texts)).tolist() == [len(w) for w in want]


# 8 Near duplicates


def brute_jp(a, b):
    ca, cb = Counter(a), Counter(b)
    out = 0.0
    for d in set(ca) & set(cb):
        out += 1 / sum(max(ca[e] / ca[d], cb[e] / cb[d]) for e in set(ca) | set(cb))
    return out


def test_probability_jaccard():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randrange(8) for _ in range(rng.randint(1, 20))] for _ in "ab")
        side = lambda x: tuple(np.array(v) for v in zip(*sorted(Counter(x).items()), strict=True))
        sa, sb = ((k.astype(np.uint64), w.astype(float)) for k, w in (side(a), side(b)))
        assert abs(near_dup.probability_jaccard(sa, sb) - brute_jp(a, b)) < 1e-9


def test_registers_estimate_it():
    a = "the cat sat on the mat and the cat sat on the hat " * 2 + "and so it goes on"
    b = a.replace("hat", "bat", 1)
    doc, g, w = near_dup.weighted_shingles(Words(pa.array([a, b])))
    sides = [g[doc == i].tolist() for i in (0, 1)]
    bags = [[x for x, n in zip(s, w[doc == i], strict=True) for _ in range(int(n))] for i, s in enumerate(sides)]
    who = near_dup.probminhash(doc, g, w, 2, 4096)
    assert abs((who[0] == who[1]).mean() - brute_jp(*bags)) < 0.04


def test_near_duplicates(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, group = [], {}
    for g in range(30):
        base = fresh(60)
        for _ in range(3 if g < 20 else 1):
            own = list(base)
            own[rng.randrange(60)] = "changed"
            group[len(docs)] = g
            docs.append((len(docs), " ".join(own)))
    docs += [(900, None), (901, ""), (None, docs[0][1]), (902, "short"), (903, "short"), (904, "...")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS a", "2 AS band", "3 AS __gone")
    found = {(r.doc_id, r.kept_doc_id) for r in near_dup.near_groups(df).collect()}
    want = {(d, min(x for x in group if group[x] == g)) for d, g in group.items()} - {(d, d) for d in group} | {(903, 902)}
    assert found <= want and len(found) >= 0.9 * len(want)
    kept = near_dup.near_dedup(df)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(found)
    assert near_dup.near_groups(df.where("false")).count() == 0


# 4 Toxicity


def test_toxicity_learns_pairs(spark):
    """An insult, or a group, alone is harmless; both together are not: only an interaction tells."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(1600):
        w = [f"n{rng.randrange(60)}" for _ in range(6)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["vermin"] * insult + ["martians"] * group
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    df = spark.createDataFrame([*docs, (9000, None), (9001, ""), (None, "x")], DOCS).selectExpr("*", "1 AS score")
    lab = spark.createDataFrame([*labels, (9000, None), (7777, 1)], "doc_id long, toxic int")
    got = {r.doc_id for r in toxicity.toxic_documents(df, lab).collect()}
    truth = {d for d, t in labels if t}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(docs)
    kept = toxicity.reject_toxic(df, lab)
    assert kept.columns == df.columns and kept.count() == len(docs) + 3 - len(got)
    assert toxicity.reject_toxic(df, lab.where("toxic = 0")).count() == df.count()
    assert toxicity.toxic_documents(df.where("false"), lab).count() == 0


# 9 Personal data


def test_em_finds_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.6
    good = [0.9, 0.8, 0.7]
    vote = np.stack([np.where(rng.random(20000) < a, truth, ~truth) * 2 - 1 for a in good], axis=1)
    patterns, count = np.unique(vote, axis=0, return_counts=True)
    p, rel, share = pii.aggregate_votes(patterns, count.astype(float))
    assert abs(share - 0.6) < 0.05
    for j, a in enumerate(good):
        assert abs(rel[j, 1, 2] - a) < 0.05 and abs(rel[j, 0, 0] - a) < 0.05
    assert p[(patterns == 1).all(axis=1)][0] > 0.95 > 0.05 > p[(patterns == -1).all(axis=1)][0]


def test_private_spans(spark):
    docs = []
    for i in range(40):
        docs += [
            (5 * i, f"write to user{i}.name@mail{i}.example.com for more"),
            (5 * i + 1, f"call +1 (4{i:02d}) 555-01{i:02d} or come by"),
            (5 * i + 2, f"the host 81.{i}.7.{200 + i} is down"),
            (5 * i + 3, f'token = "{i:02x}eb9c654e721b4f812088970e66a6345cee33{i:02x}"'),
            (5 * i + 4, f"version 1.2.3 of page {i}, in 2019-2020, with {1000 + i} units and 3.14"),
        ]
    docs += [(900, None), (901, ""), (None, "a@b.example.com")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS kind", "1 AS score")
    text = dict(docs)
    got = [(r.doc_id, r.kind, text[r.doc_id][r.start : r.end]) for r in pii.find_private(df).collect()]
    by = {k: {d for d, kind, _ in got if kind == k} for k in pii.KINDS}
    for j, k in enumerate(("email", "phone", "ip", "secret")):
        assert {5 * i + j for i in range(40)} <= by[k], k
    assert not any(d is not None and d < 200 and d % 5 == 4 for d, _, _ in got)
    assert (0, "email", "user0.name@mail0.example.com") in got and (1, "phone", "+1 (400) 555-0100") in got
    assert pii.find_private(df.where("false")).count() == 0


def test_secrets_of_any_length(spark):
    rng = random.Random(4)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = {256: pick("0123456789abcdef", 256), 1600: "sk" + pick(b64, 1598), 201: pick("0123456789abcdef", 201), 120: pick("abcdefghijk", 80) + pick("0123456789", 40)}
    for n, key in keys.items():
        assert ("secret", 6, 6 + n) in pii.candidates(f"token {key} end"), n
    docs = [(i, f"token = {pick('0123456789abcdef', 40)} end") for i in range(40)] + [(n, f"token = {key} end") for n, key in keys.items() if n in (256, 1600)]
    got = {(r.doc_id, r.start, r.end) for r in pii.find_private(spark.createDataFrame(docs, DOCS)).collect() if r.kind == "secret"}
    assert {(256, 8, 264), (1600, 8, 1608)} <= got
    assert pii.candidates("x" * 3_000_000, ("secret",)) == []  # in linear time


# 10 Language


def test_languages_that_share_a_script(spark):
    rng = random.Random(5)
    vocab = {
        "en": "the and with house water there think".split(),
        "ru": "привет мир как дела сегодня этот был чтобы рыба".split(),
        "uk": "привіт світ як справи сьогодні цей був щоб їжа".split(),
        "ar": "في من على هذا كان التي الى".split(),
        "fa": "در از به این است که برای گفت".split(),
        "hi": "है और में यह नहीं था लिए".split(),
        "mr": "आहे आणि मध्ये हे नाही होता साठी".split(),
    }
    say = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(list(vocab) * 8)]
    text = {100: f"{say('en', 12)} {say('uk', 15)} {say('ru', 15)}", 101: "東京は大きい。京都は古い。日本語を話す。", 102: "我们今天去北京。天气很好。", 103: "Apple製品 ok", 104: "covid19 корп2 abcпривет"}
    df = spark.createDataFrame(rows + [(d, t, None) for d, t in text.items()], "doc_id long, text string, lang string")
    out = language_id.language_spans(df).collect()
    held = [r for r in out if r.doc_id < 100]
    assert sum(r.n_words for r in held if r.lang == rows[r.doc_id][2]) >= 0.98 * sum(r.n_words for r in held)
    got = {d: sorted((r.start, r.end, r.lang, r.n_words) for r in out if r.doc_id == d) for d in text}
    assert [(x[2], x[3]) for x in got[100]] == [("en", 12), ("uk", 15), ("ru", 15)]
    assert [(x[2], x[3]) for x in got[101]] == [("ja", 3)] and [x[2] for x in got[102]] == ["zh"]
    assert sum(x[3] for x in got[103]) == 3 and sum(x[3] for x in got[104]) == 4



def test_viterbi():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lens = rng.integers(0, 90, 5)
        off, k, pen = np.append(0, np.cumsum(lens)), int(rng.integers(1, 5)), 3.0
        s = rng.normal(0, 2, (off[-1], k))
        label = language_id.viterbi(s, off, pen, 8)
        for a, b in zip(off[:-1], off[1:], strict=True):
            if b > a:
                v = s[a].copy()
                for t in range(a + 1, b):
                    v = np.maximum(v, v.max() - pen) + s[t]
                own = label[a:b]
                assert abs(s[np.arange(a, b), own].sum() - pen * (np.diff(own) != 0).sum() - v.max()) < 1e-9


def test_language_spans(spark):
    rng = random.Random(2)
    vocab = {"en": "the and with house water there think where light night".split(), "de": "der und nicht schon zwischen haus wasser früh straße licht".split(), "fr": "le et avec maison eau été où là lumière même".split()}
    say = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    mixed = f"{say('en', 20)} {say('de', 20)} привет мир как дела сегодня {say('fr', 20)}"
    rows += [(100, mixed, None), (101, None, "en"), (102, "", "de"), (103, "... !", None), (None, say("fr", 9), "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS start")
    out = language_id.language_spans(df).collect()
    spans = sorted((r.start, r.end, r.lang, r.n_words) for r in out if r.doc_id == 100)
    assert [(x[2], x[3]) for x in spans] == [("en", 20), ("de", 20), ("ru", 5), ("fr", 20)]
    assert mixed[spans[2][0] : spans[2][1]] == "привет мир как дела сегодня"
    assert {(r.doc_id, r.start, r.end, r.lang) for r in out if r.doc_id in (101, 102, 103)} == {(d, 0, 0, "und") for d in (101, 102, 103)}
    held = [r for r in out if r.doc_id is not None and r.doc_id < 60]
    assert sum(r.n_words for r in held if r.lang == rows[r.doc_id][2]) >= 0.98 * sum(r.n_words for r in held)
    assert {r.lang for r in language_id.language_spans(df.withColumn("lang", df.lang.substr(9, 9)).where("doc_id < 60")).collect()} == {"und"}
    assert language_id.language_spans(df.where("false")).count() == 0
