"""Near-duplicate groups by ProbMinHash.

A document is its multiset of k-word shingles, weighted by how often each occurs. For each shingle
a Poisson process whose rate is the weight, seeded by the shingle alone, drops arrivals into M
registers; a register keeps its first arrival. Arrivals of a shingle end once they are later than
the latest register of the document, and all are made when no shingle has an earlier one. Two
documents agree in a register with the probability Jaccard similarity
J_P = sum over d of 1 / sum over d' of max(x_d' / x_d, y_d' / y_d).
ROWS registers make a band; documents that share a band are candidates, all of them, and candidates
are compared by their exact J_P. Documents of the same words (J_P = 1) are joined before banding.


What is compared and grouped are texts, not documents: a text is named by (d, t), the least doc_id that has
it and the hash of that row's text. Rows whose texts have the same words share a text and are linked by it,
however many they are. In each bucket (texts of one band) all are compared with the least one first; where
that leaves more than one group in the bucket, the pairs of texts across those groups are compared too, but
for those whose J_P is below the threshold by what `_across` says. So every candidate pair is compared, known
to be too far apart, or already joined through others, and the groups are the connected components of all
candidate pairs with J_P >= threshold; nothing is capped. Band keys are counted in quotient filters, and only
rows of repeated ones are kept (and few others, by a sieve). Buckets are counted and led by
partial aggregates, so that a hot one is no task's alone; a text with very many partners is shared out.

Defined results: null and empty texts, and texts without a word, have no shingle and stay alone; fewer
than k words are one shingle, so they match equal ones only; a row is (doc_id, text): of rows that share a
doc_id but not a text only those whose own text has a partner are in a group, and rows repeated as a whole
are one; a null doc_id can't be named in a group and is left alone; of a group the least doc_id (then the
least text hash) is kept, ties of similarity play no part; an empty table gives none; a text of any length
is compared as a whole; further columns are carried along untouched by near_dedup, and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, id_text, met, n_partitions, need, release, sieve, sifted, small, stage
from .exact_dedup import repeated_fingerprints
from .textops import U, Words, mix, ngrams, pieces

SHINGLE, REGISTERS, ROWS, THRESHOLD = 3, 160, 4, 0.5


def weighted_shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and weight of each distinct shingle of each row, by rows."""
    at, g = ngrams(words.h, words.off, k)
    doc = words.doc()[at]
    lens = np.diff(words.off)
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        own = np.zeros(len(short), U)
        for j in range(k - 1):
            has = lens[short] > j
            own[has] = mix(own[has] * U(0xC2B2AE3D27D4EB4F) + words.h[words.off[short[has]] + j])
        doc, g = np.concatenate([doc, short]), np.concatenate([g, mix(own + U(1))])
    if not len(g):
        return np.zeros(0, np.int64), g, np.zeros(0)
    key = mix(g + doc.astype(U) * U(0xA0761D6478BD642F))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(first)
    return doc[first[order]], g[first[order]], count[order].astype(np.float64)


def probminhash(doc: np.ndarray, g: np.ndarray, w: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers: the shingle whose arrival in the register was first (0 for rows without shingles)."""
    when, who = np.full(n * m, np.inf), np.zeros(n * m, U)
    at, t, made = np.arange(len(g)), np.zeros(len(g)), 0
    while len(at):
        block = int(np.clip(400_000 // len(at), 1, 64)) if made >= 2 else 1
        step = (np.arange(made, made + block, dtype=U) * U(2) + U(1)) * U(0x9E3779B97F4A7C15)
        r = mix(g[at, None] + step[None, :])
        gap = -np.log(((r >> U(12)).astype(np.float64) + 0.5) * 2.0**-52) / w[at, None]
        times = t[:, None] + np.cumsum(gap, axis=1)
        slot = doc[at, None] * m + (mix(r ^ U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
        fs, ft = slot.ravel(), times.ravel()
        np.minimum.at(when, fs, ft)
        won = np.flatnonzero(when[fs] == ft)
        who[fs[won]] = g[at[won // block]]
        made += block
        t = times[:, -1]
        go = t < when.reshape(n, m).max(axis=1)[doc[at]]
        at, t = at[go], t[go]
    return who.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted shingle sets, each (sorted shingles, weights), in n log n."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1][ia], b[1][ib]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    # d' up to d in y/x has x_d'/x_d >= y_d'/y_d, those beyond the other way round; what one lacks counts for the other.
    return float((1.0 / ((np.cumsum(x) + only_x) / x + (y.sum() - np.cumsum(y) + only_y) / y)).sum())


def signatures(docs: DataFrame, k: int = SHINGLE, m: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """(doc_id, th, s1, s2, bands): a hash of the text, a 128-bit one of the sequence of its words, and the keys of the bands."""
    bands = m // rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1))
            doc, g, w = weighted_shingles(words, k)
            n = b.num_rows
            has = np.flatnonzero(np.diff(words.off) > 0)
            if not len(has):
                continue
            who = probminhash(doc, g, w, n, m)[has].reshape(len(has), bands, rows)
            key = np.zeros((len(has), bands), U)
            for j in range(rows):
                key = mix(key * U(0xC2B2AE3D27D4EB4F) + who[:, :, j] + U(1))
            key = mix(key + np.arange(bands, dtype=U)[None, :] * U(0x2545F4914F6CDD1D))
            sums = []
            for salt in (0x9E6C63D0876A9A47, 0xE7037ED1A0B428DB):
                place = np.arange(len(words.h), dtype=U) - np.repeat(words.off[:-1], np.diff(words.off)).astype(U)
                c = np.concatenate([[U(0)], np.cumsum(mix(words.h ^ mix(place + U(salt))))])
                sums.append(mix(c[words.off[1:]] - c[words.off[:-1]] + np.diff(words.off).astype(U))[has].view(np.int64))
            yield pa.record_batch(
                [b.column(0).take(pa.array(has)), b.column(2).take(pa.array(has)), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.ravel().view(np.int64)))],
                names=["doc_id", "th", "s1", "s2", "bands"],
            )

    hashed = id_text(docs).where("doc_id is not null and text is not null and text <> ''").withColumn("th", F.xxhash64("text"))
    return hashed.mapInArrow(sketch, "doc_id long, th long, s1 long, s2 long, bands array<long>")


TEXT = "struct<d: long, t: long>"


def _text(d: str | Column, t: str | Column) -> Column:
    d, t = (F.col(c) if isinstance(c, str) else c for c in (d, t))
    return F.struct(d.alias("d"), t.alias("t"))



def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of the texts x that are wanted, without repeats. It leaves rows by (doc_id, th), so a join on these moves them no more."""
    rows = id_text(docs).where("doc_id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    keys = wanted.select(F.col("x.d").alias("doc_id"), F.col("x.t").alias("th"))
    return met(rows, keys, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of texts that have J_P >= threshold. Texts b meet their text a in one sorted stream."""
    spark = pairs.sparkSession
    pairs = stage(pairs, "pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct(), "wanted")
    texts = _texts(wanted, docs)
    # A text with very many partners is shared out over salts, so that no task has them all.
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 2000).cast("int").alias("salts"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    salted = salted.join(load, "a").withColumn("salt", (F.col("salt") % F.col("salts")).cast("int"))
    members = salted.join(texts, F.expr("b.d = doc_id and b.t = th")).select("a", "salt", "b", "text")
    leaders = load.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(texts, F.expr("a.d = doc_id and a.t = th")).select("a", "salt", F.lit(None).cast(TEXT).alias("b"), "text")
    flat = [F.col(f"{c}.{f}").alias(f"{c}{f}") for c in "ab" for f in "dt"]
    stream = leaders.unionByName(members).select(*flat[:2], "salt", *flat[2:], "text")
    stream = stream.repartition(max(n_partitions(spark), n_pairs // 50_000), "ad", "at", "salt").sortWithinPartitions("ad", "at", "salt", F.col("bd").asc_nulls_first(), "bt")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, None
        for b in pieces(batches, column="text"):
            words = Words(b.column(5))
            doc, g, w = weighted_shingles(words, k)
            order = np.lexsort((g, doc))
            doc, g, w = doc[order], g[order], w[order]
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            good: list[int] = []
            for i, (ad, at, salt, bd) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                own = (g[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]])
                if bd is None:
                    now, lead = (ad, at, salt), (own[0].copy(), own[1].copy())
                elif now == (ad, at, salt) and probability_jaccard(lead, own) >= threshold:
                    good.append(i)
            if good:
                yield b.select(["ad", "at", "bd", "bt"]).take(pa.array(good))

    out = stage(stream.mapInArrow(compare, "ad long, at long, bd long, bt long").distinct().select(_text("ad", "at").alias("a"), _text("bd", "bt").alias("b")), "verified")
    release(pairs, wanted)
    return out


#: So many edges (of four longs) are joined at the driver; beyond, by rounds of joins.
DRIVER_EDGES = 200_000


def components(edges: DataFrame, most: int = DRIVER_EDGES) -> DataFrame:
    """(node, root) of the connected components of edges (a, b) of structs; root is the least node.

    By large-star and small-star steps; a counted edge table of at most `most` rows is joined at the driver.
    """
    spark = edges.sparkSession
    edges = stage(edges.where("a <> b").distinct(), "edges")
    n = edges.count()
    if n <= most:
        return _union_find(edges)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        w = both.join(least, "a")
        if large:
            out = w.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = w.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, now = None, mark(edges)
    while now != before:
        half = stage(star(edges, True), "edges")
        done, edges = edges, stage(star(half, False), "edges")
        release(half, done)
        before, now = now, mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _union_find(edges: DataFrame) -> DataFrame:
    up: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    for a, b in edges.select("a", "b").collect():
        x, y = find(tuple(a)), find(tuple(b))
        up.setdefault(x, x)
        up.setdefault(y, y)
        if x != y:
            up[max(x, y)] = min(x, y)
    schema = f"node {TEXT}, root {TEXT}"
    return edges.sparkSession.createDataFrame(pa.table([pa.array([dict(zip("dt", v, strict=True)) for v in c], pa.struct([("d", pa.int64()), ("t", pa.int64())])) for c in ([x for x in up if find(x) != x], [find(x) for x in up if find(x) != x])], ["node", "root"]), schema)


def _buckets(rows: DataFrame, d: str, t: str) -> DataFrame:
    """(band, ld, lt): buckets of rows (band, ..) in which the pairs (d, t) differ, and one of least d. Partial aggregates of longs, no window over a hot bucket."""
    many = rows.groupBy("band").agg(F.min(d).alias("ld"), F.min_by(t, d).alias("lt"), F.max(d).alias("hd"), F.min(t).alias("least"), F.max(t).alias("most"))
    return many.where("ld <> hd or least <> most").select("band", "ld", "lt")


def _across(open_: DataFrame, docs: DataFrame, threshold: float, k: int = SHINGLE) -> DataFrame:
    """(a, b): the pairs of open texts across the groups of a bucket, whose rows (doc_id, text) are docs, without those that are below the threshold for certain.

    Let P and Q be the shares of two texts' weight in shingles of both. Then 1 / J_P >= 1 / P + 1 / Q - 1: with x and y
    normalised, the inner sum at d is at least 1 / x_d + (1 - Q) / y_d, and x y / (y + (1 - Q) x) is concave and
    homogeneous, so its sum over the common shingles is at most its value at (P, Q). In any one order of shingles, all
    before the first common one is not common: if it comes after shares p and q of the weights, P <= 1 - p and
    Q <= 1 - q. So texts at the threshold t have a common shingle with 1 / (1 - p) + 1 / (1 - q) <= 1 / t + 1, and the
    lesser of p and q is at most (1 - t) / (1 + t). Rare shingles come first, so that what fills a bucket, a
    sentence of many texts, leads to a pair only where it is most of both.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column="text"):
            doc, g, w = weighted_shingles(Words(b.column(2)), k)
            at = pa.array(doc)
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(g.view(np.int64)), pa.array(w / np.bincount(doc, w, b.num_rows)[doc])], names=["d", "t", "g", "w"])

    own = stage(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(shingles, "d long, t long, g long, w double"), "shingles")
    often = own.groupBy("g").agg(F.count(F.lit(1)).alias("texts"))
    before = F.sum("w").over(Window.partitionBy("d", "t").orderBy("texts", "g").rowsBetween(Window.unboundedPreceding, -1))
    early = own.join(often, "g").withColumn("p", F.coalesce(before, F.lit(0.0))).where((F.col("p") <= 1 - threshold + 1e-9) & (F.col("texts") > 1))
    rows = stage(open_.select("band", "x", "rd", "rt").join(early.select(_text("d", "t").alias("x"), "g", "p"), "x"), "early")
    left, right = rows.where(F.col("p") <= (1 - threshold) / (1 + threshold) + 1e-9).alias("l"), rows.alias("r")
    close = f"{threshold} * (2 - l.p - r.p) <= (1 + {threshold}) * (1 - l.p) * (1 - r.p) + 1e-9D"
    apart = F.expr(f"l.band = r.band and l.g = r.g and l.x <> r.x and (l.rd <> r.rd or l.rt <> r.rt) and {close}")
    out = stage(left.join(right, apart).select(F.least("l.x", "r.x").alias("a"), F.greatest("l.x", "r.x").alias("b")).distinct(), "across")
    release(own, rows)
    return out


def grouped_rows(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, m: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """(doc_id, th, kept_doc_id, n_links): a row for each (doc_id, text) that another one of its group stands for."""
    sig = stage(signatures(docs, k, m, rows), "signatures")
    names = sig.select("doc_id", "th", "s1", "s2")
    # Rows of the same words: by (s1, s2), counted where they are before anything moves.
    shared = names.groupBy("s1", "s2").agg(F.min(_text("doc_id", "th")).alias("least"), F.count(F.lit(1)).alias("n"))
    same = stage(shared.where("n > 1").select("s1", "s2", "least"), "same")
    own = [F.coalesce("least.d", "doc_id").alias("d"), F.coalesce("least.t", "th").alias("t")]
    n_same = same.count()
    every = met(sig, same, ["s1", "s2"], "left", n_same).where("least is null or (doc_id = least.d and th = least.t)").select(*own, F.explode("bands").alias("band"))
    # Most band keys are one text's: keys are counted first, eight bytes each, and rows move only where theirs is repeated.
    shards = 1 << max(0, (n_partitions(docs.sparkSession) - 1).bit_length())
    repeated = stage(repeated_fingerprints(every.select("band"), shards).select("fp"), "repeated")
    table = sieve(repeated, repeated.count())
    bands = stage(sifted(every, "band", table, "left_semi"), "bands")
    members = stage(bands.join(small(stage(_buckets(bands, "d", "t"), "buckets")), "band").select("band", "d", "t", "ld", "lt").distinct(), "members")
    first = members.where("d <> ld or t <> lt").select(_text("ld", "lt").alias("a"), _text("d", "t").alias("b")).distinct()
    found = verified(first, docs, threshold, k)
    comp = components(found)
    # Buckets whose members aren't all joined by now: pairs across groups are compared too (the first one was with all).
    rooted = met(members.where("d <> ld or t <> lt").withColumn("x", _text("d", "t")), comp.withColumnRenamed("node", "x"), ["x"], "left")
    rooted = rooted.select("band", "x", F.coalesce("root.d", "d").alias("rd"), F.coalesce("root.t", "t").alias("rt"))
    open_ = stage(rooted.join(small(stage(_buckets(rooted, "rd", "rt").select("band"), "buckets")), "band", "left_semi"), "open")
    wanted = stage(open_.select("x").distinct(), "wanted")
    texts = stage(_texts(wanted, docs).select("doc_id", "text"), "texts")
    across = _across(open_, texts, threshold, k)
    more = verified(across.join(first, ["a", "b"], "left_anti"), texts, threshold, k)
    links = found.unionByName(more)
    final = components(comp.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
    degree = links.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("n_links"))
    inside = final.withColumnRenamed("node", "x").join(degree, "x", "full").select("x", F.coalesce("root", "x").alias("root"), "n_links")
    row = met(names, same, ["s1", "s2"], "left", n_same).select("doc_id", "th", _text(F.coalesce("least.d", "doc_id"), F.coalesce("least.t", "th")).alias("x")).distinct()
    out = met(row, stage(inside, "inside"), ["x"], "left").select("doc_id", "th", F.coalesce("root", "x").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = stage(out.where("not (doc_id = root.d and th = root.t)").select("doc_id", "th", F.col("root.d").alias("kept_doc_id"), "n_links"), "grouped")
    release(sig, bands, members, open_, same, found, more, repeated, table[0], wanted, texts, across)
    return out


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, kept_doc_id, n_links): a row for each text of a document for which another row of its group, kept_doc_id's, stands.

    Texts of one kept_doc_id, and that document's own, are one class; documents that no row names are alone in
    theirs. n_links: how many texts of other words the row's text was compared with and found near.
    """
    return grouped_rows(docs, **options).select("doc_id", "kept_doc_id", "n_links")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group, all columns kept; rows whose text has no partner stay, whatever their doc_id."""
    need(docs, "doc_id", "text")
    one, other = fresh(docs, "gone"), fresh(docs, "hash")
    gone = grouped_rows(docs, **options).select(F.col("doc_id").alias(one), F.col("th").alias(other))
    named = docs.withColumns({one: docs["doc_id"].cast("long"), other: F.xxhash64(docs["text"].cast("string"))})
    return met(named, gone, [one, other], "left_anti").drop(one, other)
