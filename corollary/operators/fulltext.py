"""Inverted index and conjunctive search."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..store import scratch


class IndexMissing(LookupError):
    pass


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, ASCII letters in lower case."""
    return F.filter(F.split(exprs.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in query))


def postings(observation: DataFrame) -> DataFrame:
    """(term, content): which contents hold a term; equal contents are one."""
    content = F.col(observation.columns[1])
    return observation.select(content.alias("content")).select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"), "content").distinct()


#: More hits than this are joined with the contents by a shuffle instead of a broadcast (they are counted).
BROADCAST = 250_000


@dataclass
class Index:
    """Written postings (term, id) and contents (id, content, by any name): each content is there once for each row that has it, not once for each of its terms."""

    postings: DataFrame
    contents: DataFrame
    paths: dict[str, list[str]] = field(default_factory=dict)

    def relations(self) -> dict[str, DataFrame]:
        return {"__postings__": self.postings, "__contents__": self.contents}


def write_postings(observation: DataFrame, folder: str | None = None, onto: Index | None = None, whole: bool = False) -> Index:
    """Contents, numbered, and their postings, sorted by term within each file, so that a search reads its terms' pages only.

    Nothing is shuffled: a file has the postings of some contents. onto: an index that these contents are added to.
    whole: the tables of contents have all rows and columns of the observations, by their names, and so are theirs too.
    """
    spark = observation.sparkSession
    text = observation.columns[1] if whole else "content"
    folder, own = folder or scratch.root(spark), uuid.uuid4().hex
    paths = {n: [*(onto.paths[n] if onto else ()), f"{folder}/{n}-{own}"] for n in ("__postings__", "__contents__")}
    read = lambda n, *at: spark.read.schema({"__postings__": "term string, id long", "__contents__": f"id long, `{text}` string"}[n]).parquet(*at)
    new = {n: at[-1] for n, at in paths.items()}
    segment = F.lit(len(paths["__postings__"]) - 1 << 54)  # ids of one job are below
    content = F.col(observation.columns[1])
    rows = observation if whole else observation.where(content.isNotNull()).select(content.alias(text))
    rows.select((F.monotonically_increasing_id() + segment).alias("id"), "*").write.parquet(new["__contents__"])
    terms = read("__contents__", new["__contents__"]).select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"), "id")
    terms.sortWithinPartitions("term", "id").write.parquet(new["__postings__"])
    return Index(read("__postings__", *paths["__postings__"]), read("__contents__", *paths["__contents__"]), paths)


def search(index: DataFrame | Index | None, query: str, top: int | None = None) -> DataFrame:
    """(content, score) of the contents that hold every term; the score is the number of query terms, repeats included."""
    if index is None:
        raise IndexMissing("there is no index; build postings first")
    terms = query_terms(query)
    wanted = sorted(set(terms))
    own = index.postings if isinstance(index, Index) else index
    hits = own.where(F.col("term").isin(wanted) if wanted else F.lit(False))
    if wanted and "bucket" in own.columns:  # a table of versions that were written with contents in postings
        at = own.sparkSession.range(1).select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(64)).cast("int") for t in wanted)).first()
        hits = hits.where(F.col("bucket").isin(sorted(set(at))))
    key = "id" if isinstance(index, Index) else "content"
    found = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(key)
    if isinstance(index, Index):
        found = F.broadcast(found) if found.limit(BROADCAST + 1).count() <= BROADCAST else found
        text = next(c for c in index.contents.columns if c != "id")
        found = index.contents.join(found, "id", "left_semi").select(F.col(text).alias("content")).distinct()
    found = found.select("content", F.lit(len(terms)).alias("score"))
    return found if top is None else found.orderBy(F.desc("score"), "content").limit(top)


def scan_search(observation: DataFrame, query: str) -> DataFrame:
    """The same result in one pass without an index: no shuffle but that of the distinct contents found."""
    terms = query_terms(query)
    content = F.col(observation.columns[1])
    wanted = F.array(*(F.lit(t) for t in sorted(set(terms)))) if terms else F.array().cast("array<string>")
    hit = (F.size(F.array_intersect(tokens(content), wanted)) == len(set(terms))) if terms else F.lit(False)
    return observation.where(hit).select(content.alias("content")).distinct().select("content", F.lit(len(terms)).alias("score"))


def owners(observation: DataFrame, found: DataFrame, every: bool = False) -> DataFrame:
    """(entity, content) of found contents: the first owner by value, or all of them."""
    entity, content = observation.columns[:2]
    own = observation.select(F.col(entity).alias("entity"), F.col(content).alias("content")).join(found.select("content"), "content", "left_semi").distinct()
    return own if every else own.groupBy("content").agg(F.min("entity").alias("entity")).select("entity", "content")
