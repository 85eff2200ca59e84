"""Full-text search over (entity_id, entity_type, name, content, tags, date): BM25, facets, prefixes, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ENTITY_TYPES

K1, B = 1.2, 0.75
FIELDS = ("name", "content", "tags")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of under 40 bytes."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < 40))


def field_text(field: str) -> Column:
    return F.array_join("tags", " ") if field == "tags" else F.coalesce(F.col(field), F.lit(""))


def words_of(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def _count(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(word)))


def postings(docs: DataFrame, words: list[str], fields=FIELDS) -> DataFrame:
    """(entity_id, field, len, term, tf) of the query's terms only: one scan of the corpus, which is never exploded into all its words."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), tokens(field_text(f)).alias("t")) for f in fields))
    hits = F.array(*(F.struct(F.lit(w).alias("term"), _count("t", w).alias("tf")) for w in words))
    t = docs.select("entity_id", F.explode(each).alias("x")).select("entity_id", "x.field", "x.t")
    return t.select("entity_id", "field", F.size("t").alias("len"), F.explode(hits).alias("h")).select("entity_id", "field", "len", "h.term", "h.tf")


def search(docs: DataFrame, query: str, limit: int = 10, offset: int = 0, kind: str | None = None, first: str | None = None, last: str | None = None, fields=FIELDS, every: bool = True) -> DataFrame:
    """(entity_id, entity_type, name, score) of the best matches, ties by id.

    A document matches when all words (every=False: any) are in some field. The score is the sum over words and fields
    of BM25, with each field's own statistics over all documents.
    """
    words = words_of(query)
    if not words:
        return docs.limit(0).select("entity_id", "entity_type", "name", F.lit(0.0).alias("score"))
    p = postings(docs, words, fields)
    stats = F.broadcast(p.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.count("*").alias("n"), F.avg("len").alias("mean")))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hits = p.filter("tf > 0").join(stats, ["field", "term"]).groupBy("entity_id").agg(F.sum(part).alias("score"), F.count_distinct("term").alias("terms"))
    found = hits.filter(F.col("terms") == len(words)) if every else hits
    rows = docs.select("entity_id", "entity_type", "name", "date")
    if kind is not None:
        rows = rows.filter(F.col("entity_type") == kind)
    if first is not None:
        rows = rows.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.filter(F.col("date") <= F.lit(last).cast("date"))
    best = found.join(rows, "entity_id").orderBy(F.round("score", 6).desc(), "entity_id").offset(offset).limit(max(limit, 1))
    return best.select("entity_id", "entity_type", "name", "score")


def facets(docs: DataFrame, query: str, kinds=ENTITY_TYPES) -> DataFrame:
    """(entity_type, n): documents of each kind with any of the words in name or content; kinds without one are left out."""
    words = words_of(query)
    any_word = F.arrays_overlap(F.concat(tokens(field_text("name")), tokens(field_text("content"))), F.array(*map(F.lit, words)).cast("array<string>"))
    return docs.filter(any_word & F.col("entity_type").isin(*kinds)).groupBy("entity_type").agg(F.count_distinct("entity_id").alias("n"))


def prefix(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """(name) of documents with a word of the name that begins so."""
    p = text.lower()
    if not p or limit == 0:
        return docs.select("name").limit(0)
    return docs.filter(F.exists(tokens(F.col("name")), lambda t: t.startswith(p))).select("name").distinct().orderBy("name").limit(limit)


def snippet(name: Column, query: str) -> Column:
    """The name with the query's words in bold."""
    words = words_of(query)
    return F.regexp_replace(name, r"(?iU)\b(" + "|".join(words) + r")\b", "<b>$1</b>") if words else name


class Query:
    """Conditions on documents, all of which have to hold; without any, all documents match."""

    def __init__(self):
        self.parts: list[Column] = []

    def _any(self, text: str, fields) -> Query:
        words = F.array(*map(F.lit, words_of(text))).cast("array<string>")
        self.parts.append(reduce(Column.__or__, (F.arrays_overlap(tokens(field_text(f)), words) for f in fields)))
        return self

    def text(self, text: str) -> Query:
        return self._any(text, FIELDS)

    def name(self, text: str) -> Query:
        return self._any(text, ("name",))

    def tag(self, text: str) -> Query:
        return self._any(text, ("tags",))

    def kind(self, kind: str) -> Query:
        self.parts.append(F.col("entity_type") == kind)
        return self

    def entity(self, entity_id: str) -> Query:
        self.parts.append(F.col("entity_id") == entity_id)
        return self

    def dates(self, first: str | None = None, last: str | None = None) -> Query:
        if first is not None:
            self.parts.append(F.col("date") >= F.lit(first).cast("date"))
        if last is not None:
            self.parts.append(F.col("date") <= F.lit(last).cast("date"))
        return self

    def run(self, docs: DataFrame) -> DataFrame:
        return docs.filter(reduce(Column.__and__, self.parts)) if self.parts else docs


def sanitize_query(c: Column) -> Column:
    """Tags out, trimmed, at most 500 bytes; null without a letter or digit."""
    plain = F.trim(F.regexp_replace(c, "<[^>]*(>|$)", ""))
    cut = F.when(F.octet_length(plain) > 500, F.decode(F.substring(F.encode(plain, "utf-8"), 1, 500), "utf-8")).otherwise(plain)
    return F.when(F.regexp_like(cut, F.lit(r"[\p{L}\p{N}]")), cut)
