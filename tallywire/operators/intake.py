"""What is checked before entities, submissions and documents are taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from .temporal import rate_limited

#: Fields of a submission's own kind that may not be blank; a field that ends in _url has to be one.
SUBMISSION_FIELDS = {
    "NewConnection": (), "NewEntity": ("entity_type",), "Correction": ("field", "current_value", "proposed_value"),
    "ConductComparison": ("official_action", "equivalent_private_conduct", "documented_consequence", "consequence_source_url"),
}


def creation_errors(entities: DataFrame) -> DataFrame:
    """Adds error, the first thing that keeps an entity from being created, or null.

    entities: (entity_id, entity_type, name, urls, archive_urls), the URLs as arrays, the primary source's first. An
    entity needs a source; persons and organizations a name; all source and archive URLs http(s) and a host.
    """
    none = F.array().cast("array<string>")
    urls = F.concat(F.coalesce("urls", none), F.filter(F.coalesce("archive_urls", none), lambda u: u.isNotNull()))
    blank = F.col("entity_type").isin("Person", "Organization") & (F.trim(F.coalesce("name", F.lit(""))) == "")
    bad = F.exists(urls, lambda u: ~N.url_ok(u))
    return entities.withColumn("error", F.when(F.size(F.coalesce("urls", none)) == 0, "no source").when(blank, "empty name").when(bad, "invalid URL"))


def _first_error(kind: Column, fields: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, names in reversed(SUBMISSION_FIELDS.items()):
        own = F.lit(None).cast("string")
        for n in reversed(names):
            value = F.coalesce(F.try_element_at(fields, F.lit(n)), F.lit(""))
            wrong = F.when(value == "", F.lit(f"empty {n}"))
            own = F.coalesce(wrong.when(~N.url_ok(value), F.lit(f"invalid {n}")) if n.endswith("_url") else wrong, own)
        out = F.when(kind == k, own).otherwise(out)
    return out


def checked_submissions(rows: DataFrame) -> DataFrame:
    """Submissions (seq, ts, contributor, kind, url, reference, description, ip, fields map) with their texts sanitized, and error.

    error is the first check that fails: a blank URL, reference, description or address, a URL that is none, an unknown
    kind, then the fields of its kind.
    """
    texts = ["url", "reference", "description", "ip"]
    clean = rows.withColumns({c: N.sanitized(F.coalesce(c, F.lit(""))) for c in texts})
    clean = clean.withColumn("fields", F.transform_values("fields", lambda k, v: N.sanitized(F.coalesce(v, F.lit("")))))
    error = F.when(F.lit(False), F.lit(""))
    for c in texts:
        error = error.when(F.col(c) == "", f"empty {c}")
    error = error.when(~N.url_ok(F.col("url")), "invalid url").when(~F.col("kind").isin(*SUBMISSION_FIELDS), "unknown kind").otherwise(_first_error(F.col("kind"), F.col("fields")))
    return clean.withColumn("error", error)


def submit(rows: DataFrame, per_hour: int = 10) -> DataFrame:
    """Checked submissions with status 'Pending' or null and error: one that passes its checks still has to keep to its address' limit."""
    checked = checked_submissions(rows)
    calls = checked.filter("error is null").select(F.col("ip").alias("key"), "seq", "ts")
    late = rate_limited(calls, per_hour).filter("not accepted").select("seq", F.lit("rate limited").alias("late"))
    out = checked.join(late, "seq", "left").withColumn("error", F.coalesce("error", "late")).drop("late")
    return out.withColumn("status", F.when(F.col("error").isNull(), "Pending"))


def content_summary(content: DataFrame) -> DataFrame:
    """(id, extractor, title, text_length, page_count, table_count) of extracted content (id, extractor, text, title, pages, tables).

    Delimited files have no text; only pages of HTML and PDF have titles, only PDF pages, only HTML and delimited files
    tables. text_length counts UTF-8 bytes.
    """
    kind = F.col("extractor")
    text = F.when(kind == "csv", F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    return content.select(
        "id", "extractor", F.when(kind.isin("pdf", "html"), F.col("title")).alias("title"), F.octet_length(text).cast("bigint").alias("text_length"),
        F.when(kind == "pdf", F.coalesce("pages", F.lit(0))).otherwise(0).cast("bigint").alias("page_count"), F.when(kind.isin("html", "csv"), F.coalesce("tables", F.lit(0))).otherwise(0).cast("bigint").alias("table_count"),
    )
