"""URL filters over dated lists: every capture is held against the list entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of matches of one capture the most specific kind decides; a longer domain or prefix beats a shorter one.
RANK = {"url": 1_000_000, "prefix": 900_000}


def list_intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, action, valid_from, valid_to) from dated entries (kind, value, action, listed_on).

    An entry holds from its date until the key's next entry, or for ever (valid_to null). 'remove' ends a listing and
    leaves no interval. Of a key's entries of one date the alphabetically last action holds. Entries with a null kind,
    value, action or date say nothing and are left out; repeated entries count once. A prefix may end with a slash, and
    a domain may stand between dots.
    """
    value = F.lower("value")
    value = F.when(F.lower("kind") == "prefix", F.regexp_replace(value, r"/+$", "")).when(F.lower("kind") == "domain", F.regexp_replace(value, r"^\.+|\.+$", "")).otherwise(value)
    known = entries.select(F.lower("kind").alias("kind"), value.alias("value"), F.lower("action").alias("action"), F.col("listed_on").cast("date").alias("valid_from")).dropna()
    one = known.groupBy("kind", "value", "valid_from").agg(F.max("action").alias("action"))
    after = Window.partitionBy("kind", "value").orderBy("valid_from")
    return one.withColumn("valid_to", F.lead("valid_from").over(after)).filter("action <> 'remove'").select("kind", "value", "action", "valid_from", "valid_to")


_AUTHORITY = r"^(?:[a-z][a-z0-9+.-]*:)?//"


def url_host(url: Column) -> Column:
    """The host, an address in brackets with them, without a last dot; empty without one."""
    return F.regexp_extract(F.lower(url), _AUTHORITY + r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+?)\.?(?=[/?#:]|$)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), _AUTHORITY + r"[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """The query with its question mark."""
    return F.regexp_extract(F.lower(url), _AUTHORITY + r"[^?#]*(\?[^#]*)", 1)


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", on_col: str = "fetched_on") -> DataFrame:
    """Captures with (host, n_active, decision, matched_kind, matched_value, valid_from, valid_to) added.

    entries: (kind, value, action, listed_on); kind 'domain' covers a host and all below it, 'prefix' a host alone
    or with any number of whole steps of a path, 'url' a host with its whole path, with its query or without; action is 'block', 'allow' or 'remove'. decision is that of
    the most specific active entry, or 'none'. A URL without a host, and a null URL or date, match nothing. Columns of
    captures with the names of added ones are replaced; all rows are kept, repeated ones too.

    Each distinct URL and date is evaluated once. Its keys meet the intervals in an equi-join on (kind, value), as-of
    by a range condition: a key has at most one interval at a time. Spark broadcasts the list only under its size
    bound, and otherwise splits skewed keys of the sort-merge join.
    """
    added = ["host", "n_active", "decision", "matched_kind", "matched_value", "valid_from", "valid_to"]
    left = captures.drop(*(c for c in captures.columns if c.lower() in added))
    asked = left.select(F.col(url_col).alias("_url"), F.col(on_col).cast("date").alias("_on")).filter("_url is not null and _on is not null").distinct()
    host, path = url_host(F.col("_url")), url_path(F.col("_url"))
    labels = F.split("_host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split("_path", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.concat(F.array("_host"), F.slice(steps, 1, i)), "/"))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    whole = F.array(key("url", F.concat("_host", "_path")), key("url", F.concat("_host", "_path", "_query")))
    keys = F.array_distinct(F.concat(F.transform(domains, lambda d: key("domain", d)), F.transform(prefixes, lambda d: key("prefix", d)), whole))
    parts = asked.withColumns({"_host": host, "_path": path, "_query": url_query(F.col("_url"))}).filter("_host <> ''")
    probes = parts.select("_url", "_on", F.explode(keys).alias("k")).select("_url", "_on", "k.kind", "k.value")
    spans = list_intervals(entries)
    active = probes.join(spans, ["kind", "value"]).filter("valid_from <= _on and (valid_to is null or _on < valid_to)")
    rank = F.when(F.col("kind") == "url", RANK["url"] + F.length("value")).when(F.col("kind") == "prefix", RANK["prefix"] + F.size(F.split("value", "/"))).otherwise(F.size(F.split("value", r"\.")))
    best = active.groupBy("_url", "_on").agg(F.count("*").alias("n_active"), F.max(F.struct(rank.alias("rank"), "kind", "value", "action", "valid_from", "valid_to")).alias("b"))
    found = best.select("_url", "_on", "n_active", F.col("b.action").alias("decision"), F.col("b.kind").alias("matched_kind"), F.col("b.value").alias("matched_value"), F.col("b.valid_from").alias("valid_from"), F.col("b.valid_to").alias("valid_to"))
    out = left.join(found, (F.col(url_col) == F.col("_url")) & (F.col(on_col).cast("date") == F.col("_on")), "left").drop("_url", "_on")
    return out.withColumns({"host": F.nullif(url_host(F.col(url_col)), F.lit("")), "n_active": F.coalesce("n_active", F.lit(0).cast("long")), "decision": F.coalesce("decision", F.lit("none"))})
