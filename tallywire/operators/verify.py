"""Confidence in sources, and flags from cross-reference answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence(kind: Column, found: Column, live: Column, archived: Column, score: Column) -> Column:
    """Filing: 1 if found; URL: live and archived 1, live 0.85, archived 0.5; sanctions: the score within 0 and 1, 0.5 without one; else 0."""
    url = F.when(live & archived, 1.0).when(live, 0.85).when(archived, 0.5).otherwise(0.0)
    return F.when(kind == "filing", F.when(found, 1.0).otherwise(0.0)).when(kind == "url", url).when(kind == "sanctions", F.when(found, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.5))))).otherwise(0.0)).otherwise(0.0)


def level(c: Column) -> Column:
    return F.when(c >= 0.85, "High").when(c >= 0.60, "Medium").when(c >= 0.30, "Low").otherwise("Unverified")


def batch_stats(results: DataFrame) -> DataFrame:
    """(verified, failed, not_applicable, avg_confidence, success_rate) of results (kind, confidence, error)."""
    ok, na = F.col("error").isNull(), F.col("kind") == "not_applicable"
    v = F.count_if(ok & ~na & (F.col("confidence") >= 0.5)).alias("verified")
    f = F.count_if(~ok | (~na & (F.col("confidence") < 0.5))).alias("failed")
    r = results.agg(v, f, F.count_if(ok & na).alias("not_applicable"), F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"))
    return r.withColumn("success_rate", F.coalesce(F.try_divide(F.col("verified"), F.col("verified") + F.col("failed")), F.lit(0.0)))


def route(source_type: Column, filing_id: Column) -> Column:
    """How a source is verified: filings by their id, everything else by its URL."""
    return F.when((source_type == "FecFiling") & filing_id.isNotNull(), "filing").when(source_type == "FecFiling", "not_applicable").otherwise("url")


def sanction_flags(answers: DataFrame, body: str = "body") -> DataFrame:
    """Adds (is_sanctioned, is_pep, matched_name, match_score) from the first result of an answer."""
    j = F.from_json(body, "datasets array<string>, schema string, score double, properties struct<name: array<string>, topics: array<string>>")
    has = lambda xs, *ws: F.coalesce(F.exists(xs, lambda d: d.rlike("|".join(ws))), F.lit(False))
    r = answers.withColumn("_j", j)
    pep = has(F.col("_j.datasets"), "pep") | (F.coalesce(F.col("_j.schema") == "Person", F.lit(False)) & has(F.col("_j.properties.topics"), "pep"))
    return r.withColumns({"is_sanctioned": has(F.col("_j.datasets"), "sanction", "ofac", "eu_fsf"), "is_pep": pep, "matched_name": F.try_element_at("_j.properties.name", F.lit(1)), "match_score": F.col("_j.score")}).drop("_j")


def filing_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """Adds (found, filing_name, filing_date) from the first result of a register's answer; an empty or unreadable one is not found."""
    j = F.from_json(body, "results array<struct<committee_name: string, receipt_date: string>>")
    first = F.try_element_at(j.getField("results"), F.lit(1))
    return answers.withColumns({"found": first.isNotNull(), "filing_name": first.getField("committee_name"), "filing_date": F.try_to_date(first.getField("receipt_date"), "yyyy-MM-dd")})


def evidence(kind: Column, found: Column, live: Column, archived: Column) -> Column:
    """A line on what was found out about a source."""
    url = F.concat(F.when(live, "URL is live").otherwise("URL is not reachable"), F.when(archived, "; archived copy exists").otherwise("; no archived copy"))
    filing = F.when(found, "Filing found").otherwise("Filing not found")
    names = F.when(found, "Name found on a list").otherwise("Name not on any list")
    return F.when(kind == "filing", filing).when(kind == "url", url).when(kind == "sanctions", names).otherwise("Not applicable")


def source_chain(primary: DataFrame, supporting: DataFrame) -> DataFrame:
    """(entity_id, source_count, urls): one primary source and any number of supporting ones, the primary first."""
    s = supporting.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("n", "url"))).alias("s"))
    urls = F.concat(F.array("url"), F.coalesce(F.col("s.url"), F.array().cast("array<string>")))
    return primary.join(s, "entity_id", "left").select("entity_id", F.size(urls).alias("source_count"), urls.alias("urls"))


# Answers after which a URL is asked again.
TRANSIENT = (429, 500, 502, 503, 504)


def url_answers(answers: DataFrame) -> DataFrame:
    """Adds (is_live, status_code, archive_available, archive_url) to landed answers (id, tries, archive_status, archive_body).

    tries are the statuses of the requests in order, of which there are four at most: the first that is not transient
    counts, else the last. A URL is live with a status of 200 to 299; without any answer both are null. The archive's
    answer counts if it came with success and can be read.
    """
    tries = F.slice("tries", F.lit(1), F.lit(4))
    settled = F.filter(tries, lambda x: ~x.isin(*TRANSIENT))
    status = F.coalesce(F.try_element_at(settled, F.lit(1)), F.try_element_at(tries, F.lit(-1)))
    body = F.when(F.col("archive_status").between(200, 299), F.from_json("archive_body", "archived_snapshots struct<closest: struct<available: boolean, url: string>>"))
    snap = body.getField("archived_snapshots").getField("closest")
    return answers.withColumns({"is_live": status.between(200, 299), "status_code": status, "archive_available": F.coalesce(snap.getField("available"), F.lit(False)), "archive_url": snap.getField("url")})


def verified(sources: DataFrame, filings: DataFrame, urls: DataFrame) -> DataFrame:
    """(source_id, kind, confidence, level, evidence, error): a row for each source (source_id, source_type, filing_id), whatever became of the others.

    filings (source_id, found) and urls (source_id, is_live, archive_available) are the answers that landed. A source
    without an answer has an error and no confidence.
    """
    r = sources.withColumn("kind", route(F.col("source_type"), F.col("filing_id")))
    r = r.join(filings.select("source_id", "found"), "source_id", "left").join(urls.select("source_id", F.col("is_live").alias("live"), F.col("archive_available").alias("archived")), "source_id", "left")
    answered = (F.col("kind") == "not_applicable") | ((F.col("kind") == "filing") & F.col("found").isNotNull()) | ((F.col("kind") == "url") & F.col("live").isNotNull())
    c = F.when(answered, confidence(F.col("kind"), F.col("found"), F.col("live"), F.col("archived"), F.lit(None).cast("double")))
    r = r.withColumn("confidence", c).withColumn("error", F.when(~answered, "no answer"))
    return r.select("source_id", "kind", "confidence", F.when(answered, level(F.col("confidence"))).alias("level"), F.when(answered, evidence(F.col("kind"), F.col("found"), F.col("live"), F.col("archived"))).alias("evidence"), "error")
