"""Entities from landed JSON answers of public registers: (source, url, body), one page of results each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

ENTITY = "entity_type string, name string, key string, detail string, amount double, date date, url string, content_hash string"


def _rows(landed: DataFrame, source: str, results: str, schema: str) -> DataFrame:
    """The results of a source's pages, with the page's URL and the hash of its body. Pages that do not parse have none."""
    body = F.from_json("body", F.lit(f"{results} array<struct<{schema}>>"))
    return landed.filter(F.col("source") == source).select("url", F.sha2("body", 256).alias("content_hash"), F.explode(body.getField(results)).alias("r")).select("url", "content_hash", "r.*")


def _entity(df: DataFrame, kind: str, name, key, detail=None, amount=None, date=None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(kind).alias("entity_type"), name.alias("name"), key.cast("string").alias("key"), (none if detail is None else detail).cast("string").alias("detail"), (none if amount is None else amount).cast("double").alias("amount"),
        (none.cast("date") if date is None else date).alias("date"), "url", "content_hash",
    )


def _day(c: str):
    return F.try_to_date(F.col(c), "yyyy-MM-dd")


def candidates(landed: DataFrame) -> DataFrame:
    r = _rows(landed, "candidates", "results", "candidate_id: string, name: string, party: string")
    return _entity(r, "Person", F.col("name"), F.col("candidate_id"), N.lookup(F.col("party"), N.PARTIES_FILINGS, "Other"))


def committees(landed: DataFrame) -> DataFrame:
    r = _rows(landed, "committees", "results", "committee_id: string, name: string, committee_type_full: string")
    return _entity(r, "Organization", F.col("name"), F.col("committee_id"), N.committee_kind(F.col("committee_type_full")))


def receipts(landed: DataFrame) -> DataFrame:
    """Contributor, committee and payment of each receipt with an amount and a valid date."""
    r = _rows(landed, "schedule_a", "results", "contributor_name: string, committee_id: string, committee_name: string, contribution_receipt_amount: double, contribution_receipt_date: string, transaction_id: string")
    r = r.withColumn("d", _day("contribution_receipt_date")).filter("contribution_receipt_amount is not null and d is not null")
    return reduce(DataFrame.unionByName, (
        _entity(r, "Person", F.col("contributor_name"), F.col("transaction_id")), _entity(r, "Organization", F.col("committee_name"), F.col("committee_id")),
        _entity(r, "Payment", F.concat_ws(" to ", "contributor_name", "committee_name"), F.col("transaction_id"), F.lit("IndividualContribution"), F.col("contribution_receipt_amount"), F.col("d")),
    ))


def disbursements(landed: DataFrame) -> DataFrame:
    """Committee, recipient and payment of each disbursement with an amount and a valid date."""
    r = _rows(landed, "schedule_b", "results", "recipient_name: string, committee_id: string, committee_name: string, disbursement_amount: double, disbursement_date: string, transaction_id: string")
    r = r.withColumn("d", _day("disbursement_date")).filter("disbursement_amount is not null and d is not null")
    return reduce(DataFrame.unionByName, (
        _entity(r, "Organization", F.col("committee_name"), F.col("committee_id")), _entity(r, "Organization", F.col("recipient_name"), F.col("transaction_id")),
        _entity(r, "Payment", F.concat_ws(" to ", "committee_name", "recipient_name"), F.col("transaction_id"), F.lit("PacContribution"), F.col("disbursement_amount"), F.col("d")),
    ))


def members(landed: DataFrame) -> DataFrame:
    r = _rows(landed, "members", "members", "bioguideId: string, name: string, partyName: string, state: string")
    return _entity(r, "Person", F.col("name"), F.col("bioguideId"), N.lookup(F.col("partyName"), N.PARTIES_MEMBERS, "Other"))


def bills(landed: DataFrame) -> DataFrame:
    """A decision for each bill: dated by its introduction, else its latest action, else the first day of 2024."""
    r = _rows(landed, "bills", "bills", "number: string, type: string, title: string, introducedDate: string, latestAction: struct<actionDate: string>")
    when = F.coalesce(_day("introducedDate"), F.try_to_date("latestAction.actionDate", "yyyy-MM-dd"), F.lit("2024-01-01").cast("date"))
    return _entity(r, "PolicyDecision", F.col("title"), F.concat("type", "number"), date=when)


def dockets(landed: DataFrame) -> DataFrame:
    r = _rows(landed, "dockets", "results", "id: bigint, docket_number: string, court: string, nature_of_suit: string, date_filed: string")
    key = F.coalesce(F.col("id").cast("string"), "docket_number")
    return _entity(r, "CourtCase", key, key, N.docket_kind(F.col("nature_of_suit"), F.col("court")), date=_day("date_filed"))


def opinions(landed: DataFrame, site: str = "https://www.courtlistener.com") -> DataFrame:
    """A case for each opinion, its own address as URL where it has one, of the kind that its court says."""
    r = _rows(landed, "opinions", "results", "id: bigint, case_name: string, court: string, absolute_url: string, date_filed: string")
    key = F.coalesce(F.concat(F.lit("opinion-"), F.col("id").cast("string")), F.lit("unknown"))
    own = r.withColumn("url", F.coalesce(F.concat(F.lit(site), "absolute_url"), "url"))
    return _entity(own, "CourtCase", key, key, N.docket_kind(F.lit(None).cast("string"), F.col("court")), date=_day("date_filed"))


def committee_details(landed: DataFrame) -> DataFrame:
    """(url, name, treasurer_name, filing_frequency) of the first result of each answer; an answer without one has no row."""
    body = F.from_json("body", "results array<struct<name: string, treasurer_name: string, filing_frequency: string>>")
    r = landed.filter("source = 'committee'").select("url", F.try_element_at(body.getField("results"), F.lit(1)).alias("r")).filter("r is not null")
    return r.select("url", F.coalesce("r.name", F.lit("")).alias("name"), "r.treasurer_name", "r.filing_frequency")


def bill_details(landed: DataFrame) -> DataFrame:
    """(url, title, congress, bill_type, bill_number, introduced_date, latest_action, policy_area); what an answer does not say of its number comes from its address."""
    body = F.from_json("body", "bill struct<title: string, congress: int, type: string, number: string, introducedDate: string, latestAction: struct<text: string>, policyArea: struct<name: string>>")
    r = landed.filter("source = 'bill'").select("url", body.getField("bill").alias("r")).filter("r is not null")
    asked = lambda k: F.nullif(F.regexp_extract("url", r"/bill/([0-9]+)/([^/?]+)/([0-9]+)", k), F.lit(""))
    return r.select(
        "url", F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.congress", asked(1).cast("int")).alias("congress"), F.coalesce("r.type", asked(2)).alias("bill_type"), F.coalesce("r.number", asked(3)).alias("bill_number"),
        _day("r.introducedDate").alias("introduced_date"), F.col("r.latestAction.text").alias("latest_action"), F.col("r.policyArea.name").alias("policy_area"),
    )


def cases(landed: DataFrame) -> DataFrame:
    r = _rows(landed, "cases", "results", "case_id: string, court: string, case_type: string, date_filed: string")
    return _entity(r, "CourtCase", F.col("case_id"), F.col("case_id"), N.case_kind(F.col("case_type")), date=_day("date_filed"))


SOURCES = (candidates, committees, receipts, disbursements, members, bills, dockets, opinions, cases)


def run_all(landed: DataFrame, sources=SOURCES) -> DataFrame:
    """All sources' entities; a body that one cannot read yields nothing and stops no other."""
    return reduce(DataFrame.unionByName, (s(landed) for s in sources))
