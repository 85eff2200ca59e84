"""Inputs of queries that no supplied table holds: rows derived from tables, and short lists of cases with what they should give."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import _pick, table

#: (input, normal form)
NAMES = [
    ("SMITH, JOHN", "John Smith"), ("Smith, John Adam", "John Adam Smith"), ("John Smith, Jr.", "John Smith"), ("madonna", "Madonna"), ("   ", ""), ("mary  jane   watson", "Mary Jane Watson"), ("DOE, JANE Q. MD", "Jane Q. Doe"),
    ("Robert Downey Jr. III", "Robert Downey"), ("Van Dyke, Dick", "Van Dyke, Dick"), ("VAN DYKE, DICK", "Dick Van Dyke"), ("o'brien, mary-jane", "Mary-jane O'brien"), ("King, PhD", "King"),
]
#: (input, first names, last name)
NAME_PARTS = [
    ("smith", "john"), ("smith john", "adam"), ("john", "smith"), ("", "madonna"), ("", ""), ("mary jane", "watson"), ("doe jane", "q"), ("robert", "downey"), ("van dyke", "dick"), ("van dyke", "dick"), ("o'brien", "mary-jane"), ("", "king"),
]
AMOUNTS = [
    ("1234", 1234.0), ("$1,234.56", 1234.56), ("$.5", 0.5), ("500K", 500000.0), ("$1.2M", 1200000.0), ("2.3 million", 2300000.0), (".5B", 500000000.0), ("1 trillion", 1e12), ("3T", 3e12), ("7 thousand", 7000.0),
    ("", None), ("  ", None), ("$", None), ("abc", None), ("-5", None), ("12,34", None), ("1,234,567", 1234567.0),
]
DATES = [
    ("2024-01-15", "2024-01-15"), ("2024-1-5", "2024-01-05"), ("01/15/2024", "2024-01-15"), ("1/5/2024", "2024-01-05"), ("January 15, 2024", "2024-01-15"), ("Jan. 15, 2024", "2024-01-15"), ("Sept 3 2023", "2023-09-03"),
    ("may 1 2020", "2020-05-01"), ("2024-13-01", None), ("2024-02-30", None), ("02/30/2024", None), ("yesterday", None), ("", None), ("Feb 29, 2024", "2024-02-29"), ("Feb 29, 2023", None),
]
STATES = [("CA", "CA"), ("california", "CA"), (" New York ", "NY"), ("dc", "DC"), ("District of Columbia", "DC"), ("XX", None), ("", None), ("texas", "TX"), ("wv", "WV"), ("PUERTO RICO", None)]
#: (input, candidate, committee)
IDS = [("H2NY05168", True, False), ("S6TX00194", True, False), ("P80003338", True, False), ("C00401224", False, True), ("h2NY05168", False, False), ("H2NY0516", False, False), ("X2NY05168", False, False), ("C0040122", False, False), ("P8A003338", True, False), ("H2N905168", False, False)]
#: (input, clean, without tags, search text)
TEXTS = [
    ("a  b\t c", "a b c", "a  b\t c", "a  b\t c"), ("x\u0001y", "xy", "x\u0001y", "x\u0001y"), ("<b>bold</b> move", "<b>bold</b> move", "bold move", "bold move"), ("1 < 2", "1 < 2", "1 ", "1"), ("a > b", "a > b", "a > b", "a > b"),
    ("  ", "", "  ", None), ("<i>", "<i>", "", None), ("!!!", "!!!", "!!!", None),
]
URLS = [("https://a.org/x?y=1", True), ("HTTP://A.ORG", True), ("ftp://a.org", False), ("not a url", False), ("https://", False), ("", False)]
#: (input, committee, case type, docket, party, member's party)
KINDS = [
    ("Super PAC", "SuperPac", "Other", "Civil", "Other", "Other"), ("Traditional PAC", "Pac", "Other", "Civil", "Other", "Other"), ("Party - Qualified", "PoliticalParty", "Other", "Civil", "Other", "Other"), ("DEM", "Other", "Other", "Civil", "Democrat", "Other"),
    ("D", "Other", "Other", "Civil", "Other", "Democrat"), ("Republican", "Other", "Other", "Civil", "Republican", "Republican"), ("scotus", "Other", "Other", "SupremeCourt", "Other", "Other"), ("ca9", "Other", "Other", "Appellate", "Other", "Other"),
    ("cacd", "Other", "Other", "Civil", "Other", "Other"), ("nysb bankruptcy", "Other", "Bankruptcy", "Bankruptcy", "Other", "Other"), ("Criminal appeal", "Other", "Criminal", "Criminal", "Other", "Other"), ("appellate", "Other", "Appellate", "Civil", "Other", "Other"),
]
MIMES = [("text/html; charset=utf-8", "html"), ("TEXT/CSV", "csv"), ("application/pdf", "pdf"), (" text/plain ", "text"), ("image/png", None), ("", None), ("text/tab-separated-values", "csv")]
PASSAGES = [
    "Sen. John Smith received $1,500 from Acme Holdings LLC on Jan. 15, 2024 under FEC-2024-123.", "The vote on H.R. 123 and S.Res. 34 was on 01/15/2024; $2.3 million and $500K were spent in Q1 2024 and FY 2024.",
    "Mary Jones met Robert Brown in New York before the Federal Reserve spoke.", "Case 24-cv-12345 against Widget Corp. named Dr. Anna Lee Moore.",
]
PAGES = [
    '<html><head><title> Budget report </title><meta name="description" content="Where it went"></head><body><h1>Totals</h1><script>var x=1;</script><p>See <a href="/a" title="t">part one</a> and <a href="/b">two</a>.</p>'
    "<table><tr><th>Name</th><th>Sum</th></tr><tr><td>Roads</td><td>10</td></tr><tr><td>Schools</td><td>20</td></tr><tr></tr></table></body></html>", "",
]
ANSWERS = [
    {"id": "a", "schema": "Person", "score": 0.91, "datasets": ["us_ofac_sdn"], "properties": {"name": ["Ann Lee"], "topics": ["role.pep"]}}, {"id": "b", "schema": "Company", "score": 0.4, "datasets": ["eu_fsf"], "properties": {"name": ["Acme"], "topics": ["role.pep"]}},
    {"id": "c", "schema": "Person", "datasets": ["wd_peps"], "properties": {}}, {"id": "d", "schema": "Person", "score": 0.2, "datasets": ["news"], "properties": {"name": ["Bo", "Beau"], "topics": ["crime"]}}, {},
]
LANDED = [
    ("candidates", "https://r/1", {"results": [{"candidate_id": "H2NY05168", "name": "DOE, JANE", "party": "DEM"}, {"candidate_id": "S6TX00194", "name": "ROE, RAY", "party": "WHIG"}, {"candidate_id": "P80003338", "name": "POE, PAT"}]}),
    ("committees", "https://r/2", {"results": [{"committee_id": "C00000001", "name": "Forward", "committee_type_full": "Super PAC (Independent)"}]}),
    ("schedule_a", "https://r/3", {"results": [{"contributor_name": "Ann", "committee_id": "C1", "committee_name": "Forward", "contribution_receipt_amount": 250.5, "contribution_receipt_date": "2024-03-01", "transaction_id": "t1"}, {"contributor_name": "Bob", "committee_id": "C1", "committee_name": "Forward", "contribution_receipt_date": "2024-03-01", "transaction_id": "t2"}]}),
    ("schedule_b", "https://r/4", {"results": [{"recipient_name": "Printer", "committee_id": "C1", "committee_name": "Forward", "disbursement_amount": 99.0, "disbursement_date": "bad", "transaction_id": "t3"}, {"recipient_name": "Printer", "committee_id": "C1", "committee_name": "Forward", "disbursement_amount": 10.0, "disbursement_date": "2024-04-02", "transaction_id": "t4"}]}),
    ("members", "https://r/5", {"members": [{"bioguideId": "M1", "name": "Lee, Ann", "partyName": "Democratic", "state": "CA"}]}),
    ("bills", "https://r/6", {"bills": [{"number": "12", "type": "HR", "title": "Roads", "introducedDate": "2023-05-01"}, {"number": "13", "type": "S", "title": "Parks", "latestAction": {"actionDate": "2023-06-01"}}, {"number": "14", "type": "S", "title": "Ponds"}]}),
    ("dockets", "https://r/7", {"results": [{"id": 77, "docket_number": "1:24", "court": "ca9", "nature_of_suit": "x", "date_filed": "2024-01-02"}, {"docket_number": "2:24", "court": "nysd", "nature_of_suit": "Criminal matter"}]}),
    ("cases", "https://r/8", {"results": [{"case_id": "K1", "court": "x", "case_type": "Civil rights", "date_filed": "2022-02-02"}]}), ("cases", "https://r/9", None),
    ("opinions", "https://r/10", {"results": [{"id": 5, "case_name": "A v. B", "court": "scotus", "absolute_url": "/opinion/5/", "date_filed": "2023-04-05"}, {"court": "nysd"}]}),
    ("committee", "https://r/committee/C1/", {"results": [{"name": "Forward", "treasurer_name": "T. Lee", "filing_frequency": "Q"}, {"name": "no"}]}), ("committee", "https://r/committee/C2/", {"results": []}), ("committee", "https://r/committee/C3/", {"results": [{}]}),
    ("bill", "https://r/bill/118/hr/21", {"bill": {"title": "Roads", "congress": 117, "type": "S", "number": "9", "introducedDate": "2023-01-02", "latestAction": {"text": "Passed"}, "policyArea": {"name": "Transport"}}}), ("bill", "https://r/bill/118/hr/22", {"bill": {}}), ("bill", "https://r/bill/118/hr/23", None),
]
SOURCE_ROWS = [("FecFiling", "F1", "filing"), ("FecFiling", None, "not_applicable"), ("NewsArticle", None, "url"), ("SanctionsList", "x", "url")]


def _inline(s: SparkSession, rows: list, schema: str) -> DataFrame:
    """Small inline rows, numbered from one below zero downwards, so that they go beside a table's ids."""
    return s.createDataFrame([(-1 - i, *r) for i, r in enumerate(rows)], "id bigint, " + schema)


def names(s):
    return _inline(s, [(x[0],) for x in NAMES], "t string")


def amounts(s):
    return _inline(s, [(x[0],) for x in AMOUNTS], "t string")


def dates(s):
    return _inline(s, [(x[0],) for x in DATES], "t string")


def states(s):
    return _inline(s, [(x[0],) for x in STATES], "t string")


def ids(s):
    return _inline(s, [(x[0],) for x in IDS], "t string")


def texts(s):
    return _inline(s, [(x[0],) for x in TEXTS], "t string")


def urls(s):
    return _inline(s, [(x[0],) for x in URLS], "t string")


def kinds(s):
    return _inline(s, [(x[0],) for x in KINDS], "t string")


def mimes(s):
    return _inline(s, [(x[0],) for x in MIMES], "t string").withColumn("id", F.col("id") - 100)


def passages(s):
    return _inline(s, [(x,) for x in PASSAGES], "t string")


def pages(s):
    return _inline(s, [("https://p/", x) for x in PAGES], "url string, html string").withColumnRenamed("id", "page_id")


def answers(s):
    return _inline(s, [(json.dumps(x),) for x in ANSWERS], "body string")


def landed(s):
    return s.createDataFrame([(a, b, "oops" if c is None else json.dumps(c)) for a, b, c in LANDED], "source string, url string, body string")


def source_rows(s):
    return _inline(s, [x[:2] for x in SOURCE_ROWS], "source_type string, filing_id string")


def records(s, d) -> DataFrame:
    """(seq, source_type, fields): parts by name and size; every seventh has no amount, every eleventh a blank one."""
    k = F.col("p_partkey")
    amount = F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("K")))
    name = F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    full, part = F.create_map(F.lit("name"), name, F.lit("amount"), amount), F.create_map(F.lit("name"), name)
    return table(s, d, "part").select(k.alias("seq"), F.lit("Filing").alias("source_type"), F.when(k % 7 == 0, part).otherwise(full).alias("fields"))


def reputation_events(s, d) -> DataFrame:
    status = _pick(F.col("event_type"), {"purchase": "approved", "error": "rejected", "signup": "disputed"}, "seen")
    return table(s, d, "events").select(F.col("user_id").alias("contributor"), F.col("event_id").alias("seq"), status.alias("status"))


def submission_events(s, d) -> DataFrame:
    action = _pick(F.col("event_type"), {"view": "claim", "purchase": "approve", "error": "reject", "click": "dispute"}, "withdraw")
    return table(s, d, "events").select((F.col("event_id") % 997).alias("submission_id"), F.col("event_id").alias("seq"), action.alias("action"))


def changes(s, d) -> DataFrame:
    kind = _pick(F.col("event_type"), {"purchase": "NewRelationship", "signup": "NewTimingCorrelation"}, "EntityUpdated")
    return table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), kind.alias("alert_type"))


def subscriptions(s, d) -> DataFrame:
    kind = _pick(F.col("c_custkey") % 4, {0: "Entity", 1: "EntityRelationship", 2: "TimingCorrelations"}, "Keyword")
    return table(s, d, "customer").select(F.col("c_custkey").alias("sub_id"), F.col("c_nationkey").alias("subscriber"), (F.col("c_custkey") % 200).alias("entity_id"), kind.alias("watch_type"), (F.col("c_acctbal") > 0).alias("active"))


def verify_results(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        k.alias("source_id"), _pick(k % 4, {0: "filing", 1: "url", 2: "sanctions"}, "not_applicable").alias("kind"), (F.col("o_orderstatus") == "O").alias("found"), (k % 3 != 0).alias("live"), (k % 2 == 0).alias("archived"),
        F.when(k % 6 != 0, (k % 130).cast("double") / 100).alias("score"), F.when(k % 17 == 0, "timeout").alias("error"),
    )


def audit_entries(s, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(
        k.alias("seq"), F.md5(F.concat(F.lit("a"), k.cast("string"))).alias("id"), F.timestamp_add("MINUTE", k.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"), F.lit("Create").alias("operation"), F.lit("Organization").alias("entity_type"),
        F.md5(F.concat(F.lit("O"), k.cast("string"))).alias("entity_id"), F.sha2("s_name", 256).alias("data_hash"),
    )


FILINGS = [{"results": [{"committee_name": "Forward", "receipt_date": "2024-05-06"}, {"committee_name": "Other"}]}, {"results": []}, None, {"results": [{"committee_name": "Back", "receipt_date": "bad"}]}]


def filings(s):
    return _inline(s, [("404" if x is None else json.dumps(x),) for x in FILINGS], "body string")


def submissions(s, d) -> DataFrame:
    status = _pick(F.col("o_orderstatus"), {"O": "Pending", "F": "Approved"}, "Rejected")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("contributor"), status.alias("status"), F.col("o_orderdate").alias("submitted_at"))
