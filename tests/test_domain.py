import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tallywire import model
from tallywire.functions import names, ner
from tallywire.operators import audit, crowd, dedup, index, ingest, intake, repo, search, temporal, verify
from tallywire.plans import fixtures as X
from tallywire.plans.oracles import ORACLES
from tallywire.plans.queries import QUERIES
from tallywire.sources import delimited, html


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.9444), ("DIXON", "DICKSONX", 0.7667), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0)])
def test_jaro(a, b, want):
    assert names.jaro(a, b) == pytest.approx(want, abs=1e-4)


def test_jaro_winkler_has_no_threshold():
    assert names.jaro_winkler("abcd", "axyz") == pytest.approx(0.55)


def people(spark, *rows):
    return spark.createDataFrame([(i, n, None if b is None else dt.date.fromisoformat(b)) for i, (n, b) in enumerate(rows)], "id bigint, name string, birth_date date")


def test_person_matches(spark):
    def match(a, b, da=None, db=None):
        return dedup.person_matches(people(spark, (a, da)), people(spark, (b, db))).collect()

    assert len(match("John Smith", "John Smith Jr.")) == 1
    assert len(match("Jhon Smith", "John Smith")) == 1
    assert match("Zara Thornton", "Bob Smith") == []
    assert match("Zara Thornton", "Bob Smith", "1960-01-01", "1960-01-01")[0].confidence >= 0.95
    assert match("John Smith", "John Smith", "1960-01-01", "1961-01-01") == []


def test_person_matches_equal_all_pairs(spark):
    pool = ["john smith", "jon smith", "john smyth", "ann lee", "anne lee", "anna leigh", "bo", "b o", "marta kovacs", "martha kovacs", "smith john"]
    a = people(spark, *((n, None) for n in pool))
    got = {(r.new_id, r.existing_id): r.confidence for r in dedup.person_matches(a, a).collect()}

    def split(n):
        w = [x for x in n.split() if x not in names.SUFFIXES]
        return " ".join(w[:-1]), w[-1]

    def sim(x, y):
        return 1.0 if x == y == "" else 0.0 if not x or not y else names.jaro_winkler(x, y)

    want = {}
    for i, x in enumerate(pool):
        for j, y in enumerate(pool):
            (f, la), (g, lb) = split(x), split(y)
            if (c := (sim(f, g) + sim(la, lb)) / 2) >= 0.85:
                want[i, j] = c
    assert got == pytest.approx(want)


def test_mentions():
    got = [(k, t) for k, t, *_ in ner.mentions(X.PASSAGES[0])]
    assert ("person", "Sen. John Smith") in got and ("amount", "$1,500") in got and ("organization", "Acme Holdings LLC") in got and ("filing", "FEC-2024-123") in got and ("date", "Jan. 15, 2024") in got
    assert [t for k, t, *_ in ner.mentions(X.PASSAGES[2]) if k == "person"] == ["Mary Jones", "Robert Brown"]
    assert [x[:3] for x in ner.mentions("Sen. John Smith met Sen. Ann Lee.") if x[0] == "person"] == [("person", "Sen. John Smith", 0), ("person", "John Smith", 5), ("person", "Sen. Ann Lee", 20), ("person", "Ann Lee", 25)]
    assert ner.mentions("é $5")[0][2:] == (2, 3)


def test_html_page():
    p = html.Page(X.PAGES[0])
    assert p.title == "Budget report" and p.description == "Where it went" and "var x" not in p.text
    assert [x[:2] for x in p.links] == [("/a", "part one"), ("/b", "two")]
    assert p.tables == [[["Name", "Sum"], ["Roads", "10"], ["Schools", "20"]]]
    assert html.Page("").text == ""


def test_references_without_a_semicolon():
    t = '<title>a &amp</title><p>b &amp; c &amp</p><p>&copyright; &#65; &#65 &am</p><a href="?x=1&amp;y&copy=2">&amp&lt;</a>'
    assert html.Page(t).title == "a &" and html.Page(t).text == "b & c & \xa9right; A A &am &<"
    p = html.Page(t, closed=True)
    assert p.title == "a &amp" and p.text == "b & c &amp &copyright; A &#65 &am &amp<" and p.links == [("?x=1&y&copy=2", "&amp<", None)]


def test_html_text_of_cut_pages_equals_sql(spark, tmp_path):
    rows = [(k, "u", f"<html><title>t{x}</title><body><h1>t{x}</h1><p>a &amp; b</p></body></html>") for k, x in enumerate(["", "&", "&a", "&am", "&amp", "&amp;", "&lt", "&quot;&quot"])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in QUERIES["html_text"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(duck.sql(ORACLES["html_text"]).fetchall())


def test_delimited():
    assert delimited.sniff("a\tb\tc") == "\t" and delimited.sniff("plain") == ";" and delimited.sniff("\n a|b") == "|"
    head, rows = delimited.parse('a,b\n"x, ""y""",2\n\n3\n1,2,3')
    assert head == ["a", "b"] and rows == [['x, "y"', "2"], ["3", ""], ["1", "2", "3"]]
    assert next(delimited.records("A,b\n1,2\n")) == {"A": "1", "b": "2"}
    with pytest.raises(ValueError):
        delimited.parse(" \n")


def test_containment(spark):
    rows = spark.createDataFrame([('{"a":{"b":1,"t":["x","y"]}}',), ('{"a":{"b":2}}',), ("oops",)], "data string")
    n = lambda q: rows.filter(repo.contains(q)).count()
    assert n('{"a":{"b":1}}') == 1 and n('{"a":{"t":["y"]}}') == 1 and n('{"a":{"t":["z"]}}') == 0 and n("{}") == 3


def test_paging(spark):
    e = spark.createDataFrame([(f"e{i:04}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 3)) for i in range(250)], "entity_id string, created_at timestamp_ntz")
    seen, after = [], None
    while True:
        page = repo.keyset_page(e, 100, after).orderBy("created_at", "entity_id").collect()
        seen += [r.entity_id for r in page]
        if not page or not page[-1].has_more:
            break
        after = (str(page[-1].created_at), page[-1].entity_id)
    assert seen == sorted(seen) and len(seen) == 250
    assert repo.keyset_page(e, 0).count() == 0 and repo.total_pages(10, 0) == 0 and repo.total_pages(101, 100) == 2 and repo.clamp_page(0, 500) == (0, 100)


def test_active_on(spark):
    r = spark.createDataFrame([("a", None, None), ("b", dt.date(2024, 1, 1), dt.date(2024, 1, 31)), ("c", dt.date(2024, 2, 1), None)], "rel_id string, start_date date, end_date date")
    assert [x.rel_id for x in repo.active_on(r, "2024-01-31").orderBy("rel_id").collect()] == ["a", "b"]


def test_reputation(spark):
    def last(*status):
        return crowd.reputation(spark.createDataFrame([(1, i, s) for i, s in enumerate(status)], "contributor bigint, seq bigint, status string")).first()

    assert (last("approved").score, last("approved").tier) == (10, "New")
    assert last(*["approved"] * 5).tier == "Established" and last(*["approved"] * 20).tier == "Trusted"
    assert last(*["rejected"] * 4).suspended and not last(*["rejected"] * 3).suspended
    assert last(*["approved"] * 5, *["rejected"] * 10).tier == "Established"


def test_submission_transitions(spark):
    def end(*actions):
        r = crowd.submission_states(spark.createDataFrame([("s", i, a) for i, a in enumerate(actions)], "submission_id string, seq bigint, action string")).first()
        return r.status, r.errors

    assert end("claim", "approve") == ("Approved", 0) and end("approve") == ("Pending", 1) and end("claim", "reject", "dispute", "claim") == ("Disputed", 1)


def test_batch_stats(spark):
    rows = [("url", 1.0, None), ("url", 0.0, None), ("not_applicable", 0.0, None), ("url", 0.0, "timeout")]
    r = verify.batch_stats(spark.createDataFrame(rows, "kind string, confidence double, error string")).first()
    assert (r.verified, r.failed, r.not_applicable) == (1, 2, 1) and r.success_rate == pytest.approx(1 / 3)


def test_audit_chain_shows_tampering(spark):
    e = spark.createDataFrame([(i, f"{i:032x}", dt.datetime(2024, 1, 1), "Create", "Person", f"{i + 100:032x}", "d") for i in range(1, 6)], "seq bigint, id string, timestamp timestamp_ntz, operation string, entity_type string, entity_id string, data_hash string")
    log = audit.append(e)
    assert audit.summary(log).first().chain_valid
    bad = log.withColumn("operation", F.when(F.col("seq") == 3, "Delete").otherwise(F.col("operation")))
    assert [r.seq for r in audit.verify(bad).filter("not (link_ok and hash_ok)").collect()] == [3]
    gone = log.filter("seq <> 3")
    assert [r.seq for r in audit.verify(gone).filter("not link_ok").collect()] == [4]


def test_search_wants_all_words_and_facets_any(spark):
    docs = spark.createDataFrame(
        [("1", "Person", "Budget hearing", "the budget of the city", ["x"], dt.date(2020, 1, 1)), ("2", "Document", "New budget", "roads", ["y"], dt.date(2024, 1, 1)), ("3", "Document", "Roads", "nothing", ["y"], dt.date(2024, 1, 1))],
        "entity_id string, entity_type string, name string, content string, tags array<string>, date date",
    )
    assert [r.entity_id for r in search.search(docs, "budget roads").collect()] == ["2"]
    assert [r.entity_id for r in search.search(docs, "budget", first="2023-01-01").collect()] == ["2"]
    assert search.search(docs, "budget").collect()[0].entity_id == "1"
    assert {r.entity_type: r.n for r in search.facets(docs, "budget roads").collect()} == {"Person": 1, "Document": 2}
    assert [r.name for r in search.prefix(docs, "ro", 5).collect()] == ["Roads"] and search.prefix(docs, "", 5).count() == 0
    assert search.Query().run(docs).count() == 3 and search.search(docs, " ").count() == 0


def test_ingest_counts_after_dedup(spark):
    rows = [(0, "F", {"name": "SMITH, ANN", "amount": "$5M"}), (1, "f", {"amount": " $5m", "name": "smith,  ann"}), (2, "F", {"name": ""})]
    r = spark.createDataFrame(rows, "seq bigint, source_type string, fields map<string,string>")
    out, errors, counters = ingest.pipeline(r, ["name", "amount"], names=["name"], amounts=["amount"])
    got = out.orderBy("record_index").collect()
    assert [(x.record_index, x.seq) for x in got] == [(0, 0), (1, 2)] and got[0].fields == {"name": "Ann Smith", "amount": "5000000"}
    assert sorted((x.record_index, x.field, x.reason) for x in errors.collect()) == [(1, "amount", "missing"), (1, "name", "empty")]
    assert tuple(counters.first()) == (2, 1, 2)


def test_submissions_are_checked_then_limited(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 1, "NewConnection", "http://a/", "p", "d\x07 e", "ip", {}) for i in range(4)] + [(9, dt.datetime(2024, 1, 1), 1, "NewConnection", "", "p", "d", "ip", {}), (10, dt.datetime(2024, 1, 1), 1, "Other", "http://a/", "p", "d", "ip2", {})]
    d = spark.createDataFrame(rows, "seq bigint, ts timestamp, contributor bigint, kind string, url string, reference string, description string, ip string, fields map<string,string>")
    got = {r.seq: (r.status, r.error) for r in intake.submit(d, 2).collect()}
    assert got == {0: ("Pending", None), 1: ("Pending", None), 2: (None, "rate limited"), 3: (None, "rate limited"), 9: (None, "empty url"), 10: (None, "unknown kind")}


def test_folds_are_the_rules(spark):
    import random

    r = random.Random(5)
    rows = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(400))) for k in "abc" for i in range(40)] + [("one", 1, dt.datetime(2024, 1, 1))]
    e = spark.createDataFrame(rows, "entity string, seq bigint, ts timestamp_ntz")
    want = []
    for k in {x[0] for x in rows}:
        line = sorted((t, i) for q, i, t in rows if q == k)
        at = 0
        while at < len(line):
            n = sum(line[at][0] <= t <= line[at][0] + dt.timedelta(days=2) for t, _ in line[at:])
            if n >= 3:
                want.append((k, line[at][0], line[at + n - 1][0], n))
                at += n
            else:
                at += 1
    assert sorted(tuple(x) for x in temporal.bursts(e, 2 * 86400).collect()) == sorted(want) and want
    assert temporal.bursts(e.limit(0)).count() == 0


def test_index_keeps_the_latest(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame([(i, "Document", n, c, ["t"], dt.date(2024, 1, 1)) for i, n, c in rows], "entity_id string, entity_type string, name string, content string, tags array<string>, date date")
    path = str(tmp_path / "i")
    index.append(docs([("a", "first", "river bank"), ("b", "second", "river"), ("c", "third", "hill")]), path, 0)
    index.append(docs([("b", "second", "lake")]), path, 1, deleted=docs([("a", "", "")]))
    index.append(docs([("c", "third", "river hill")]), path, 2)
    index.append(docs([("c", "third", "river hill hill")]), path, 2)  # tried again
    assert [r.entity_id for r in index.search(spark, path, "river").collect()] == ["c"] and index.search(spark, path, "bank").count() == 0
    now = docs([("b", "second", "lake"), ("c", "third", "river hill hill")])
    for q in ("hill", "lake", "third", "t", "nothing", ""):
        assert sorted(map(tuple, index.search(spark, path, q).collect())) == [(*x[:3], pytest.approx(x[3])) for x in sorted(map(tuple, search.search(now, q).collect()))]


def test_similar_parts_equal_all_pairs(spark):
    import random

    r = random.Random(6)
    pool = ["", "a", "smith", "smyth", "smithe", "johnson", "jonson", "o'neil", "oneill", "li", "lee", "müller", "muller"] + ["".join(r.choice("aeiostrn") for _ in range(r.randint(1, 9))) for _ in range(80)]
    pool += [x[: r.randint(1, len(x))] + r.choice("aez") + x[2:] for x in pool if x]
    d = lambda c: spark.createDataFrame([(x,) for x in pool], f"{c} string")
    for least in (0.82, 0.85, 0.95):
        want = {(x, y) for x in pool for y in pool if (1.0 if x == y == "" else 0.0 if not x or not y else names.jaro_winkler(x, y)) >= least}
        assert {tuple(x) for x in names.similar_parts(d("a"), d("b"), least).collect()} == want


def test_entities_and_relationships_from_scratch(spark):
    rows = spark.createDataFrame([("1", "Person", {"name": "A"}), ("2", "Person", {"name": "B", "status": "Former"}), ("3", "Payment", {"x": "y"})], "entity_id string, entity_type string, fields map<string,string>")
    got = {r.entity_id: (r.fields, r.version) for r in model.new_entities(rows).collect()}
    assert got == {"1": ({"name": "A", "status": "Active"}, 1), "2": ({"name": "B", "status": "Former"}, 1), "3": ({"x": "y"}, 1)}
    rel = model.new_relationships(spark.createDataFrame([("r", "a", "b", "DonatedTo")], "rel_id string, src string, dst string, rel_type string")).first()
    assert (rel.version, rel.start_date, rel.end_date) == (1, None, None)
    log = crowd.log_review(*(spark.createDataFrame([x], "submission_id bigint, reviewer bigint, action string, rationale string, at string") for x in ((1, 2, "approve", "ok", "t"), (3, 4, "reject", "no", "u"))))
    assert log.count() == 2
