import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywire.operators import audit, crowd, index
from tallywire.streaming import engines


@pytest.fixture
def stream(spark, tmp_path):
    """Rows written file by file, read as a stream; gives what a query puts out."""

    def run(schema, files, build, mode="append"):
        src = str(tmp_path / "in")
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
            del i
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
        name = f"t{abs(hash(str(tmp_path))) % 10**9}"
        q = build(df).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    return run


def test_dedup(stream):
    rows = [[("F", {"name": "A"})], [("f", {"name": " a "}), ("F", {"name": "B"})]]
    assert len(stream("source_type string, fields map<string,string>", rows, engines.dedup_records)) == 2


def test_late_donation_still_pairs(stream):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [[(2, "e", "Vote", t("2024-03-01"))], [(1, "e", "Donation", t("2024-02-10"))], [(3, "e", "Donation", t("2023-01-01"))]]
    got = stream("seq bigint, entity_id string, event_type string, ts timestamp", rows, lambda d: engines.timing_correlations(d))
    assert [(r.event_a_id, r.event_b_id, r.days_between, r.correlation_type) for r in got] == [(1, 2, 20, "DonationToVote")]


def test_reputation_is_the_batch_fold(spark, stream):
    schema = "contributor bigint, seq bigint, status string"
    rows = [(1, i, s) for i, s in enumerate(["approved", "rejected", "disputed"] * 4)] + [(2, i, "rejected") for i in range(4)]
    got = stream(schema, [rows[:5], rows[5:]], engines.reputation, "update")
    want = {r.contributor: tuple(r) for r in crowd.reputation(spark.createDataFrame(rows, schema)).collect()}
    last = {}
    for r in got:
        if r.contributor not in last or abs(r.approved + r.rejected + r.disputed) > abs(sum(last[r.contributor][2:5])):
            last[r.contributor] = tuple(r)
    assert last == want


def test_alerts(spark, stream):
    subs = spark.createDataFrame([(1, 7, 5, "Entity", True), (2, 8, 5, "Keyword", True), (3, 9, 5, "EntityRelationship", True)], "sub_id bigint, subscriber bigint, entity_id bigint, watch_type string, active boolean")
    got = stream("seq bigint, entity_id bigint, alert_type string", [[(1, 5, "EntityUpdated")]], lambda d: engines.watch_alerts(d, subs))
    assert [r.sub_id for r in got] == [1]


def test_windows(stream):
    rows = [[(dt.datetime(2024, 1, d), 1.0) for d in (1, 2, 8)], [(dt.datetime(2024, 3, 1), 5.0)]]
    got = stream("ts timestamp, amount double", rows, lambda d: engines.flow_windows(d, 7))
    assert sum(r.n for r in got) == 3


def test_rate_limit(stream):
    t = dt.datetime(2024, 1, 1)
    rows = [[(1, 0, t), (1, 1, t + dt.timedelta(minutes=1))], [(1, 2, t + dt.timedelta(minutes=2)), (1, 3, t + dt.timedelta(minutes=61))]]
    got = stream("key bigint, seq bigint, ts timestamp", rows, lambda d: engines.rate_limited(d, 2))
    by_seq = {r.seq: r.accepted for r in got}
    assert all(F is not None for _ in by_seq) and (by_seq[0], by_seq[1]) == (True, True) and sorted(by_seq) == [0, 1, 2, 3]


def test_pardons_in_any_order(stream):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [[(4, "e", "Pardon", t("2025-12-31")), (9, "f", "Pardon", t("2020-01-01"))], [(1, "e", "Indictment", t("2020-06-15"))], [(2, "e", "Indictment", t("2026-01-01")), (8, "f", "Indictment", t("2020-01-01"))]]
    got = stream("seq bigint, entity_id string, event_type string, ts timestamp", rows, engines.pardons)
    assert sorted((r.entity_id, r.event_a_id, r.event_b_id, r.days_between) for r in got) == [("e", 1, 4, 2025), ("f", 8, 9, 0)]


def test_sinks(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame([(i, "Document", i, c, ["t"], dt.date(2024, 1, 1)) for i, c in rows], "entity_id string, entity_type string, name string, content string, tags array<string>, date date")
    write = engines.index_sink(str(tmp_path / "i"))
    write(docs([("a", "river")]), 0), write(docs([("a", "hill")]), 1), write(docs([("a", "hill")]), 1)
    assert [r.entity_id for r in index.search(spark, str(tmp_path / "i"), "hill").collect()] == ["a"]
    entry = lambda k: (k, f"{k:032x}", dt.datetime(2024, 1, 1), "Insert", "Person", f"{k + 100:032x}", "d")
    schema = "seq bigint, id string, timestamp timestamp_ntz, operation string, entity_type string, entity_id string, data_hash string"
    chain = engines.audit_sink(str(tmp_path / "log"))
    for number, ks in ((0, (1, 2)), (1, (3,)), (1, (3,)), (2, (4, 5))):
        chain(spark.createDataFrame([entry(k) for k in ks], schema), number)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 5 and audit.summary(log).first().chain_valid
