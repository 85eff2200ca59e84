import datetime as dt

from tallywire.operators import temporal, timing


def day(s):
    return dt.date.fromisoformat(s)


def events(spark, *rows):
    return spark.createDataFrame([(i, e, k, day(d)) for i, (e, k, d) in enumerate(rows)], "seq bigint, entity_id string, event_type string, date date")


def stamps(spark, *rows):
    return spark.createDataFrame([(i, e, dt.datetime.fromisoformat(d)) for i, (e, d) in enumerate(rows)], "seq bigint, entity string, ts timestamp_ntz")


def correlations(spark, *rows):
    return [(r.correlation_type, r.days_between, r.threshold_days) for r in timing.timing_correlations(events(spark, *rows)).collect()]


def test_correlation_thresholds_are_strict(spark):
    assert correlations(spark, ("e", "Donation", "2024-01-01"), ("e", "Vote", "2024-03-01")) == [("DonationToVote", 60, 90)]
    assert correlations(spark, ("e", "Donation", "2024-01-01"), ("e", "Vote", "2024-03-31")) == []
    assert correlations(spark, ("e", "Donation", "2024-01-01"), ("e", "Vote", "2024-03-30")) == [("DonationToVote", 89, 90)]
    assert correlations(spark, ("e", "Lobbying", "2024-01-01"), ("e", "Vote", "2024-06-29")) == []
    assert correlations(spark, ("e", "Lobbying", "2024-01-01"), ("e", "Vote", "2024-06-01")) == [("LobbyingToVote", 152, 180)]
    assert correlations(spark, ("e", "Indictment", "2020-06-15"), ("e", "Pardon", "2025-12-31")) == [("IndictmentToPardon", 2025, None)]


def test_arrival_order_matters_only_on_one_day(spark):
    assert correlations(spark, ("e", "Vote", "2024-03-01"), ("e", "Donation", "2024-01-01")) == [("DonationToVote", 60, 90)]
    assert correlations(spark, ("e", "Vote", "2024-03-01"), ("e", "Donation", "2024-03-01")) == []
    assert correlations(spark, ("e", "Donation", "2024-03-01"), ("e", "Vote", "2024-03-01")) == [("DonationToVote", 0, 90)]
    assert correlations(spark, ("a", "Donation", "2024-01-01"), ("b", "Vote", "2024-01-02")) == []


def test_flags(spark):
    def flags(*rows):
        return [(r.severity, r.description) for r in timing.timing_flags(events(spark, *rows)).collect()]

    assert flags(("e", "Donation", "2024-01-01"), ("e", "Vote", "2024-01-20")) == [("High", "Donation followed by vote within 19 days")]
    assert flags(("e", "Donation", "2024-01-01"), ("e", "Vote", "2024-01-31")) == []
    assert flags(("e", "Lobbying", "2024-01-01"), ("e", "Vote", "2024-03-01")) == [("Medium", "Lobbying followed by vote within 60 days")]
    assert flags(("e", "Lobbying", "2024-01-01"), ("e", "Vote", "2024-03-31")) == []
    assert flags(("e", "Indictment", "2024-01-01"), ("e", "Pardon", "2024-01-01")) == [("Critical", "Indictment followed by pardon (0 days apart)")]


def flows(spark, *rows):
    return spark.createDataFrame([(i, a, b, float(x), day(d)) for i, (a, b, x, d) in enumerate(rows)], "flow_id bigint, donor string, recipient string, amount double, date date")


def test_periods(spark):
    f = flows(spark, ("a", "b", 100, "2024-01-01"), ("a", "b", 200, "2024-01-10"), ("a", "c", 300, "2024-02-01"))
    got = sorted(timing.flow_periods(f, 30).collect())
    assert [(r.n, r.total, r.donors, str(r.period_end)) for r in got] == [(2, 300.0, 1, "2024-01-30"), (1, 300.0, 1, "2024-02-29")]
    assert timing.flow_periods(f, 0).count() == 0


def test_bursts_before_votes(spark):
    f = flows(spark, ("a", "v", 25, "2024-05-20"), ("b", "v", 30, "2024-05-25"), ("c", "v", 20, "2024-05-30"), ("d", "v", 500, "2024-05-29"), ("e", "v", 10, "2024-06-01"))
    votes = spark.createDataFrame([(1, day("2024-06-01")), (2, day("2024-06-01"))], "vote_row bigint, vote_date date")
    got = timing.suspicious_bursts(f, votes, 14, 50.0, 3).collect()
    assert sorted((r.vote_row, r.n, r.total) for r in got) == [(1, 3, 75.0), (2, 3, 75.0)]
    assert timing.suspicious_bursts(f, votes, 14, 50.0, 4).count() == 0
    assert timing.suspicious_bursts(f, votes, 0, 50.0, 1).count() == 0


def test_greedy_bursts(spark):
    assert [r.n for r in temporal.bursts(stamps(spark, ("e", "2024-01-01"), ("e", "2024-01-03"), ("e", "2024-01-06"))).collect()] == [3]
    assert temporal.bursts(stamps(spark, ("e", "2024-01-01"), ("e", "2024-01-10"), ("e", "2024-01-20"))).count() == 0
    # the second burst begins only after the first
    got = temporal.bursts(stamps(spark, *(("e", f"2024-01-{d:02}") for d in (1, 3, 6, 8, 9, 12, 13)))).collect()
    assert sorted((r.first_ts.day, r.last_ts.day, r.n) for r in got) == [(1, 8, 4), (9, 13, 3)]
    assert [r.n for r in temporal.bursts(stamps(spark, *[("e", "2024-01-01")] * 4)).collect()] == [4]


def test_periodic_runs(spark):
    hit = temporal.periodic_runs(stamps(spark, *(("e", d) for d in ("2024-01-01", "2024-03-27", "2024-06-25", "2024-09-29")))).collect()
    assert [r.n for r in hit] == [4]
    assert temporal.periodic_runs(stamps(spark, *(("e", d) for d in ("2024-01-01", "2024-02-15", "2024-06-01", "2024-08-20")))).count() == 0


def test_response_chain_is_inclusive(spark):
    a, b = stamps(spark, ("d", "2024-01-01T12:00:00")), stamps(spark, ("o", "2024-01-25T11:00:00"), ("o", "2024-01-31T12:00:00"), ("o", "2024-01-31T12:00:01"))
    assert sorted(r.days for r in temporal.response_chains(a, b, 30).collect()) == [23, 30]


def test_rate_limit_counts_accepted_calls_only(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, t + dt.timedelta(minutes=m)) for i, m in enumerate((0, 10, 20, 59, 60, 61, 71))]
    got = temporal.rate_limited(spark.createDataFrame(rows, "key bigint, seq bigint, ts timestamp_ntz"), 2).collect()
    assert [r.accepted for r in sorted(got, key=lambda r: r.seq)] == [True, True, False, False, True, False, True]
