"""Rules over pairs of dated events of one entity, and reports on money flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (earlier, later, correlation, days it must stay under; None: always).
CORRELATIONS = (("Donation", "Vote", "DonationToVote", 90), ("Lobbying", "Vote", "LobbyingToVote", 180), ("Indictment", "Pardon", "IndictmentToPardon", None))
#: (earlier, later, severity, days it must stay under; None: always).
FLAGS = (("Donation", "Vote", "High", 30), ("Lobbying", "Vote", "Medium", 90), ("Indictment", "Pardon", "Critical", None))


def event_pairs(events: DataFrame, rules) -> DataFrame:
    """(entity_id, earlier, later, label, threshold, days, dates, seqs) of the pairs that a rule covers.

    The event of smaller date is the earlier one, on one date that of smaller seq; days stay strictly under the rule's
    threshold. A bounded rule joins on a bucket of as many days too, so an entity with a very long history is dealt
    out; pairs beyond the threshold are hardly ever formed.
    """
    out = None
    for earlier, later, label, most in rules:
        a = events.filter(F.col("event_type") == earlier).select("entity_id", F.col("seq").alias("seq_a"), F.col("date").alias("date_a"))
        b = events.filter(F.col("event_type") == later).select("entity_id", F.col("seq").alias("seq_b"), F.col("date").alias("date_b"))
        keys = ["entity_id"]
        if most is not None:
            day = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / most)  # noqa: E731, B023
            a = a.withColumn("bucket", F.explode(F.array(day("date_a"), day("date_a") + 1)))
            b = b.withColumn("bucket", day("date_b"))
            keys.append("bucket")
        days = F.datediff("date_b", "date_a")
        pairs = a.join(b, keys).filter((F.col("date_a") < F.col("date_b")) | ((F.col("date_a") == F.col("date_b")) & (F.col("seq_a") < F.col("seq_b"))))
        if most is not None:
            pairs = pairs.filter(days < most)
        part = pairs.select("entity_id", F.lit(earlier).alias("earlier"), F.lit(later).alias("later"), F.lit(label).alias("label"), F.lit(most).cast("int").alias("threshold"), days.alias("days"), "date_a", "date_b", "seq_a", "seq_b")
        out = part if out is None else out.unionByName(part)
    return out


def timing_correlations(events: DataFrame, rules=CORRELATIONS) -> DataFrame:
    return event_pairs(events, rules).select(
        "entity_id", F.col("seq_a").alias("event_a_id"), F.col("earlier").alias("event_a_description"), F.col("date_a").alias("event_a_date"), F.col("seq_b").alias("event_b_id"), F.col("later").alias("event_b_description"),
        F.col("date_b").alias("event_b_date"), F.col("days").alias("days_between"), F.col("label").alias("correlation_type"), F.lit(True).alias("auto_flagged"), F.col("threshold").alias("threshold_days"),
    )


def flag_text(earlier: Column, later: Column, days: Column) -> Column:
    return F.when(earlier == "Indictment", F.concat(F.lit("Indictment followed by pardon ("), days.cast("string"), F.lit(" days apart)"))).otherwise(F.concat(earlier, F.lit(" followed by vote within "), days.cast("string"), F.lit(" days")))


def timing_flags(events: DataFrame, rules=FLAGS) -> DataFrame:
    return event_pairs(events, rules).select("entity_id", flag_text(F.col("earlier"), F.col("later"), F.col("days")).alias("description"), F.col("label").alias("severity"), F.col("days").alias("time_delta"))


def correlations_by_type(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("correlation_type").agg(F.count("*").alias("n"), F.min("days_between").alias("min_days"), F.max("days_between").alias("max_days"))


def correlations_for(correlations: DataFrame, event_id: int) -> DataFrame:
    """Correlations that an event takes part in, on either side."""
    return correlations.filter((F.col("event_a_id") == event_id) | (F.col("event_b_id") == event_id))


def correlation_summary(correlations: DataFrame) -> DataFrame:
    """Rows, flagged rows, rounded mean and least gap."""
    return correlations.agg(F.count("*").alias("n"), F.count_if("auto_flagged").alias("flagged"), F.round(F.avg("days_between")).cast("bigint").alias("avg_gap"), F.min("days_between").alias("min_gap"))


def flows_between(flows: DataFrame, first: str, last: str) -> DataFrame:
    """Flows of a window of dates, both ends included."""
    return flows.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def flow_periods(flows: DataFrame, days: int) -> DataFrame:
    """Tumbling periods from the first date on: (period_start, period_end, total, n, donors, recipients); empty ones are left out."""
    if days <= 0:
        return flow_periods(flows.limit(0), 1)
    first = flows.agg(F.min("date").alias("first"))
    k = F.floor(F.datediff("date", "first") / days).cast("int")
    out = flows.crossJoin(F.broadcast(first)).groupBy("first", k.alias("k")).agg(F.sum("amount").alias("total"), F.count("*").alias("n"), F.count_distinct("donor").alias("donors"), F.count_distinct("recipient").alias("recipients"))
    start = F.date_add("first", F.col("k") * days)
    return out.select(start.alias("period_start"), F.date_add(start, days - 1).alias("period_end"), "total", "n", "donors", "recipients")


def suspicious_bursts(flows: DataFrame, votes: DataFrame, lookback: int, most: float, least: int) -> DataFrame:
    """Per vote (vote_row, vote_date) the small flows of the days before it: (vote_row, vote_date, n, total, average, donors, recipients).

    Flows of [vote - lookback, vote - 1] with 0 < amount <= most; votes with fewer than `least` are left out. A repeated
    date is a row of its own.

    Flows are added up by day, and who gave and got on a day are made distinct, before the days that lie ahead of each
    distinct date of a vote meet them by day: no vote meets a flow, and a busy day is as many rows as it has people.
    """
    if lookback <= 0 or most <= 0 or least == 0:
        flows = flows.limit(0)
        lookback = max(lookback, 1)
    small = flows.filter((F.col("amount") > 0) & (F.col("amount") <= most))
    days = votes.select("vote_date").distinct().withColumn("date", F.explode(F.sequence(F.date_sub("vote_date", lookback), F.date_sub("vote_date", 1))))
    by_day = small.groupBy("date").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    sums = days.join(by_day, "date").groupBy("vote_date").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter(F.col("n") >= least)

    def people(c: str, name: str) -> DataFrame:
        return days.join(small.select("date", c).dropna().distinct(), "date").select("vote_date", c).distinct().groupBy("vote_date").agg(F.count("*").alias(name))

    out = votes.join(sums, "vote_date").join(people("donor", "donors"), "vote_date", "left").join(people("recipient", "recipients"), "vote_date", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("vote_row", "vote_date", "n", "total", (F.col("total") / F.col("n")).alias("average"), none("donors"), none("recipients"))
