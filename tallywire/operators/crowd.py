"""Submissions, reputation, watches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import in_order

# Points of a review's outcome.
POINTS = {"approved": 10, "rejected": -3, "disputed": 15, "bad_faith": -25}
#: (from, action, to); anything else is refused and changes nothing.
TRANSITIONS = (("Pending", "claim", "InReview"), ("InReview", "approve", "Approved"), ("InReview", "reject", "Rejected"), ("Rejected", "dispute", "Disputed"))
#: Submissions an hour by tier, and the tiers whose submissions are reviewed first.
EXPEDITED = ("Trusted", "Verified", "Maintainer")
#: What a subscription is told of unless it says so itself.
NOTIFY = ("EntityUpdate", "NewRelationship", "NewCorrelation", "NewDocument")
TIER_LIMITS = {"New": 5, "Established": 15, "Trusted": 30, "Verified": 60, "Maintainer": 120}


def reputation(events: DataFrame) -> DataFrame:
    """(contributor, score, approved, rejected, disputed, tier, suspended) from events (contributor, seq, status).

    A tier is that of the highest score so far: 50 Established, 200 Trusted; nobody falls back. Suspended is who has at
    some time stood below -10 with three rejections and no approval, or has acted in bad faith.
    """
    w = Window.partitionBy("contributor").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    points = F.lit(0)
    for k, v in POINTS.items():
        points = F.when(F.col("status") == k, v).otherwise(points)
    run = lambda k: F.sum((F.col("status") == k).cast("int")).over(w)
    r = events.withColumns({"s": F.sum(points).over(w), "a": run("approved"), "r": run("rejected"), "d": run("disputed")})
    r = r.withColumn("bad", ((F.col("s") < -10) & (F.col("r") >= 3) & (F.col("a") == 0)) | (F.col("status") == "bad_faith"))
    top = F.greatest(F.max("s"), F.lit(0))
    tier = F.when(top >= 200, "Trusted").when(top >= 50, "Established").otherwise("New")
    last = lambda c: F.max_by(c, "seq")
    return r.groupBy("contributor").agg(last("s").alias("score"), last("a").alias("approved"), last("r").alias("rejected"), last("d").alias("disputed"), tier.alias("tier"), F.bool_or("bad").alias("suspended"))


def leaderboard(profiles: DataFrame, n: int) -> DataFrame:
    return profiles.filter("not suspended").orderBy(F.col("score").desc(), "contributor").limit(n)


def submission_states(events: DataFrame) -> DataFrame:
    """(submission_id, status, errors) after all actions (submission_id, seq, action) in order; refused ones are counted."""
    moves = {(a, b): c for a, b, c in TRANSITIONS}

    def walker():
        status, errors = "Pending", 0

        def step(row):
            nonlocal status, errors
            if row is None:
                return [(status, errors)]
            to = moves.get((status, row[1]))
            status, errors = to or status, errors + (to is None)
            return []

        return step

    kind = events.schema["submission_id"].dataType.simpleString()
    return in_order(events.select("submission_id", "seq", "action"), "submission_id", ["seq", "action"], walker, f"submission_id {kind}, status string, errors bigint")


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"))


def watch_alerts(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(sub_id, subscriber, seq, entity_id, alert_type): changes that an active subscription of their entity is for. Keyword watches match nothing."""
    fits = (F.col("watch_type") == "Entity") | ((F.col("watch_type") == "EntityRelationship") & (F.col("alert_type") == "NewRelationship")) | ((F.col("watch_type") == "TimingCorrelations") & (F.col("alert_type") == "NewTimingCorrelation"))
    return changes.join(subscriptions.filter("active and watch_type <> 'Keyword'"), "entity_id").filter(fits).select("sub_id", "subscriber", "seq", "entity_id", "alert_type")


def tier_rights(profiles: DataFrame) -> DataFrame:
    """Adds per_hour and expedited, what a profile's tier allows."""
    limit = F.create_map(*(F.lit(x) for kv in TIER_LIMITS.items() for x in kv))
    return profiles.withColumns({"per_hour": F.try_element_at(limit, F.col("tier")), "expedited": F.col("tier").isin(*EXPEDITED)})


def reject_note(reason, note):
    return F.concat(reason, F.lit(": "), note)


def log_review(log: DataFrame, actions: DataFrame) -> DataFrame:
    """The review log (submission_id, reviewer, action, rationale, at) with further actions."""
    return log.unionByName(actions.select(*log.columns))


def subscribe(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(sub_id, entity_id, entity_type, entity_name, notify_on, subscribed_at), the newest first, of events (seq, at, sub_id, action, entity_id, notify_on).

    An entity that is not stored cannot be subscribed to. 'delete' removes a subscription for good.
    """
    made = events.filter("action = 'subscribe'").join(entities.select("entity_id", "entity_type", F.col("name").alias("entity_name")), "entity_id")
    gone = events.filter("action = 'delete'").select("sub_id", F.col("seq").alias("gone"))
    left = made.join(gone, "sub_id", "left").filter("gone is null or gone < seq").dropDuplicates(["sub_id"])
    told = F.coalesce("notify_on", F.array(*map(F.lit, NOTIFY)))
    return left.select("sub_id", "entity_id", "entity_type", "entity_name", told.alias("notify_on"), F.col("at").alias("subscribed_at")).orderBy(F.col("subscribed_at").desc(), "sub_id")


def dispute_note(note, text):
    return F.concat(F.coalesce(note, F.lit("")), F.lit("\n\nDISPUTE: "), text)


def pending(submissions: DataFrame, n: int | None = None) -> DataFrame:
    """Pending submissions, those handed in first coming first."""
    out = submissions.filter("status = 'Pending'")
    return out if n is None else out.orderBy("submitted_at", "submission_id").limit(n)


def by_contributor(submissions: DataFrame, contributor) -> DataFrame:
    return submissions.filter(F.col("contributor") == contributor)


def review_counts(reviews: DataFrame) -> DataFrame:
    """(reviewer, action, n, submissions) of a review log (submission_id, reviewer, action)."""
    return reviews.groupBy("reviewer", "action").agg(F.count("*").alias("n"), F.count_distinct("submission_id").alias("submissions"))


def current_subscriptions(events: DataFrame) -> DataFrame:
    """(subscriber, entity_id) that are on: of subscribe and unsubscribe events (seq, subscriber, entity_id, action) the last one counts."""
    last = events.groupBy("subscriber", "entity_id").agg(F.max_by("action", "seq").alias("action"))
    return last.filter("action = 'subscribe'").select("subscriber", "entity_id")


def unread(alerts: DataFrame, read: DataFrame) -> DataFrame:
    """Alerts whose (sub_id, seq) was not marked as read."""
    return alerts.join(read.select("sub_id", "seq").distinct(), ["sub_id", "seq"], "left_anti")


def by_preference(alerts: DataFrame, subscriptions: DataFrame, notify: str) -> DataFrame:
    """Alerts of the subscriptions with one way of being told: at once, or in a digest."""
    return alerts.join(subscriptions.filter(F.col("notify") == notify).select("sub_id"), "sub_id", "left_semi")
