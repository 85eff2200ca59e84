"""Streams in, streams out; each has a batch twin among the operators.

State is bounded by a watermark wherever the rule allows it; where it does not, the function says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import audit, crowd, index, timing


def dedup_records(records: DataFrame, time_col: str | None = None, late: str = "30 days") -> DataFrame:
    """The first record of each fingerprint. With a time column the state is kept for `late`, else for ever."""
    out = records.withColumn("fingerprint", N.fingerprint(F.col("source_type"), F.col("fields")))
    if time_col is None:
        return out.dropDuplicates(["fingerprint"])
    return out.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["fingerprint"])


def timing_correlations(events: DataFrame, rules=timing.CORRELATIONS, late: str = "30 days") -> DataFrame:
    """Pairs of events (seq, entity_id, event_type, ts) by the bounded rules, in whatever order they arrive.

    A join of the stream with itself in which both sides' state is let go once the threshold and the watermark have
    passed. The rule without a threshold, indictment and pardon, is a stream of its own: `pardons`.
    """
    bounded = [(i, a, b, c, t) for i, (a, b, c, t) in enumerate(rules) if t is not None]
    longest = max(t for *_, t in bounded)
    rule = lambda k: F.coalesce(*(F.when((F.col("a.event_type") == r[1]) & (F.col("b.event_type") == r[2]), F.lit(r[k])) for r in bounded))
    first = events.filter(F.col("event_type").isin(*{r[1] for r in bounded})).withWatermark("ts", late).alias("a")
    second = events.filter(F.col("event_type").isin(*{r[2] for r in bounded})).withWatermark("ts", late).alias("b")
    on = F.expr(f"a.entity_id = b.entity_id AND b.ts >= a.ts - INTERVAL 1 DAY AND b.ts <= a.ts + INTERVAL {longest} DAYS")
    days = F.datediff(F.to_date("b.ts"), F.to_date("a.ts"))
    earlier = (days > 0) | ((days == 0) & (F.col("a.seq") < F.col("b.seq")))
    pairs = first.join(second, on).filter(earlier & (days < rule(4)))
    return pairs.select(F.col("a.entity_id").alias("entity_id"), F.col("a.seq").alias("event_a_id"), F.col("b.seq").alias("event_b_id"), days.alias("days_between"), rule(3).alias("correlation_type"))


def pardons(events: DataFrame) -> DataFrame:
    """(entity_id, event_a_id, event_b_id, days_between, correlation_type) of indictments and later pardons, in whatever order they arrive.

    The rule has no threshold, so an entity's indictments and pardons are kept for ever, numbers and days only.
    """
    rows = events.filter(F.col("event_type").isin("Indictment", "Pardon")).select("entity_id", "seq", "event_type", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"))
    kind = events.schema["entity_id"].dataType.simpleString()

    def step(key, frames, state):
        known = list(zip(*state.get, strict=True)) if state.exists else []
        new = [(int(s), int(d), t == "Pardon") for s, d, t in pd.concat(list(frames)).sort_values("seq")[["seq", "day", "event_type"]].itertuples(index=False)]
        old = [(int(s), int(d), bool(p)) for s, d, p in known]
        pairs = []
        for x in new:
            for y in old:
                a, b = (y, x) if x[2] else (x, y)
                if not a[2] and b[2] and (a[1], a[0]) < (b[1], b[0]):
                    pairs.append((key[0], a[0], b[0], b[1] - a[1], "IndictmentToPardon"))
            old.append(x)
        state.update(tuple(map(list, zip(*old, strict=True))))
        yield pd.DataFrame(pairs, columns=["entity_id", "event_a_id", "event_b_id", "days_between", "correlation_type"])

    out = f"entity_id {kind}, event_a_id bigint, event_b_id bigint, days_between int, correlation_type string"
    return rows.groupBy("entity_id").applyInPandasWithState(step, out, "seqs array<bigint>, days array<int>, pardons array<boolean>", "append", "NoTimeout")


def watch_alerts(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts for a stream of changes; the subscriptions are a table, read anew for each batch."""
    return crowd.watch_alerts(changes, subscriptions)


def flow_windows(flows: DataFrame, days: int, late: str = "7 days", start: str = "0 days") -> DataFrame:
    """Sums of a stream of flows (ts, donor, recipient, amount) by windows of days. Windows begin at the epoch plus `start`, not at the first flow, which a stream does not know."""
    w = F.window("ts", f"{days} days", startTime=start)
    out = flows.withWatermark("ts", late).groupBy(w).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    return out.select(F.to_date("window.start").alias("period_start"), F.date_sub(F.to_date("window.end"), 1).alias("period_end"), "total", "n")


def reputation(events: DataFrame) -> DataFrame:
    """(contributor, score, approved, rejected, disputed, tier, suspended) after each batch that has events of a contributor.

    State is six numbers for each contributor. Events (contributor, seq, status) of a batch are taken in order of seq.
    """
    out = "contributor bigint, score bigint, approved bigint, rejected bigint, disputed bigint, tier string, suspended boolean"
    held = "score bigint, approved bigint, rejected bigint, disputed bigint, top bigint, suspended boolean"

    def step(key, frames: Iterator[pd.DataFrame], state):
        score, a, r, d, top, bad = state.get if state.exists else (0, 0, 0, 0, 0, False)
        for status in pd.concat(list(frames)).sort_values("seq")["status"]:
            score += crowd.POINTS.get(status, 0)
            a, r, d = a + (status == "approved"), r + (status == "rejected"), d + (status == "disputed")
            top = max(top, score)
            bad = bad or status == "bad_faith" or (score < -10 and r >= 3 and a == 0)
        state.update((score, int(a), int(r), int(d), top, bool(bad)))
        tier = "Trusted" if top >= 200 else "Established" if top >= 50 else "New"
        yield pd.DataFrame({"contributor": [key[0]], "score": [score], "approved": [a], "rejected": [r], "disputed": [d], "tier": [tier], "suspended": [bool(bad)]})

    return events.groupBy("contributor").applyInPandasWithState(step, out, held, "update", "NoTimeout")


def rate_limited(calls: DataFrame, per_hour: int, window: int = 3600) -> DataFrame:
    """(key, seq, accepted) of a stream of calls (key, seq, ts); state is at most per_hour times for each key."""

    def step(key, frames, state):
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        said = []
        for t in rows["ts"]:
            now = pd.Timestamp(t).value // 1000
            live = [x for x in live if x > now - window * 1_000_000]
            said.append(len(live) < per_hour)
            if said[-1]:
                live.append(now)
        state.update((live,))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "seq": rows["seq"].tolist(), "accepted": said})

    return calls.groupBy("key").applyInPandasWithState(step, "key bigint, seq bigint, accepted boolean", "live array<bigint>", "append", "NoTimeout")


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch sink (an upsert, an audit append, an index write) on each micro-batch, once each."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def index_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that indexes documents for operators.index; a batch that is tried again replaces itself."""
    return lambda batch, number: index.append(batch, path, number)


def audit_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that chains entries (seq and what audit.append takes) on to the log below path; there is one writer.

    A batch goes on from the last hash of the batches before it, and one that is tried again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = audit.GENESIS
        if number:
            log = spark.read.parquet(path).filter(F.col("batch") < number)
            row = log.agg(F.max_by("entry_hash", "seq")).first()
            last = row[0] or last
        audit.append(batch, last).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
