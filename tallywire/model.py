"""The domain's views over the supplied tables: events, flows, edges, entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of kinds, fields and edge types below.
#: Kinds of entities, in the order in which facets are listed.
ENTITY_TYPES = (
    "Person", "Organization", "Document", "Payment", "CourtCase", "Pardon", "FlightLogEntry", "TimingCorrelation", "ConductComparison",
    "PublicStatement", "PolicyDecision", "LobbyingActivity",
)
#: Required and optional fields by entity type, for the types that declare them; all of them need a source.
SCHEMAS = {
    "Person": (("name",), ("aliases", "current_role", "party_affiliation", "jurisdiction", "status", "birth_date")),
    "Organization": (("name", "org_type"), ("aliases", "jurisdiction", "known_principals", "foreign_connection")),
    "Payment": (("amount", "date", "donor", "recipient"), ("filing_id", "election_cycle", "description")),
    "TimingCorrelation": (("event_a", "event_b", "days_between", "correlation_type"), ("threshold_days",)),
    "ConductComparison": (("official_action", "official", "action_date", "action_source", "equivalent_private_conduct", "documented_consequence", "consequence_source"), ()),
}
#: What a new entity has unless it says otherwise.
DEFAULTS = {"Person": {"status": "Active"}, "Organization": {"foreign_connection": "false"}, "LobbyingActivity": {"foreign_connection": "false"}}
#: Operations that the audit log knows.
AUDIT_OPERATIONS = ("Insert", "Update", "Delete")
#: Edge types along which money moves.
FINANCIAL = ("DonatedTo", "ReceivedContract", "LobbiedFor")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: dict, other: str) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def timing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, entity_id, event_type, date), one for each order; seq is the order of arrival."""
    kind = _pick(F.substring("o_orderpriority", 1, 1), {"1": "Donation", "2": "Vote", "3": "Indictment", "4": "Pardon"}, "Lobbying")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("entity_id"), kind.alias("event_type"), F.to_date("o_orderdate").alias("date"))


def temporal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, entity, ts, description) of the event stream."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity"), "ts", F.col("event_type").alias("description"))


def flows(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """(flow_id, donor, recipient, amount, date, event_type): each event moves its value on to a user k further round the ring of users."""
    events = table(spark, sf_dir, "events")
    users = events.agg(F.count_distinct("user_id").alias("users"))
    step = F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("bigint")
    out = events.crossJoin(F.broadcast(users)).select(
        F.col("event_id").alias("flow_id"), F.col("user_id").alias("donor"), ((F.col("user_id") + step) % F.col("users")).alias("recipient"), F.col("value").alias("amount"), F.to_date("ts").alias("date"), "event_type",
    )
    return out.filter("event_type = 'purchase' and amount > 100") if sparse else out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, src, dst, rel_type, amount): flows above 100, typed by their event."""
    kind = _pick(F.col("event_type"), {"purchase": "DonatedTo", "signup": "ReceivedContract", "click": "LobbiedFor", "view": "HoldsPosition"}, "Pardoned")
    return flows(spark, sf_dir).filter("amount > 100").select(F.col("flow_id").alias("seq"), F.col("donor").alias("src"), F.col("recipient").alias("dst"), kind.alias("rel_type"), "amount")


def money_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases among the edges: sparse enough for enumerating paths."""
    return edges(spark, sf_dir).filter("rel_type = 'DonatedTo'")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, entity_type, name, version, created_at, updated_at, data): data is the externally tagged JSON of the entity."""

    def part(name: str, prefix: str, kind: str, key: str, label: Column, extra: Column) -> DataFrame:
        k = F.col(key).cast("bigint")
        made = F.timestamp_add("HOUR", (k % 5000).cast("int"), F.lit("2020-01-01").cast("timestamp_ntz"))
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), k.cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), label.alias("name"), (k % 3 + 1).alias("version"), made.alias("created_at"),
            F.timestamp_add("DAY", (k % 97).cast("int"), made).alias("updated_at"), F.concat(F.lit('{"' + kind + '":{'), extra, F.lit("}}")).alias("data"),
        )

    text = lambda field, c: F.concat(F.lit(f'"{field}":"'), c, F.lit('"'))
    return (
        part("customer", "P", "Person", "c_custkey", F.col("c_name"), F.concat(text("name", F.col("c_name")), F.lit(","), text("segment", F.col("c_mktsegment")), F.lit(',"tags":["customer","n'), F.col("c_nationkey").cast("string"), F.lit('"]')))
        .unionByName(part("supplier", "O", "Organization", "s_suppkey", F.col("s_name"), F.concat(text("name", F.col("s_name")), F.lit(',"tags":["supplier","n'), F.col("s_nationkey").cast("string"), F.lit('"]'))))
        .unionByName(part("orders", "Y", "Payment", "o_orderkey", F.concat(F.lit("payment "), F.col("o_orderkey").cast("string")), text("status", F.col("o_orderstatus"))))
        .unionByName(part("documents", "D", "Document", "doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")), text("source", F.col("source"))))
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_id, src, dst, rel_type, start_date, end_date, version, created_at, amount): customers to suppliers, by line item."""
    start, line = F.to_date("l_shipdate"), F.col("l_linenumber")
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("R"), F.col("l_orderkey").cast("string"), F.lit("-"), line.cast("string")).alias("rel_id"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("O"), F.col("l_suppkey").cast("string")).alias("dst"),
        _pick(F.col("l_returnflag"), {"A": "DonatedTo", "N": "ReceivedContract"}, "LobbiedFor").alias("rel_type"), start.alias("start_date"), F.when(line % 3 != 0, F.date_add(start, (line * 30).cast("int"))).alias("end_date"),
        (line % 2 + 1).cast("bigint").alias("version"), F.col("o_orderdate").alias("created_at"), F.col("l_extendedprice").alias("amount"),
    )


def missing_fields(entities: DataFrame) -> DataFrame:
    """(entity_id, entity_type, field): required fields that entities (entity_id, entity_type, fields map) do not have or leave blank."""
    out = None
    for kind, (required, _) in SCHEMAS.items():
        value = F.try_element_at("fields", F.col("field"))
        rows = entities.filter(F.col("entity_type") == kind).withColumn("field", F.explode(F.array(*map(F.lit, required)))).filter(value.isNull() | (F.trim(value) == ""))
        rows = rows.select("entity_id", "entity_type", "field")
        out = rows if out is None else out.unionByName(rows)
    return out


def new_entities(rows: DataFrame) -> DataFrame:
    """Rows (entity_id, entity_type, fields map) with the defaults of their type and version 1."""
    fields = F.col("fields")
    for kind, values in DEFAULTS.items():
        own = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
        rest = F.map_filter(own, lambda k, v: ~F.map_contains_key("fields", k))
        fields = F.when(F.col("entity_type") == kind, F.map_concat("fields", rest)).otherwise(fields)
    return rows.withColumn("fields", fields).withColumn("version", F.lit(1).cast("bigint"))


def new_relationships(rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows (rel_id, src, dst, rel_type) with version 1 and their dates, null unless given."""
    none = F.lit(None).cast("date")
    return rows.withColumns({"start_date": none if start is None else start, "end_date": none if end is None else end, "version": F.lit(1).cast("bigint")})
