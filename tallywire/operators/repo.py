"""The store's query surface: lookups, lists, pages, containment, merges."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str = "entity_id") -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), key)


def by_id(df: DataFrame, value: str, key: str = "entity_id") -> DataFrame:
    return df.filter(F.col(key) == value)


def page(df: DataFrame, offset: int, limit: int, key: str = "entity_id") -> DataFrame:
    """A page of the newest rows; the key breaks ties."""
    return newest(df, key).offset(offset).limit(limit)


def by_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.filter(F.col("entity_type") == kind)


def in_dates(entities: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows whose created_at or updated_at lies within, both ends included."""
    if column not in ("created_at", "updated_at"):
        raise ValueError(f"not a date column: {column}")
    return entities.filter(F.col(column).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def contains(query: str, column: str = "data") -> Column:
    """Whether a JSON column contains the query deeply: all its leaves at their paths, an array's leaves anywhere in the array there."""
    doc = F.try_parse_json(F.col(column))

    def leaves(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{path}.{k}")
        elif isinstance(value, list):
            for v in value:
                yield path, v, True
        else:
            yield path, value, False

    out = F.lit(True)
    for path, value, member in leaves(json.loads(query), "$"):
        kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
        if member:
            out &= F.coalesce(F.array_contains(F.try_variant_get(doc, path, f"array<{kind}>"), value), F.lit(False))
        else:
            out &= F.coalesce(F.try_variant_get(doc, path, kind) == F.lit(value), F.lit(False))
    return out


def type_and_version(entities: DataFrame, kind: str, least: int) -> DataFrame:
    return by_type(entities, kind).filter(F.col("version") >= least).orderBy(F.col("version").desc(), F.col("updated_at").desc(), "entity_id")


def recent(entities: DataFrame, n: int) -> DataFrame:
    return entities.orderBy(F.col("updated_at").desc(), "entity_id").limit(n)


def keyset_page(entities: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """The next rows by (created_at, id), with has_more on each of them."""
    rows = entities
    if after is not None:
        at, key = F.lit(after[0]).cast("timestamp_ntz"), after[1]
        rows = rows.filter((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("entity_id") > key)))
    one_more = rows.orderBy("created_at", "entity_id").limit(limit + 1 if limit > 0 else 0)
    k = one_more.withColumn("k", F.row_number().over(Window.orderBy("created_at", "entity_id"))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return k.filter(F.col("k") <= limit).drop("k")


def total_pages(total: int, size: int) -> int:
    return 0 if size <= 0 else -(-total // size)


def clamp_page(page_no: int, per_page: int) -> tuple[int, int]:
    """(offset, limit) of a page numbered from 1, of 1 to 100 rows."""
    limit = min(max(per_page, 1), 100)
    return max(page_no - 1, 0) * limit, limit


def edges_of(rel: DataFrame, entity: str, way: str) -> DataFrame:
    return rel.filter(F.col("src" if way == "from" else "dst") == entity)


def edges_between(rel: DataFrame, a: str, b: str) -> DataFrame:
    return rel.filter(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a)))


def active_on(rel: DataFrame, date: str) -> DataFrame:
    """Relationships that hold on a date; a missing bound is open, bounds are included."""
    d = F.lit(date).cast("date")
    return rel.filter(F.coalesce(F.col("start_date") <= d, F.lit(True)) & F.coalesce(d <= F.col("end_date"), F.lit(True)))


def like_search(entities: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Rows whose JSON holds the text, letters of either case; % and _ in it stay wildcards."""
    rows = entities if kind is None else by_type(entities, kind)
    return rows.filter(F.col("data").ilike(f"%{text}%"))


def neighbours(rel: DataFrame, entities: DataFrame, entity: str, way: str) -> DataFrame:
    own, other = ("src", "dst") if way == "out" else ("dst", "src")
    e = entities.select(F.col("entity_id").alias(other), "entity_type", "name")
    return rel.filter(F.col(own) == entity).join(e, other).select("rel_id", "rel_type", F.col(other).alias("neighbour"), "entity_type", "name")


def bundle(rel: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """All relationships of an entity that exists, each way."""
    there = by_id(entities, entity).select("entity_id").limit(1)
    out = rel.join(there.withColumnRenamed("entity_id", "src"), "src", "left_semi").withColumn("direction", F.lit("out"))
    into = rel.join(there.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def upsert(stored: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Stored rows with a batch merged in by id: the batch's last row of an id wins, whatever its version; created_at stays."""
    old = stored.select("entity_id", "entity_type", "version", "created_at", "updated_at", "data").withColumns({"rank": F.lit(0), "n": F.lit(-1).cast("bigint")})
    new = batch.select("entity_id", "entity_type", "version", "created_at", "updated_at", "data", F.lit(1).alias("rank"), F.col(order).cast("bigint").alias("n"))
    both = old.unionByName(new)
    at = F.struct("rank", "n")
    row = F.struct("entity_type", "version", "updated_at", "data")
    out = both.groupBy("entity_id").agg(F.max_by(row, at).alias("r"), F.min_by("created_at", at).alias("created_at"))
    return out.select("entity_id", "r.entity_type", "r.version", "created_at", "r.updated_at", "r.data")


def versioned_update(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity_id, outcome, new_version, data): a change applies to a row whose version is one less than its own.

    outcome is 'invalid' (version <= 0), 'missing', 'stale' or 'applied'; data is the stored JSON's top level with the
    change's laid over it, as sorted key:value text, for applied ones.
    """
    s = stored.select("entity_id", F.col("version").alias("old"), F.col("data").alias("old_data"))
    j = changes.join(s, "entity_id", "left")
    outcome = F.when(F.col("version") <= 0, "invalid").when(F.col("old").isNull(), "missing").when(F.col("old") != F.col("version") - 1, "stale").otherwise("applied")
    m = lambda c: F.from_json(F.col(c), "map<string,string>")
    kept = F.map_filter(m("old_data"), lambda k, v: ~F.map_contains_key(m("data"), k))
    merged = F.map_concat(kept, m("data"))
    text = F.array_join(F.transform(F.array_sort(F.map_keys(merged)), lambda k: F.concat(k, F.lit(":"), F.element_at(merged, k))), ",")
    return j.select("entity_id", outcome.alias("outcome"), F.when(outcome == "applied", F.col("version")).otherwise(F.col("old")).alias("new_version"), F.when(outcome == "applied", text).alias("data"))


def cascade_delete(entities: DataFrame, rel: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without the given ids, and relationships without an end among them."""
    gone = ids.select("entity_id").distinct()
    left = rel.join(gone.withColumnRenamed("entity_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("entity_id", "dst"), "dst", "left_anti")
    return entities.join(gone, "entity_id", "left_anti"), left


def insert_new(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch that can be inserted: their id is neither stored nor given twice."""
    once = batch.withColumn("n", F.count("*").over(Window.partitionBy("entity_id"))).filter("n = 1").drop("n")
    return once.join(stored.select("entity_id"), "entity_id", "left_anti")


def orphans(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with an end that is not stored: what a foreign key would refuse."""
    ids = entities.select("entity_id")
    a = rel.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_anti")
    b = rel.join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_anti")
    return a.unionByName(b).distinct()


def faceted(entities: DataFrame, text: str | None = None, kinds: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows that meet all given conditions: text within name or type, type in a list, created within dates."""
    out = entities
    if text:
        out = out.filter(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("entity_type"), F.lit(text.lower())))
    if kinds:
        out = out.filter(F.col("entity_type").isin(*kinds))
    if first:
        out = out.filter(F.to_date("created_at") >= F.lit(first).cast("date"))
    if last:
        out = out.filter(F.to_date("created_at") <= F.lit(last).cast("date"))
    return out
