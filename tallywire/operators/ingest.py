"""From raw records to normalized ones: cap, de-duplicate, validate, normalize."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..session import numbered
from .dedup import dedup_records


def validation_errors(records: DataFrame, required: list[str]) -> DataFrame:
    """(record_index, field, reason) of required fields that are missing or blank. Validation drops no record."""
    value = F.try_element_at("fields", F.col("field"))
    r = records.select("record_index", "fields", F.explode(F.array(*map(F.lit, required))).alias("field"))
    return r.filter(value.isNull() | (F.trim(value) == "")).select("record_index", "field", F.when(value.isNull(), "missing").otherwise("empty").alias("reason"))


def indexed(records: DataFrame) -> DataFrame:
    """Records numbered from 0 in order of arrival."""
    return numbered(records, "record_index", "seq")


def normalized(records: DataFrame, names: list[str], amounts: list[str], dates: list[str], states: list[str]) -> DataFrame:
    """Fields of the given kinds in their normal form; a value that has none stays as it is."""

    def one(k, v):
        out = F.when(k.isin(*names), N.person_name(v)) if names else F.when(F.lit(False), v)
        for group, f in ((amounts, lambda x: N.plain_number(N.dollar_amount(x))), (dates, lambda x: N.calendar_date(x).cast("string")), (states, N.state_code)):
            if group:
                out = out.when(k.isin(*group), F.coalesce(f(v), v))
        return out.otherwise(v)

    return records.withColumn("fields", F.transform_values("fields", one))


def pipeline(records: DataFrame, required: list[str], cap: int = 1000, seen: DataFrame | None = None, **kinds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(normalized records, errors, counters) of the first `cap` records by arrival; the index counts what de-duplication left."""
    taken = records.orderBy("seq").limit(cap)
    kept = indexed(dedup_records(taken, seen))
    errors = validation_errors(kept, required)
    out = normalized(kept, kinds.get("names", []), kinds.get("amounts", []), kinds.get("dates", []), kinds.get("states", []))
    count = lambda d, n: d.agg(F.count("*").alias(n))
    counters = count(taken, "taken").crossJoin(count(kept, "processed")).crossJoin(count(errors, "validation_errors")).select("processed", (F.col("taken") - F.col("processed")).alias("skipped_duplicate"), "validation_errors")
    return out, errors, counters
