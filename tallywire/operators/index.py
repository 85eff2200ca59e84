"""A search index that is kept: postings by shard of the term, written batch by batch.

A batch's files are visible once it is committed; a document's latest batch counts, and a deletion is a batch's row too.
A search reads the shards of its terms and the table of documents, not the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import B, FIELDS, K1, field_text, tokens, words_of

SHARDS = 256


def _shard(term):
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def append(docs: DataFrame, path: str, version: int, deleted: DataFrame | None = None) -> None:
    """Index a batch (entity_id, entity_type, name, content, tags, date) as `version`; `deleted` has entity_ids that go.

    Run again with its version, a batch replaces itself: a retried micro-batch is indexed once. Of several rows of one
    entity in a batch one counts.
    """
    docs = docs.dropDuplicates(["entity_id"])
    words = {f: tokens(field_text(f)) for f in FIELDS}
    sizes = docs.select("entity_id", "entity_type", "name", "date", F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*(F.size(words[f]) for f in FIELDS))).alias("lengths"), F.lit(False).alias("gone"))
    if deleted is not None:
        names = deleted.select("entity_id").distinct().join(docs.select("entity_id"), "entity_id", "left_anti")
        sizes = sizes.unionByName(names.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    each = reduce(DataFrame.unionAll, (docs.select("entity_id", F.lit(f).alias("field"), F.explode(words[f]).alias("term")) for f in FIELDS))
    postings = each.groupBy("entity_id", "field", "term").agg(F.count("*").alias("tf")).withColumn("shard", _shard("term"))
    postings.repartition("shard").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings/version={version}")
    sizes.write.mode("overwrite").parquet(f"{path}/documents/version={version}")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, version, entity_type, name, date, lengths) of the documents that are indexed now."""
    rows = spark.read.parquet(f"{path}/documents")
    rest = [c for c in rows.columns if c not in ("entity_id", "version")]
    last = rows.groupBy("entity_id").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("r"))
    return last.select("entity_id", "version", "r.*").filter("not gone").drop("gone")


def search(spark: SparkSession, path: str, query: str, limit: int = 10, kind: str | None = None, every: bool = True) -> DataFrame:
    """(entity_id, entity_type, name, score): as operators.search.search over the documents that are indexed now."""
    now = documents(spark, path)
    words = words_of(query)
    if not words:
        return now.limit(0).select("entity_id", "entity_type", "name", F.lit(0.0).alias("score"))
    shards = [r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(_shard("term")).collect()]
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("shard").isin(shards) & F.col("term").isin(words))
    hits = hits.join(now, ["entity_id", "version"]).withColumn("len", F.element_at("lengths", F.col("field")))
    fields = now.select(F.explode("lengths").alias("field", "len")).groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df")).join(fields, "field")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    found = hits.join(F.broadcast(df), ["field", "term"]).groupBy("entity_id", "entity_type", "name").agg(F.sum(part).alias("score"), F.count_distinct("term").alias("terms"))  # a row for each field and word
    found = found.filter(F.col("terms") == len(words)) if every else found
    found = found if kind is None else found.filter(F.col("entity_type") == kind)
    return found.orderBy(F.round("score", 6).desc(), "entity_id").limit(max(limit, 1)).select("entity_id", "entity_type", "name", "score")
