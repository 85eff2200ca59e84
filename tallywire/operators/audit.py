"""A hash-chained log of changes, and files addressed by their content."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import numbered

GENESIS = "0" * 64


def rfc3339(ts: Column) -> Column:
    """A time in UTC with whole seconds."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _entry() -> Column:
    """What an entry puts into its hash ahead of the hash before it: ids as their bytes, the rest as text."""
    raw = lambda c: F.unhex(F.replace(F.col(c), F.lit("-"), F.lit("")))
    text = lambda c: F.encode(c, "utf-8")
    return F.concat(raw("id"), text(rfc3339(F.col("timestamp"))), text(F.col("operation")), text(F.col("entity_type")), raw("entity_id"), text(F.col("data_hash")))


def entry_hash(prev: Column) -> Column:
    """SHA-256 over an entry's id, time, operation, type, entity, data hash and the hash before it."""
    return F.sha2(F.concat(_entry(), F.encode(prev, "utf-8")), 256)


def append(entries: DataFrame, last: str = GENESIS) -> DataFrame:
    """Adds prev_hash and entry_hash. Each hash needs the one before it, so the log is one chain by nature.

    What an entry adds to the chain is made ready by all tasks. One task then walks over these short parts in order and
    writes the hashes out as it goes, holding a batch: the sort before it spills, and nothing comes to the driver.
    """
    heads = entries.select("seq", _entry().alias("_head")).repartition(1).sortWithinPartitions("seq")

    def run(batches):
        now = last
        for b in batches:
            prev, own = [], []
            for head in b.column(1).to_pylist():
                prev.append(now)
                now = hashlib.sha256(bytes(head) + now.encode()).hexdigest()
                own.append(now)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(prev, pa.string()), pa.array(own, pa.string())], ["seq", "prev_hash", "entry_hash"])

    return entries.join(heads.mapInArrow(run, "seq bigint, prev_hash string, entry_hash string"), "seq")


def verify(log: DataFrame) -> DataFrame:
    """(seq, link_ok, hash_ok): whether an entry follows on the one before it, and whether its hash is its own.

    All in parallel: entries are numbered by ranges, and each meets the one before it in a join on the number.
    """
    rows = numbered(log, "_i", "seq")
    before = rows.select((F.col("_i") + 1).alias("_i"), F.col("entry_hash").alias("_before"))
    link = F.col("prev_hash") == F.coalesce("_before", F.lit(GENESIS))
    return rows.join(before, "_i", "left").select("seq", link.alias("link_ok"), (F.col("entry_hash") == entry_hash(F.col("prev_hash"))).alias("hash_ok"))


def summary(log: DataFrame) -> DataFrame:
    v = verify(log).agg(F.count("*").alias("total_entries"), F.coalesce(F.bool_and(F.col("link_ok") & F.col("hash_ok")), F.lit(True)).alias("chain_valid"))
    return v.withColumn("status", F.when(F.col("chain_valid"), "valid").otherwise("invalid"))


def archive_mismatches(files: DataFrame) -> DataFrame:
    """(path) of files (path, content) whose name is not the SHA-256 of what is in them."""
    return files.filter(F.sha2("content", 256) != F.substring_index("path", "/", -1)).select("path")


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return archive_mismatches(files.filter(~F.contains("path", F.lit("/merkle/"))))


def store_path(digest: Column) -> Column:
    """Where content of a hash is kept: two levels of folders by its first letters."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def merkle_hash(nodes: DataFrame) -> DataFrame:
    """(id, hash) of nodes (id, children array of hashes, data binary): SHA-256 of the sorted child hashes, then the data."""

    def run(batches):
        for b in batches:
            out = [hashlib.sha256("".join(sorted(c or [])).encode() + (d or b"")).hexdigest() for c, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "hash"])

    return nodes.select(F.col("id").cast("string"), "children", "data").mapInArrow(run, "id string, hash string")


def merkle_broken(nodes: DataFrame) -> DataFrame:
    """(id) of nodes whose hash is not their content's, or with a child that is not stored."""
    wrong = nodes.join(merkle_hash(nodes).withColumnRenamed("hash", "own"), "id").filter("hash <> own").select("id")
    child = nodes.select("id", F.explode("children").alias("hash"))
    return wrong.union(child.join(nodes.select("hash"), "hash", "left_anti").select("id")).distinct()
