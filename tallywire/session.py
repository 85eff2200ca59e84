"""Sessions, shipping this package to executors, and cutting the lineage of iterative plans."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def session(name: str = "tallywire", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything else is the cluster's to set."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> bool:
    """Send this package along as a zip, so executors need no copy of the repository. True the first time in an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return False
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    out = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.join(name, os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
    return True


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """df, read back from the checkpoint folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a row's place from 0 on in an order of columns, without bringing all rows into one task.

    Rows are dealt out by ranges of the order; a range's rows are numbered by themselves and begin where the ranges
    before it end. The ranges are written first, since a second run could draw them elsewhere.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(ranges.select("_range", ahead.alias("_ahead")))  # a row for each partition
    k = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_k", k).join(starts, "_range").withColumn(name, (F.col("_k") + F.col("_ahead")).cast("bigint")).drop("_range", "_k", "_ahead")
