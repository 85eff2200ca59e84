"""From raw documents to packed training sequences: each stage calls one operator on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywire.llm.common import delete, discard, stash, table, tracked, with_rows
from tallywire.llm.decontaminate import contaminated
from tallywire.llm.exact_dedup import exact_dedup
from tallywire.llm.minhash import near_duplicates
from tallywire.llm.packing import pack
from tallywire.llm.quality import perplexity_verdicts

#: What a stage calls the numbers of its rows; they are gone from what it returns.
ROW = "_row"

# Stages decide by row, not by id: each numbers its rows, in a written table, and drops those whose numbers its operator
# rejects. So rows without an id, and rows that share one, are documents of their own in every stage, rows that repeat a
# document are copies of it, and a stage without rows gives none. Null and empty texts are kept by the first stage, are
# equal to each other in the second, and hold no item in the fourth. A stage's result is to be written before the next
# stage is called, as run() does: then what it is read from is deleted.


_left: dict[str, list[str]] = {}


def _stage(f):
    """A stage over numbered rows. What the stage called before it has left in the shared folder is deleted once its own rows are written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        with tracked() as made:
            rows = with_rows(docs, ROW)
            delete(spark, _left.pop(app, []))
            rejected = f(spark, rows, sf_dir)
        _left[app] = made
        return rows.join(rejected.select(ROW).distinct(), ROW, "left_anti").drop(ROW)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    return perplexity_verdicts(docs, table(spark, sf_dir, "labels"), row_col=ROW).filter("not kept")


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id."""
    return exact_dedup(docs, row_col=ROW).filter("not kept")


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles, similarity 0.8."""
    return near_duplicates(docs, row_col=ROW).filter("not kept")


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contaminated(docs, table(spark, sf_dir, "benchmark"), row_col=ROW)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]

#: Perplexities, sketches and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage keeps is written to the shared folder and read again, and goes when the next stage is done."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    delete(spark, _left.pop(spark.sparkContext.applicationId, []))
    return docs
