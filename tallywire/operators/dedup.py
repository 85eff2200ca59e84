"""Records and persons that are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.names import may_reach, name_parts, part_similarity, similar_parts
from ..session import cut


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. min_by adds up before the shuffle, so a frequent key is no large group."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r")).select(key, "r.*").select(*df.columns)


def content_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(content_hash, first_id, copies) of each distinct content."""
    return docs.groupBy(F.sha2(F.col(text_col).cast("string"), 256).alias("content_hash")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))


def with_fingerprint(records: DataFrame) -> DataFrame:
    return records.withColumn("fingerprint", N.fingerprint(F.col("source_type"), F.col("fields")))


def dedup_records(records: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Records (seq, source_type, fields), the first of each fingerprint, without those whose fingerprint was seen in earlier batches."""
    out = first_of(with_fingerprint(records), "fingerprint", "seq")
    return out if seen is None else out.join(seen.select("fingerprint"), "fingerprint", "left_anti")


def dedup_stats(records: DataFrame) -> DataFrame:
    r = with_fingerprint(records).agg(F.count("*").alias("total_seen"), F.count_distinct("fingerprint").alias("unique_passed"))
    return r.select("total_seen", (F.col("total_seen") - F.col("unique_passed")).alias("duplicates_skipped"), "unique_passed")


def person_matches(new: DataFrame, existing: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(new_id, existing_id, confidence, reason) of persons (id, name, birth_date) that may be one.

    Confidence is the mean similarity of first and last names. One birth date on both sides makes it 0.95 at least,
    different ones take it down by 0.3 of itself. Rows below the threshold are left out.

    Distinct names are compared, not persons, and of their parts first: a mean reaches the threshold only if one part
    does, and the other twice the threshold less one. Pairs of parts that may reach the threshold meet by
    `similar_parts`; the other part of their names is held against its own bound before the similarity is worked out.
    Equal birth dates are a join of their own. Nothing is compared all against all.
    """
    first, last = name_parts(F.col("name"))
    a, b = (d.select("id", "birth_date", first.alias("first"), last.alias("last")) for d in (new, existing))
    ends = lambda d, s: d.select(F.col("first").alias(f"first_{s}"), F.col("last").alias(f"last_{s}")).distinct()
    na, nb = cut(ends(a, "a")), cut(ends(b, "b"))
    met = None
    for part, other in (("last", "first"), ("first", "last")):
        near = similar_parts(na.select(F.col(f"{part}_a").alias("a")), nb.select(F.col(f"{part}_b").alias("b")), threshold)
        near = near.select(F.col("a").alias(f"{part}_a"), F.col("b").alias(f"{part}_b"))
        got = na.join(near, f"{part}_a").join(nb, f"{part}_b").filter(may_reach(F.col(f"{other}_a"), F.col(f"{other}_b"), 2 * threshold - 1))
        got = got.select("first_a", "last_a", "first_b", "last_b")
        met = got if met is None else met.union(got).distinct()
    scored = met.withColumn("sim", (part_similarity(F.col("first_a"), F.col("first_b")) + part_similarity(F.col("last_a"), F.col("last_b"))) / 2).filter(F.col("sim") >= threshold)
    pa = a.select(F.col("id").alias("new_id"), F.col("birth_date").alias("born_a"), F.col("first").alias("first_a"), F.col("last").alias("last_a"))
    pb = b.select(F.col("id").alias("existing_id"), F.col("birth_date").alias("born_b"), F.col("first").alias("first_b"), F.col("last").alias("last_b"))
    by_name = pa.join(scored, ["first_a", "last_a"]).join(pb, ["first_b", "last_b"]).select("new_id", "existing_id", "born_a", "born_b", "sim")
    born = pa.join(pb, F.col("born_a") == F.col("born_b"))
    by_date = born.withColumn("sim", (part_similarity(F.col("first_a"), F.col("first_b")) + part_similarity(F.col("last_a"), F.col("last_b"))) / 2).filter(F.col("sim") < threshold).select("new_id", "existing_id", "born_a", "born_b", "sim")
    same, known = F.col("born_a") == F.col("born_b"), F.col("born_a").isNotNull() & F.col("born_b").isNotNull()
    conf = F.when(known & same, F.greatest(F.col("sim"), F.lit(0.95))).when(known & (F.col("sim") >= threshold), F.col("sim") * 0.7).otherwise(F.col("sim"))
    why = F.concat_ws(", ", F.when(F.col("sim") >= threshold, F.concat(F.lit("name similarity "), F.format_string("%.2f", "sim"))), F.when(known & same, F.lit("birth_date match")))
    return by_name.unionByName(by_date).withColumn("confidence", conf).filter(F.col("confidence") >= threshold).select("new_id", "existing_id", "confidence", why.alias("reason"))
