"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _listing(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of the pages: the tables have no list of their own.

    By the MD5 of a host: those that begin with 0-3 are blocked from a day of 2024 on, 0 and 1 of them only for 200
    days; 4 and 5 have their /fr pages blocked and 6 are allowed. The domain example.org is blocked, allowed for a
    while, and let go.
    """
    from .url_filters import url_host

    hosts = pages.select(url_host(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("h", F.md5("host"))
    sign, day = F.substring("h", 1, 1), F.conv(F.substring("h", 2, 2), 16, 10).cast("int")
    on = F.date_add(F.lit("2024-01-01").cast("date"), day)
    make = lambda kind, value, action, at: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), at.alias("listed_on"))
    of = F.array_compact(F.array(
        F.when(sign.isin(*"0123"), make("domain", F.col("host"), "block", on)), F.when(sign.isin(*"01"), make("domain", F.col("host"), "remove", F.date_add(on, 200))),
        F.when(sign.isin(*"45"), make("prefix", F.concat("host", F.lit("/fr")), "block", on)), F.when(sign == "6", make("domain", F.col("host"), "allow", on)),
    ))
    spark = pages.sparkSession
    fixed = spark.sql("SELECT * FROM VALUES ('domain', 'example.org', 'block', DATE '2024-03-01'), ('domain', 'example.org', 'allow', DATE '2024-09-01'), ('domain', 'example.org', 'remove', DATE '2025-02-01') AS t(kind, value, action, listed_on)")
    return hosts.select(F.explode(of).alias("e")).select("e.*").unionByName(fixed)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the listing; a page counts as fetched on day page_id % 600 from 2024-01-01 on."""
    from .url_filters import url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 600).cast("int")))
    out = url_filter(captures, _listing(pages))
    return out.select("page_id", "url", "fetched_on", "host", "n_active", "decision", "matched_kind", "matched_value", "valid_from", "valid_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    got = round_trip(table(spark, sf_dir, "pages"))
    gap = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", "offset", "reason"))  # nothing has damaged these archives
    got = got.withColumn("record_id", F.when(F.col("kind") == "gap", gap).otherwise(F.col("record_id")))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import perplexity_verdicts

    return perplexity_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH u AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 600 AS INTEGER) AS fetched_on,
                  regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
                  regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS h FROM u WHERE host <> ''),
d AS (SELECT host, substr(h, 1, 1) AS sign, DATE '2024-01-01' + CAST('0x' || substr(h, 2, 2) AS INTEGER) AS since FROM h),
e AS (SELECT 'domain' AS kind, host AS value, 'block' AS action, since FROM d WHERE sign IN ('0', '1', '2', '3')
      UNION ALL SELECT 'domain', host, 'remove', since + 200 FROM d WHERE sign IN ('0', '1')
      UNION ALL SELECT 'prefix', host || '/fr', 'block', since FROM d WHERE sign IN ('4', '5')
      UNION ALL SELECT 'domain', host, 'allow', since FROM d WHERE sign = '6'
      UNION ALL SELECT 'domain', 'example.org', 'block', DATE '2024-03-01'
      UNION ALL SELECT 'domain', 'example.org', 'allow', DATE '2024-09-01'
      UNION ALL SELECT 'domain', 'example.org', 'remove', DATE '2025-02-01'),
i AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM e),
m AS (SELECT u.page_id, i.*, CASE WHEN kind = 'prefix' THEN 900000 ELSE len(string_split(value, '.')) END AS rank
      FROM u JOIN i ON i.action <> 'remove' AND i.since <= u.fetched_on AND (i.until IS NULL OR u.fetched_on < i.until)
       AND ((i.kind = 'domain' AND (u.host = i.value OR ends_with(u.host, '.' || i.value)))
         OR (i.kind = 'prefix' AND u.host || regexp_extract(u.path, '^(/[^/]*)', 1) = i.value))
      WHERE u.host <> ''),
b AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, kind DESC, value DESC) AS k FROM m)
SELECT u.page_id, u.url, u.fetched_on, nullif(u.host, '') AS host, coalesce(b.n, 0) AS n_active, coalesce(b.action, 'none') AS decision,
       b.kind AS matched_kind, b.value AS matched_value, b.since AS valid_from, b.until AS valid_to
FROM u LEFT JOIN b ON u.page_id = b.page_id AND b.k = 1
"""

OP5_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM q
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    got = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return got.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, personal_data

    got = personal_data(table(spark, sf_dir, "documents"))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *(count(k) for k in KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

#: Two documents of the query's bound are a candidate with a probability of all but 1e-6; here all pairs with a common shingle are.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id > b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(generate_series(0, n - 100)) AS s FROM d WHERE n >= 100)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM f)),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM r UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_minhash, op3_packing, op4_exact_dedup, op5_warc, op6_suffix_dedup, op7_personal_data, op8_token_counts, op9_quality, op10_decontamination)}
ORACLES = {"op1_url_filters": OP1_SQL, "op2_minhash": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op6_suffix_dedup": OP6_SQL}
