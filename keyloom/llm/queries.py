"""The queries of the operators in this subpackage: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ads_ann import nearest_neighbours
from .common import table
from .decontaminate import decontaminate
from .pii_feistel import pseudonymise
from .quality_rules import held_out, score_quality
from .rans_tokens import encode_and_read_back, read_checksums
from .simhash_lsh import simhash_near_duplicates
from .stock_packing import pack_documents
from .substring_dedup import rlz_dedup
from .suffix_dedup import suffix_array_dedup
from .url_cascade import judge_urls

_REMOVED = "aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", F.expr(_REMOVED).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.expr(_REMOVED).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(table(spark, sf_dir, "documents"), end_id=2, read=read_checksums)


def op10_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), length=1024, end_id=0)


def op8_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


_OP9_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS n
         FROM urls u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON u.page_id = f.page_id
"""


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The key is a parameter; a real one comes from the caller, not from here.
PII_KEY = "example-key"


def op7_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", "n_replaced")


#: Windows of 50 tokens by doubling; the steps are the same for bytes and words.
_WINDOWS_SQL = """
s2 AS (SELECT *, b || $ || lead(b, 1) OVER o AS x FROM tokens WINDOW o AS (PARTITION BY r ORDER BY p)),
s4 AS (SELECT *, x || $ || lead(x, 2) OVER o AS y FROM s2 WINDOW o AS (PARTITION BY r ORDER BY p)),
s8 AS (SELECT * EXCLUDE (y), y || $ || lead(y, 4) OVER o AS y FROM s4 WINDOW o AS (PARTITION BY r ORDER BY p)),
s16 AS (SELECT * EXCLUDE (y), y || $ || lead(y, 8) OVER o AS y FROM s8 WINDOW o AS (PARTITION BY r ORDER BY p)),
windows AS (SELECT r, id, p, b, y || $ || lead(y, 16) OVER o || $ || lead(y, 32) OVER o || $ || lead(x, 48) OVER o AS w FROM s16 WINDOW o AS (PARTITION BY r ORDER BY p)),
firsts AS (SELECT w, min(id) AS least FROM windows WHERE w IS NOT NULL GROUP BY w),
marked AS (SELECT b.r, b.p, b.b, coalesce(f.least < b.id, false) AS dup FROM windows b LEFT JOIN firsts f ON b.w = f.w),
gone AS (SELECT r, p, b, coalesce(max(CASE WHEN dup THEN p END) OVER (PARTITION BY r ORDER BY p) > p - 50, false) AS g FROM marked)
"""
_OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '..') AS t FROM documents),
tokens AS (SELECT r, id, unnest(t) AS b, unnest(range(len(t))) AS p FROM d), {_WINDOWS_SQL.replace("$", "''")},
edges AS (SELECT r, p, b, g, g AND NOT coalesce(lag(g) OVER (PARTITION BY r ORDER BY p), false) AS begins FROM gone),
done AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (g) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT g), '') AS kept FROM edges GROUP BY r)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN done ON d.r = done.r
"""
_OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
tokens AS (SELECT r, id, unnest(t) AS b, unnest(range(len(t))) AS p FROM d), {_WINDOWS_SQL.replace("$", "' '")},
done AS (SELECT r, count(*) AS n_words, count(*) FILTER (g) AS n_removed, coalesce(string_agg(b, ' ' ORDER BY p) FILTER (NOT g), '') AS kept FROM gone GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done ON d.r = done.r
"""

QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_substring_dedup, op3_template_decontamination, op4_quality_rules, op5_simhash_near_dedup, op6_rans_tokens, op7_pii_feistel, op8_adaptive_scan, op9_url_cascade, op10_stock_packing)}
ORACLE_SQL: dict[str, str] = {"op1_suffix_array_dedup": _OP1_SQL, "op2_substring_dedup": _OP2_SQL, "op9_url_cascade": _OP9_SQL}
