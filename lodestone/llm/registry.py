"""Queries over the whole tables, one for each operator, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import read_table
from .decontaminate import decontaminate
from .jaccard_join import jaccard_components
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .neighbours import nearest
from .packing import pack
from .secrets import digests, scan_secrets
from .urls import judge_urls
from .warc import round_trip

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, read_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(spark, rows, rows.filter("vec_id % 20 = 0"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(spark, docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = read_table(spark, sf_dir, "labels").filter(~quality.held_out())
    return quality.score(spark, docs, quality.train(spark, docs, labels)).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(spark, read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_secret_scan": op10_secret_scan,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, w[i : i + least(13, len(w)) - 1] AS v FROM b, LATERAL unnest(range(1, greatest(2, len(w) - 11))) t(i) WHERE len(w) > 0),
n AS (SELECT DISTINCT len(v) AS n FROM v),
s AS (SELECT doc_id, n, i, w[i : i + n - 1] AS s FROM d, n, LATERAL unnest(range(1, len(w) - n + 2)) t(i)),
h AS (SELECT doc_id, item, i, n FROM s JOIN v ON s = v),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, LATERAL unnest(range(0, n)) t(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s FROM d, LATERAL unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)""",
    "op7_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY ALL)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h AND p.n = m.n""",
    "op8_line_dedup": f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), l AS (SELECT doc_id, i, x[i] AS line FROM t, LATERAL unnest(range(1, len(x) + 1)) r(i)),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN h ON k.key = h.key GROUP BY doc_id""",
}
