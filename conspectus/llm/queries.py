"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, filter_audit, grid_join
from .bpe import encode_bpe
from .common import table
from .decontaminate import find_leaks
from .html_extract import extract_pages
from .language_id import language_id
from .licenses import oracle as _license_sql
from .licenses import scan_licenses
from .merkle import edited_fingerprints
from .minhash import DOCUMENTS, near_duplicates
from .substring_dedup import passage_clusters, repeated_passages
from .token_files import token_files
from .url_filter import RULES, SOFT, STRICT, THIRDS, filter_urls


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_clusters(repeated_passages(table(spark, sf_dir, "documents")))


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bpe(table(spark, sf_dir, "documents"), with_ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


def _url_sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[0]))

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"

    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[of]}'" for r in rules) + " END"
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bounded = lambda t: f"regexp_matches(low, '(^|[^a-z0-9])({t})([^a-z0-9]|$)')"
    soft = " + ".join(f"CASE WHEN {bounded(t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())
    return f"""
WITH parts AS (
  SELECT page_id, {low} AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, low, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^/[^?#]*') AS path FROM parts
)
SELECT page_id, host, path, {case(0)} AS rule,
       coalesce({case(1)}, CASE WHEN {bounded('|'.join(STRICT))} OR {soft} >= {THIRDS} THEN 'block' ELSE 'allow' END) AS verdict
FROM split"""


def _copies_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= {DOCUMENTS.at} * (x.n + y.n - same)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(id, root) AS (SELECT a, a FROM e2 UNION SELECT e2.b, c.root FROM c JOIN e2 ON e2.a = c.id WHERE c.root < e2.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m.root, d.doc_id), d.doc_id) AS component_id, coalesce(least(m.root, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(root) AS root FROM c GROUP BY 1) m ON m.id = d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": _license_sql(),
        "op2_minhash_dedup": _copies_sql(),
        "op9_url_filter": _url_sql(),
        "op11_filter_audit": filter_audit.oracle(),
        "op12_centroid_clustering": centroids.oracle(),
        "op13_embedding_dedup": grid_join.oracle(),
    }
