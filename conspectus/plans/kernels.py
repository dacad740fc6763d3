"""Kernel queries over the driver's tables, each beside the SQL of an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import relational as R
from ..operators import search as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WEIGHT = "CASE WHEN confidence > 0.85 THEN 'strong' WHEN confidence > 0.5 THEN 'moderate' WHEN confidence > 0.2 THEN 'weak' ELSE 'info' END"
NOW = 1_000_000_000


@query(f"""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS total_count, count(*) FILTER (WHERE l_discount >= 0.05) AS adoption_count FROM lineitem GROUP BY ALL)
SELECT *, round(adoption_count / total_count, 6) AS confidence, {WEIGHT.replace('confidence', 'round(adoption_count / total_count, 6)')} AS weight FROM g""")
def A1_A2_adoption_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return R.adoption(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") >= 0.05)


@query(f"""WITH d AS (SELECT o_orderpriority, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS s FROM orders),
p AS (SELECT o_orderpriority, CAST(quantile_disc(s, 0.9) AS BIGINT) AS p90 FROM d GROUP BY 1)
SELECT *, CASE WHEN p90 IS NULL THEN 'unknown' WHEN greatest({NOW} - p90, 0) // 86400 < 90 THEN 'rising' WHEN greatest({NOW} - p90, 0) // 86400 < 365 THEN 'stable' ELSE 'declining' END AS trend FROM p""")
def A3_trend_p90(spark: SparkSession, sf: str) -> DataFrame:
    s = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    return R.trend_by(t(spark, sf, "orders").select("o_orderpriority", s.alias("s")), ["o_orderpriority"], "s", NOW)


@query("SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 20")
def A4_evidence_sample_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return R.ranked(rows, ["l_partkey"], [F.asc("l_orderkey"), F.asc("l_linenumber")], 20)


@query("SELECT p_brand, p_partkey, round FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS round FROM part) ORDER BY round, p_brand LIMIT 20")
def W4_diverse_sample(spark: SparkSession, sf: str) -> DataFrame:
    return R.diverse_sample(t(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", [F.asc("p_partkey")], 20)


@query("SELECT lang, count(*) AS files FROM documents GROUP BY 1")
def A6_language_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "lang")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def A7_state_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return R.pivot_counts(t(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("""WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS k FROM n)
SELECT p_type, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS total, max(p_brand) FILTER (WHERE k = 1) AS most_used, max(n) FILTER (WHERE k = 1) AS uses FROM r GROUP BY 1""")
def A8_domain_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return R.most_used(t(spark, sf, "part"), "p_type", "p_brand")


@query("""WITH g AS (SELECT source, round(avg(quality), 6) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT count(*) FILTER (WHERE c > 0.85) AS high, count(*) FILTER (WHERE c >= 0.5 AND c <= 0.85) AS medium, count(*) FILTER (WHERE c < 0.5) AS low FROM g""")
def A9_confidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("c"))
    return c.agg(F.count_if(F.col("c") > 0.85).alias("high"), F.count_if((F.col("c") >= 0.5) & (F.col("c") <= 0.85)).alias("medium"), F.count_if(F.col("c") < 0.5).alias("low"))


@query("SELECT source, min(doc_id) AS id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def A10_module_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("id"), F.min_by("lang", "doc_id").alias("lang"))


@query("SELECT doc_id, count(*) FILTER (WHERE quality = 1) AS compliance FROM labels GROUP BY 1 HAVING count(*) FILTER (WHERE quality = 1) > 0")
def A11_compliance_counts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "labels").where("quality = 1").groupBy("doc_id").agg(F.count("*").alias("compliance"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY 1")
def A12_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query("""SELECT l_partkey, l_suppkey, count(*) AS site_count, array_to_string(list_sort(list(l_orderkey)), ',') AS lines, CAST(sum(count(*)) OVER (PARTITION BY l_partkey) AS BIGINT) AS total
FROM lineitem GROUP BY l_partkey, l_suppkey QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) <= 5""")
def A13_T7_call_site_agg(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    top = R.top_groups(lines, ["l_partkey"], "l_suppkey", 5)
    return R.gathered(lines, top, ["l_partkey", "l_suppkey"], "l_orderkey", "lines").withColumn("lines", F.array_join("lines", ","))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages, count(*) AS file_count FROM documents GROUP BY 1")
def A19_module_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"), F.count("*").alias("file_count"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def J1_pending_review_anti(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT least(a.c_custkey, b.c_custkey) AS lo, greatest(a.c_custkey, b.c_custkey) AS hi FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND abs(a.c_custkey - b.c_custkey) BETWEEN 1 AND 50")
def J2_U9_contradiction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_custkey") / 50).alias("cell"))
    near = c.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1)))
    other = c.select(F.col("c_custkey").alias("other"), "c_nationkey", "c_mktsegment", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    return R.unordered_pairs(near.join(other, ["c_nationkey", "c_mktsegment", "cell"]).where(F.abs(F.col("c_custkey") - F.col("other")).between(1, 50)), "c_custkey", "other")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def J3_X36_json_unnest_count(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') GROUP BY 1")
def J5_exists_count(spark: SparkSession, sf: str) -> DataFrame:
    urgent = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey", "c_nationkey").join(urgent, "c_custkey", "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


_PATHS = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT page_id, string_split({_PATHS}, '/') AS parts FROM pages),
s AS (SELECT page_id, array_to_string(parts, '/') AS path, array_to_string(list_slice(parts, i, len(parts)), '/') AS suffix FROM p, unnest(range(1, len(parts) + 1)) AS u(i))
SELECT suffix, min(path) AS path FROM s GROUP BY 1""")
def J4_J6_suffix_index(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return R.suffix_index(t(spark, sf, "pages").select(path.alias("path")))


@query("""WITH c AS (SELECT n_nationkey, unnest([n_name || '_X', r_name, n_name]) AS candidate, unnest([0, 1, 2]) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT r_name AS known FROM region UNION SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)
SELECT n_nationkey, arg_min(candidate, pos) AS resolved FROM c JOIN k ON candidate = known GROUP BY 1""")
def J7_first_candidate_resolution(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = t(spark, sf, "nation"), t(spark, sf, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.array(F.concat("n_name", F.lit("_X")), "r_name", "n_name").alias("candidates"))
    known = region.select(F.col("r_name").alias("known")).unionAll(nation.where("n_nationkey % 2 = 0").select("n_name"))
    return R.first_candidate(rows, "n_nationkey", "candidates", known, "known").select("n_nationkey", "resolved")


@query("""WITH o AS (SELECT o_orderkey % 1000 AS k, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'deleted' WHEN o.o_totalprice <> n.o_totalprice THEN 'modified' ELSE 'unchanged' END AS status
FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey""")
def J9_U4_tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    return R.tree_diff(o.where("o_orderkey % 3 <> 0"), new, "o_orderkey", "o_totalprice").select("o_orderkey", "status")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 + 1 AS e FROM events)
SELECT a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e""")
def J10_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = t(spark, sf, "events").select("event_id", "user_id", s.alias("s"), (s + F.floor(F.col("value") * 60).cast("bigint") * 1000000 + 1).alias("e"))
    return R.interval_overlap(e, e, ["user_id"], ("s", "e"), ("s", "e")).where("a.event_id < b.event_id").select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_-]+'), lambda w: length(w) >= 2))"


@query(f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents), b AS (SELECT item_id, {_TOK.format('text')} AS w FROM benchmark),
dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d), bt AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b)
SELECT doc_id, item_id, count(*) AS common, round(count(*) / (dt.n + bt.n - count(*)), 6) AS similarity FROM dt JOIN bt USING (t) GROUP BY doc_id, item_id, dt.n, bt.n HAVING count(*) / (dt.n + bt.n - count(*)) >= 0.15""")
def J11_X17_X19_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    tok = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_-]+"), lambda w: F.length(w) >= 2)).alias("w")
    out = R.jaccard_join(R.spread(t(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tok), t(spark, sf, "benchmark").select("item_id", tok), "doc_id", "item_id", "w", "w", 0.15)
    return out.withColumn("similarity", F.round("similarity", 6))


_TRADE = "SELECT DISTINCT s_nationkey AS importer, c_nationkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45 AND s_nationkey <> c_nationkey"


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_suppkey", "l_linenumber")
    owners = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    suppliers = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines.join(owners, "l_orderkey").join(suppliers, "l_suppkey").select(F.col("s_nationkey").alias("importer"), F.col("c_nationkey").alias("target"), F.col("c_mktsegment").alias("name"), F.col("l_linenumber").alias("line"))


@query("""SELECT s_nationkey AS importer, c_nationkey AS target, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS names, min(l_linenumber) AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45 AND s_nationkey <> c_nationkey GROUP BY 1, 2""")
def A15_reverse_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return G.reverse_adjacency(_trade(spark, sf)).withColumn("names", F.array_join("names", ","))


@query(f"""WITH RECURSIVE e AS ({_TRADE}), b(node, depth) AS (SELECT 2, 0 UNION SELECT e.importer, b.depth + 1 FROM b JOIN e ON e.target = b.node WHERE b.depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node HAVING min(depth) > 0""")
def G1_bfs_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return G.dependents(_trade(spark, sf).select("importer", "target"), spark.range(2, 3).select(F.col("id").cast("int").alias("node")), 3).select("node", "depth")


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey, max(n) AS worst, CAST(sum(n) AS BIGINT) AS total, CASE WHEN max(n) > 20 THEN 'high' WHEN max(n) >= 5 THEN 'medium' ELSE 'low' END AS risk FROM n GROUP BY 1""")
def X29_A16_blast_tiers(spark: SparkSession, sf: str) -> DataFrame:
    per = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = t(spark, sf, "nation").join(per, "n_nationkey", "left").select("n_regionkey", F.coalesce("n", F.lit(0)).alias("n"))
    return n.groupBy("n_regionkey").agg(F.max("n").alias("worst"), F.sum("n").alias("total")).withColumn("risk", T.blast_tier("worst"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def W1_dedupe_best_rank(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("rank")


_BUCKET = "CASE WHEN l_returnflag = 'R' THEN 'rule' WHEN l_discount > 0.08 THEN 'confirmed' WHEN l_tax > 0.06 THEN 'observation' ELSE 'other' END"


@query(f"SELECT bucket, l_orderkey, l_linenumber FROM (SELECT {_BUCKET} AS bucket, * FROM lineitem) QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 10")
def U10_T4_bucket_partition(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").withColumn("bucket", F.expr(_BUCKET))
    return R.ranked(rows, ["bucket"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10).select("bucket", "l_orderkey", "l_linenumber")


def _score(tok: str, col: str = "p_name") -> str:
    return f"CASE WHEN lower({col}) = '{tok}' THEN 1.0 WHEN lower({col}) LIKE '{tok}%' THEN 0.7 WHEN lower({col}) LIKE '%{tok}%' THEN 0.4 ELSE 0.0 END"


@query(f"SELECT p_partkey, CAST(greatest({_score('small')}, {_score('ring')}, {_score('red widget')}) AS DOUBLE) AS score FROM part WHERE greatest({_score('small')}, {_score('ring')}, {_score('red widget')}) > 0")
def U3_X8_W2_merge_max_score(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select("p_partkey", "p_name")
    return R.best_of([S.name_search(p, "p_name", ["small", "ring"]), S.name_search(p, "p_name", ["red widget"])], ["p_partkey"], "score").select("p_partkey", "score")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%reserved%'")
def F5_keyword_or_search(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").where(S.any_keyword(F.col("text"), ["License", "reserved", "x"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' AND lower(text) LIKE '%apache%' AND lower(text) LIKE '%under%'")
def F6_keyword_and_search(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").where(S.all_keywords(F.col("text"), ["license", "apache", "under"])).select("doc_id")


@query("WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '%') ELSE p_name END AS n FROM part) SELECT p_partkey, contains(n, '_r') AS underscore, contains(n, '%w') AS percent FROM n")
def F7_escaped_contains(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "part").withColumn("n", F.expr("CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '%') ELSE p_name END"))
    return n.select("p_partkey", S.contains_literally(F.col("n"), "_r").alias("underscore"), S.contains_literally(F.col("n"), "%w").alias("percent"))


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def F8_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name")


@query("""WITH f(focus) AS (VALUES ('zzz'), ('7')), m AS (SELECT *, count(*) FILTER (WHERE contains(s_name, focus)) OVER (PARTITION BY focus) AS hits FROM supplier CROSS JOIN f)
SELECT focus, s_suppkey, hits > 0 AS focus_matched FROM m WHERE hits = 0 OR contains(s_name, focus)""")
def F10_W5_focus_fallback(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name")
    one = lambda focus: R.focused(s, F.col("s_name").contains(focus)).select(F.lit(focus).alias("focus"), "s_suppkey", "focus_matched")
    return one("zzz").unionAll(one("7"))


_DT = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> ''))"


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_DT}, lambda w: starts_with(w, 'licens'))) > 0 AND len(list_filter({_DT}, lambda w: starts_with(w, 'und'))) > 0")
def S1_fts_prefix_and(spark: SparkSession, sf: str) -> DataFrame:
    return S.prefix_search(t(spark, sf, "documents"), "text", "licens* und").select("doc_id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(least(list_cosine_similarity(embedding::DOUBLE[], q), 1.0), 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def S3_X23_cosine_search(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings")
    return S.vector_top(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 20)


def _case_sql(c: str) -> str:
    n = f"regexp_replace(regexp_replace({c}, '^_+', ''), '_+$', '')"
    m = lambda p: f"regexp_matches({n}, '{p}')"
    return f"""CASE WHEN {n} IS NULL OR {n} = '' THEN 'unknown' WHEN {m('-')} AND NOT {m('_')} AND NOT {m('[A-Z]')} THEN 'kebab-case'
WHEN {m('[A-Z]')} AND NOT {m('[a-z]')} AND {m('_')} THEN 'SCREAMING_SNAKE_CASE' WHEN {m('[A-Z]')} AND NOT {m('[a-z]')} AND {m('^[A-Z0-9]+$')} THEN 'UPPER'
WHEN {m('_')} AND NOT {m('[A-Z]')} THEN 'snake_case' WHEN {m('^[A-Z]')} AND {m('[a-z]')} AND NOT {m('[_-]')} THEN 'PascalCase'
WHEN {m('^[a-z]')} AND {m('[A-Z]')} AND NOT {m('[_-]')} THEN 'camelCase' WHEN {m('^[a-z0-9]+$')} THEN 'lower' ELSE 'unknown' END"""


@query(f"WITH n AS (SELECT n_name AS name FROM nation UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT replace(p_name, ' ', '_') FROM part UNION SELECT event_type FROM events) SELECT name, {_case_sql('name')} AS pattern FROM n")
def X6_case_classifier(spark: SparkSession, sf: str) -> DataFrame:
    names = [t(spark, sf, a).select(F.expr(b).alias("name")) for a, b in (("nation", "n_name"), ("part", "p_type"), ("customer", "c_mktsegment"), ("part", "replace(p_name, ' ', '_')"), ("events", "event_type"))]
    out = names[0]
    for n in names[1:]:
        out = out.unionAll(n)
    return out.distinct().withColumn("pattern", T.case_pattern("name"))


@query(r"""SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(trim(lower(text)), '\s', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), 1, 16) AS description_hash FROM documents""")
def X1_X2_description_hash(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", T.description_hash("text").alias("description_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def X3_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("content_hash"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS content, len(string_split(text, chr(10))) > 3 AS truncated FROM documents")
def X24_snippet_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", T.truncate_snippet("text", 3).alias("s")).select("doc_id", "s.content", "s.truncated")


@query("SELECT l_orderkey, l_linenumber, CAST(round(least(greatest(l_discount * 12, 0), 1) * 100) AS INTEGER) AS pct FROM lineitem")
def X28_percent(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.percent(F.col("l_discount") * 12).alias("pct"))


@query("""WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS rank FROM conversations), s AS (SELECT *, lag(rank) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM r)
SELECT conv_id, sum(CASE WHEN rank < last THEN 1 ELSE 0 END) = 0 AS ordered, CAST(sum(CASE WHEN last IS NULL OR rank <> last THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM s GROUP BY 1""")
def W6_W7_import_order_check(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return R.order_breaks(t(spark, sf, "conversations").select("conv_id", "turn", rank.alias("rank")), ["conv_id"], "turn", "rank")


@query("SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 = count(*) AS contiguous FROM conversations WHERE role = 'user' GROUP BY 1")
def W8_contiguous_run(spark: SparkSession, sf: str) -> DataFrame:
    return R.one_run(t(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) AS trailing FROM events")
def W9_ST4_bulk_trigger_window(spark: SparkSession, sf: str) -> DataFrame:
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 1000000")
    return R.trailing_count(t(spark, sf, "events"), ["event_type"], s, 43200).select("event_id", "trailing")


@query("SELECT event_type, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL")
def ST_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 86400000000")
    return t(spark, sf, "events").groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS s, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM g GROUP BY 1""")
def ST_session_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).count().groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("""WITH o AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20), n AS (SELECT n_nationkey, n_name || '!' AS n_name FROM nation WHERE n_nationkey >= 15)
SELECT * FROM o WHERE n_nationkey NOT IN (SELECT n_nationkey FROM n) UNION ALL SELECT * FROM n""")
def SK1_keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    return R.keyed_upsert(n.where("n_nationkey < 20"), n.where("n_nationkey >= 15").withColumn("n_name", F.concat("n_name", F.lit("!"))), ["n_nationkey"])


@query("SELECT l_orderkey, l_linenumber, round(least(l_tax * 10 + 0.1 * (1 - l_tax * 10), 1), 6) AS boosted FROM lineitem")
def X22_confidence_boost(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.boost_confidence(F.col("l_tax") * 10), 6).alias("boosted"))
