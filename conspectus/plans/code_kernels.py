"""Queries that run the functions on names, paths, descriptions and conventions over the driver's tables, each beside its SQL.

The tables stand for a code base: a part is a file, a description or a convention, by what its columns make up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import dictionaries as D
from ..functions import text as T
from ..operators import detectors
from ..operators import relational as R
from ..operators import search as S
from .kernels import query, t

#: Expressions that both engines read.
LANGUAGE = "CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' ELSE 'javascript' END"
MODULE = "CASE p_partkey % 7 WHEN 0 THEN replace(p_name, ' ', '::') WHEN 1 THEN 'crate::' || replace(p_name, ' ', '::') WHEN 2 THEN '@' || replace(p_name, ' ', '/') || '/x' WHEN 3 THEN replace(p_name, ' ', '.') WHEN 4 THEN './' || replace(p_name, ' ', '/') WHEN 5 THEN 'super::self::' || replace(p_name, ' ', '::') ELSE 'os.' || p_name END"
FOLDER = "CASE p_partkey % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'src/Models' WHEN 2 THEN 'app/core/utils' WHEN 3 THEN 'node_modules/x' ELSE 'packages/' || lower(p_type) || '/src' END"
FILE = f"({FOLDER}) || '/' || CASE p_size % 4 WHEN 0 THEN 'mod' WHEN 1 THEN 'index' WHEN 2 THEN '__init__' ELSE replace(p_name, ' ', '_') END || CASE p_partkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' ELSE '.mjs' END"
TEXT = "'Use ' || replace(p_name, ' ', ', prefer ') || '; canonical library: (' || lower(p_type) || ') for the ' || p_brand"
CONFIDENCE = "CAST(p_size AS DOUBLE) / 50"


def _part(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", *[F.expr(e).alias(k) for k, e in columns.items()])


def _sql(body: str, **columns: str) -> str:
    return f"WITH p AS (SELECT p_partkey, {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM part)\n{body}"


def _in(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- names, modules and paths ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))::VARCHAR) || '\\x00'::BLOB || encode(text)) AS blob_id FROM documents WHERE text IS NOT NULL")
def X4_git_blob_id(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.git_blob_id("text").alias("blob_id"))


@query(_sql("SELECT p_partkey, translate(lower(m), '-.', '__') AS name, regexp_extract(m, '^[^ :./]*') AS top, regexp_split_to_array(m, '::|\\.')[1] AS first, regexp_replace(regexp_replace(m, '^((crate|super|self)::)+', ''), '::|\\.', '/', 'g') AS suffix FROM p", m=MODULE))
def X7_X9_X11_X12_module_names(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, m=MODULE).select("p_partkey", T.normalize_name("m").alias("name"), T.top_level_module("m").alias("top"), T.first_segment("m").alias("first"), T.module_to_path_suffix("m").alias("suffix"))


@query(_sql("SELECT p_partkey, CASE WHEN l IN ('typescript', 'javascript') THEN CASE WHEN starts_with(m, '@') THEN regexp_extract(m, '^@[^/]+(/[^/]+)?') ELSE regexp_extract(m, '^[^/]*') END WHEN l = 'rust' THEN regexp_extract(m, '^[^:]*') ELSE regexp_extract(m, '^[^.]*') END AS package FROM p", m=MODULE, l=LANGUAGE))
def X10_root_package(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, m=MODULE, l=LANGUAGE).select("p_partkey", T.root_package("m", "l").alias("package"))


@query(_sql("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/c/' || p_name WHEN 1 THEN 'c/' || p_name ELSE 'a/' || p_name END AS path FROM p""", p_name="p_name"))
def X13_resolve_path(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, path="CASE p_partkey % 3 WHEN 0 THEN './a//b/../c/./' || p_name WHEN 1 THEN '../x/../c/' || p_name ELSE 'a' || chr(92) || 'b' || chr(92) || '..' || chr(92) || p_name END").select("p_partkey", T.resolve_path("path").alias("path"))


@query(_sql("""SELECT p_partkey, CASE WHEN list_contains(string_split(f, '/'), 'src') THEN array_to_string(list_slice(string_split(f, '/'), 1, len(string_split(f, '/')) - list_position(list_reverse(string_split(f, '/')), 'src')), '/') ELSE '' END AS root,
  CASE WHEN list_contains(string_split(f, '/'), 'src') THEN nullif(string_split(f, '/')[list_position(string_split(f, '/'), 'src') + 1], '') END AS below FROM p""", f=FOLDER))
def X14_X16_package_roots(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, f=FOLDER).select("p_partkey", T.package_root("f").alias("root"), C.segment_after("f", "src").alias("below"))


@query(_sql(r"""SELECT p_partkey, CASE l WHEN 'rust' THEN CASE WHEN regexp_replace(regexp_replace(f, '^src/', ''), '\.rs$', '') IN ('lib', 'main') THEN 'crate' ELSE 'crate::' || replace(regexp_replace(regexp_replace(regexp_replace(f, '^src/', ''), '\.rs$', ''), '/mod$', ''), '/', '::') END
  WHEN 'python' THEN replace(regexp_replace(regexp_replace(f, '\.py$', ''), '/__init__$', ''), '/', '.') ELSE regexp_replace(regexp_replace(f, '\.(ts|mjs)$', ''), '/index$', '') END AS module FROM p""", f=FILE, l=LANGUAGE))
def X15_file_module_path(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, f=FILE, l=LANGUAGE).select("p_partkey", C.file_module_path("f", "l").alias("module"))


@query(_sql(f"""SELECT p_partkey, CASE WHEN starts_with(f, 'src/') THEN substr(f, 5) END AS below, len(list_intersect(list_slice(string_split(f, '/'), 1, -2), [{_in(D.VENDORED_DIRS)}])) > 0 AS vendored,
  list_filter(list_reverse(list_slice(string_split(f, '/'), 1, -2)), lambda x: lower(x) IN ({_in(D.COMMON_DIRS)}))[1] AS deepest, list_min(list_transform(list_filter(list_slice(string_split(f, '/'), 1, -2), lambda x: lower(x) IN ({_in(D.LAYER_DIRS)})), lambda x: list_position(string_split(f, '/'), x) - 1))::INT AS layer FROM p""", f=FILE))
def X16_F21_W10_folders(spark: SparkSession, sf: str) -> DataFrame:
    parts = C.components("f")
    return _part(spark, sf, f=FILE).select("p_partkey", C.strip_root("f", F.lit("src")).alias("below"), C.is_vendored("f").alias("vendored"), C.deepest_of(parts, D.COMMON_DIRS).alias("deepest"), C.earliest_of(parts, D.LAYER_DIRS).alias("layer"))


@query(_sql("SELECT p_partkey, regexp_matches(m, '^(\\.|/|@/|~/|#|crate::|self::|super::)') OR m IN ('crate', 'self', 'super') OR list_contains(['red', 'small'], replace(regexp_extract(m, '^[^ :./]*'), '-', '_')) AS internal FROM p", m=MODULE))
def F16_likely_internal(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, m=MODULE).select("p_partkey", C.is_likely_internal("m", F.array(F.lit("red"), F.lit("small"))).alias("internal"))


@query(_sql("SELECT p_partkey, f = 'utils/mod.rs' OR ends_with(f, '/' || 'utils/mod.rs') OR f LIKE '%/__init__.py' AS suffix, ends_with(m, '::ring') OR ends_with(m, '.ring') OR m = 'ring' AS callee FROM p", f=FILE, m=MODULE))
def F12_F13_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, f=FILE, m=MODULE).select("p_partkey", (T.suffix_matches("f", F.lit("utils/mod.rs")) | T.suffix_matches("f", F.lit("__init__.py"))).alias("suffix"), T.callee_matches("m", F.lit("ring")).alias("callee"))


@query(_sql("SELECT p_partkey, n, regexp_matches(n, '(^|[_-])(?i:ring|wid)') OR regexp_matches(n, '[a-z](Ring|Wid)') AS hit FROM p", n="CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_brand || replace(p_name, ' ', '') ELSE replace(replace(p_name, ' r', 'R'), ' w', 'W') END"))
def F15_keyword_at_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, n="CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_brand || replace(p_name, ' ', '') ELSE replace(replace(p_name, ' r', 'R'), ' w', 'W') END").select("p_partkey", "n", T.keyword_at_boundary("n", ["ring", "wid"]).alias("hit"))


_KNOWN = detectors.domain_rows()


@query(f"WITH k(language, package, domain) AS (VALUES {', '.join(str(r) for r in _KNOWN)}), l(language) AS (VALUES ('rust'), ('python'), ('typescript'), ('javascript')), n AS (SELECT DISTINCT package FROM k UNION SELECT DISTINCT p_name FROM part) SELECT l.language, n.package, k.domain FROM l CROSS JOIN n LEFT JOIN k ON k.language = l.language AND k.package = n.package")
def X31_package_domains(spark: SparkSession, sf: str) -> DataFrame:
    languages = spark.createDataFrame([(x,) for x in ("rust", "python", "typescript", "javascript")], "language string")
    names = spark.createDataFrame(sorted({(r[1],) for r in _KNOWN}), "package string").union(t(spark, sf, "part").select("p_name").distinct())
    return names.crossJoin(F.broadcast(languages)).select("language", "package", detectors.known_domain(F.col("package"), F.col("language")).alias("domain"))


@query(_sql(f"SELECT p_partkey, CASE l WHEN 'python' THEN string_split(m, '.')[1] IN ({_in(D.PYTHON_STDLIB)}) WHEN 'rust' THEN string_split(m, '::')[1] IN ({_in(D.RUST_BUILTINS)}) ELSE starts_with(m, 'node:') OR m IN ({_in(D.NODE_BUILTINS)}) END AS stdlib FROM p", m=MODULE, l=LANGUAGE))
def X32_stdlib(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, m=MODULE, l=LANGUAGE).select("p_partkey", detectors.is_stdlib(F.col("m"), F.col("l")).alias("stdlib"))


# --- descriptions ------------------------------------------------------------------------------------------------------------


def _choices_sql(c: str) -> str:
    after = ", ".join(f"list_transform((string_split(lower({c}), '{x}'))[2:], lambda w: regexp_extract(w, '^[^\\s,;)]*'))" for x in D.CHOICE_PHRASES)
    return f"list_sort(list_distinct(list_filter(list_transform(flatten([{after}]), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_-]+|[^\\p{{L}}\\p{{N}}_-]+$', '', 'g')), lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({_in(D.NO_CHOICES)}))))"


@query(_sql(f"SELECT p_partkey, array_to_string({_choices_sql('d')}, ',') AS choices FROM p", d=TEXT))
def X20_choices(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, d=TEXT).select("p_partkey", F.array_join(C.choices("d"), ",").alias("choices"))


_OTHER = "'The standard: ' || CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN 'nothing' ELSE '' END || ' in all files'"


@query(_sql(f"""SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 'unrelated' WHEN len(list_filter(a, lambda x: len(list_filter(b, lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0 THEN 'reinforcement' ELSE 'contradiction' END AS relationship
FROM (SELECT p_partkey, {_choices_sql('d')} AS a, {_choices_sql('e')} AS b FROM p)""", d=TEXT, e=_OTHER))
def X21_relationship(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, d=TEXT, e=_OTHER).select("p_partkey", C.relationship(C.choices("d"), C.choices("e")).alias("relationship"))


@query(f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda w: octet_length(encode(w)) > 1 AND w NOT IN ({_in(D.SEARCH_STOP_WORDS)})), ' ') AS words FROM benchmark")
def X18_search_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "benchmark").select("item_id", F.array_join(C.search_keywords("text"), " ").alias("words"))


@query(f"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: length(w) >= 2 AND w NOT IN ({_in(D.TOPIC_STOP_WORDS)}))) AS w FROM benchmark)
SELECT item_id, len(w) AS n, array_to_string(list_sort(w), ' ') AS words FROM w""")
def X17_topic_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "benchmark").select("item_id", T.keywords("text").alias("w")).select("item_id", F.size("w").cast("bigint").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


_FINDING = "CASE p_partkey % 3 WHEN 0 THEN 'Canonical ' || lower(p_type) || ' library: ' || p_name WHEN 1 THEN 'Likely HTTP library (heuristic): ' || p_name ELSE 'Possible logging library (name heuristic): ' || p_name END"


@query(_sql("""SELECT p_partkey, CASE WHEN regexp_matches(d, '^Canonical (.*?) library: (.*)$') THEN regexp_extract(d, '^Canonical (.*?) library: (.*)$', 1) ELSE 'other' END AS domain, CASE WHEN regexp_matches(d, '^Canonical (.*?) library: (.*)$') THEN regexp_extract(d, '^Canonical (.*?) library: (.*)$', 2) ELSE d END AS package,
  nullif(trim(regexp_extract(d, '\\((name )?heuristic\\): (.*)$', 2)), '') AS subject FROM p""", d=_FINDING))
def X34_description_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, d=_FINDING).withColumn("s", C.domain_and_package("d")).select("p_partkey", "s.domain", "s.package", detectors.heuristic_subject(F.col("d")).alias("subject"))


@query("WITH n AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 400000) AS r, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 300000) AS x, count(*) FILTER (WHERE o_orderstatus = 'O') AS c FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN r > 0 THEN 'blocked' WHEN x > 0 THEN 'conflict' WHEN c > 0 THEN 'aligned' ELSE 'unknown' END AS verdict, CASE WHEN r > 0 THEN 'stop' WHEN x > 0 THEN 'review' WHEN c > 0 THEN 'go' ELSE 'unknown' END AS readiness FROM n")
def X35_verdict(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.expr("o_orderstatus = 'F' AND o_totalprice > 400000")).alias("r"), F.count_if(F.expr("o_orderstatus = 'P' AND o_totalprice > 300000")).alias("x"), F.count_if(F.expr("o_orderstatus = 'O'")).alias("c"))
    return n.select("o_custkey", T.verdict("r", "x", "c").alias("verdict")).withColumn("readiness", C.readiness("verdict"))


@query("""SELECT doc_id, trim(array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^#+', ''))), lambda x: x <> ''), 1, 3), chr(10))) AS doc,
  regexp_matches(trim(text), '^(@ts-|@type|@jest-|@flow|@noinspection|(// |/\\* )?eslint-disable|noqa|#!)|type: ?ignore') OR octet_length(encode(trim(text))) < 8 AS noise FROM documents""")
def A20_clean_doc(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.trim(C.clean_doc("text", 3)).alias("doc"), C.is_noise_doc("text").alias("noise"))


_COMMENT = "'/** ' || p_name || chr(10) || ' * ' || p_type || chr(10) || ' *' || chr(10) || ' * ' || p_brand || ' */'"


@query(_sql("SELECT p_partkey, n || chr(10) || y || chr(10) || chr(10) || b AS doc FROM p", n="p_name", y="p_type", b="p_brand"))
def X40_clean_comment(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, c=_COMMENT).select("p_partkey", C.clean_comment("c").alias("doc"))


@query(_sql("SELECT p_partkey, regexp_extract(s, '^([\\w.-]+)', 1) AS name, trim(regexp_extract(s, '^[\\w.-]+(\\[[^\\]]*\\])?\\s*([^;]*)', 2)) AS version FROM p", s="' ' || replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '[a,b] >= ' || p_size WHEN 1 THEN '==' || p_size || ' ; x' ELSE '' END").replace("regexp_extract(s,", "regexp_extract(trim(s),"))
def X38_pep508(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, s="' ' || replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '[a,b] >= ' || p_size WHEN 1 THEN '==' || p_size || ' ; x' ELSE '' END").withColumn("v", T.pep508("s")).select("p_partkey", "v.name", "v.version")


def _near(k: int) -> str:
    return f"len(list_filter(list_transform(range(1, greatest(length(c) - {k} + 1, 1) + 1), lambda i: substr(c, i, {k})), lambda w: levenshtein(w, 'rinq') <= 2)) > 0"


@query(_sql(f"SELECT p_partkey, contains(c, 'rinq') OR {' OR '.join(_near(k) for k in range(2, 7))} AS hit FROM p", c="lower(p_name)"))
def X37_fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", T.fuzzy_match("rinq", "p_name").alias("hit"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:,.1f}', n_chars / 1024) || ' KB' ELSE format('{:,.1f}', n_chars / 1048576) || ' MB' END AS size FROM documents")
def X41_human_size(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", T.human_size("n_chars").alias("size"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x, doc_id % 5 + 1 AS a, doc_id % 5 + 2 AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_slice(x, greatest(a - 2, 1), greatest(a - 2, 1) + least(least(b + 4, len(x)) - greatest(a - 2, 1) + 1, 30) - 1), chr(10)) AS snippet FROM d""")
def X26_X27_snippet_window(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.snippet_window("text", F.col("doc_id") % 5 + 1, F.col("doc_id") % 5 + 2).alias("snippet"))


_VIS = "CASE WHEN p_size % 2 = 0 THEN '' WHEN l = 'rust' THEN 'pub ' WHEN l IN ('typescript', 'javascript') THEN 'export ' ELSE '' END"


@query(_sql(f"""SELECT p_partkey, {_VIS} || CASE WHEN p_size % 3 = 0 THEN 'async ' ELSE '' END || CASE l WHEN 'rust' THEN 'fn' WHEN 'python' THEN 'def' ELSE 'function' END || ' ' || n || '(' || replace(n, '_', ', ') || ')' AS f,
  {_VIS} || CASE p_size % 4 WHEN 0 THEN 'struct' WHEN 1 THEN 'type' ELSE 'class' END || ' ' || n AS y, CASE l WHEN 'rust' THEN 'pub use ' || n WHEN 'python' THEN n ELSE 'export ' || CASE WHEN p_size % 2 = 0 THEN 'default ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'type ' ELSE '' END || n END AS e FROM p""", l=LANGUAGE, n="replace(p_name, ' ', '_')", p_size="p_size"))
def X25_definition_snippets(spark: SparkSession, sf: str) -> DataFrame:
    p = _part(spark, sf, l=LANGUAGE, n="replace(p_name, ' ', '_')", s="p_size", k="CASE p_size % 4 WHEN 0 THEN 'struct' WHEN 1 THEN 'type alias' ELSE 'class' END")
    name, lang, odd, third = F.col("n"), F.col("l"), F.col("s") % 2 != 0, F.col("s") % 3 == 0
    return p.select("p_partkey", C.function_snippet(name, odd, third, F.split("n", "_"), lang).alias("f"), C.type_snippet(name, F.col("k"), odd, lang).alias("y"), C.export_snippet(name, ~odd, third, lang).alias("e"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest(l_linenumber, l_quantity::INT) AS INT) AS first, CAST(least(greatest(l_linenumber + l_suppkey % 9 - 1, l_linenumber), l_quantity::INT + 5) AS BIGINT) AS last FROM lineitem")
def X30_range_intersection(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_quantity").cast("int")
    return t(spark, sf, "lineitem").withColumn("s", C.intersection(F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_suppkey") % 9, line, line + 5)).select("l_orderkey", "l_linenumber", "l_partkey", "s.first", F.col("s.last").cast("bigint").alias("last"))


@query(_sql("SELECT p_partkey, 'function ' || n || chr(10) || l || ' ' || n || chr(10) || 'file: ' || f || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE chr(10) || p_brand END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE chr(10) || 'imports: ' || replace(n, ' ', ', ') END AS txt FROM p", l=LANGUAGE, f=FILE, n="p_name", p_brand="p_brand"))
def X39_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    p = _part(spark, sf, l=LANGUAGE, f=FILE, n="p_name", b="CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END")
    uses = F.when(F.col("p_partkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.split("n", " "))
    return p.select("p_partkey", C.embedding_text(F.lit("function"), F.col("n"), F.col("f"), F.concat_ws(" ", "l", "n"), F.col("b"), uses).alias("txt"))


# --- predicates on conventions -------------------------------------------------------------------------------------------------

EXT = "CASE p_partkey % 5 WHEN 0 THEN '{\"source\": \"auto_detected\"}' WHEN 1 THEN '{\"source\": \"user\", \"removed\": 1}' WHEN 2 THEN '{\"source\": \"user\", \"removed\": false}' WHEN 3 THEN '{\"source\": \"docs\"}' END"
NATURE = "CASE p_size % 4 WHEN 0 THEN 'convention' WHEN 1 THEN 'observation' WHEN 2 THEN 'decision' ELSE 'fact' END"
WEIGHT = "CASE p_size % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'strong' ELSE 'weak' END"


@query(_sql("SELECT p_partkey, coalesce(json_extract_string(x, '$.removed'), '0') NOT IN ('1', 'true') AS alive, coalesce(json_extract_string(x, '$.source') IN ('auto_detected', 'user'), FALSE) AND coalesce(json_extract_string(x, '$.removed'), '0') NOT IN ('1', 'true') AS own FROM p", x=EXT))
def F1_F2_source_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, x=EXT).select("p_partkey", T.not_removed("x").alias("alive"), C.from_source("x").alias("own"))


@query(_sql("SELECT n AS nature, b AS branch, count(*) AS rows FROM p WHERE n IN ('convention', 'decision') AND b = 'Brand#2' GROUP BY ALL", n=NATURE, b="p_brand"))
def F3_nature_and_branch(spark: SparkSession, sf: str) -> DataFrame:
    p = _part(spark, sf, nature=NATURE, branch="p_brand")
    return p.where(F.col("nature").isin("convention", "decision") & (F.col("branch") == "Brand#2")).groupBy("nature", "branch").agg(F.count("*").alias("rows"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 8")
def F4_current_schema(spark: SparkSession, sf: str) -> DataFrame:
    cached = t(spark, sf, "orders").withColumn("ir_schema_version", F.col("o_orderkey") % 10)
    return cached.where(F.col("ir_schema_version") == F.lit(8)).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS confirmed FROM orders")
def F9_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("confirmed"))


_EVIDENCE = "CASE p_partkey % 3 WHEN 0 THEN '[{\"file\": \"a\"}]' WHEN 1 THEN '{}' END"


@query(_sql("SELECT p_partkey, c >= 0.5 AND coalesce(regexp_matches(e, '^\\s*\\['), FALSE) AND (w IN ('rule', 'strong') OR n >= 3) AS risky FROM p", c=CONFIDENCE, e=_EVIDENCE, w=WEIGHT, n="p_partkey % 6"))
def F11_convention_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, c=CONFIDENCE, e=_EVIDENCE, w=WEIGHT, n="p_partkey % 6").select("p_partkey", C.is_risky(F.col("c"), F.col("e"), F.col("w"), F.col("n")).alias("risky"))


@query("SELECT doc_id, regexp_matches(d, '(^|\n)<<<<<<<') AS conflicted FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' || chr(10) || '<<<<<<< HEAD' || text WHEN 1 THEN 'a <<<<<<< b' ELSE text END AS d FROM documents)")
def F20_conflict_markers(spark: SparkSession, sf: str) -> DataFrame:
    d = F.expr("CASE doc_id % 3 WHEN 0 THEN 'a' || chr(10) || '<<<<<<< HEAD' || text WHEN 1 THEN 'a <<<<<<< b' ELSE text END")
    return t(spark, sf, "documents").select("doc_id", C.has_conflict_markers(d).alias("conflicted"))


# --- order, unions and indexes ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size, (SELECT count(*) FROM part) > 50 AS truncated FROM part ORDER BY p_size DESC, p_partkey LIMIT 50")
def T2_with_truncation(spark: SparkSession, sf: str) -> DataFrame:
    some, more = R.with_truncation(t(spark, sf, "part").select("p_partkey", "p_size"), [F.desc("p_size"), F.asc("p_partkey")], 50)
    return some.withColumn("truncated", F.lit(more))


@query(_sql("SELECT p_partkey, c, row_number() OVER (ORDER BY c DESC, h, p_partkey) AS place FROM p QUALIFY place <= 200", c=CONFIDENCE, h="p_type"))
def T3_by_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return R.ordered_top(_part(spark, sf, c=CONFIDENCE, h="p_type"), [F.desc("c"), F.asc("h"), F.asc("p_partkey")], 200).select("p_partkey", "c", "place")


@query("SELECT o_custkey, list_sort(list(o_orderkey))[1] AS example, count(*) > 1 AS trimmed FROM orders GROUP BY 1")
def T5_trimmed_examples(spark: SparkSession, sf: str) -> DataFrame:
    every = t(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    lists = every.select("o_custkey", F.array_distinct(F.array("first", "last")).alias("examples"))
    return R.trim_examples(lists, "examples").select("o_custkey", F.get("examples", F.lit(0)).alias("example"), "trimmed")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) > 5 AS truncated FROM customer QUALIFY rank <= 5")
def T8_capped_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.capped_groups(t(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5).select("c_nationkey", "c_custkey", "rank", "truncated")


@query("SELECT s, max(n) AS n FROM (SELECT l_suppkey AS s, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n >= 3 GROUP BY s ORDER BY n DESC, s LIMIT 5")
def T10_next_steps(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), "l_partkey").agg(F.count("*").alias("n")).where("n >= 3")
    return n.groupBy("s").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "s").limit(5)


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 100")
def T9_T11_latest_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return R.ordered_top(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 100)


@query("""WITH d AS (SELECT s_name AS name, s_suppkey % 7 = 0 AS blank, s_suppkey AS id FROM supplier), a AS (SELECT CASE WHEN blank THEN '' ELSE 'k' || id END AS hash, 'decision' AS part, id FROM d WHERE id % 3 = 0), b AS (SELECT CASE WHEN blank THEN '' ELSE 'k' || id END AS hash, 'node' AS part, id FROM d)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE hash = '' OR hash NOT IN (SELECT hash FROM a)""")
def U1_decisions_win(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").select(F.expr("CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'k' || s_suppkey END").alias("hash"), F.col("s_suppkey").alias("id"))
    return R.first_wins(s.where("id % 3 = 0").withColumn("part", F.lit("decision")), s.withColumn("part", F.lit("node")), "hash").select("hash", "part", "id")


@query("SELECT part, count(*) AS n FROM (SELECT 'node' AS part FROM supplier UNION ALL SELECT 'decision' FROM customer) GROUP BY 1")
def U2_all_conventions(spark: SparkSession, sf: str) -> DataFrame:
    both = t(spark, sf, "supplier").select(F.lit("node").alias("part")).unionByName(t(spark, sf, "customer").select(F.lit("decision").alias("part")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NOT NULL THEN 'staged' ELSE 'unstaged' END AS part FROM (SELECT * FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 4 = 0) b ON a.o_orderkey = b.o_orderkey")
def U6_staged_wins(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey")
    return R.first_wins(o.where("o_orderkey % 3 = 0").withColumn("part", F.lit("staged")), o.where("o_orderkey % 4 = 0").withColumn("part", F.lit("unstaged")), "o_orderkey")


@query("SELECT name, min(pos) AS pos FROM (SELECT lower(r_name) AS name, r_regionkey AS pos FROM region UNION ALL SELECT lower(r_name), n_nationkey + 100 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(n_name), n_nationkey + 100 FROM nation) GROUP BY 1")
def U7_internal_names(spark: SparkSession, sf: str) -> DataFrame:
    region, nation = t(spark, sf, "region"), t(spark, sf, "nation")
    manifest = region.select(F.lower("r_name").alias("name"), F.col("r_regionkey").alias("pos"))
    local = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.explode(F.array(F.lower("r_name"), F.lower("n_name"))).alias("name"), (F.col("n_nationkey") + 100).alias("pos"))
    return R.ordered_distinct(manifest.unionAll(local), "name", "pos")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def SK5_bulk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return R.lookup(t(spark, sf, "customer").select("c_custkey"), wanted, "c_custkey")


@query("SELECT doc_id, token FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> '')) AS token FROM documents) WHERE doc_id % 3 <> 1 AND starts_with(token, 'un')")
def SK7_SK8_index_entries(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents")
    index = S.inverted_index(docs.where("doc_id % 3 != 2"), "doc_id", "text")
    index = S.delete_entries(S.insert_entries(index, docs.where("doc_id % 3 = 2"), "doc_id", "text"), docs.where("doc_id % 3 = 1").select("doc_id"), "doc_id")
    return index.where(F.col("token").startswith("un"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> ''))"


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS}, lambda w: starts_with(w, 'licens'))) > 0 AND len(list_filter({_TOKENS}, lambda w: starts_with(w, 'und'))) > 0")
def S1_SK7_indexed_prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.indexed_prefix_search(S.inverted_index(t(spark, sf, "documents"), "doc_id", "text"), "doc_id", "licens* und")


@query("WITH m AS (SELECT c_custkey AS old, row_number() OVER (ORDER BY c_custkey) + 1000 AS new FROM customer) SELECT o_orderkey, a.new AS source, coalesce(b.new, -1) AS target FROM orders JOIN m a ON o_custkey = a.old LEFT JOIN m b ON o_orderkey % 2000 = b.old")
def SK11_remapped_edges(spark: SparkSession, sf: str) -> DataFrame:
    ids = R.numbered(t(spark, sf, "customer").select(F.col("c_custkey").alias("old")), "old", "new").withColumn("new", F.col("new") + 1000)
    edges = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 2000).alias("target"))
    both = R.remap(R.remap(edges, ids, "source"), ids, "target", "left")
    return both.select("o_orderkey", F.col("source").cast("bigint").alias("source"), F.coalesce("target", F.lit(-1)).cast("bigint").alias("target"))


@query("SELECT l_suppkey AS target, array_to_string(list_distinct(list(l_returnflag || l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey)), ',') IS NOT NULL AS some, count(DISTINCT l_returnflag || l_linestatus) AS n, arg_min(l_returnflag || l_linestatus, (l_orderkey, l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY 1")
def A14_dependency_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("target"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"))
    merged = R.names_in_order(rows, ["target"], "name", "at")
    return merged.select("target", F.col("names").isNotNull().alias("some"), F.size("names").cast("bigint").alias("n"), F.get("names", F.lit(0)).alias("first"))


@query(_sql("SELECT l AS language, count(*) AS files, count(DISTINCT y) AS kinds FROM p GROUP BY 1", l=LANGUAGE, y="p_type"))
def A17_language_report(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf, language=LANGUAGE, y="p_type").groupBy("language").agg(F.count("*").alias("files"), F.count_distinct("y").alias("kinds"))


@query("SELECT branch, kind, n FROM (SELECT o_orderstatus AS branch, 'files' AS kind, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_returnflag, 'definitions', count(*) FROM lineitem GROUP BY 1)")
def A18_counts_by_branch(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"files": t(spark, sf, "orders").select(F.col("o_orderstatus").alias("branch")), "definitions": t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("branch"))}
    return R.count_tables(tables, "branch")


@query("""SELECT l_suppkey, l_linenumber, l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_partkey) = 1""")
def W3_overlap_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return R.ranked(rows, ["l_suppkey", "l_linenumber"], [F.desc("l_quantity"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey")]).select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey")


@query("""WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS rank, turn * 2 - CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 1 ELSE 0 END AS line FROM conversations), s AS (SELECT *, lag(rank) OVER w AS last, lag(line) OVER w AS before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) FILTER (WHERE rank <> last) > 0 AND count(*) FILTER (WHERE rank <> last AND line - before <= 1) = 0 AS separated FROM s GROUP BY 1""")
def W7_transition_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    line = F.expr("turn * 2 - CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 1 ELSE 0 END")
    return R.separated(t(spark, sf, "conversations").select("conv_id", "turn", rank.alias("rank"), line.alias("line")), ["conv_id"], "turn", "rank", "line")


@query("""WITH e AS (SELECT p_partkey % 50 AS file, p_name AS name, p_size AS line, p_partkey FROM part), k AS (SELECT file, name, arg_min(line, p_partkey) AS line FROM e GROUP BY ALL)
SELECT v.vec_id, coalesce(k.line, 0) AS line FROM (SELECT vec_id, vec_id % 60 AS file, CASE vec_id % 2 WHEN 0 THEN 'small ring' ELSE 'red widget' END AS name FROM embeddings) v LEFT JOIN k USING (file, name)""")
def J14_embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    symbols = t(spark, sf, "part").select((F.col("p_partkey") % 50).alias("file"), F.col("p_name").alias("name"), F.col("p_size").alias("line"), "p_partkey")
    vectors = t(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 60).alias("file"), F.when(F.col("vec_id") % 2 == 0, "small ring").otherwise("red widget").alias("name"))
    return R.first_match(vectors, symbols, ["file", "name"], "p_partkey").select("vec_id", F.coalesce("line", F.lit(0)).alias("line"))


@query(f"""WITH p AS (SELECT p_partkey, {FILE} AS path FROM part), c(suffix) AS (VALUES ('utils/mod.rs'), ('src/__init__.py'), ('index.ts'), ('src/x/index.ts'), ('Models/mod.rs'))
SELECT p_partkey, suffix FROM p JOIN c ON path = suffix OR ends_with(path, '/' || suffix)""")
def J4_J17_suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    changed = spark.createDataFrame([(x,) for x in ("utils/mod.rs", "src/__init__.py", "index.ts", "src/x/index.ts", "Models/mod.rs")], "suffix string")
    return R.suffix_join(_part(spark, sf, path=FILE), changed, "path", "suffix").select("p_partkey", "suffix")


@query("""WITH d AS (SELECT s_suppkey, 'dep-' || s_suppkey AS name, s_suppkey % 5 = 0 AS is_dev FROM supplier), u AS (SELECT DISTINCT 'dep_' || l_suppkey AS package, l_orderkey AS path FROM lineitem WHERE l_quantity > 49)
SELECT name, is_dev, count(path) AS n_files, count(path) = 0 AS is_dead FROM d LEFT JOIN u ON replace(name, '-', '_') = package GROUP BY ALL""")
def J15_dependency_usage(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.project import dependency_usage

    declared = t(spark, sf, "supplier").select(F.lit("m").alias("manifest"), F.expr("'dep-' || s_suppkey").alias("name"), F.lit("1").alias("version"), (F.col("s_suppkey") % 5 == 0).alias("is_dev"))
    files = t(spark, sf, "lineitem").where("l_quantity > 49").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_set(F.struct(F.expr("'Dep_' || l_suppkey").alias("package"))).alias("dependencies_used"))
    return dependency_usage(declared, files).select("name", "is_dev", "n_files", "is_dead")


@query("SELECT l_suppkey AS path, count(*) AS compliance FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1 ORDER BY compliance DESC, path LIMIT 5")
def Q_GOLD_T1_A11_golden_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    from . import conventions

    return conventions.golden_files(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_discount") >= 0.05).alias("follows")))


@query("""WITH a AS (SELECT user_id AS k, max(ts) AS at, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS k, max(ts) AS at, max(event_id) AS v FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.at > a.at THEN b.v ELSE a.v END AS v, CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'inserted' WHEN b.at > a.at THEN 'updated' ELSE 'skipped' END AS action FROM a FULL JOIN b ON a.k = b.k""")
def U8_A21_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda where: t(spark, sf, "events").where(where).groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("at"), F.max("event_id").alias("v"))
    return R.latest_wins(side("event_id % 2 = 0"), side("event_id % 2 = 1 AND user_id % 3 != 0"), "k", "at").select("k", "v", "action")


@query("""WITH n AS (SELECT doc_id, 'Use ' || source || ' for ' || lang AS description, list_distinct(list_filter(regexp_split_to_array(lower('Use ' || source || ' for ' || lang), '[^a-z0-9_-]+'), lambda w: length(w) >= 2 AND w NOT IN ('use', 'for'))) AS w FROM documents),
d AS (SELECT DISTINCT 'Prefer ' || source || ' in ' || lang AS description FROM documents), e AS (SELECT description, list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9_-]+'), lambda w: length(w) >= 2 AND w NOT IN ('in'))) AS w FROM d)
SELECT e.description AS doc, n.doc_id AS convention, CASE WHEN split_part(e.description, ' ', 2) = split_part(n.description, ' ', 2) OR contains(split_part(e.description, ' ', 2), split_part(n.description, ' ', 2)) OR contains(split_part(n.description, ' ', 2), split_part(e.description, ' ', 2)) THEN 'reinforces' ELSE 'contradicts' END AS edge_type
FROM e JOIN n ON len(list_intersect(e.w, n.w)) / (len(e.w) + len(n.w) - len(list_intersect(e.w, n.w))) >= 0.25""")
def G5_J11_cross_reference(spark: SparkSession, sf: str) -> DataFrame:
    from . import conventions

    d = t(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    nodes = d.select(F.col("doc_id").alias("description_hash"), F.expr("'Use ' || source || ' for ' || lang").alias("description"))
    docs = d.select(F.expr("'Prefer ' || source || ' in ' || lang").alias("description")).distinct().withColumn("id", F.col("description"))
    return conventions.cross_reference_edges(nodes, docs, 0.25).select("doc", F.col("description_hash").alias("convention"), "edge_type")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version') AND contains(lower(text), 'apache') AND contains(lower(text), 'under') ORDER BY doc_id LIMIT 50")
def F6_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.keyword_search(t(spark, sf, "documents").select("doc_id", "text"), "text", "the Apache License version and under", "doc_id").select("doc_id")


_EVENTS = "'[{\"file\": \"a' || user_id || '\", \"line\": ' || event_id % 9 || '}, {\"file\": \"b\", \"line\": 0}]'"


@query("SELECT event_id, file, line FROM (SELECT event_id, 'a' || user_id AS file, CAST(event_id % 9 AS INT) AS line FROM events UNION ALL SELECT event_id, 'b', 0 FROM events) WHERE file = 'b' OR line > 4")
def J3_evidence_unnest(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "events").select("event_id", F.expr(_EVENTS).alias("evidence"))
    return R.unnested(rows, "evidence", "file string, line int").where("file = 'b' OR line > 4")


@query(_sql("""SELECT y, p_partkey FROM (SELECT y, p_partkey, row_number() OVER (PARTITION BY y, split_part(f, '/', 1) ORDER BY f) AS turn, split_part(f, '/', 1) AS folder FROM p) QUALIFY row_number() OVER (PARTITION BY y ORDER BY turn, folder) <= 20""", y="p_type", f="CASE p_partkey % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'app' ELSE 'lib' || p_size % 7 END || '/x/m_' || p_partkey || '.py'"))
def W4_diverse_files(spark: SparkSession, sf: str) -> DataFrame:
    p = _part(spark, sf, y="p_type", f="CASE p_partkey % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'app' ELSE 'lib' || p_size % 7 END || '/x/m_' || p_partkey || '.py'")
    return R.diverse_files(p, "f", ["y"]).select("y", "p_partkey")


@query(_sql("""SELECT y, count(*) AS total, count(*) FILTER (WHERE ok) AS adoption, '// ' || count(*) || CASE WHEN count(*) = 1 THEN ' file ' ELSE ' files ' END || CASE WHEN bool_and(ok) THEN CASE WHEN count(*) = 1 THEN 'matches' ELSE 'match' END WHEN NOT bool_or(ok) THEN CASE WHEN count(*) = 1 THEN 'violates' ELSE 'violate' END ELSE 'reference' END || ' this convention'
  || CASE WHEN bool_or(ok) AND NOT bool_and(ok) THEN ' (' || count(*) FILTER (WHERE ok) || ' follow / ' || count(*) FILTER (WHERE NOT ok) || ' violate)' ELSE '' END || CASE WHEN count(*) > 20 THEN ' (showing 20)' ELSE '' END || ':' AS head, CASE WHEN count(*) > 20 THEN '// ... and ' || (count(*) - 20) || ' more (truncated)' ELSE '' END AS foot FROM p GROUP BY 1""", y="p_brand", ok="p_size > 40"))
def A5_composite_text(spark: SparkSession, sf: str) -> DataFrame:
    p = _part(spark, sf, y="p_brand", f="'d' || p_size % 5 || '/m_' || p_partkey || '.py'", ok="p_size > 40")
    text = R.composite(p, "f", "ok", ["y"])
    return text.select("y", "total", "adoption", F.substring_index("text", "\n", 1).alias("head"), F.regexp_extract("text", "\n(// [.]{3} and .*)$", 1).alias("foot"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_quantity ORDER BY (l_returnflag = 'R')::INT DESC, l_orderkey, l_partkey) = 1) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_returnflag = 'R')::INT DESC, l_orderkey, l_partkey) <= 20")
def A4_anchored_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_returnflag") == "R").alias("anchored"))
    return R.anchored_sample(rows, ["l_suppkey"], "anchored", ["l_orderkey", "l_partkey"], ["l_linenumber", "l_quantity"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH s AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part), c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '::') WHEN 1 THEN replace(p_name, ' ', '.') WHEN 2 THEN split_part(p_name, ' ', 2) ELSE replace(p_name, ' ', '_') END AS callee FROM part)
SELECT name, p_partkey FROM s JOIN c ON callee = name OR ends_with(callee, '::' || name) OR ends_with(callee, '.' || name)""")
def J13_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    symbols = t(spark, sf, "part").select(F.expr("split_part(p_name, ' ', 2)").alias("name")).distinct()
    calls = _part(spark, sf, callee="CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '::') WHEN 1 THEN replace(p_name, ' ', '.') WHEN 2 THEN split_part(p_name, ' ', 2) ELSE replace(p_name, ' ', '_') END")
    return R.matched_calls(symbols, calls, "name", "callee").select("name", "p_partkey")
