"""The convention pipeline and its queries: findings to conventions, and what is asked of them.

Conventions, files, symbols and decisions are DataFrames; every query is a lazily built plan over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import dictionaries as D
from ..functions import text as T
from ..functions.dictionaries import NODE_BUILTINS, PYTHON_STDLIB
from ..operators import graph as G
from ..operators import relational as R
from ..operators import search as S
from ..sources.code import symbol_definitions, symbol_imports


def aggregate(findings: DataFrame, dates: DataFrame | None = None, now: int = 0, sample: int = 20) -> DataFrame:
    """A1 to A4: one convention for each detector and description, with counts, confidence, weight, trend and sampled evidence.

    Counts and the percentile are combined on the map side; only the first `sample` files of a group are carried along.
    """
    f = findings if dates is None else findings.join(dates.select("path", "last_commit_date"), "path", "left")
    date = F.col("last_commit_date") if dates is not None else F.lit(None).cast("bigint")
    keys = ["detector", "description"]
    groups = f.withColumn("d", date).groupBy(*keys).agg(
        F.min("nature").alias("nature"), F.count("*").alias("total_count"), F.count_if("follows").alias("adoption_count"), F.expr("CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY d) AS BIGINT)").alias("p90")
    )
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("path", "line"))  # each task sends on its first ones alone
    some = findings.select(*keys, "path", "line").withColumn("k", place).where(F.col("k") <= sample).drop("k").distinct()
    evidence = some.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("evidence"))
    out = groups.join(evidence, keys).withColumn("confidence", F.round(F.col("adoption_count") / F.col("total_count"), 6))
    return out.select(*keys, "nature", "total_count", "adoption_count", "confidence", T.weight("confidence").alias("weight"), T.trend("p90", now).alias("trend"), "evidence", T.description_hash("description").alias("description_hash"))


def persist_view(conventions: DataFrame, decisions: DataFrame) -> DataFrame:
    """SK4: conventions on which nothing is decided yet."""
    return conventions.join(decisions.select("description_hash"), "description_hash", "left_anti")


def compliance(findings: DataFrame) -> DataFrame:
    """A11, SK6"""
    return findings.where("follows").groupBy("path").agg(F.count("*").alias("compliance"))


def golden_files(findings: DataFrame, most: int = 5) -> DataFrame:
    """T1, Q-GOLD"""
    return compliance(findings).orderBy(F.desc("compliance"), "path").limit(most)


def resolve_imports(files: DataFrame) -> DataFrame:
    """(importer, target, name, line). An import's candidates, in order, are joined to path suffixes; the first hit counts.

    Relative imports are tried as they stand, with the languages' extensions and index files; internal modules by their
    path suffix below the first segment. What matches no file (the standard library, external packages) is left out.
    A module is looked up once for each language, and a relative one for each folder, that asks for it; what is found is kept
    before the imports are joined to it, so that adaptive execution can split a module that very many files import.
    """
    index = R.suffix_index(files.select("path"))
    i = files.select(F.col("path").alias("importer"), "language", F.explode("imports").alias("i")).select("importer", "language", "i.module", "i.names", "i.line")
    asks = ["language", "folder", "module"]
    i = i.withColumn("folder", F.when(F.col("module").startswith("."), F.regexp_replace("importer", "/?[^/]*$", "")).otherwise(""))
    folder, module = F.col("folder"), F.col("module")
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    above = F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - dots + 1, F.lit(0))), "/")
    python_base = F.concat_ws("/", F.nullif(above, F.lit("")), F.nullif(F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/"), F.lit("")))
    script_base = T.resolve_path(F.concat_ws("/", F.nullif(folder, F.lit("")), module))
    rust_base = T.module_to_path_suffix(module)
    python_abs = F.regexp_replace(module, r"\.", "/")
    with_tail = lambda base, tails: F.array(*[F.concat(base, F.lit(t)) for t in tails])
    scripts = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js")
    lang = F.col("language")
    candidates = (
        F.when((lang == "python") & (dots > 0), with_tail(python_base, (".py", "/__init__.py")))
        .when((lang == "python") & ~T.first_segment(module).isin(*PYTHON_STDLIB), with_tail(python_abs, (".py", "/__init__.py")))
        .when(lang.isin("typescript", "javascript") & module.rlike(r"^\."), with_tail(script_base, scripts))
        .when((lang == "rust") & ~T.top_level_module(module).isin("std", "core", "alloc", *NODE_BUILTINS), F.concat(with_tail(rust_base, (".rs", "/mod.rs")), with_tail(F.regexp_replace(rust_base, "/[^/]*$", ""), (".rs", "/mod.rs"))))
    )
    rows = i.select(*asks).distinct().select(*asks, F.posexplode(candidates).alias("pos", "candidate"))
    found = rows.join(index.select(F.col("suffix").alias("candidate"), F.col("path").alias("target")), "candidate").groupBy(*asks).agg(F.min_by("target", "pos").alias("target"))
    hits = i.join(G.keep(found), asks).where("importer != target").select("importer", "target", "module", "names", "line").distinct()
    return hits.select("importer", "target", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("*")))).alias("name"), "line")


def query_dependencies(files: DataFrame, path: str, depth: int = 3) -> dict[str, DataFrame]:
    """Q-DEP: what a file imports, who imports it directly, and its dependents up to `depth` steps (500 at most, flagged)."""
    spark, edges = files.sparkSession, G.keep(G.reverse_adjacency(resolve_imports(files)))
    target = spark.createDataFrame([(path,)], "node string")
    direct = edges.where(F.col("target") == path).select(F.col("importer").alias("path"), "names", "line").orderBy("path")
    found = G.capped(G.dependents(edges, target, depth))
    return {"dependencies": edges.where(F.col("importer") == path).select(F.col("target").alias("path"), "names", "line").orderBy("path"), "dependents": direct, "transitive": found, "blast_radius": direct.agg(T.blast_tier(F.count("*")).alias("blast_radius"))}


def query_convention(conventions: DataFrame, decisions: DataFrame, topic: str) -> DataFrame:
    """Q-CONV: decisions that mention any keyword, then conventions that hold all terms; a decision hides its convention."""
    d = decisions.where(S.any_keyword(F.col("description"), topic.split()) & (F.col("state") != "rejected")).select("description_hash", "description", "nature", "weight", F.lit(1.0).alias("confidence"), F.lit(0).alias("part"))
    c = S.prefix_search(conventions.withColumn("searched", F.concat_ws(" ", "description", "detector")), "searched", topic).select("description_hash", "description", "nature", "weight", "confidence", F.lit(1).alias("part"))
    both = d.unionByName(c.join(decisions.select("description_hash"), "description_hash", "left_anti"))
    return both.withColumn("percent", T.percent("confidence")).orderBy("part", F.desc("confidence"), "description_hash").drop("part")


def _pattern_symbols(files: DataFrame, query: str, kind: str | None, embeddings: DataFrame | None, vector: list[float] | None) -> tuple[DataFrame, DataFrame]:
    """(Symbols by name score and vector hits, with their call sites; rows (symbol_name, importer_file), each once, of the files that import a name)."""
    defs = symbol_definitions(files)
    found = S.name_search(defs if kind is None else defs.where(F.col("kind") == kind), "symbol_name", query.split()).select("symbol_name", "path", "kind", "line", "score")
    if embeddings is not None and vector:
        near = S.vector_search(embeddings, "embedding", vector).select(F.col("item_name").alias("symbol_name"), F.col("file_path").alias("path"), F.col("item_kind").alias("kind"), F.lit(0).alias("line"), "score")
        found = R.best_of([found, near if kind is None else near.where(F.col("kind") == kind)], ["path", "symbol_name", "kind"], "score")
    found = R.ranked(found, ["path", "symbol_name", "kind"], [F.desc("score"), F.asc("line")]).drop("rank")
    calls = files.select(F.explode("function_calls").alias("c")).select("c.callee")
    sites = R.matched_calls(found.select("symbol_name").distinct(), calls, "symbol_name", "callee").groupBy("symbol_name").agg(F.count("*").alias("call_sites"))
    users = symbol_imports(files).select(F.col("imported_name").alias("symbol_name"), "importer_file").distinct()
    return found.join(sites, "symbol_name", "left").withColumn("call_sites", F.coalesce("call_sites", F.lit(0))), users


def query_code_pattern(files: DataFrame, query: str, kind: str | None = None, embeddings: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
    """Q-PAT: symbols by name score, merged with vector hits where there are some; call sites, importers and blast tier."""
    found, users = _pattern_symbols(files, query, kind, embeddings, vector)
    out = found.join(users.groupBy("symbol_name").agg(F.sort_array(F.collect_set("importer_file")).alias("importers")), "symbol_name", "left")
    own = F.filter(F.coalesce("importers", F.array().cast("array<string>")), lambda p: p != F.col("path"))
    return out.select("symbol_name", "path", "kind", "line", "score", "call_sites", own.alias("dependent_files")).withColumn("blast_radius", T.blast_tier(F.size("dependent_files"))).orderBy(F.desc("score"), "symbol_name", "path", "kind")


def code_pattern_digests(files: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """query_code_pattern's symbols in any order, with n_dependents and the MD5 digest of dependent_files, joined by commas, but without these lists."""
    found, users = _pattern_symbols(files, query, kind, None, None)
    found = G.keep(found)
    lists = users.select(F.col("symbol_name").alias("key"), F.col("importer_file").alias("member"))
    digests = R.list_digests(found.select(F.col("symbol_name").alias("key"), F.col("path").alias("own")).distinct(), lists)
    out = found.join(digests, F.col("symbol_name").eqNullSafe(F.col("key")) & F.col("path").eqNullSafe(F.col("own")))
    return out.select("symbol_name", "path", "kind", "line", "score", "call_sites", F.col("n").alias("n_dependents"), F.col("digest").alias("dependents")).withColumn("blast_radius", T.blast_tier(F.col("n_dependents")))


def validate_approach(conventions: DataFrame, decisions: DataFrame, files: DataFrame, description: str, edges: DataFrame | None = None) -> DataFrame:
    """Q-VAL: related rules, conventions and observations (each row in one bucket, 10 of each), duplicates, contradictions, verdict: one row."""
    rows = query_convention(conventions, decisions, description)
    bucket = F.when(F.col("weight") == "rule", "rules").when(F.col("nature") == "decision", "decisions").when(F.col("nature") == "observation", "observations").otherwise("conventions")
    capped = R.ranked(rows.withColumn("bucket", bucket), ["bucket"], [F.desc("confidence"), F.asc("description_hash")], 10)
    n = capped.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("rules", "decisions", "conventions", "observations")], F.coalesce(F.bool_or(F.col("confidence") <= 0.5), F.lit(False)).alias("has_stale"))
    dup = query_code_pattern(files, description).where("score >= 0.6").limit(10).agg(F.count("*").alias("duplicates"))
    bad = _contradictions(rows, edges) if edges is not None else files.sparkSession.range(1).select(F.lit(0).alias("contradictions"))
    return n.join(F.broadcast(dup)).join(F.broadcast(bad)).withColumn("verdict", T.verdict("rules", "contradictions", "conventions"))


def _contradictions(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """How many unordered pairs of the rows (description_hash) contradict each other by an edge (source, target, edge_type)."""
    own = rows.select("description_hash").distinct()
    both = edges.where("edge_type = 'contradicts'").join(own.withColumnRenamed("description_hash", "source"), "source", "left_semi").join(own.withColumnRenamed("description_hash", "target"), "target", "left_semi")
    return R.unordered_pairs(both.where("source != target"), "source", "target").agg(F.count("*").alias("contradictions"))


def project_context(files: DataFrame, findings: DataFrame, conventions: DataFrame, decisions: DataFrame, focus: str | None = None) -> dict[str, DataFrame]:
    """Q-CTX: languages, modules, dependency domains, confidence summary, decisions by state, golden files."""
    c = conventions
    if focus:
        hit = conventions.where(F.lower("description").contains(focus.lower()))
        c = hit if not hit.isEmpty() else conventions
    parts = c.where("detector = 'dependency_usage'").select(F.regexp_extract("description", r"^Canonical (.*) library: (.*)$", 1).alias("domain"), F.regexp_extract("description", r"^Canonical (.*) library: (.*)$", 2).alias("package"), "total_count")
    module = F.regexp_replace("path", "/?[^/]*$", "")
    return {
        "languages": files.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language"),
        "modules": files.groupBy(module.alias("module")).agg(F.count("*").alias("file_count"), F.sort_array(F.collect_set("language")).alias("languages")).orderBy("module"),
        "dependencies": parts.groupBy("domain").agg(F.max_by("package", F.struct("total_count", "package")).alias("most_used"), F.sort_array(F.collect_set("package")).alias("packages"), F.sum("total_count").alias("total")).orderBy("domain"),
        "confidence": c.agg(F.count_if(F.col("confidence") > 0.85).alias("high"), F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") <= 0.85)).alias("medium"), F.count_if(F.col("confidence") < 0.5).alias("low")),
        "decisions": decisions.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("approved", "rejected", "partial", "recorded")]),
        "golden_files": golden_files(findings),
    }


def touched_symbols(definitions: DataFrame, hunks: DataFrame) -> DataFrame:
    """The definitions whose lines a hunk (path, new_start, new_end, half-open) touches, with the lines (first, last) of each hunk in them; paths are equal or end alike at a boundary.

    A pure deletion at line s touches the lines s - 1 and s, and counts as all of the definition. Neither definitions nor
    hunks, of which only the sources' size is known when this is planned, are broadcast.
    """
    s = definitions.where("line > 0").withColumn("end_line", F.greatest("line", "end_line"))
    near = R.suffix_join(s.select("path").distinct(), hunks.select(F.col("path").alias("changed")).distinct().hint("merge"), "path", "changed").groupBy("path").agg(F.min_by("changed", F.struct(-F.length("changed"), "changed")).alias("changed"))
    changes = near.hint("merge").join(hunks.select(F.col("path").alias("changed"), "new_start", "new_end"), "changed").drop("changed")
    meets = "(new_start = new_end AND line <= new_start AND end_line >= new_start - 1) OR (new_start < new_end AND line < new_end AND end_line >= new_start)"
    lines = F.when(F.col("new_start") == F.col("new_end"), F.struct(F.col("line").alias("first"), F.col("end_line").alias("last"))).otherwise(F.struct(F.greatest("line", "new_start").alias("first"), F.least("end_line", F.col("new_end") - 1).alias("last")))
    return s.join(changes.hint("merge"), "path").where(meets).groupBy("path", "symbol_name", "kind", "line", "end_line").agg(F.sort_array(F.collect_set(lines)).alias("changed_lines"))


def direct_dependents(files: DataFrame) -> DataFrame:
    """(path, dependents, blast_radius): how many other files import each file."""
    n = resolve_imports(files).select("importer", F.col("target").alias("path")).distinct().groupBy("path").agg(F.count("*").alias("dependents"))
    all_ = files.select("path").join(n, "path", "left").select("path", F.coalesce("dependents", F.lit(0)).cast("bigint").alias("dependents"))
    return all_.withColumn("blast_radius", T.blast_tier("dependents"))


def module_purposes(files: DataFrame, names: int = 8, docs: int = 10) -> DataFrame:
    """(module, purpose): of each folder the documentation of its entry point, else that of its files, else its public names.

    Documentation is cut to its first lines before it is shuffled, and of a folder's files only the first `docs` are carried.
    """
    module, file = F.regexp_replace("path", "/?[^/]*$", "").alias("module"), F.regexp_extract("path", "([^/]*)$", 1)
    said = files.where(F.col("file_doc").isNotNull() & ~C.is_noise_doc("file_doc")).select(module, "path", file.isin(*D.ENTRY_POINTS).alias("entry"), F.nullif(C.clean_doc(F.trim("file_doc"), 5), F.lit("")).alias("long"), F.nullif(C.clean_doc(F.trim("file_doc"), 3), F.lit("")).alias("short")).where("long IS NOT NULL")
    entry = said.where("entry").groupBy("module").agg(F.min_by("long", "path").alias("by_entry"))
    some = R.ranked(said, ["module"], [F.asc("path")], docs, "k").groupBy("module").agg(F.sort_array(F.collect_list(F.struct("path", "short"))).alias("x"))
    some = some.select("module", F.array_join(F.transform("x", lambda r: r["short"]), " | ").alias("by_files"))
    public = F.filter(F.concat(F.transform("functions", lambda f: F.when(f["is_public"], f["name"])), F.transform("types", lambda f: F.when(f["is_public"], f["name"]))), lambda x: x.isNotNull())
    each = files.select(module, F.explode(public).alias("name")).distinct()
    listed = each.groupBy("module").agg(F.sort_array(F.collect_set("name")).alias("names"))
    listed = listed.select("module", F.concat(F.array_join(F.slice("names", 1, names), ", "), F.when(F.size("names") > names, F.concat(F.lit(" +"), (F.size("names") - names).cast("string"), F.lit(" more"))).otherwise(F.lit(""))).alias("by_names"))
    out = files.select(module).distinct().join(entry, "module", "left").join(some, "module", "left").join(listed, "module", "left")
    return out.select("module", F.coalesce("by_entry", "by_files", "by_names").alias("purpose"))


def diff_impact(files: DataFrame, hunks: DataFrame, depth: int = 3) -> DataFrame:
    """Q-DIFF: public symbols that changed lines touch (hunks: path, new_start, new_end, half-open, as diff.file_hunks gives them), with direct and transitive dependents.

    A symbol counts if some direct dependent imports it by name or `*`; the file's dependents further off are added to those.
    Of the kinds that a name has in a file the one with most dependents stays, then exports before functions before types.
    """
    touched = G.keep(touched_symbols(symbol_definitions(files).where("is_public"), hunks))  # made of contents, and asked twice
    edges = G.keep(G.reverse_adjacency(resolve_imports(files)))
    far = G.count_far_dependents(edges, touched.select(F.col("path").alias("node")).distinct(), depth).withColumnRenamed("source", "path")
    direct = touched.join(edges.select("importer", F.col("target").alias("path"), "names"), "path").where(F.array_contains("names", F.col("symbol_name")) | F.array_contains("names", F.lit("*")))
    n = direct.groupBy("path", "symbol_name", "kind", "line", "changed_lines").agg(F.count_distinct("importer").alias("direct"), F.slice(F.sort_array(F.collect_set("importer")), 1, 5).alias("dependents"))
    out = n.join(far, "path", "left").withColumn("transitive", F.col("direct") + F.coalesce("far", F.lit(0))).drop("far")
    rank = F.when(F.col("kind") == "export", 0).when(F.col("kind") == "function", 1).otherwise(2)
    return R.ranked(out, ["path", "symbol_name"], [F.desc("transitive"), rank.asc(), F.asc("line")]).drop("rank").withColumn("blast_radius", T.blast_tier("transitive"))


def cross_reference(conventions: DataFrame, docs: DataFrame, least: float = 0.15) -> DataFrame:
    """Pairs of documentation facts (id, description) and conventions whose keywords have a Jaccard index of `least`."""
    a = docs.select(F.col("id").alias("doc"), T.keywords("description").alias("w"))
    b = conventions.select("description_hash", T.keywords("description").alias("w"))
    return R.jaccard_join(a, b, "doc", "description_hash", "w", "w", least)


def cross_reference_edges(conventions: DataFrame, docs: DataFrame, least: float = 0.15) -> DataFrame:
    """(doc, description_hash, edge_type): documentation that reinforces a convention on its topic, or contradicts it by choosing otherwise."""
    pairs = cross_reference(conventions, docs, least)
    own = conventions.select("description_hash", C.choices("description").alias("b"))
    theirs = docs.select(F.col("id").alias("doc"), C.choices("description").alias("a"))
    judged = pairs.join(theirs, "doc").join(own, "description_hash").withColumn("r", C.relationship(F.col("a"), F.col("b"))).where("r != 'unrelated'")
    return judged.select("doc", "description_hash", F.when(F.col("r") == "reinforcement", "reinforces").otherwise("contradicts").alias("edge_type"))
