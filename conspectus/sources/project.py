"""What stands beside the code: manifests, documentation, submodules and history, as rows."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import ship_package
from .tree import path_pattern


def parse_manifest(name: str, content: str) -> list[dict]:
    """SC10: declared dependencies (name, version, is_dev) of Cargo.toml, package.json or pyproject.toml; none if it cannot be read."""
    try:
        data = json.loads(content) if name.endswith(".json") else tomllib.loads(content)
    except ValueError:
        return []
    out = []

    def add(deps: object, dev: bool) -> None:
        for k, v in (deps or {}).items() if isinstance(deps, dict) else ():
            version = v if isinstance(v, str) else v.get("version", "") if isinstance(v, dict) else ""
            out.append({"name": k, "version": version, "is_dev": dev})

    def specs(items: object, dev: bool) -> None:
        for s in items if isinstance(items, list) else ():
            if isinstance(s, str) and (m := re.match(r"\s*([\w.-]+)(?:\[[^\]]*\])?\s*([^;]*)", s)):
                out.append({"name": m[1], "version": m[2].strip(), "is_dev": dev})

    if name.endswith("package.json"):
        add(data.get("dependencies"), False)
        add(data.get("devDependencies"), True)
    elif name.endswith("Cargo.toml"):
        add(data.get("dependencies"), False)
        add(data.get("dev-dependencies"), True)
        add(data.get("workspace", {}).get("dependencies"), False)
    else:
        project = data.get("project", {})
        specs(project.get("dependencies"), False)
        for extra in project.get("optional-dependencies", {}).values():
            specs(extra, True)
        poetry = data.get("tool", {}).get("poetry", {})
        add({k: v for k, v in poetry.get("dependencies", {}).items() if k != "python"}, False)
        add(poetry.get("dev-dependencies"), True)
    return out


def declared_dependencies(spark: SparkSession, manifests: dict[str, str]) -> DataFrame:
    """A project has a handful of manifests at its root; they are read on the driver."""
    rows = [(f, d["name"], d["version"], d["is_dev"]) for f, c in sorted(manifests.items()) for d in parse_manifest(f, c)]
    return spark.createDataFrame(rows, "manifest string, name string, version string, is_dev boolean")


def dependency_usage(declared: DataFrame, files: DataFrame) -> DataFrame:
    """In how many files each declared dependency is imported; dead if in none."""
    norm = lambda c: F.translate(F.lower(c), "-", "_")
    used = files.select("path", F.explode("dependencies_used").alias("x")).select(norm(F.col("x.package")).alias("key"), "path").groupBy("key").agg(F.count_distinct("path").alias("n"))
    return declared.withColumn("key", norm(F.col("name"))).join(used, "key", "left").select("manifest", "name", "version", "is_dev", F.coalesce("n", F.lit(0)).alias("n_files"), F.col("n").isNull().alias("is_dead"))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """SC12: (key, section, level, title, content): sections start at headings of level 1 and 2 outside fences; deeper ones are body, text before the first is dropped."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    fence = F.sum(F.when(F.col("line").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)).over(w)
    head = F.col("line").rlike(r"^#{1,2}\s+\S") & (fence % 2 == 0)
    marked = lines.withColumn("head", head).withColumn("section", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(w)).where("section > 0")
    grouped = marked.groupBy(key, "section").agg(F.sort_array(F.collect_list(F.struct("pos", "head", "line"))).alias("x"))
    first = F.get(F.col("x"), F.lit(0))["line"]
    return grouped.select(key, "section", F.length(F.regexp_extract(first, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(first, r"^#+\s+|\s+#*\s*$", "")).alias("title"), F.trim(F.array_join(F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda s: s["line"]), "\n")).alias("content"))


def schema_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """SC13: (key, element, type, description): the properties of JSON Schemas (with $schema, properties, or type and title)."""
    t = F.col(text)
    gate = F.get_json_object(t, "$['$schema']").isNotNull() | F.get_json_object(t, "$.properties").isNotNull() | (F.get_json_object(t, "$.type").isNotNull() & F.get_json_object(t, "$.title").isNotNull())
    props = docs.where(gate).select(key, F.explode(F.from_json(F.get_json_object(t, "$.properties"), "map<string,struct<type:string,description:string>>")).alias("element", "p"))
    return props.select(key, "element", F.col("p.type").alias("type"), F.col("p.description").alias("description"))


def submodule_paths(gitmodules: DataFrame, text: str = "value") -> DataFrame:
    """SC2"""
    return gitmodules.select(F.regexp_extract(text, r"^\s*path\s*=\s*(.+?)\s*$", 1).alias("path")).where("path != ''")


def first_seen_dates(log: DataFrame) -> DataFrame:
    """SC16, A12: of a history (commit_pos from the newest, ts, path) the time of the first commit that names each path."""
    return log.groupBy("path").agg(F.min_by("ts", "commit_pos").alias("last_commit_date"))


def module_graph(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules (folders) with their files and languages; distinct depends_on edges between them, part_of where the parent is a module."""
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    modules = files.groupBy(folder(F.col("path")).alias("module")).agg(F.count("*").alias("file_count"), F.sort_array(F.collect_set("language")).alias("languages"), F.sort_array(F.collect_list("path")).alias("files"))
    depends = edges.select(folder(F.col("importer")).alias("source"), folder(F.col("target")).alias("target"), F.lit("depends_on").alias("edge_type")).where("source != target").distinct()
    names = modules.select("module")
    part = names.select(F.col("module").alias("source"), folder(F.col("module")).alias("target")).where("source != target").join(names.withColumnRenamed("module", "target"), "target", "left_semi").select("source", "target", F.lit("part_of").alias("edge_type"))
    return modules, depends.unionByName(part)


def latest_changes(events: DataFrame) -> DataFrame:
    """ST1 in batch: the last event of each path."""
    return R.ranked(events, ["path"], [F.desc("ts"), F.desc("seq")], 1).drop("rank")


def internal_names(name: str, content: str) -> list[str]:
    """SC11: names that a manifest gives the project's own packages: the package, and the workspace's members by their globs' last parts."""
    if name.endswith((".yaml", ".yml")):
        return _member_names(re.findall(r"^\s*-\s*['\"]?([^'\"#\s]+)", content, re.M))
    try:
        data = json.loads(content) if name.endswith(".json") else tomllib.loads(content)
    except ValueError:
        return []
    if name.endswith(".json"):
        spaces = data.get("workspaces") or []
        return [x for x in [data.get("name"), *_member_names(spaces.get("packages", []) if isinstance(spaces, dict) else spaces)] if x]
    if name.endswith("Cargo.toml"):
        return [x.replace("-", "_") for x in [data.get("package", {}).get("name"), data.get("lib", {}).get("name"), *_member_names(data.get("workspace", {}).get("members", []))] if x]
    tool = data.get("tool", {})
    own = [data.get("project", {}).get("name"), tool.get("poetry", {}).get("name"), *[p.get("include") for p in tool.get("poetry", {}).get("packages", []) if isinstance(p, dict)]]
    return [x.replace("-", "_") for x in own if x]


def _member_names(globs: list[str]) -> list[str]:
    return [last for g in globs if isinstance(g, str) and not g.startswith("!") and (last := g.rstrip("/").rpartition("/")[2]) and "*" not in last]


def _manifest(path: str, content: str) -> tuple[str, list[str], list[str]]:
    """(Kind, names that a manifest gives its own package, patterns of its workspace's members)."""
    name = path.rpartition("/")[2]
    if name.endswith((".yaml", ".yml")):
        return "js", [], re.findall(r"^\s*-\s*['\"]?([^'\"#\s]+)", content, re.M)
    try:
        data = json.loads(content.removeprefix("\ufeff")) if name.endswith(".json") else tomllib.loads(content)
    except ValueError:
        return "", [], []
    if not isinstance(data, dict):
        return "", [], []
    listed = lambda x: [y for y in x if isinstance(y, str)] if isinstance(x, list) else []
    if name.endswith(".json"):
        spaces = data.get("workspaces")
        return "js", listed([data.get("name")]), listed(spaces.get("packages") if isinstance(spaces, dict) else spaces)
    if name == "Cargo.toml":
        table = lambda k: data.get(k) if isinstance(data.get(k), dict) else {}
        return "rust", [x.replace("-", "_") for x in listed([table("package").get("name")])], listed(table("workspace").get("members"))
    return "python", internal_names(path, content), []


def workspace_names(manifests: DataFrame) -> DataFrame:
    """SC11: (folder, name): the names of the project's own packages by their manifests (path, content), and of what their workspaces hold: (folder of the workspace, name).

    Member patterns are matched against the folders of the other manifests of their kind, each of which meets the patterns of
    the folders above it. Absolute patterns, those that leave the workspace, and folders without a manifest name nothing.
    """
    ship_package(manifests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, names, members = _manifest(path, content or "")
                safe = [m.strip().removeprefix("./").rstrip("/") or "." for m in members if m.strip() and not m.startswith("/") and ".." not in m.split("/")]
                rows.append((path.rpartition("/")[0], kind, [n for n in names if n.strip()], [path_pattern(m) if set("*?[") & set(m) else re.escape(m) for m in safe]))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["folder", "kind", "names", "members"])

    read = manifests.select("path", F.col("content").cast("string")).mapInArrow(run, "folder string, kind string, names array<string>, members array<string>")
    own = read.select("folder", "kind", F.explode("names").alias("name"))
    patterns = read.select("folder", "kind", F.explode("members").alias("pattern")).distinct()
    parts = F.split("inner", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    inner = own.where("kind != 'python'").select(F.col("folder").alias("inner"), "kind", "name").withColumn("folder", F.explode(F.array_distinct(above)))
    below = F.when(F.col("inner") == F.col("folder"), ".").when(F.col("folder") == "", F.col("inner")).otherwise(F.expr("substr(inner, length(folder) + 2)"))
    members = inner.join(R.if_few(patterns), ["folder", "kind"]).where(F.regexp_like(below, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))))
    return own.select("folder", "name").unionAll(members.select("folder", "name")).distinct()


def openapi_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """SC14: (key, kind, name, description): the API, endpoints and schemas of OpenAPI and Swagger documents, in JSON or, where a reader of it is installed, YAML."""

    def facts(content: str | None) -> list[tuple[str, str, str]]:
        try:
            data = json.loads(content or "")
        except ValueError:
            try:
                import yaml
            except ImportError:
                return []
            try:
                data = yaml.safe_load(content or "")
            except yaml.YAMLError:
                return []
        if not isinstance(data, dict) or not (data.get("openapi") or data.get("swagger")):
            return []
        info = data.get("info") or {}
        out = [("api", str(info.get("title") or ""), str(info.get("description") or info.get("version") or ""))]
        for path, methods in sorted((data.get("paths") or {}).items()):
            for method, x in sorted(methods.items()) if isinstance(methods, dict) else ():
                if method in ("get", "put", "post", "delete", "options", "head", "patch", "trace"):
                    out.append(("endpoint", f"{method.upper()} {path}", str((x or {}).get("summary") or (x or {}).get("description") or "")))
        schemas = (data.get("components") or {}).get("schemas") or data.get("definitions") or {}
        return out + [("schema", n, str((x or {}).get("description") or "")) for n, x in sorted(schemas.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, f) for k, content in enumerate(batch.column(1).to_pylist()) for f in facts(content)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in found], pa.int64())), *(pa.array([f[i] for _, f in found], pa.string()) for i in range(3))], [key, "kind", "name", "description"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, kind string, name string, description string")


def read_documentation(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """SC15: (path relative to the root, content) of Markdown, JSON and YAML files; extensions are filtered before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,json,yaml,yml}").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = files.select(path.alias("path"), F.col("content").cast("string").alias("content")).where(~F.col("path").rlike(r"(^|/)\.git/"))
    for glob in exclude:
        rows = rows.where(~F.col("path").rlike("^" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*") + "$"))
    return rows
