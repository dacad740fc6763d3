"""What a tree of files and a history of trees say as tables: ignore rules, the modules that imports name, first-parent histories."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.graph import keep
from ..session import ship_package

# --- SC1: ignore rules -------------------------------------------------------------------------------------------------


def path_pattern(pattern: str) -> str:
    """A regular expression for the paths that a pattern of an ignore file matches: ** crosses folders, *, ? and [...] do not."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k) and (not k or pattern[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern[k:] == "**" and (not k or pattern[k - 1] == "/"):
            out, k = out + ".+", k + 2
        elif pattern[k] == "*":
            out += "[^/]*"
            while pattern.startswith("*", k):
                k += 1
        elif pattern[k] == "?":
            out, k = out + "[^/]", k + 1
        elif pattern[k] == "[" and (end := pattern.find("]", k + 2)) > 0:
            inner = pattern[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif pattern[k] == "\\" and k + 1 < len(pattern):
            out, k = out + re.escape(pattern[k + 1]), k + 2
        else:
            out, k = out + re.escape(pattern[k]), k + 1
    return out


def rules_of(content: str) -> list[tuple[int, str, bool, bool]]:
    """(Line, regular expression for paths below the file's folder, whether it takes back, whether for folders alone) of an ignore file's rules."""
    out = []
    for line, raw in enumerate((content or "").split("\n")):
        text = raw.removesuffix("\r")
        while text.endswith(" ") and not text.endswith("\\ "):
            text = text[:-1]
        if not text or text.startswith("#"):
            continue
        back = text.startswith("!")
        text = text[back:]
        folders = text.endswith("/")
        text = text.rstrip("/") if folders else text
        if not text:
            continue
        anchored = "/" in text
        out.append((line, ("" if anchored else "(?:.*/)?") + path_pattern(text.removeprefix("/")), back, folders))
    return out


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rows (folder, depth, line, pattern, back, folders) of ignore files (path, content); rules of a path outside of the tree (`/`) come before all others."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p.rpartition("/")[0], -1 if p.startswith("/") else p.count("/"), *r) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rules_of(c)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["folder", "depth", "line", "pattern", "back", "folders"])

    return files.select("path", F.col("content").cast("string")).mapInArrow(run, "folder string, depth int, line int, pattern string, back boolean, folders boolean")


def _prefixes(path: Column) -> Column:
    """All that stands above a path, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def walked(paths: DataFrame, ignores: DataFrame, submodules: DataFrame | None = None) -> DataFrame:
    """SC1: the paths (path) that a walk of their tree comes to, by its ignore files (path, content) and submodules (path).

    Of the rules of all folders above an entry the last of the deepest folder that matches decides; a name that starts with a dot
    is passed over unless a rule takes it back; nothing below a folder that is passed over is reached, whatever its rules say.
    Each folder is judged once, however many paths are below it, and meets its rules by the folders above it.
    """
    found = paths.select("path").distinct()
    each = found.select("path", F.posexplode(_prefixes(F.col("path"))).alias("k", "entry"))
    entries = each.select("entry", (F.col("entry") != F.col("path")).alias("is_folder")).groupBy("entry").agg(F.bool_or("is_folder").alias("is_folder"))
    entries = keep(entries)
    above = entries.select("entry", "is_folder", F.explode(F.concat(F.array(F.lit("")), F.slice(_prefixes(F.col("entry")), F.lit(1), F.size(F.split("entry", "/")) - 1))).alias("folder"))
    rules = ignore_rules(ignores)
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substr(entry, length(folder) + 2)"))
    hits = above.join(R.if_few(keep(rules)), "folder").where((F.col("is_folder") | ~F.col("folders")) & F.regexp_like(below, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))))
    judged = hits.groupBy("entry").agg(F.max_by("back", F.struct("depth", "line")).alias("back"))
    name = F.element_at(F.split("entry", "/"), -1)
    passed = entries.join(judged, "entry", "left").where((name == ".git") | F.coalesce(~F.col("back"), name.startswith("."))).select("entry")
    if submodules is not None:
        passed = passed.unionAll(submodules.select(F.col("path").alias("entry")))
    gone = each.join(R.if_few(keep(passed.distinct())), "entry").select("path").distinct()
    return found.join(gone, "path", "left_anti")


# --- J18: the modules that imports name --------------------------------------------------------------------------------


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _inside(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def import_targets(files: DataFrame) -> DataFrame:
    """(key, module): the folder that a name stands for. Files name theirs, in the order of their paths, by path, stem, module paths and exports, and then folders by themselves; the first that names it counts."""
    path, folder = F.col("path"), _folder(F.col("path"))
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    python, rust = F.col("language") == "python", F.col("language") == "rust"
    dotted = lambda c: F.replace(c, F.lit("/"), F.lit("."))
    colons = lambda c: F.replace(c, F.lit("/"), F.lit("::"))
    own = F.array(stem, path, F.when(python, dotted(stem)), F.when(python & (folder != ""), dotted(folder)), F.when(rust, colons(stem)))
    exports = F.transform(F.filter("exports", lambda e: e["name"] != ""), lambda e: _inside(folder, e["name"]))
    by_file = files.select(F.lit(0).alias("phase"), path.alias("at"), folder.alias("module"), F.posexplode(F.concat(own, exports)).alias("k", "key"))
    folders = files.select(folder.alias("module")).distinct().where("module != ''")
    module = F.col("module")
    by_folder = folders.select(F.lit(1).alias("phase"), module.alias("at"), module, F.posexplode(F.array(module, colons(module), dotted(module), F.element_at(F.split(module, "/"), -1))).alias("k", "key"))
    return by_file.unionByName(by_folder).where("key IS NOT NULL").groupBy("key").agg(F.min_by("module", F.struct("phase", "at", "k")).alias("module"))


def module_dependencies(files: DataFrame) -> DataFrame:
    """(source, target): folders whose files import a name that stands for another folder.

    Each import's candidates, in order, meet the names in one equi join; the first hit counts.
    """
    folder, lang, m = _folder(F.col("path")), F.col("language"), F.col("m")
    i = files.select(folder.alias("source"), "language", F.explode("imports.module").alias("m")).distinct()
    up = _folder(F.col("source"))
    cleaned = F.regexp_replace(F.regexp_replace(m, r"^(\./)+", ""), r"^(\.\./)+", "")
    relative = F.when(m.startswith("../"), _inside(up, cleaned)).when(m.startswith("./"), _inside(F.col("source"), cleaned))
    path_of = lambda mark: F.replace(F.substr(m, F.lit(len(mark) + 1)), F.lit("::"), F.lit("/"))
    dots = m.startswith(".")
    candidates = F.concat(
        F.array(m, relative),
        F.when((lang == "python") & m.contains(".") & ~dots, F.array(F.substring_index(m, ".", 1))).otherwise(F.array().cast("array<string>")),
        F.when(lang == "rust", F.array(
            F.when(m.startswith("crate::"), path_of("crate::")), F.when(m.startswith("crate::"), F.concat(F.lit("src/"), path_of("crate::"))),
            F.when(m.startswith("super::") & (F.col("source") != ""), _inside(up, path_of("super::"))), F.when(m.startswith("self::"), _inside(F.col("source"), path_of("self::"))),
        )).otherwise(F.array().cast("array<string>")),
        F.array(F.when(lang.isin("typescript", "javascript"), F.concat(relative, F.lit("/index")))),
    )
    each = i.select("source", "language", "m", F.posexplode(candidates).alias("k", "key")).where("key IS NOT NULL")
    hits = each.join(import_targets(files), "key").groupBy("source", "language", "m").agg(F.min_by("module", "k").alias("target"))
    return hits.where("source != target").select("source", "target").distinct()


# --- SC16: histories ---------------------------------------------------------------------------------------------------


def first_parents(commits: DataFrame, head: DataFrame) -> DataFrame:
    """SC16: (id, pos): the commits (id, parent) from head (id) back along first parents, with their distance from it, by pointer doubling: as many joins as the distance has binary digits, twice."""
    jump = keep(commits.where("parent IS NOT NULL").select("id", "parent"))
    jumps = []
    while jump.head(1):
        jumps.append(jump)
        jump = keep(jump.join(jump.select(F.col("id").alias("parent"), F.col("parent").alias("further")), "parent").select("id", F.col("further").alias("parent")))
    found = commits.join(head.select("id"), "id", "left_semi").select("id", F.lit(0).cast("bigint").alias("pos"))
    for k in range(len(jumps) - 1, -1, -1):
        found = keep(found.unionAll(found.join(jumps[k], "id").select(F.col("parent").alias("id"), F.col("pos") + (1 << k))))
    return found


def last_changes(commits: DataFrame, trees: DataFrame, head: DataFrame) -> DataFrame:
    """SC16, A12: (path, last_commit_date): of each path the time of the newest commit, along first parents from head, whose tree (commit, path, oid) differs from its parent's there; commits (id, parent, ts)."""
    walk = keep(first_parents(commits, head).join(commits.select("id", "ts"), "id"))
    rows = trees.select(F.col("commit").alias("id"), "path", "oid").join(walk, "id")
    before = rows.select((F.col("pos") - 1).alias("pos"), "path", F.col("oid").alias("old"))
    changed = rows.select("pos", "path", "oid").join(before, ["pos", "path"], "full_outer").where("pos >= 0 AND NOT oid <=> old")
    newest = changed.groupBy("path").agg(F.min("pos").alias("pos"))
    return newest.join(walk.select("pos", F.col("ts").alias("last_commit_date")), "pos").select("path", "last_commit_date")
