"""Scalar functions on the names, paths, descriptions and rows of a code base, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as D
from . import text as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


# --- paths and modules -------------------------------------------------------------------------------------------------


def components(path: Column | str) -> Column:
    """The folders of a path, without the file's name."""
    parts = F.split(F.regexp_replace(_c(path), r"\\", "/"), "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: ~x.isin("", "."))


def segment_after(path: Column | str, marker: str) -> Column:
    """The segment after the first marker that has one behind it, or null."""
    parts = F.split(F.regexp_replace(_c(path), r"\\", "/"), "/")
    after = F.transform(parts, lambda x, k: F.when(x == marker, F.nullif(F.get(parts, k + 1), F.lit(""))))
    return F.get(F.filter(after, lambda x: x.isNotNull()), F.lit(0))


def strip_root(path: Column | str, root: Column | str) -> Column:
    """The path below a root, or null where it does not stand below it; an empty root is above all."""
    p, r = F.regexp_replace(_c(path), r"\\", "/"), F.rtrim(F.regexp_replace(_c(root), r"\\", "/"), F.lit("/"))
    below = p.startswith(F.concat(r, F.lit("/")))
    return F.when(r == "", _c(path)).when(below, F.substr(p, F.length(r) + 2)).when(p == r, F.lit(""))


def file_module_path(path: Column | str, language: Column | str) -> Column:
    """The module that a file is to its importers; null for a file without its language's extension."""
    p, lang = _c(path), _c(language)
    inner = F.regexp_replace(F.regexp_replace(p, r"^src/", ""), r"\.rs$", "")
    rust = F.when(inner.isin("lib", "main"), F.lit("crate")).otherwise(F.concat(F.lit("crate::"), F.replace(F.regexp_replace(inner, "/mod$", ""), F.lit("/"), F.lit("::"))))
    script = F.regexp_replace(F.regexp_replace(p, r"\.(tsx?|jsx?|mjs|cjs)$", ""), "/index$", "")
    python = F.replace(F.regexp_replace(F.regexp_replace(p, r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))
    return (
        F.when((lang == "rust") & p.endswith(".rs"), rust)
        .when(lang.isin("typescript", "javascript") & p.rlike(r"\.(tsx?|jsx?|mjs|cjs)$"), script)
        .when((lang == "python") & p.endswith(".py"), python)
    )


def is_vendored(path: Column | str) -> Column:
    """some folder of the path holds what others wrote."""
    return F.arrays_overlap(components(path), _strings(D.VENDORED_DIRS))


def is_likely_internal(module: Column | str, internal: Column) -> Column:
    """F16: relative and crate-local modules, aliases, and those whose first part is among the project's names."""
    m = _c(module)
    marks = reduce(lambda a, b: a | b, [m.startswith(x) for x in (".", "/", "@/", "~/", "#", "crate::", "self::", "super::")])
    return marks | m.isin("crate", "self", "super") | F.array_contains(internal, F.translate(T.top_level_module(m), "-", "_"))


def deepest_of(parts: Column, names: tuple[str, ...]) -> Column:
    """The last of the folders that is one of the names, as it is written, or null."""
    return F.get(F.filter(F.reverse(parts), lambda x: F.lower(x).isin(*names)), F.lit(0))


def earliest_of(parts: Column, names: tuple[str, ...]) -> Column:
    """The place, from 0, of the first of the folders that is one of the names, or null."""
    return F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(F.lower(x).isin(*names), i)), lambda i: i.isNotNull()))


# --- descriptions --------------------------------------------------------------------------------------------------------


def search_keywords(d: Column | str) -> Column:
    """The words of a search, in order, with repeats: more than one byte, no stop words."""
    return F.filter(F.split(F.lower(F.trim(_c(d))), r"\s+"), lambda w: (F.octet_length(w) > 1) & ~w.isin(*D.SEARCH_STOP_WORDS))


def choices(d: Column | str) -> Column:
    """What a description chooses: the words after its signal phrases, without marks at their ends, sorted, once each."""
    low = F.lower(_c(d))
    after = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(rf"{phrase}(?=([^\s,;)]*))"), F.lit(1)) for phrase in D.CHOICE_PHRASES]))
    bare = F.transform(after, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*D.NO_CHOICES))))


def relationship(a: Column, b: Column) -> Column:
    """Of two lists of choices: reinforcement where one is, holds or lies in one of the other; contradiction where none does; unrelated without choices."""
    agree = F.exists(a, lambda x: F.exists(b, lambda y: x.contains(y) | y.contains(x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit("unrelated")).when(agree, F.lit("reinforcement")).otherwise(F.lit("contradiction"))


def domain_and_package(d: Column | str) -> Column:
    """Struct (domain, package) of a description "Canonical D library: P"; others have the whole description as the package."""
    m = r"^Canonical (.*?) library: (.*)$"
    hit = _c(d).rlike(m)
    return F.struct(F.when(hit, F.regexp_extract(_c(d), m, 1)).otherwise(F.lit("other")).alias("domain"), F.when(hit, F.regexp_extract(_c(d), m, 2)).otherwise(_c(d)).alias("package"))


def readiness(verdict: Column | str) -> Column:
    """What a verdict says of going on."""
    return F.when(_c(verdict) == "blocked", F.lit("stop")).when(_c(verdict) == "conflict", F.lit("review")).when(_c(verdict) == "aligned", F.lit("go")).otherwise(F.lit("unknown"))


def snapshot_hash(ext: Column | str) -> Column:
    """A hash of a row's extra data at the time it was shown, to tell whether it has changed since; null counts as empty."""
    return F.xxhash64(F.coalesce(_c(ext), F.lit("")))


def clean_doc(text: Column | str, lines: int) -> Column:
    """The first lines that are not empty, without the marks of headings."""
    own = F.transform(F.split(_c(text), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    return F.array_join(F.slice(F.filter(own, lambda x: x != ""), 1, lines), "\n")


def is_noise_doc(text: Column | str) -> Column:
    """Directives to tools, and what is too short to say something."""
    s = F.trim(_c(text))
    return s.rlike(r"^(@ts-|@type|@jest-|@flow|@noinspection|(// |/\* )?eslint-disable|noqa|#!)|type: ?ignore") | (F.octet_length(s) < 8)


def clean_comment(raw: Column | str) -> Column:
    """A block comment without its marks, stars and empty ends."""
    inner = F.regexp_replace(F.trim(_c(raw)), r"^/\*+|\*+/$", "")
    return F.trim(F.array_join(F.transform(F.split(inner, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+ ?", ""))), "\n"))


# --- definitions and changes ---------------------------------------------------------------------------------------------


def _visible(public: Column, language: Column) -> Column:
    return F.when(~public, F.lit("")).when(language == "rust", F.lit("pub ")).when(language.isin("typescript", "javascript"), F.lit("export ")).otherwise(F.lit(""))


def function_snippet(name: Column, public: Column, is_async: Column, parameters: Column, language: Column) -> Column:
    """X25"""
    word = F.when(language == "rust", F.lit("fn")).when(language == "python", F.lit("def")).otherwise(F.lit("function"))
    return F.concat(_visible(public, language), F.when(is_async, F.lit("async ")).otherwise(F.lit("")), word, F.lit(" "), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))


def type_snippet(name: Column, kind: Column, public: Column, language: Column) -> Column:
    """X25"""
    return F.concat(_visible(public, language), F.when(kind == "type alias", F.lit("type")).otherwise(kind), F.lit(" "), name)


def export_snippet(name: Column, is_default: Column, type_only: Column, language: Column) -> Column:
    """X25"""
    script = F.concat(F.lit("export "), F.when(is_default, F.lit("default ")).otherwise(F.lit("")), F.when(type_only, F.lit("type ")).otherwise(F.lit("")), name)
    return F.when(language == "rust", F.concat(F.lit("pub use "), name)).when(language == "python", name).otherwise(script)


def intersection(start: Column, end: Column, line: Column, end_line: Column) -> Column:
    """Struct (first, last) of the lines that a half-open hunk and an inclusive span share; a deletion stands for its own line."""
    last = F.greatest(end - 1, start)
    return F.struct(F.greatest(start, line).alias("first"), F.least(last, end_line).alias("last"))


def has_conflict_markers(text: Column | str) -> Column:
    """some line starts with seven angle brackets."""
    return F.coalesce(_c(text).rlike(r"(?m)^<<<<<<<"), F.lit(False))


def is_risky(confidence: Column, evidence: Column, weight: Column, adoption: Column) -> Column:
    """conventions that a change may break: evidence is a list, half of the files follow, and a strong weight or three files."""
    return (confidence >= 0.5) & F.coalesce(evidence.rlike(r"^\s*\["), F.lit(False)) & (weight.isin("rule", "strong") | (adoption >= 3))


def from_source(ext: Column | str) -> Column:
    """extra data of a detected or a user's convention that is not removed."""
    return F.coalesce(F.get_json_object(_c(ext), "$.source").isin("auto_detected", "user"), F.lit(False)) & T.not_removed(ext)


def embedding_text(kind: Column, name: Column, path: Column, signature: Column, body: Column, imports: Column) -> Column:
    """What stands for a symbol in an embedding: its signature, file, body and up to twenty imports."""
    uses = F.when(F.size(imports) > 0, F.concat(F.lit("imports: "), F.array_join(F.slice(imports, 1, 20), ", ")))
    return F.concat_ws("\n", F.concat(kind, F.lit(" "), name), signature, F.concat(F.lit("file: "), path), F.nullif(body, F.lit("")), uses)
