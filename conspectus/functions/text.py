"""Scalar functions of the engine as Column builders: normalising, scoring, classifying names, paths and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as D

def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_description(d: Column | str) -> Column:
    """Lower case, trimmed, each white-space character one space (runs stay), no marks at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(_c(d))), r"\s", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def description_hash(d: Column | str) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the normalised description."""
    return F.substring(F.sha2(normalize_description(d).cast("binary"), 256), 1, 16)


def content_hash(text: Column | str) -> Column:
    """X3"""
    return F.sha2(_c(text).cast("binary"), 256)


def git_blob_id(content: Column | str, most: int = 50 * 1024 * 1024) -> Column:
    """SHA-1 of git's blob header and the bytes; null for content over `most` bytes."""
    b = _c(content).cast("binary")
    return F.when(F.octet_length(b) <= most, F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(b).cast("string")).cast("binary"), F.unhex(F.lit("00")), b)))


def case_pattern(name: Column | str) -> Column:
    """The case of an identifier, without the underscores at its ends; the first rule that fits counts."""
    return case_of(bare_name(name))


def bare_name(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), "^_+|_+$", "")


def case_of(n: Column) -> Column:
    """case_pattern of a bare name, which is looked at many times."""
    has = lambda p: n.rlike(p)
    upper, lower = has("[A-Z]"), has("[a-z]")
    return (
        F.when(n.isNull() | (n == ""), F.lit("unknown"))
        .when(has("-") & ~has("_") & ~upper, F.lit("kebab-case"))
        .when(upper & ~lower & has("_"), F.lit("SCREAMING_SNAKE_CASE"))
        .when(upper & ~lower & has("^[A-Z0-9]+$"), F.lit("UPPER"))
        .when(has("_") & ~upper, F.lit("snake_case"))
        .when(has("^[A-Z]") & lower & ~has("[_-]"), F.lit("PascalCase"))
        .when(has("^[a-z]") & upper & ~has("[_-]"), F.lit("camelCase"))
        .when(has("^[a-z0-9]+$"), F.lit("lower"))
        .otherwise(F.lit("unknown"))
    )


#: What a single word in one case also satisfies.
SATISFIES = {"snake_case": ("snake_case", "lower"), "camelCase": ("camelCase", "lower"), "kebab-case": ("kebab-case", "lower"), "PascalCase": ("PascalCase", "UPPER"), "SCREAMING_SNAKE_CASE": ("SCREAMING_SNAKE_CASE", "UPPER")}


def matches_case(pattern: Column | str, expected: str) -> Column:
    return _c(pattern).isin(*SATISFIES[expected])


def normalize_name(name: Column | str) -> Column:
    """X7"""
    return F.translate(F.lower(_c(name)), "-.", "__")


def name_score(name: Column | str, tokens: list[str]) -> Column:
    """The best of 1.0 (equal), 0.7 (starts with), 0.4 (contains), 0 over the tokens, all normalised."""
    n = normalize_name(name)
    scores = [F.when(n == t, F.lit(1.0)).when(n.startswith(t), F.lit(0.7)).when(n.contains(t), F.lit(0.4)).otherwise(F.lit(0.0)) for t in (t.lower().replace("-", "_").replace(".", "_") for t in tokens)]
    return F.greatest(*scores, F.lit(0.0)) if scores else F.lit(0.0)


def top_level_module(module: Column | str) -> Column:
    """X9"""
    return F.regexp_extract(_c(module), "^[^ :./]*", 0)


def root_package(module: Column | str, language: Column | str) -> Column:
    """The package that a module belongs to; a scoped npm package keeps two segments."""
    m, lang = _c(module), _c(language)
    js = F.when(m.startswith("@"), F.regexp_extract(m, "^@[^/]+(/[^/]+)?", 0)).otherwise(F.regexp_extract(m, "^[^/]*", 0))
    return F.when(lang.isin("typescript", "javascript"), js).when(lang == "rust", F.regexp_extract(m, "^[^:]*", 0)).otherwise(F.regexp_extract(m, r"^[^.]*", 0))


def first_segment(module: Column | str) -> Column:
    """X11"""
    return F.split(_c(module), r"::|\.")[0]


def module_to_path_suffix(module: Column | str) -> Column:
    """X12"""
    return F.regexp_replace(F.regexp_replace(_c(module), "^(?:(?:crate|super|self)::)+", ""), r"::|\.", "/")


def resolve_path(path: Column | str) -> Column:
    """X13: "." and ".." segments, empty segments and backslashes resolved."""
    parts = F.split(F.regexp_replace(_c(path), r"\\", "/"), "/")
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(done, "/")


def package_root(directory: Column | str) -> Column:
    """What stands before the last `src` component."""
    return F.regexp_extract(_c(directory), "^(.*?)/?src(?:/(?!.*src(?:/|$)).*)?$", 1)


def suffix_matches(path: Column | str, suffix: Column | str) -> Column:
    """equal, or ends with the suffix at a path boundary."""
    p, s = _c(path), _c(suffix)
    return (p == s) | p.endswith(F.concat(F.lit("/"), s))


def callee_matches(callee: Column | str, name: Column | str) -> Column:
    """F13"""
    c, n = _c(callee), _c(name)
    return (c == n) | c.endswith(F.concat(F.lit("::"), n)) | c.endswith(F.concat(F.lit("."), n))


def keywords(d: Column | str, stop: tuple[str, ...] = D.TOPIC_STOP_WORDS) -> Column:
    """Distinct words of two characters or more that are no stop words, in order."""
    words = F.filter(F.split(F.lower(_c(d)), r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) >= 2)
    return F.array_except(words, F.array(*map(F.lit, stop)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """0 for two empty lists."""
    either = F.size(F.array_union(_c(a), _c(b)))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / either)


def boost_confidence(c: Column | str, boost: float = 0.10) -> Column:
    """X22"""
    return F.least(_c(c) + F.lit(boost) * (1 - _c(c)), F.lit(1.0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for vectors of different lengths, zero or non-finite vectors."""
    x, y = _c(a), _c(b)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(total(F.transform(x, lambda p: p.cast("double") * p.cast("double")))) * F.sqrt(total(F.transform(y, lambda q: q.cast("double") * q.cast("double"))))
    out = dot / F.nullif(norm, F.lit(0.0))
    return F.when((F.size(x) != F.size(y)) | out.isNull() | F.isnan(out) | (F.abs(out) == float("inf")), F.lit(0.0)).otherwise(out)


def truncate_snippet(text: Column | str, lines: int = 20) -> Column:
    """Struct (content, truncated)."""
    parts = F.split(_c(text), "\n")
    return F.struct(F.array_join(F.slice(parts, 1, lines), "\n").alias("content"), (F.size(parts) > lines).alias("truncated"))


def snippet_window(text: Column | str, line: Column | str, end_line: Column | str, before: int = 2, after: int = 4, most: int = 30) -> Column:
    """The lines around [line, end_line] (from 1)."""
    parts = F.split(_c(text), "\n")
    start = F.greatest(_c(line) - before, F.lit(1))
    n = F.least(_c(end_line) + after, F.size(parts)) - start + 1
    return F.when(_c(line) >= 1, F.array_join(F.slice(parts, start.cast("int"), F.greatest(F.least(n, F.lit(most)), F.lit(0)).cast("int")), "\n")).otherwise(F.lit(""))


def percent(x: Column | str) -> Column:
    """Per cent of a share cut to [0, 1], half up."""
    return F.round(F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def blast_tier(n: Column | str) -> Column:
    """X29"""
    return F.when(_c(n).isNull(), F.lit("none")).when(_c(n) > 20, F.lit("high")).when(_c(n) >= 5, F.lit("medium")).otherwise(F.lit("low"))


def weight(confidence: Column | str, strong: float = 0.85, moderate: float = 0.50, weak: float = 0.20) -> Column:
    """A2: bounds belong to the lower tier."""
    c = _c(confidence)
    return F.when(c > strong, F.lit("strong")).when(c > moderate, F.lit("moderate")).when(c > weak, F.lit("weak")).otherwise(F.lit("info"))


def trend(p90: Column | str, now: Column | int, rising: int = 90, stable: int = 365) -> Column:
    """A3: by the age in whole days of the 90th percentile of commit times (seconds)."""
    at = F.lit(now) if isinstance(now, int) else now
    days = F.floor(F.greatest(at - _c(p90), F.lit(0)) / 86400)
    return F.when(_c(p90).isNull(), F.lit("unknown")).when(days < rising, F.lit("rising")).when(days < stable, F.lit("stable")).otherwise(F.lit("declining"))


def not_removed(ext: Column | str) -> Column:
    """F1"""
    return ~F.coalesce(F.get_json_object(_c(ext), "$.removed"), F.lit("0")).isin("1", "true")


def verdict(rules: Column | str, contradictions: Column | str, conventions: Column | str) -> Column:
    """From the numbers of rule violations, contradictions and related conventions."""
    return F.when(_c(rules) > 0, F.lit("blocked")).when(_c(contradictions) > 0, F.lit("conflict")).when(_c(conventions) > 0, F.lit("aligned")).otherwise(F.lit("unknown"))


def keyword_at_boundary(name: Column | str, words: list[str]) -> Column:
    """a keyword at the start, after "_" or "-", or capitalised after a lower-case letter."""
    n = _c(name)
    out = F.lit(False)
    for w in words:
        out = out | n.rlike(f"(?i)(?:^|[_-]){w}") | n.rlike(f"[a-z]{w[:1].upper()}{w[1:]}")
    return n.rlike(f"(?i){'|'.join(words)}") & out  # few names hold any


def pep508(spec: Column | str) -> Column:
    """Struct (name, version)."""
    s = F.trim(_c(spec))
    return F.struct(F.regexp_extract(s, r"^([\w.-]+)", 1).alias("name"), F.trim(F.regexp_extract(s, r"^[\w.-]+(?:\[[^\]]*\])?\s*([^;]*)", 1)).alias("version"))


def fuzzy_match(query: str, candidate: Column | str, distance: int = 2) -> Column:
    """Within `distance` edits of some window of the candidate whose length differs by at most 2."""
    q, c = query.lower(), F.lower(_c(candidate))
    if not q:
        return F.lit(True)
    lengths = [k for k in range(len(q) - 2, len(q) + 3) if k > 0]
    near = lambda k: F.exists(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.levenshtein(F.substr(c, i, F.lit(k)), F.lit(q)) <= distance)
    return c.contains(q) | F.greatest(*[near(k) for k in lengths])


def human_size(n: Column | str) -> Column:
    """X41"""
    b = _c(n)
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1024**2, F.concat(F.format_number(b / 1024, 1), F.lit(" KB"))).when(b < 1024**3, F.concat(F.format_number(b / 1024**2, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(b / 1024**3, 1), F.lit(" GB")))
