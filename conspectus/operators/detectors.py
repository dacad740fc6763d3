"""Convention detectors: table-valued functions from files (schemas.FILE) to findings, as column expressions.

A detector is a function of the files' DataFrame. Each array is looked at inside its row by higher-order functions, so that
detectors do not shuffle, but for the packages used and the cross-file one; those of the rows are all read in one pass over
the files. What several findings, or each element of an array, look at is a column of its own, made once for a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as T
from .graph import keep
from .relational import if_few

#: Languages as descriptions name them, and the cases they expect.
DISPLAY = {"rust": "Rust", "typescript": "TypeScript", "javascript": "JavaScript", "python": "Python"}
FUNCTION_CASE = {"rust": "snake_case", "python": "snake_case", "typescript": "camelCase", "javascript": "camelCase"}
FILE_CASE = {"rust": "snake_case", "python": "snake_case", "typescript": "kebab-case", "javascript": "kebab-case"}
SPECIAL_STEMS = ("mod", "lib", "main", "index", "__init__", "__main__", "conftest", "setup", "build")

#: Logging libraries by package, and those that log structures.
LOGGERS = {
    "tracing": "tracing tracing_subscriber tracing_log tracing_appender tracing_futures tracing_opentelemetry", "log": "log env_logger pretty_env_logger flexi_logger simple_logger fern",
    "slog": "slog slog_async slog_term slog_json slog_scope", "winston": "winston winston_daily_rotate_file winston_transport", "pino": "pino pino_pretty pino_http", "bunyan": "bunyan",
    "log4js": "log4js", "logging (stdlib)": "logging", "loguru": "loguru", "structlog": "structlog",
}
STRUCTURED = ("tracing", "slog", "pino", "bunyan", "structlog")
#: What names of unknown logging packages hold, and names of log levels.
LOGGING_HINTS = ("log", "logger", "logging", "trace", "tracing", "observ")
LEVELS = ("info", "debug", "warn", "error", "fatal", "trace")
#: Exceptions of Python itself that a class may share its name with.
BUILTIN_EXCEPTIONS = tuple("Exception BaseException ValueError TypeError KeyError IndexError AttributeError IOError OSError RuntimeError NotImplementedError StopIteration ImportError FileNotFoundError PermissionError ConnectionError TimeoutError ArithmeticError LookupError EnvironmentError SystemError UnicodeError AssertionError".split())
#: Words of unknown testing packages.
TESTING_HINTS = ("test", "mock", "assert", "spec")


def domain_rows() -> list[tuple[str, str, str]]:
    """(language, package, domain) of well-known packages, lower-cased, with underscores."""
    tables = {"rust": D.RUST_DOMAINS, "typescript": D.SCRIPT_DOMAINS, "javascript": D.SCRIPT_DOMAINS, "python": D.PYTHON_DOMAINS}
    return [(lang, package, domain) for lang, table in tables.items() for domain, names in table.items() for package in names.split()]


def _strings(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, words))


def known_domain(package: Column, language: Column) -> Column:
    """The domain of a well-known package, or null. The dictionaries are constants, looked up in the row."""
    name = F.translate(F.lower(package), "-", "_")
    out = F.lit(None).cast("string")
    for languages, table in ((("rust",), D.RUST_DOMAINS), (("typescript", "javascript"), D.SCRIPT_DOMAINS), (("python",), D.PYTHON_DOMAINS)):
        of = F.lit(None).cast("string")
        for domain, names in table.items():
            of = F.coalesce(of, F.when(name.isin(*names.split()), F.lit(domain)))
        out = F.coalesce(out, F.when(language.isin(*languages), of))
    return out


def likely_domain(package: Column, language: Column) -> Column:
    """The domain that a word of an unknown package's name speaks for, or null; modules of Python itself have none."""
    return F.when(known_domain(package, language).isNull(), _telling_domain(package, language))


def _telling_domain(package: Column, language: Column) -> Column:
    out = F.lit(None).cast("string")
    for domain, words in D.TELLING_WORDS:
        out = F.coalesce(out, F.when(T.keyword_at_boundary(package, words.split()), F.lit(domain)))
    some = "|".join(w for _, words in D.TELLING_WORDS for w in words.split())
    return F.when(package.rlike(f"(?i){some}") & ~((language == "python") & is_stdlib(package, language)), out)


def is_stdlib(module: Column, language: Column) -> Column:
    """Whether a module is one of its language's own."""
    first = F.split(module, r"\.")[0]
    py, rs = first.isin(*D.PYTHON_STDLIB), F.split(module, "::")[0].isin(*D.RUST_BUILTINS)
    return F.when(language == "python", py).when(language == "rust", rs).otherwise(module.startswith("node:") | module.isin(*D.NODE_BUILTINS))


def _lang(table: dict[str, str], default: str | None = None) -> Column:
    return reduce(lambda c, kv: c.when(F.col("language") == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(None))).otherwise(F.lit(default))


def _row(detector: str, description: Column | str, nature: Column | str = "convention", follows: Column | bool = True, kind: str = "pattern", line: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(detector).alias("detector"), lit(nature).alias("nature"), F.lit(kind).alias("kind"), lit(description).alias("description"), lit(follows).cast("boolean").alias("follows"), lit(line).cast("int").alias("line"), F.lit("file_level" if isinstance(line, int) else "declaration").alias("anchor"))


def _finding(detector: str, when: Column, description: Column | str, nature: Column | str = "convention", follows: Column | bool = True, kind: str = "pattern", line: Column | int = 0) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), _row(detector, description, nature, follows, kind, line))


#: What a detector reads off a row: columns to be made first, in steps that build on each other, and its findings.
Held = list[dict[str, Column]]


def _emit(files: DataFrame, *parts: tuple[Held, list[Column]]) -> DataFrame:
    """The findings of detectors, in one pass; a finding is a struct or null, or an array of structs."""
    for k in range(max(len(held) for held, _ in parts)):
        files = files.withColumns({name: c for held, _ in parts for name, c in (held[k] if k < len(held) else {}).items()})
    rows = F.filter(F.array(*[f for _, findings in parts for f in findings if not isinstance(f, list)]), lambda x: x.isNotNull())
    more = [f for _, findings in parts for each in findings if isinstance(each, list) for f in each]
    return files.select("path", F.explode(F.flatten(F.filter(F.array(rows, *more), lambda x: x.isNotNull()))).alias("f")).select("path", "f.*")


def naming(files: DataFrame) -> DataFrame:
    """One finding of a kind in a file: it follows if some names conform and none of the known cases does not."""
    return _emit(files, _naming())


def _naming() -> tuple[Held, list[Column]]:
    lang = _lang(DISPLAY)
    nature = F.when(F.col("language") == "rust", "observation").otherwise("convention")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.(?:test|spec|d))?\.\w+$", 1)
    parameters = F.flatten(F.transform("functions", lambda f: f["parameters"]))
    types = F.transform("types", lambda x: x["name"])
    upper = F.filter(types, lambda n: n.rlike("^[A-Z][A-Z0-9_]*$") & (F.length(n) > 1))
    names = {
        "Function naming": (F.transform("functions", lambda f: f["name"]), FUNCTION_CASE),
        "Parameter naming": (parameters, FUNCTION_CASE),
        "Type naming": (F.filter(types, lambda n: ~(n.rlike("^[A-Z][A-Z0-9_]*$") & n.contains("_"))), dict.fromkeys(DISPLAY, "PascalCase")),
        "File naming": (F.filter(F.array(stem), lambda s: ~s.isin(*SPECIAL_STEMS)), FILE_CASE),
        "Constant naming": (F.filter(upper, lambda n: n.contains("_")), dict.fromkeys(DISPLAY, "SCREAMING_SNAKE_CASE")),
    }
    out, held = [], {}
    for what, (column, case) in names.items():
        held[f"_naming_{len(held)}"] = F.filter(F.transform(F.transform(column, T.bare_name), T.case_of), lambda p: p != "unknown")
        patterns = F.col([*held][-1])
        good = reduce(lambda c, kv: c.when(F.col("language") == kv[0], F.size(F.filter(patterns, _matcher(kv[1])))), case.items(), F.when(F.lit(False), F.lit(0)))
        out.append(_finding("naming_conventions", F.size(patterns) > 0, F.concat(F.lit(f"{what}: "), _lang(case), F.lit(" convention ("), lang, F.lit(")")), nature, good == F.size(patterns)))
    return [held], out


def _matcher(expected: str):
    return lambda p: T.matches_case(p, expected)


def file_structure(files: DataFrame) -> DataFrame:
    """By-type or by-layer directories (the earlier one; on a tie the layer), else by-feature; common directories; configuration."""
    return _emit(files, _file_structure())


def _file_structure() -> tuple[Held, list[Column]]:
    parts, low = F.col("_structure_parts"), F.col("_structure_low")
    held = [{"_structure_parts": F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))}, {"_structure_low": F.transform(parts, F.lower)}]
    first = lambda names: F.array_min(F.filter(F.transform(low, lambda x, i: F.when(x.isin(*names), i)), lambda i: i.isNotNull()))
    held.append({"_structure_kind": first(D.TYPE_DIRS), "_structure_layer": first(D.LAYER_DIRS), "_structure_root": first(D.SOURCE_ROOTS)})
    kind, layer, root = map(F.col, held[-1])
    by_layer = layer.isNotNull() & (kind.isNull() | (layer <= kind))
    below = F.slice(low, root + 2, F.greatest(F.size(low) - root - 1, F.lit(0)))
    other = F.exists(below, lambda x: ~x.isin(*D.TYPE_DIRS, *D.LAYER_DIRS, *D.COMMON_DIRS, *D.CONFIG_DIRS, *D.SOURCE_ROOTS) & ~x.rlike("^[._]") & (F.length(x) > 1))
    common = F.get(F.filter(F.reverse(parts), lambda x: F.lower(x).isin(*D.COMMON_DIRS) & ~F.lower(x).isin(*D.TEST_DIRS)), F.lit(0))
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    config = reduce(lambda a, b: a | b, [name.startswith(x) for x in D.CONFIG_FILES])
    in_dir = F.exists(low, lambda x: x.isin(*D.CONFIG_DIRS))
    d = "file_structure"
    return held, [
        _finding(d, by_layer, "By-layer directory organization (domain/, infrastructure/, application/)"),
        _finding(d, kind.isNotNull() & ~by_layer, "By-type directory organization (models/, controllers/, services/)"),
        _finding(d, kind.isNull() & layer.isNull() & root.isNotNull() & other, "By-feature directory organization (domain-specific directories)"),
        _finding(d, common.isNotNull(), F.concat(F.lit("Uses '"), common, F.lit("/' directory convention")), "observation"),
        _finding(d, config & in_dir, "Configuration files placed in config directory"),
        _finding(d, config & ~in_dir & (F.size(parts) <= 1), "Configuration files placed at project root"),
    ]


def _group(module: Column) -> Column:
    """0 standard library, 1 external, 2 internal."""
    lang = F.col("language")
    top = T.top_level_module(module)
    root = F.split(module, r"\.")[0]
    py = F.when(module.startswith("."), 2).when(root.isin(*D.PYTHON_STDLIB), 0).when(root.isin(*D.PYTHON_OWN), 2).otherwise(1)
    js = F.when(module.startswith(".") | module.startswith("/") | module.startswith("@/") | module.startswith("~"), 2).when(module.startswith("node:") | module.isin(*D.NODE_BUILTINS), 0).otherwise(1)
    rs = F.when(top.isin("crate", "self", "super"), 2).when(top.isin("std", "core", "alloc"), 0).otherwise(1)
    return F.when(lang == "python", py).when(lang == "rust", rs).otherwise(js)


def import_organization(files: DataFrame) -> DataFrame:
    """Files of two imports or more."""
    return _emit(files, _import_organization())


def _import_organization() -> tuple[Held, list[Column]]:
    d, i = "import_organization", F.col("imports")
    n = F.size(i)
    inner = F.filter(i, lambda x: x["module"].startswith("."))
    typed = F.filter(F.transform(i, lambda x, k: F.when(x["is_type_only"], k)), lambda k: k.isNotNull())
    held = [{"_organization_groups": F.transform(i, lambda x: _group(x["module"])), "_organization_lines": F.transform(i, lambda x: x["line"]), "_organization_typed": typed, "_organization_froms": F.size(F.filter(i, lambda x: F.size(x["names"]) > 0)), "_organization_inner": inner}]
    groups, lines, typed, froms, inner = map(F.col, held[0])
    steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    held.append({"_organization_falls": F.exists(steps, lambda k: F.get(groups, k) < F.get(groups, k - 1)), "_organization_turns": F.filter(steps, lambda k: F.get(groups, k) != F.get(groups, k - 1))})
    falls, turns = map(F.col, held[1])
    apart = (F.size(turns) > 0) & F.forall(turns, lambda k: F.get(lines, k) - F.get(lines, k - 1) > 1)
    mixed = (n >= 2) & (F.size(F.array_distinct(groups)) >= 2)
    together = F.array_max(typed) - F.array_min(typed) + 1 == F.size(typed)
    bare = n - froms
    lang = F.col("language")
    barrels = F.size(F.filter(inner, lambda x: x["module"].rlike(r"/index(\.js|\.ts)?$")))
    return held, [
        _finding(d, mixed & ~falls & apart, "Imports grouped in canonical order with blank-line separators"),
        _finding(d, mixed & ~falls & ~apart, "Imports ordered by group but without blank-line separators"),
        _finding(d, mixed & falls, "Imports not grouped in canonical order (stdlib → external → internal)", "observation", False),
        _finding(d, (n >= 2) & (lang == "rust") & F.array_contains(groups, 0) & F.array_contains(groups, 1), "Rust use grouping: std/core, external crates, crate/self/super"),
        _finding(d, (n >= 2) & (lang == "typescript") & (F.size(typed) > 0) & together, "Type-only imports separated (TypeScript)"),
        _finding(d, (n >= 2) & (lang == "typescript") & (F.size(typed) > 0) & ~together, "Type-only imports interleaved with value imports (TypeScript)", "observation", False),
        _finding(d, (n >= 2) & F.col("typescript.has_barrel_exports"), "Barrel export file detected (re-exports via index)"),
        _finding(d, (n >= 2) & F.col("javascript.has_module_exports"), "CommonJS module.exports detected alongside imports", "observation"),
        _finding(d, (n >= 2) & (lang == "python") & (bare == 0), "Python import style: exclusively from-import"),
        _finding(d, (n >= 2) & (lang == "python") & (froms == 0), "Python import style: exclusively bare import"),
        _finding(d, (n >= 2) & (lang == "python") & (froms > 0) & (bare > 0), F.when(froms >= bare, "Python import style: prefers from-import").otherwise("Python import style: prefers import")),
        _finding(d, lang.isin("typescript", "javascript") & (F.size(inner) >= 2), F.when(barrels * 2 > F.size(inner), "Internal import style: prefers barrel (index) imports").otherwise("Internal import style: prefers direct file imports")),
    ]


def export_patterns(files: DataFrame) -> DataFrame:
    """D3"""
    return _emit(files, _export_patterns())


def _export_patterns() -> tuple[Held, list[Column]]:
    d, lang, x = "export_patterns", F.col("language"), F.col("exports")
    script = lang.isin("typescript", "javascript")
    held = [{"_exports_defaults": F.size(F.filter(x, lambda e: e["is_default"]))}]
    defaults, n = F.col("_exports_defaults"), F.size(x)
    name = F.concat(F.lit(" ("), _lang(DISPLAY), F.lit(")"))
    stem = F.regexp_extract("path", r"([^/.]+)\.\w+$", 1)
    system = F.col("javascript.module_system")
    public = F.size(F.filter("functions", lambda f: f["is_public"])) + F.size(F.filter("types", lambda t: t["is_public"]))
    mods, root = F.size("rust.mod_declarations"), stem.isin("lib", "mod")
    return held, [
        _finding(d, script & (n > 0) & (defaults == n), F.concat(F.lit("Uses default exports exclusively"), name)),
        _finding(d, script & (n > 0) & (defaults == 0), F.concat(F.lit("Uses named exports exclusively"), name)),
        _finding(d, script & (defaults > 0) & (defaults < n), F.concat(F.lit("Mixes default and named exports"), name), "observation", False),
        _finding(d, F.col("typescript.has_barrel_exports") | script & stem.isin("index", "mod") & (n > 1), "Uses barrel export pattern (re-exports from index file)"),
        _finding(d, (lang == "typescript") & F.exists(x, lambda e: e["is_type_only"]), "Uses type-only exports (TypeScript)"),
        _finding(d, F.col("javascript.has_module_exports"), "Uses CommonJS module.exports pattern", "observation"),
        _finding(d, system == "esm", "Uses ESM module system", "observation"),
        _finding(d, system == "commonjs", "Uses CommonJS module system", "observation"),
        _finding(d, system == "mixed", "Mixes ESM and CommonJS module systems in the same file", "observation", False),
        _finding(d, (lang == "rust") & (public > 0), "pub visibility pattern (Rust)", "observation"),
        _finding(d, (lang == "rust") & (mods > 0) & root, "Module declarations (module root file) (Rust)"),
        _finding(d, (lang == "rust") & (mods > 0) & ~root, "Module declarations (Rust)", "observation"),
        _finding(d, (lang == "rust") & F.arrays_overlap(F.transform(x, lambda e: e["line"]), F.transform("imports", lambda i: i["line"])), "Uses pub use re-exports (Rust)"),
        _finding(d, F.col("python.has_all_export"), "Uses __all__ to define explicit public API"),
        _finding(d, F.col("python.is_init_file") & (F.size("imports") > 0), "Uses __init__.py as package re-export point"),
        _finding(d, (lang == "python") & (n > 0) & ~F.col("python.has_all_export"), "Exports without __all__ definition (Python)", "observation", False),
    ]


def _packages() -> Column:
    return F.array_distinct(F.transform("dependencies_used", lambda x: F.translate(F.lower(x["package"]), "-", "_")))


def error_handling(files: DataFrame) -> DataFrame:
    """D2"""
    return _emit(files, _error_handling())


def _error_handling() -> tuple[Held, list[Column]]:
    d, lang = "error_handling", F.col("language")
    known = F.array_sort(F.array_intersect(_packages(), F.array(*map(F.lit, ("anyhow", "color_eyre", "eyre", "miette", "snafu", "thiserror")))))
    wraps = F.filter("imports", lambda i: i["module"].rlike("^(anyhow|eyre|color_eyre)") & F.arrays_overlap(i["names"], F.array(F.lit("Context"), F.lit("WrapErr"))))
    held = [{"_errors_known": known, "_errors_wraps": wraps}]
    known, wraps = map(F.col, held[0])
    derives = F.exists("rust.derive_macros", lambda m: F.exists(m["derives"], lambda x: x.rlike("(^|::)Error$")))
    impls = F.exists("rust.trait_implementations", lambda t: t["trait_name"].rlike("(^|::)Error$"))
    first = F.when(F.array_contains(known, "thiserror"), "thiserror").when(F.array_contains(known, "anyhow"), "anyhow").otherwise(F.get(known, F.lit(0)))
    classes = F.exists("types", lambda t: (t["kind"] == "class") & t["name"].rlike("(Error|Exception)$"))
    builtin = F.exists("types", lambda t: (t["kind"] == "class") & t["name"].isin(*BUILTIN_EXCEPTIONS))
    own = F.exists("types", lambda t: (t["kind"] == "class") & t["name"].rlike("(Error|Exception)$") & ~t["name"].isin(*BUILTIN_EXCEPTIONS))
    named = F.exists("functions", lambda f: F.lower(f["name"]).contains("error"))
    return held, [
        _finding(d, (lang == "rust") & (F.size(known) > 0), F.concat(F.lit("Rust error handling: "), first)),
        _finding(d, (lang == "rust") & (F.size(known) == 0) & (derives | impls), "Rust error handling: unknown library with Error derive/impl", "observation"),
        _finding(d, (lang == "rust") & (F.size(known) > 1), F.concat(F.lit("Multiple error handling libraries in same file: "), F.array_join(known, ", ")), "observation", False),
        _finding(d, F.size(wraps) > 0, F.concat(F.lit("Error wrapping via "), T.first_segment(F.get(wraps, F.lit(0))["module"]), F.lit("::Context"))),
        _finding(d, (lang == "rust") & impls & ~F.array_contains(known, "thiserror"), "Manual std::error::Error trait implementation"),
        _finding(d, F.exists("rust.trait_implementations", lambda t: t["trait_name"].contains("From<") & t["type_name"].contains("Error")), "Error type conversion via From impls (Rust)"),
        _finding(d, lang.isin("typescript", "javascript") & classes, F.concat(F.lit("Custom error classes ("), _lang(DISPLAY), F.lit(")"))),
        _finding(d, (lang == "typescript") & (F.exists("types", lambda t: t["name"].isin("Result", "Either")) | F.exists("imports", lambda i: F.arrays_overlap(i["names"], F.array(F.lit("Result"), F.lit("Either"))))), "Result/Either pattern for error handling"),
        _finding(d, (lang == "typescript") & F.exists("functions", lambda f: f["name"].rlike("(?i)^is.*error")), "Error type guard functions detected", "observation"),
        _finding(d, (lang == "javascript") & F.exists("imports", lambda i: i["module"].isin("bluebird")), "Promise library for error handling", "observation"),
        _finding(d, (lang == "javascript") & named, "Error handler functions detected", "observation"),
        _finding(d, (lang == "python") & own, "Custom exception hierarchy (Python)"),
        _finding(d, (lang == "python") & ~own & builtin, "Uses built-in exception types only", "observation"),
        _finding(d, (lang == "python") & F.exists("imports", lambda i: i["module"] == "contextlib"), "contextlib used for error context management", "observation"),
        _finding(d, (lang == "python") & named, "Error handling utility functions", "observation"),
    ]


def logger_of(package: Column) -> Column:
    """The logging library that a package belongs to, or null."""
    name = F.translate(F.lower(package), "-", "_")
    out = F.lit(None).cast("string")
    for library, packages in LOGGERS.items():
        out = F.coalesce(out, F.when(name.isin(*packages.split()), F.lit(library)))
    return F.when(name.isin(*" ".join(LOGGERS.values()).split()), out)


def logging_observability(files: DataFrame) -> DataFrame:
    """D6"""
    return _emit(files, _logging_observability())


def _logging_observability() -> tuple[Held, list[Column]]:
    d, lang = "logging_observability", F.col("language")
    used = F.array_union(F.transform("dependencies_used", lambda x: x["package"]), F.transform("imports", lambda i: T.top_level_module(i["module"])))
    hinted = lambda m: F.lower(m).rlike("|".join(LOGGING_HINTS)) & logger_of(m).isNull() & logger_of(T.top_level_module(m)).isNull() & ~((lang == "python") & is_stdlib(m, lang))
    levels = lambda i: (F.size(i["names"]) >= 2) & (F.size(F.filter(i["names"], lambda n: F.lower(n).isin(*LEVELS))) >= 2)
    held = [{
        "_logging_known": F.array_sort(F.array_distinct(F.filter(F.transform(used, logger_of), lambda x: x.isNotNull()))),
        "_logging_packages": F.filter(F.transform("dependencies_used", lambda x: x["package"]), hinted),
        "_logging_shaped": F.filter("imports", lambda i: levels(i) & logger_of(i["module"]).isNull()),
    }]
    known, packages, shaped = map(F.col, held[0])
    structured = F.arrays_overlap(known, _strings(STRUCTURED))
    held.append({"_logging_modules": F.filter(F.transform("imports", lambda i: i["module"]), lambda m: hinted(m) & ~F.array_contains(packages, m))})
    modules = F.col("_logging_modules")
    none = F.size(known) == 0
    possible = lambda column, text: _finding(d, none & (F.size(column) > 0), F.concat(F.lit(text), F.get(column, F.lit(0))), "observation", kind="heuristic")
    return held, [
        _finding(d, F.size(known) > 1, F.concat(F.lit("Conflicting logging libraries in same file: "), F.array_join(known, ", ")), "observation", False),
        _finding(d, F.size(known) > 0, F.when(structured, "Logging style: structured logging").otherwise("Logging style: unstructured logging")),
        possible(packages, "Possible logging library (name heuristic): "),
        possible(modules, "Possible logging library (name heuristic): "),
        possible(F.transform(shaped, lambda i: i["module"]), "Possible structured logging (API shape): "),
    ]


def test_patterns(files: DataFrame) -> DataFrame:
    """D8"""
    return _emit(files, _test_patterns())


def _test_patterns() -> tuple[Held, list[Column]]:
    d, lang, path = "test_patterns", F.col("language"), F.col("path")
    separate, beside = path.rlike(r"(^|/)(tests?|__tests__)/"), path.rlike(r"(\.|_)(test|spec)\.\w+$|(^|/)test_[^/]+\.py$")
    inline = F.exists("rust.mod_declarations", lambda m: m["name"] == "tests")
    is_test = separate | beside | inline
    calls = F.transform("function_calls", lambda c: c["callee"])
    uses = lambda *names: F.arrays_overlap(F.array_union(_packages(), F.transform("imports", lambda i: T.top_level_module(i["module"]))), F.array(*map(F.lit, names)))
    script = lang.isin("typescript", "javascript")
    described = F.arrays_overlap(calls, F.array(F.lit("describe"), F.lit("it")))
    framework = F.when(lang == "rust", "built-in #[test]").when(script & uses("vitest"), "Vitest").when(script & uses("mocha"), "Mocha").when(script & (uses("jest", "@jest") | described), "Jest").when((lang == "python") & uses("unittest"), "unittest").when((lang == "python") & uses("pytest"), "pytest")
    decorators = F.coalesce("python.decorators", F.array().cast("array<string>"))
    marks = F.array_sort(F.array_distinct(F.filter(F.transform(decorators, lambda x: F.regexp_extract(x, r"^pytest\.mark\.(\w+)", 1)), lambda m: ~m.isin("", "parametrize"))))
    display = F.concat(F.lit(" ("), _lang(DISPLAY), F.lit(")"))
    held, names = _testing_names()
    return held, [
        _finding(d, is_test & framework.isNotNull(), F.concat(F.lit("Tests written with "), framework, F.lit(" framework"))),
        _finding(d, is_test & framework.isNull(), "Uses testing (framework unknown)", "observation"),
        _finding(d, path.rlike(r"(^|/)jest\.config\."), "Testing framework (from config file): Jest", "observation"),
        _finding(d, path.rlike(r"(^|/)vitest\.config\."), "Testing framework (from config file): Vitest", "observation"),
        _finding(d, path.rlike(r"(^|/)conftest\.py$"), "Testing framework (from config file): pytest", "observation"),
        _finding(d, separate, "Test file placement: separate tests/ directory"),
        _finding(d, beside & ~separate, "Test file placement: co-located test file"),
        _finding(d, inline, "Test file placement: inline #[cfg(test)] mod tests"),
        _finding(d, is_test & F.exists("functions", lambda f: f["name"].startswith("test_")), F.concat(F.lit("Test naming convention: test_* prefix"), display)),
        _finding(d, is_test & script & described, F.concat(F.lit("Test naming convention: describe/it blocks"), display)),
        _finding(d, is_test & script & F.array_contains(calls, "test"), F.concat(F.lit("Test naming convention: test() function calls"), display)),
        _finding(d, is_test & F.exists("types", lambda t: t["name"].rlike("^Test[A-Z]")), F.concat(F.lit("Test naming convention: TestClass classes"), display)),
        _finding(d, is_test & script & F.arrays_overlap(calls, F.array(F.lit("beforeEach"), F.lit("afterEach"))), "Test setup pattern: beforeEach/afterEach hooks"),
        _finding(d, F.exists(decorators, lambda x: x.startswith("pytest.fixture")), "Test setup pattern: @pytest.fixture decorators"),
        _finding(d, is_test & F.exists("functions", lambda f: f["name"].isin("setUp", "tearDown")), "Test setup pattern: setUp/tearDown methods"),
        _finding(d, F.exists(decorators, lambda x: x.startswith("pytest.mark.parametrize")), "Pytest parametrize pattern"),
        _finding(d, F.size(marks) > 0, F.concat(F.lit("Pytest markers in use: "), F.array_join(marks, ", ")), "observation"),
        names,
    ]


#: Test frameworks that D8 names, which are no guesses.
FRAMEWORKS = ("jest", "@jest", "vitest", "mocha", "pytest", "unittest")


def _testing_names() -> tuple[Held, list[Column]]:
    """Dependencies, and modules of other roots, whose names speak of testing."""
    lang = F.col("language")
    hinted = lambda m: T.keyword_at_boundary(m, list(TESTING_HINTS)) & ~T.top_level_module(m).isin(*FRAMEWORKS) & ~((lang == "python") & is_stdlib(m, lang))
    root = lambda m: F.split(F.split(F.split(m, "/")[0], "::")[0], r"\.")[0]
    packages, modules, roots = map(F.col, ("_testing_packages", "_testing_modules", "_testing_roots"))
    held = [
        {"_testing_packages": F.filter(F.array_distinct(F.transform("dependencies_used", lambda x: x["package"])), hinted)},
        {"_testing_modules": F.filter(F.array_distinct(F.transform("imports", lambda i: i["module"])), lambda m: hinted(m) & ~F.array_contains(packages, root(m)))},
        {"_testing_roots": F.transform(modules, root)},
    ]
    firsts = F.transform(F.array_distinct(roots), lambda r: F.get(modules, (F.array_position(roots, r) - 1).cast("int")))
    rows = lambda names, text: F.transform(names, lambda x: _row("test_patterns", F.concat(F.lit(text), x), "observation", kind="heuristic"))
    return held, [rows(packages, "Testing-related dependency (heuristic): "), rows(firsts, "Testing-related import (heuristic): ")]


def dependency_usage(files: DataFrame) -> DataFrame:
    """The most used known package of each domain in a file (ties: the smallest name); unknown packages with a telling name."""
    used = files.select("path", "language", F.explode("dependencies_used").alias("x")).select("path", "language", F.col("x.package").alias("name"), F.col("x.line").alias("line"))
    each = used.groupBy("path", "language", "name").agg(F.count("*").alias("n"), F.min("line").alias("line")).withColumn("package", F.translate(F.lower("name"), "-", "_"))
    domains = {(lang, package): domain for lang, package, domain in reversed(domain_rows())}  # the first domain counts
    known = files.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{lang}', '{package}', '{domain}')" for (lang, package), domain in domains.items()) + " AS v(language, package, known)")
    judged = each.join(F.broadcast(known), ["language", "package"], "left")
    is_known = F.col("known").isNotNull()
    domain = F.explode(F.array_compact(F.array(F.when(is_known, F.col("known")).otherwise(_telling_domain(F.col("name"), F.col("language")))))).alias("domain")
    named = judged.select("path", is_known.alias("is_known"), F.when(is_known, F.col("package")).otherwise(F.col("name")).alias("package"), "n", "line", domain)
    n = named.groupBy("path", "is_known", "domain", "package").agg(F.sum("n").alias("n"), F.min("line").alias("line"))
    best = n.withColumn("k", F.row_number().over(Window.partitionBy("path", "is_known", "domain").orderBy(F.desc("n"), "package"))).where("k = 1 OR NOT is_known")
    lit = lambda a, b: F.when(F.col("is_known"), a).otherwise(b)
    return best.select("path", F.lit("dependency_usage").alias("detector"), lit("convention", "observation").alias("nature"), lit("pattern", "heuristic").alias("kind"), F.concat(lit("Canonical ", "Likely "), "domain", lit(" library: ", " library (heuristic): "), "package").alias("description"), F.lit(True).alias("follows"), F.col("line").cast("int"), F.lit("import_line").alias("anchor"))


#: The detectors that read a file's row alone; dependency_usage is the one besides.
IN_ROW = (_error_handling, _export_patterns, _file_structure, _import_organization, _logging_observability, _naming, _test_patterns)


def internal_packages(files: DataFrame) -> DataFrame:
    """(package) names that are the project's own: workspace crates, module declarations, Python packages below src or at the top; with underscores."""
    path, lang = F.col("path"), F.col("language")
    parts = F.split(path, "/")
    own = ~F.arrays_overlap(parts, _strings(D.VENDORED_DIRS))
    after = lambda mark: F.get(parts, F.array_position(parts, mark).cast("int"))
    python = own & (lang == "python")
    named = F.array(
        F.when(own & F.array_contains(parts, "crates"), after("crates")),
        F.when(python & F.array_contains(parts, "src") & (F.size(parts) - F.array_position(parts, "src") > 1), after("src")),
        F.when(python & path.rlike("^[^/]+/__init__[.]py$"), parts[0]),
    )
    mods = F.when(own & (lang == "rust"), F.transform("rust.mod_declarations", lambda m: m["name"]))
    every = files.select(F.explode(F.concat(named, F.coalesce(mods, F.array().cast("array<string>")))).alias("package"))
    return every.select(F.translate("package", "-", "_").alias("package")).where("package IS NOT NULL AND package != ''").distinct()


def detect(files: DataFrame, edges: DataFrame | None = None, internal: DataFrame | None = None) -> DataFrame:
    """Findings of all detectors; with the import edges (importer, target) those across files too; guesses about the project's own packages go."""
    parts = [dependency_usage(files), _emit(files, *[f() for f in IN_ROW])] + ([] if edges is None else [wrapper_facades(files, edges)])
    return drop_internal(reduce(DataFrame.unionByName, parts), internal_packages(files) if internal is None else internal)


def wrapper_facades(files: DataFrame, edges: DataFrame) -> DataFrame:
    """D1-X: packages that one file wraps for the others (edges: importer, target).

    Of the files that import an external package, which must be two at least, the wrapper is the one that most other files
    import (ties: the smallest path), if those are more than the package's other importers. It follows; each other importer does not.
    """
    uses = files.select(F.col("path").alias("importer"), F.explode("dependencies_used").alias("x")).select(F.col("x.package").alias("package"), "importer", F.col("x.line").alias("line")).groupBy("package", "importer").agg(F.min("line").alias("line"))
    consumers = edges.select("importer", "target").distinct().groupBy(F.col("target").alias("importer")).agg(F.count("*").alias("consumers"))
    n = uses.groupBy("package").agg(F.count("*").alias("importers")).where("importers >= 2")
    ranked = uses.join(n, "package").join(consumers, "importer").withColumn("k", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("consumers"), "importer")))
    best = ranked.where("k = 1 AND consumers > importers - 1").select("package", F.col("importer").alias("wrapper"))
    rows = uses.join(best, "package")
    return rows.select(F.col("importer").alias("path"), F.lit("dependency_usage").alias("detector"), F.lit("convention").alias("nature"), F.lit("wrapper").alias("kind"), F.concat(F.lit("Use "), "wrapper", F.lit(" for "), "package", F.lit(" operations")).alias("description"), (F.col("importer") == F.col("wrapper")).alias("follows"), F.col("line").cast("int").alias("line"), F.lit("import_line").alias("anchor"))


def heuristic_subject(description: Column) -> Column:
    """The package that a guess is about; null for any other finding."""
    return F.nullif(F.trim(F.regexp_extract(description, r"\((?:name )?heuristic\): (.*)$", 1)), F.lit(""))


def drop_internal(findings: DataFrame, internal: DataFrame) -> DataFrame:
    """guesses about the project's own packages (package) go.

    The packages are made once; where they are too many to be sent to all tasks, findings that are no guesses are dealt by their paths.
    """
    subject = F.nullif(F.translate(T.top_level_module(heuristic_subject(F.col("description"))), "-", "_"), F.lit(""))
    key = F.coalesce(subject, F.concat(F.lit("/"), F.col("path")))  # no package holds a slash
    own = keep(internal.select(F.col("package").alias("_subject")).where("_subject != ''").distinct())
    return findings.withColumn("_subject", key).join(if_few(own), "_subject", "left_anti").select(findings.columns)


def matches_import(callee: Column, imports: Column) -> Column:
    """whether a call is of an imported module or name: the first part before "::", the receiver before ".", or the callee itself."""
    first, receiver = F.substring_index(callee, "::", 1), F.substring_index(callee, ".", 1)
    named = lambda what: F.exists(imports, lambda i: F.array_contains(i["names"], what))
    scoped = callee.contains("::") & (F.exists(imports, lambda i: T.top_level_module(i["module"]) == first) | named(first))
    return scoped | (callee.contains(".") & named(receiver)) | named(callee)


def call_evidence(files: DataFrame, modules: list[str] | None = None, most: int = 5) -> DataFrame:
    """(path, callee, line, end_line, snippet): of each file the first calls that imports (of the modules) account for.

    The first call of a callee counts; of those that start on one line the widest, then that of the longest snippet.
    """
    imports = F.col("imports") if modules is None else F.filter("imports", lambda i: T.top_level_module(i["module"]).isin(*modules) | i["module"].isin(*modules))
    calls = files.select("path", imports.alias("imports"), F.posexplode("function_calls").alias("pos", "c")).where(matches_import(F.col("c.callee"), F.col("imports")))
    first = calls.select("path", "pos", "c.*").withColumn("k", F.row_number().over(Window.partitionBy("path", "callee").orderBy("line", "pos"))).where("k = 1")
    wide = Window.partitionBy("path", "line").orderBy((F.col("end_line") - F.col("line")).desc(), F.length("snippet").desc(), "pos")
    one = first.withColumn("k", F.row_number().over(wide)).where("k = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("line", "pos"))).where(F.col("k") <= most).select("path", "callee", "line", "end_line", "snippet")
