"""The convention pipeline on a small project with known answers; the store; decisions; streams."""

import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conspectus.operators import detectors
from conspectus.operators import relational as R
from conspectus.plans import catalog
from conspectus.plans import conventions as C
from tests.sample import FILES
from conspectus.sources import code, project
from conspectus.sources.store import Decisions, TableStore, scan_changes
from conspectus.streaming import watch


@pytest.fixture(scope="module")
def files(spark):
    return code.parse_files(spark.createDataFrame(sorted(FILES.items()), "path string, content string")).cache()


@pytest.fixture(scope="module")
def findings(files):
    return detectors.detect(files).cache()


def test_parsers(files):
    rows = {r.path: r for r in files.collect()}
    assert len(rows) == len(FILES) and rows["py/broken.py"].functions == []
    rust = rows["src/services/orders.rs"]
    assert [f.name for f in rust.functions] == ["find_order", "load"] and rust.functions[0].is_async and rust.functions[0].parameters == ["id"] and rust.functions[0].doc_comment == "Finds an order."
    assert {d.package for d in rust.dependencies_used} == {"serde", "tracing"}
    assert rows["tools/report.cjs"].javascript.module_system == "commonjs"
    assert [i.module for i in rows["py/app/service.py"].imports] == ["logging", "requests", ".models"]
    assert rows["web/src/index.ts"].typescript.has_barrel_exports


def test_findings(findings):
    found = {(r.path, r.description): r.follows for r in findings.collect()}
    for path, text in [
        ("src/errors.rs", "Rust error handling: thiserror"), ("src/lib.rs", "Module declarations (module root file) (Rust)"), ("src/services/orders.rs", "Function naming: snake_case convention (Rust)"),
        ("src/services/orders.rs", "Imports grouped in canonical order with blank-line separators"), ("src/services/orders.rs", "Canonical serialization library: serde"), ("src/services/orders.rs", "Logging style: structured logging"),
        ("src/services/orders.rs", "By-type directory organization (models/, controllers/, services/)"), ("web/src/api-client.ts", "File naming: kebab-case convention (TypeScript)"), ("web/src/api-client.ts", "Custom error classes (TypeScript)"),
        ("web/src/index.ts", "Uses barrel export pattern (re-exports from index file)"), ("web/src/api-client.test.ts", "Tests written with Vitest framework"), ("web/src/api-client.test.ts", "Test file placement: co-located test file"),
        ("tools/report.cjs", "Uses CommonJS module system"), ("py/app/models.py", "Uses __all__ to define explicit public API"), ("py/app/models.py", "Custom exception hierarchy (Python)"), ("py/tests/test_service.py", "Tests written with pytest framework"),
        ("py/tests/test_service.py", "Test setup pattern: @pytest.fixture decorators"), ("py/app/service.py", "Logging style: unstructured logging"),
    ]:
        assert found.get((path, text)) is True, (path, text)
    assert found["py/app/service.py", "Exports without __all__ definition (Python)"] is False


def test_aggregate_and_queries(spark, files, findings, tmp_path):
    dates = files.select("path", F.lit(1_000_000).cast("bigint").alias("last_commit_date"))
    conv = C.aggregate(findings, dates, now=1_000_000 + 100 * 86400).cache()
    rows = {r.description: r for r in conv.collect()}
    exports = rows["Exports without __all__ definition (Python)"]
    assert exports.adoption_count == 0 and exports.weight == "info" and exports.trend == "stable"
    store = TableStore(spark, str(tmp_path))
    decisions = Decisions(store, now=5)
    key = decisions.record("Use pytest framework for all tests", category="testing")
    assert decisions.review(conv).count() == conv.count()
    found = C.query_convention(conv, decisions.all(), "pytest framework").collect()
    assert found[0].description_hash == key and "Tests written with pytest framework" in {r.description for r in found}
    pattern = C.query_code_pattern(files, "load_item").collect()
    assert pattern[0].symbol_name == "load_item" and pattern[0].score == 1.0 and pattern[0].dependent_files == ["py/tests/test_service.py"] and pattern[0].call_sites == 1
    deps = C.query_dependencies(files, "py/app/models.py")
    assert [(r.path, r.names) for r in deps["dependents"].collect()] == [("py/app/service.py", ["Item"])]
    assert [(r.node, r.depth, r.via) for r in deps["transitive"].orderBy("depth").collect()] == [("py/app/service.py", 1, ""), ("py/tests/test_service.py", 2, "py/app/service.py")]
    assert {r.target for r in C.resolve_imports(files).where("importer = 'web/src/api-client.test.ts'").collect()} == {"web/src/api-client.ts"}
    context = C.project_context(files, findings, conv, decisions.all())
    assert context["languages"].first().files == 4 and context["decisions"].first().recorded == 1
    assert C.validate_approach(conv, decisions.all(), files, "pytest").first().verdict == "aligned"
    hunks = spark.createDataFrame([("py/app/models.py", 13, 15)], "path string, new_start int, new_end int")
    hit = C.diff_impact(files, hunks).collect()
    assert [(r.symbol_name, r.direct, r.transitive, r.blast_radius) for r in hit] == [("Item", 1, 2, "low")]


def test_decisions(spark, tmp_path):
    d = Decisions(TableStore(spark, f"{tmp_path}/a"), now=10)
    key = d.record("One", category="x")
    moved = d.update(key, description="Two", category="")
    row = d.all().first()
    assert moved != key and row.description == "Two" and row.category is None
    approved = d.record("Three", state="approved")
    with pytest.raises(ValueError):
        d.remove(approved)
    d.export(f"{tmp_path}/out")
    other = Decisions(TableStore(spark, f"{tmp_path}/b"), now=3)
    other.record("Two", reason="older")
    assert other.import_from(f"{tmp_path}/out") == {"updated": 1, "inserted": 1}
    with pytest.raises(ValueError):
        other.import_from(f"{tmp_path}/out", strict=True)
    d.remove(moved)
    assert d.all().count() == 1


def test_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "branch_id string, path string, content_hash string")
    s.upsert("files", rows(("main", "a", "1"), ("main", "b", "1")), ["branch_id", "path"])
    s.upsert("files", rows(("main", "a", "2"), ("main", "c", "1")), ["branch_id", "path"])
    s.create_snapshot(["files"], "main", "dev")
    s.delete("files", rows(("dev", "b", "")), ["branch_id", "path"])
    assert sorted(tuple(r) for r in s.read("files").collect()) == [("dev", "a", "2"), ("dev", "c", "1"), ("main", "a", "2"), ("main", "b", "1"), ("main", "c", "1")]
    assert s.orphan_branches("files", []) == ["dev"]
    s.delete_branch(["files"], "dev")
    found = {r.path: r.status for r in scan_changes(rows(("main", "a", "3"), ("main", "b", "1"), ("main", "d", "1")), s.read("files")).collect()}
    assert found == {"a": "modified", "b": "unchanged", "c": "deleted", "d": "added"}


def test_project_sources(spark):
    declared = project.declared_dependencies(spark, {"package.json": '{"dependencies": {"lodash": "^4"}, "devDependencies": {"jest": "1"}}', "pyproject.toml": '[project]\ndependencies = ["requests[x]>=2; python_version>\'3\'"]\n', "Cargo.toml": "not toml ["})
    assert sorted((r.name, r.version, r.is_dev) for r in declared.collect()) == [("jest", "1", True), ("lodash", "^4", False), ("requests", ">=2", False)]
    text = "lead\n# One\na\n### deep\n```\n# no\n```\n## Two\nb"
    found = project.markdown_sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("section").collect()
    assert [(r.level, r.title, r.content) for r in found] == [(1, "One", "a\n### deep\n```\n# no\n```"), (2, "Two", "b")]


def test_streams(spark, tmp_path):
    base = pd.Timestamp("2024-01-01", tz="UTC")
    rows = [("r", (base + pd.Timedelta(milliseconds=90 * k)).to_pydatetime(), f"p{k % 5}", "modify" if k < 20 else "remove", k) for k in range(24)]
    spark.createDataFrame(rows, "root string, ts timestamp, path string, kind string, seq int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("root string, ts timestamp, path string, kind string, seq int").parquet(f"{tmp_path}/in")
    seen = {}
    watch.hot_tier(stream, lambda up, down: seen.update(up=sorted(r.path for r in up.collect()), down=sorted(r.path for r in down.collect())), f"{tmp_path}/c1", once=True).awaitTermination()
    assert seen == {"up": ["p4"], "down": ["p0", "p1", "p2", "p3"]}
    q = watch.bulk_triggers(stream).writeStream.format("memory").queryName("bulk").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("select * from bulk").collect()] == [21]


def test_wrappers(spark):
    files = spark.createDataFrame([("w.ts", [("axios", "axios", 1)]), ("a.ts", [("axios", "axios", 2)]), ("b.ts", []), ("c.ts", [])], "path string, dependencies_used array<struct<package:string,import_path:string,line:int>>")
    edges = spark.createDataFrame([("b.ts", "w.ts"), ("c.ts", "w.ts"), ("b.ts", "a.ts")], "importer string, target string")
    assert {(r.path, r.description, r.follows) for r in detectors.wrapper_facades(files, edges).collect()} == {("w.ts", "Use w.ts for axios operations", True), ("a.ts", "Use w.ts for axios operations", False)}


def test_scope_and_envelope():
    from conspectus.plans.envelope import Envelope, resolve_scope

    mounts = ["libs/a", "libs/a/b", "x/a"]
    assert resolve_scope(mounts, file_path="libs/a/b/f.py") == "libs/a/b" and resolve_scope(mounts, scope="b") == "libs/a/b" and resolve_scope(mounts) == ""
    for bad in ({"scope": "a"}, {"scope": "z"}, {"file_path": "../x"}):
        with pytest.raises(ValueError):
            resolve_scope(mounts, **bad)
    assert '"status": "error"' in Envelope.failure("t", "r", "NOT_FOUND", "no").to_json()


def test_digests_of_lists_without_the_asker(spark):
    """Against lists written out: places at the ends and on both sides of a chunk's, askers that are in no list, lists of one and of none, nulls, commas."""
    names = [f"d{k % 7}/ü_{k},x" for k in range(60)]
    lists = {"a": names[::2], "b": [names[3]], "d": ["", "a"], "e": names}
    askers = [(key, own) for key in ("a", "b", "c") for own in [*names, None]] + [(None, "x"), ("d", ""), ("d", "a"), ("d", "z")]
    rows = spark.createDataFrame([(k, m) for k, ms in lists.items() for m in ms], "key string, member string")
    for size in (1, 40, R.CHUNK_BYTES):
        found = [tuple(r) for r in R.list_digests(spark.createDataFrame(askers, "key string, own string"), rows, size).select("key", "own", "n", "digest").collect()]
        assert len(found) == len(askers)
        for key, own, n, digest in found:
            rest = [m for m in sorted(lists.get(key, []), key=str.encode) if own is not None and m != own]
            assert (n, digest) == (len(rest), hashlib.md5(",".join(rest).encode()).hexdigest()), (size, key, own)


def test_dependents_of_symbols_are_not_written_out_for_each(spark, capsys):
    """Q_PAT_dependents_of_symbols: no row of the plan holds the list of all importers."""
    catalog.queries()["Q_PAT_dependents_of_symbols"](spark, "/root/testdata/sf0.001").explain("simple")
    assert not re.search("importers|dependent_files", capsys.readouterr().out)


def test_findings_are_read_in_one_pass(spark, files, capsys):
    """D0_F17_findings_of_all: the detectors of a row share one scan of the files, and packages have another one."""
    detectors.detect(files).explain("simple")
    assert capsys.readouterr().out.count("InMemoryTableScan") <= 2


def test_many_imports_of_a_file_are_looked_at_once(spark):
    """D0_F17_findings_of_all: what an import's finding compares with is not made anew for each import."""
    imports = [(f"test_{k % 1500}.m{k}", ["a"], False, 2 * k) for k in range(3000)]
    one = spark.createDataFrame([("a.py", "python", imports)], "path string, language string, imports array<struct<module:string,names:array<string>,is_type_only:boolean,line:int>>")
    rest = [(F.array() if kind.startswith("array") else F.lit(None)).cast(kind).alias(name) for name, kind in spark.createDataFrame([], code.schemas.FILE).dtypes if name not in one.columns]
    found = detectors.detect(one.select("*", *rest)).collect()
    assert sorted(r.description for r in found if r.detector == "test_patterns") == sorted(f"Testing-related import (heuristic): test_{k}.m{k}" for k in range(1500))
    assert {r.description for r in found if r.detector == "import_organization"} == {"Python import style: exclusively from-import"}


def test_evidence_is_limited_before_it_is_dealt(findings, capsys):
    """D0_A1_conventions_of_all: no shuffle of all findings by their places."""
    C.aggregate(findings).explain("simple")
    assert not re.search(r"hashpartitioning\(detector#\d+, description#\d+, path", capsys.readouterr().out)
