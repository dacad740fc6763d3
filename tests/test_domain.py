"""Stores, reviews, changes, streams and plug-ins of the domain layer, with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conspectus.operators import detectors
from conspectus.operators import relational as R
from conspectus.plans import conventions as C
from conspectus.plans import plugins
from conspectus.sources import changes, project
from conspectus.sources.code import parse_files
from conspectus.sources.store import Decisions, TableStore
from conspectus.streaming import watch

CODE = {
    "crates/acme/src/lib.rs": "mod store;\nuse acme_http_kit::get;\nuse log_things::warn;\n",
    "app/__init__.py": '"""The application.\n\n# Orders and more"""\n',
    "app/api.py": "import os\nfrom app_mock_lib import thing\nfrom mylevels import info, warn\n\n\nclass ValueError(Exception):\n    pass\n\n\ndef go():\n    return thing(1)\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return parse_files(spark.createDataFrame(sorted(CODE.items()), "path string, content string")).cache()


def test_guesses_and_own_packages(files):
    found = {(r.path, r.description) for r in detectors.detect(files).collect()}
    assert ("crates/acme/src/lib.rs", "Likely HTTP library (heuristic): acme_http_kit") in found
    assert ("app/api.py", "Testing-related dependency (heuristic): app_mock_lib") in found
    assert ("app/api.py", "Possible structured logging (API shape): mylevels") in found
    assert ("app/api.py", "Uses built-in exception types only") in found
    assert {r.package for r in detectors.internal_packages(files).collect()} == {"acme", "store", "app"}
    own = detectors.internal_packages(files).unionAll(files.sparkSession.createDataFrame([("acme_http_kit",)], "package string"))
    assert not any("acme_http_kit" in r.description for r in detectors.detect(files, internal=own).where("kind = 'heuristic'").collect())


def test_call_evidence(files):
    assert [(r.path, r.callee) for r in detectors.call_evidence(files).collect()] == [("app/api.py", "thing")]
    assert detectors.call_evidence(files, ["os"]).count() == 0


def test_module_purposes(files):
    found = {r.module: r.purpose for r in C.module_purposes(files).collect()}
    assert found == {"crates/acme/src": None, "app": "The application.\nOrders and more"}


def test_joint_commits(spark, files, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.upsert_files(files)
    assert store.read("symbol_definitions").where("path = 'app/api.py'").count() == 4
    changed = parse_files(spark.createDataFrame([("app/api.py", "def other():\n    pass\n")], "path string, content string"))
    store.upsert_files(changed)
    assert {r.symbol_name for r in store.read("symbol_definitions").where("path = 'app/api.py'").collect()} == {"other"} and store.read("files_ir").count() == 3
    gone = spark.createDataFrame([("main", "app/api.py"), ("main", "none.py")], "branch_id string, path string")
    assert store.delete_files(gone) == ["none.py"] and store.read("symbol_definitions").where("path = 'app/api.py'").count() == 0
    store.upsert_files(changed)
    assert not store.backfill_symbols()
    store.write("symbol_definitions", store.read("symbol_definitions").where("1 = 0"))
    assert store.backfill_symbols() and store.read("symbol_definitions").count() == 2
    before = store.read("files_ir")
    with pytest.raises(Exception):
        store.write_all({"files_ir": changed, "symbol_imports": spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))})
    assert store.read("files_ir").count() == before.count() == 3 and store.read("symbol_imports").columns == ["branch_id", "imported_name", "path"]


def test_branches_values_edges(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.current_branch() == "main" and store.list_branches() == ["main"] and store.value("dev", "last_scanned") is None
    store.switch_branch("dev")
    store.set_value("dev", "last_scanned", "a1")
    store.set_value("dev", "last_scanned", "b2")
    assert store.current_branch() == "dev" and store.value("dev", "last_scanned") == "b2"
    edges = spark.createDataFrame([("main", 1, 2, "contradicts"), ("main", 1, 2, "contradicts"), ("main", 1, 3, "reinforces"), ("dev", 1, 2, "contradicts")], "branch_id string, source int, target int, edge_type string")
    store.insert_edges(edges)
    assert store.edges("main").count() == 2 and store.edges("main", target=3).first().edge_type == "reinforces"
    store.write("cache", spark.createDataFrame([("a", 1), ("b", 9)], "name string, fetched_at int"))
    assert store.delete_stale("cache", "fetched_at", 5) == 1 and store.read("cache").first().name == "b"
    assert changes.freshness("a", "a") == {"state": "up_to_date"} and changes.freshness("a", "b")["state"] == "stale" and changes.freshness("a", None)["state"] == "git_unavailable"


def test_conventions_are_replaced_but_for_decided_ones(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    nodes = spark.createDataFrame([("h1", "One"), ("h2", "Two")], "description_hash string, description string")
    store.replace_conventions("main", nodes, nodes.where("1 = 0"))
    store.replace_conventions("dev", nodes, nodes.where("1 = 0"))
    store.replace_conventions("main", nodes, nodes.where("description_hash = 'h1'"))
    assert sorted((r.branch_id, r.description_hash) for r in store.read("nodes").collect()) == [("dev", "h1"), ("dev", "h2"), ("main", "h2")]


def test_review_actions(spark, tmp_path):
    d = Decisions(TableStore(spark, str(tmp_path)), now=5)
    conv = spark.createDataFrame([(f"h{k}", f"Rule {k}", "convention", "strong", 0.5, f"{{{k}}}") for k in range(4)], "description_hash string, description string, nature string, weight string, confidence double, ext_data string")
    pending = d.review(conv)
    seen = {r.description_hash: r.seen for r in pending.collect()}
    actions = spark.createDataFrame([("h0", "confirm", seen["h0"]), ("h1", "reject", seen["h1"]), ("h2", "partial", seen["h2"]), ("h3", "confirm", 1), ("zz", "confirm", 1)], "description_hash string, action string, seen bigint")
    assert d.apply_review(actions, conv) == {"confirm": 1, "reject": 1, "partial": 1, "changed": 1, "missing": 1}
    assert {(r.description_hash, r.state, r.nature) for r in d.all().collect()} == {("h0", "approved", "convention"), ("h1", "rejected", "convention"), ("h2", "partial", "preference")}
    assert [r.description_hash for r in d.review(conv).collect()] == ["h3"]


def test_contradictions_are_those_of_the_topic(spark, files):
    conv = spark.createDataFrame([("a", "Use tabs for layout", "convention", "strong", 0.9, "x"), ("b", "Use spaces for layout", "convention", "strong", 0.9, "x"), ("c", "Other", "convention", "strong", 0.9, "x")], "description_hash string, description string, nature string, weight string, confidence double, detector string")
    from conspectus import schemas

    edges = spark.createDataFrame([("a", "b", "contradicts"), ("b", "a", "contradicts"), ("a", "c", "contradicts")], "source string, target string, edge_type string")
    row = C.validate_approach(conv, spark.createDataFrame([], schemas.DECISION), files, "layout", edges).first()
    assert row.contradictions == 1 and row.verdict == "conflict"


def test_blob_pairs(spark):
    pairs = changes.blob_pairs(
        spark.createDataFrame([("a", "modified", "1", "2"), ("b", "added", None, "3")], "path string, status string, old_oid string, new_oid string"),
        spark.createDataFrame([("1", bytearray(b"old")), ("2", bytearray(b"n\0w")), ("3", bytearray(b"new"))], "oid string, content binary"),
    )
    assert sorted(map(tuple, pairs.collect())) == [("a", "modified", "old", None), ("b", "added", None, "new")]
    text = spark.createDataFrame([("x", "a\n<<<<<<< HEAD\n"), ("y", "a <<<<<<< b")], "path string, content string")
    assert [r.path for r in changes.conflicted_paths(text).collect()] == ["x"]


def test_sync_of_a_moved_head(spark, files, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.upsert_files(files)
    old = files.select("path", F.col("content_hash").alias("oid"))
    new = old.where("path != 'app/api.py'").unionAll(spark.createDataFrame([("app/new.py", "1")], "path string, oid string"))
    runs = []
    parse = lambda paths: parse_files(paths.select("path", F.lit("x = 1\n").alias("content")))
    assert watch.sync_trees(store, "main", old, new, parse, lambda: runs.append(1)) == {"added": 1, "deleted": 1}
    assert sorted(r.path for r in store.read("files_ir").collect()) == ["app/__init__.py", "app/new.py", "crates/acme/src/lib.rs"] and runs == [1]
    assert watch.sync_trees(store, "main", new, new, parse, lambda: runs.append(1)) == {} and runs == [1]
    assert watch.sync_metadata(True, "main") == {"syncing": True, "snapshot_based": "main", "detached_head": True}


def test_warm_tier(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "path string, seq int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream, runs = spark.readStream.schema("path string, seq int").parquet(f"{tmp_path}/in"), []
    for _ in range(2):
        watch.warm_tier(stream, lambda: runs.append(1), f"{tmp_path}/c", once=True).awaitTermination()
    assert runs == [1]


def test_manifest_names_and_openapi(spark):
    names = project.internal_names
    assert names("Cargo.toml", '[package]\nname = "a-b"\n[workspace]\nmembers = ["crates/x-y", "crates/*"]\n') == ["a_b", "x_y"]
    assert names("package.json", '{"name": "root", "workspaces": {"packages": ["packages/ui", "!packages/no"]}}') == ["root", "ui"]
    assert names("pnpm-workspace.yaml", "packages:\n  - 'apps/web'\n  - libs/*\n") == ["web"]
    assert names("pyproject.toml", '[project]\nname = "my-lib"\n') == ["my_lib"] and names("Cargo.toml", "no [") == []
    api = {"openapi": "3.0.0", "info": {"title": "Shop", "version": "1"}, "paths": {"/o": {"get": {"summary": "List"}, "x-own": {}}}, "components": {"schemas": {"Order": {"description": "An order"}}}}
    rows = [(1, json.dumps(api)), (2, "{}"), (3, None), (4, "not: [")]
    found = project.openapi_facts(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    assert [tuple(r) for r in found.collect()] == [(1, "api", "Shop", "1"), (1, "endpoint", "GET /o", "List"), (1, "schema", "Order", "An order")]


def test_plugins(spark, files):
    class Own:
        name, languages = "own", ("python",)

        def per_file(self, files):
            return files.select("path", F.lit("own").alias("detector"), F.lit("convention").alias("nature"), F.lit("pattern").alias("kind"), F.lit("Has a file").alias("description"), F.lit(True).alias("follows"), F.lit(0).alias("line"), F.lit("file_level").alias("anchor"))

        def across_files(self, files, edges):
            return None

    edges = C.resolve_imports(files)
    assert plugins.detect_with([Own()], files, edges).where("detector = 'own'").count() == 2
    vectors = plugins.embed(spark.createDataFrame([("a b",), ("b a",), (None,)], "t string"), "t").collect()
    assert np.allclose(vectors[0].embedding, vectors[1].embedding) and len(vectors[2].embedding) == 384 and not any(vectors[2].embedding)

    def fails():
        raise RuntimeError("no model")

    assert plugins.search_with_fallback(lambda: files, fails, lambda a, b: a)[1] == "keyword" and plugins.search_with_fallback(lambda: files, lambda: files, lambda a, b: a)[1] == "hybrid"
    row = spark.createDataFrame([("web-programming::x", "ORM")], "c string, k string").select(plugins.category_domain(F.col("c")), plugins.keyword_domain(F.col("k"))).first()
    assert tuple(row) == ("web framework", "database")
    assert plugins.parse_metadata("pypi", '{"info": {"name": "x", "keywords": "a, b"}}')["keywords"] == ["a", "b"] and plugins.parse_metadata("npm", "no") == {}
    def parse_lines(row, content):
        row["functions"] = [{"name": x, "is_public": True, "is_async": False, "line": k + 1, "end_line": k + 1, "parameters": [], "doc_comment": None} for k, x in enumerate(content.split())]

    from conspectus.sources import code

    plugins.register_parser("lst", "list", parse_lines)
    try:
        row = parse_files(spark.createDataFrame([("a.lst", "x\ny")], "path string, content string")).first()
        assert row.language == "list" and [f.name for f in row.functions] == ["x", "y"]
    finally:
        del code.LANGUAGES["lst"], code.PARSERS["list"]
    said = []
    plugins.Progress([lambda step, facts: said.append((step, facts))]).tell("parsed", files=3)
    assert said == [("parsed", {"files": 3})]


def test_composite_text(spark):
    rows = [("a", "x/p/one.py", True), ("a", "x/q/two.py", False), ("a", "x/q/__init__.py", True), ("b", "y/__init__.py", True), ("b", "z/__init__.py", True), ("c", "m.py", False)]
    found = {r.g: r.text for r in R.composite(spark.createDataFrame(rows, "g string, path string, ok boolean"), "path", "ok", ["g"]).collect()}
    assert found["a"] == "// 3 files reference this convention (2 follow / 1 violate) (showing 2 informative; 1 __init__.py markers omitted):\n//   x/p/one.py\n//   x/q/two.py   [non-conforming]"
    assert found["b"].startswith("// 2 files match this convention (all are __init__.py markers):") and found["c"] == "// 1 file violates this convention:\n//   m.py   [non-conforming]"


def test_input_checks():
    from conspectus.plans.envelope import check_inputs

    check_inputs("x", 3, "a/b.py")
    for bad in ({"query": " "}, {"depth": 0}, {"depth": 11}, {"path": "/a"}, {"path": "a/../b"}, {"path": "C:/a"}, {"path": ""}):
        with pytest.raises(ValueError):
            check_inputs(**bad)
