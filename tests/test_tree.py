"""Ignore rules against git, module names against a dictionary, histories against a walk."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from conspectus.sources import tree


@pytest.mark.skipif(not shutil.which("git"), reason="git is not installed")
@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_ignore_rules_equal_git(spark, tmp_path, seed):
    r = random.Random(seed)
    names = ["a", "b", "ab", "x.js", "y.js", "t e", "lib", "[z]", "a.b.c"]
    paths = sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 4))) + f"/{r.choice(names)}{k % 7}" for k in range(60)})
    parts = ["*", "a", "*.js", "b*", "?b", "[ab]", "[!a]", "lib", "**", "a*", "x.js3", "\\[z\\]*", "*.c?", "t e"]
    rule = lambda: r.choice(["", "", "!"]) + r.choice(["", "", "/"]) + "/".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 3]))) + r.choice(["", "", "/", "  "])
    folders = [""] + sorted({p.rpartition("/")[0] for p in r.sample(paths, 8)})
    ignores = {f"{f}/.gitignore".removeprefix("/"): "\n".join(["# note", "", *(rule() for _ in range(r.randint(1, 4)))]) for f in folders}
    root = tmp_path / "tree"
    for path, text in [*((p, "") for p in paths), *ignores.items()]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git = lambda *a, **k: subprocess.run(["git", "-c", "core.excludesFile=/dev/null", *a], cwd=root, capture_output=True, text=True, timeout=60, **k)
    git("init", "-q")
    ignored = set(git("check-ignore", "--no-index", "-z", "--stdin", input="\0".join(paths)).stdout.split("\0"))
    left = tree.walked(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(sorted(ignores.items()), "path string, content string"))
    assert {x.path for x in left.collect()} == set(paths) - ignored and ignored & set(paths)


def test_hidden_files_and_submodules(spark):
    paths = ["a.py", ".env", "src/.cache/x.py", "src/.keep/y.py", "sub/z.py", "subs/z.py", "d/.git/config", "d/e.log"]
    ignores = [(".gitignore", "!.keep\n"), ("/global", "*.log\n!.env\n"), ("d/.gitignore", "!e.log\n")]
    left = tree.walked(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(ignores, "path string, content string"), spark.createDataFrame([("sub",)], "path string"))
    assert sorted(x.path for x in left.collect()) == [".env", "a.py", "d/e.log", "src/.keep/y.py", "subs/z.py"]
    assert tree.walked(spark.createDataFrame([], "path string"), spark.createDataFrame([], "path string, content string")).count() == 0


def test_module_names(spark):
    from conspectus.sources.code import parse_files

    files = {
        "app/api.py": "from app.models import X\nimport lib\nfrom .models import Y\nfrom core.deep.thing import z\n", "app/models.py": "", "lib/__init__.py": "", "core/deep.py": "", "src/net/mod.rs": "use crate::util::x;\nuse super::util::y;\nuse self::inner::z;\n", "src/util/x.rs": "", "src/net/inner/z.rs": "",
        "web/a/one.ts": "import { q } from '../b/two';\nimport { r } from './three';\nimport { s } from '../c';\nimport { t } from 'shared';\n", "web/b/two.ts": "", "web/a/three.ts": "", "web/c/index.ts": "", "x/shared/u.ts": "", "main.ts": "import { v } from './web/b/two';\n",
    }
    rows = parse_files(spark.createDataFrame(sorted(files.items()), "path string, content string"))
    found = sorted(tuple(x) for x in tree.module_dependencies(rows).collect())
    assert found == [("", "web/b"), ("app", "core"), ("app", "lib"), ("src/net", "src/net/inner"), ("src/net", "src/util"), ("web/a", "web/b"), ("web/a", "web/c"), ("web/a", "x/shared")]
    keys = {x.key: x.module for x in tree.import_targets(rows).collect()}
    assert keys["app.api"] == keys["app"] == "app" and keys["src::util::x"] == "src/util" and keys["inner"] == "src/net/inner" and keys["main"] == ""


def test_histories(spark):
    r = random.Random(9)
    commits = [(0, None, 100)] + [(k, r.randint(max(0, k - 3), k - 1), 100 + k) for k in range(1, 70)]
    trees = [(k, f"p{j}", str(r.randint(0, 3))) for k, _, _ in commits for j in range(6) if r.random() < 0.8]
    c = spark.createDataFrame(commits, "id int, parent int, ts bigint")
    parent, ts, held = {k: p for k, p, _ in commits}, {k: t for k, _, t in commits}, {}
    for k, p, o in trees:
        held.setdefault(k, {})[p] = o
    walk, at, want = [], 69, {}
    while at is not None:
        walk.append(at)
        own, before = held.get(at, {}), held.get(parent[at], {}) if parent[at] is not None else {}
        for p in own.keys() | before.keys():
            if own.get(p) != before.get(p):
                want.setdefault(p, ts[at])
        at = parent[at]
    head = spark.createDataFrame([(69,)], "id int")
    assert [x.id for x in tree.first_parents(c, head).orderBy("pos").collect()] == walk
    assert {x.path: x.last_commit_date for x in tree.last_changes(c, spark.createDataFrame(trees, "commit int, path string, oid string"), head).collect()} == want
    assert tree.first_parents(c.where("id = 0"), c.where("id = 0").select("id")).collect() == [(0, 0)] and tree.first_parents(c, c.where("false").select("id")).count() == 0


def test_workspace_names(spark):
    from conspectus.sources import project

    files = {
        "Cargo.toml": '[package]\nname = "top-crate"\n[workspace]\nmembers = ["crates/*", "tools/cli", "crates/deep/?n", "/abs", "../up"]\n', "crates/a/Cargo.toml": '[package]\nname = "crate-a"\n', "crates/deep/in/Cargo.toml": '[package]\nname = "inner"\n',
        "tools/cli/Cargo.toml": '[package]\nname = "cli"\n', "tools/other/Cargo.toml": '[package]\nname = "other"\n', "crates/broken/Cargo.toml": "not = [toml", "crates/js/package.json": '{"name": "js"}',
        "web/package.json": '﻿{"name": "web", "workspaces": ["packages/*", ".", "!packages/x", ""]}', "web/packages/x/package.json": '{"name": "@w/x"}', "web/packages/y/package.json": '{"name": ""}', "web/packages/z/q/package.json": '{"name": "q"}',
        "p/pnpm-workspace.yaml": "packages:\n  - 'libs/**'\n  - apps/one\n", "p/libs/m/n/package.json": '{"name": "n"}', "p/apps/one/package.json": '{"name": "one"}', "py/pyproject.toml": '[project]\nname = "my-py"\n', "l/package.json": "[1]",
    }
    found = {tuple(x) for x in project.workspace_names(spark.createDataFrame(sorted(files.items()), "path string, content string")).collect()}
    own = {("", "top_crate"), ("crates/a", "crate_a"), ("crates/deep/in", "inner"), ("tools/cli", "cli"), ("tools/other", "other"), ("crates/js", "js"), ("web", "web"), ("web/packages/x", "@w/x"), ("web/packages/z/q", "q"), ("p/libs/m/n", "n"), ("p/apps/one", "one"), ("py", "my_py")}
    assert found == own | {("", "crate_a"), ("", "cli"), ("", "inner"), ("web", "@w/x"), ("web", "web"), ("p", "n"), ("p", "one")}
