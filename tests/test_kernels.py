"""Every kernel query against its SQL on the smallest tables, and edge cases of the kernels."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from conspectus.functions import text as T
from conspectus.operators import graph as G
from conspectus.operators import relational as R
from conspectus.operators import search as S
from conspectus.plans import catalog, codebase, kernels
from conspectus.plans import conventions as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v

    return sorted(map(repr, (tuple(map(value, r)) for r in rows)))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in kernels.ORACLE])
def test_equals_sql(spark, db, name):
    found = kernels.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.execute(kernels.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(found.select(*columns).collect()) == plain([tuple(r[k] for k in order) for r in want.fetchall()])


def test_dependents_of_a_cycle_and_a_diamond(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("e", "d"), ("x", "x")], "importer string, target string")
    found = {(r.node, r.depth, r.via) for r in G.dependents(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert found == {("b", 1, ""), ("c", 1, ""), ("d", 2, "b"), ("e", 3, "b > d")}
    with pytest.raises(ValueError):
        G.dependents(edges, edges.select(F.col("target").alias("node")), 11)


def test_far_dependents_are_counted_without_chains(spark, monkeypatch):
    """Q_DIFF_impact: numbers of dependents beyond the first step equal the rows with their chains, which are not made."""
    rng = random.Random(4)
    edges = spark.createDataFrame(sorted({(f"n{rng.randrange(60)}", f"n{min(rng.randrange(60), rng.randrange(60))}") for _ in range(150)}), "importer string, target string")
    sources = spark.createDataFrame([(f"n{k}",) for k in range(0, 60, 2)] + [("none",)], "node string")
    expected = {depth: {r[0]: r[1] for r in G.dependents(edges, sources, depth).where("depth > 1").groupBy("source").count().collect()} for depth in (1, 3)}
    monkeypatch.setattr(G, "dependents", None)
    for most in (2, 1 << 14):
        monkeypatch.setattr(G, "NODES", most)
        assert {r.source: r.far for r in G.count_far_dependents(edges, sources, 3).collect()} == expected[3]
    assert G.count_far_dependents(edges, sources, 1).collect() == [] and not expected[1] and max(expected[3].values()) > 5


def test_weights_belong_to_the_lower_tier(spark):
    rows = spark.createDataFrame([(0.86,), (0.85,), (0.5,), (0.2,)], "c double").select(T.weight("c").alias("w")).collect()
    assert [r.w for r in rows] == ["strong", "moderate", "weak", "info"]


def test_latest_wins_is_strict(spark):
    now = spark.createDataFrame([("h1", 5, "a"), ("h2", 5, "b")], "k string, at int, v string")
    new = spark.createDataFrame([("h1", 5, "x"), ("h2", 6, "y"), ("h3", 1, "z")], "k string, at int, v string")
    found = {r.k: (r.v, r.action) for r in R.latest_wins(now, new, "k", "at").collect()}
    assert found == {"h1": ("a", "skipped"), "h2": ("y", "updated"), "h3": ("z", "inserted")}


def test_paths(spark):
    row = spark.createDataFrame([("a/./b/../c\\d",)], "p string").select(T.resolve_path("p").alias("p"), T.suffix_matches(F.lit("x/ab/c"), F.lit("b/c")).alias("no"), T.suffix_matches(F.lit("x/b/c"), F.lit("b/c")).alias("yes")).first()
    assert tuple(row) == ("a/c/d", False, True)


def test_jaccard_by_either_way(spark):
    import random

    r = random.Random(2)
    rows = lambda n, words: [(k, r.sample(range(words), r.randint(0, 12)) or None if k % 9 else []) for k in range(n)]
    a, b = (spark.createDataFrame([(k, None if w is None else [f"w{x}" for x in w]) for k, w in rows(n, 40)], f"{key} int, w array<string>") for n, key in ((120, "i"), (60, "j")))
    sets = [{x[0]: set(x[1] or ()) for x in df.collect()} for df in (a, b)]
    want = {(i, j, len(x & y), len(x & y) / len(x | y)) for i, x in sets[0].items() for j, y in sets[1].items() if x & y and len(x & y) / len(x | y) >= 0.2}
    for held in (0, 4096):
        assert {tuple(x) for x in R.jaccard_join(a, b.where("w IS NOT NULL"), "i", "j", "w", "w", 0.2, held).collect()} == want
    assert R.jaccard_join(a, b.where("false"), "i", "j", "w", "w", 0.2).count() == R.jaccard_join(a.where("false"), b, "i", "j", "w", "w", 0.2).count() == 0


def test_spans_of_all_lengths(spark):
    """Spans from one to a million wide meet, and none makes more rows than bins are allowed."""
    import random

    r = random.Random(4)
    rows = [(k, k % 3, s := r.randint(-2000, 2000), s + r.choice([1, 2, 30, 500, 1_000_000])) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, key int, s bigint, e bigint")
    found = R.interval_overlap(df, df, ["key"], ("s", "e"), ("s", "e"), width=3).select("a.id", F.col("b.id").alias("other")).collect()
    want = [(p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and p[2] < q[3] and q[2] < p[3]]
    assert sorted(map(tuple, found)) == sorted(want)


def test_best_of_each_query_in_slices(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(6)
    x = r.integers(-2, 3, (700, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0])], "id bigint, v array<double>").repartition(3)
    found = S.vector_top(df, df.where("id % 50 = 0 AND id < 700"), "id", "v", 7).collect()
    norm = np.linalg.norm(x, axis=1)
    for q in range(0, 700, 50):
        with np.errstate(all="ignore"):
            s = np.nan_to_num(np.round(np.minimum(x @ x[q] / (norm * norm[q]), 1), 6))
        want = [(int(k), float(s[k])) for k in np.lexsort((np.arange(700), -s))[:7] if s[k] > 0]
        assert sorted([(f.id, f.score) for f in found if f.query_id == q], key=lambda y: (-y[1], y[0])) == want


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 3, 9, 9, -1)], "x int")
    assert sorted((r.x, r.n) for r in R.numbered(rows, "x", "n").collect()) == [(-1, 1), (3, 2), (5, 3), (9, 4), (9, 5)]
    assert R.numbered(rows.where("false"), "x", "n").count() == 0


def test_trailing_counts_are_running_sums(spark):
    """Each row of a window is looked at once, at the windows' ends too; rows without a time count each other once."""
    times = [0, 1, 5, 5, 9, 10, 11, 14, 15, 16, 26, 27, None, None]
    found = R.trailing_count(spark.createDataFrame([("a", k, s) for k, s in enumerate(times)], "g string, k int, s bigint"), ["g"], F.col("s"), 10)
    assert {r.k: r.trailing for r in found.collect()} == {k: sum(x is not None and s - 10 <= x <= s for x in times) if s is not None else 2 for k, s in enumerate(times)}
    assert "-10" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_dealt_by_their_lines(spark):
    """Costly work on each file has tasks for all cores, and more as the lines grow, though keys are short."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    n = R.tasks_for(lines)
    assert n > 1 and R.tasks_for(lines, 100) == -(-lines.count() // 100)
    assert codebase.files(spark, SF).select("path", "functions").rdd.getNumPartitions() == n


def test_modules_are_looked_up_once(spark):
    """What many files import is resolved once for a language, and a relative module once for each folder."""
    files = codebase.files(spark, SF)
    found = C.resolve_imports(files)
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()  # candidates were looked up before
    assert found.where("importer = target").isEmpty() and not found.isEmpty()
