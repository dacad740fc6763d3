"""Changes over snapshots: random upserts and deletes against a dictionary, what a commit writes, and what a sweep leaves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conspectus.sources import store as module
from conspectus.sources.store import TableStore


def written(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "_commits" not in d)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "branch string, k int, v int").coalesce(1)


@pytest.mark.parametrize("most", [2, 16])
def test_random_changes(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(module, "MOST_CHANGES", most)
    r, store, held = random.Random(most), TableStore(spark, str(tmp_path)), {}
    for step in range(9):
        if step and r.random() < 0.3:
            gone = [("m", r.randint(0, 30), 0) for _ in range(r.randint(1, 4))]
            store.delete("t", rows(spark, gone), ["branch", "k"])
            for _, k, _ in gone:
                held.pop(k, None)
        else:
            new = {r.randint(0, 30): step for _ in range(r.randint(1, 30 if not step else 4))}
            # several rows of a key replace all earlier ones
            store.upsert("t", rows(spark, [("m", k, v + 100 * j) for k, v in new.items() for j in range(1 + k % 2)]), ["branch", "k"])
            held |= {k: [v + 100 * j for j in range(1 + k % 2)] for k, v in new.items()}
        assert sorted((x.k, x.v) for x in store.read("t").collect()) == sorted((k, v) for k, vs in held.items() for v in vs)
    store.change({"t": (None, rows(spark, [("m", 1, 0)])), "u": (rows(spark, [("m", 1, 0)]), rows(spark, [("m", 1, 0)]))}, ["branch", "k"])
    assert store.read("u").count() == 1 and store.read("t").where("k = 1").count() == 0
    store.upsert("u", rows(spark, [("m", 2, 0)]), ["k"])  # by other keys than before
    store.delete("u", rows(spark, [("m", 1, 0)]), ["branch", "k"])
    assert [x.k for x in store.read("u").collect()] == [2]


def test_a_commit_writes_what_it_changes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("t", spark.range(200_000).selectExpr("id AS k", "hash(id) AS v").coalesce(1))
    whole = written(tmp_path)
    for k in range(3):
        store.upsert("t", spark.range(5).selectExpr(f"id + {k} AS k", "-1 AS v").coalesce(1), ["k"])
    assert written(tmp_path) - whole < whole / 50
    assert store.read("t").where("v = -1").count() == 7 and store.read("t").count() == 200_000
    assert store.sweep() == 0  # all of it is young
    store.upsert("t", spark.range(60_000).selectExpr("id AS k", "-2 AS v").coalesce(1), ["k"])  # over a quarter: folded into a new snapshot
    assert len(store._entries("t")) == 1 and store.read("t").agg(F.sum("k"), F.count("*")).first() == (199_999 * 100_000, 200_000)
    before = written(tmp_path)
    assert store.sweep(-1) > 4 and written(tmp_path) < before and store.read("t").where("v = -2").count() == 60_000
    assert len(store._log()) == 1
    assert store.sweep(-1) == 0 or store.read("t").count() == 200_000
