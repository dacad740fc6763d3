"""Operators 11 to 13 against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conspectus.llm import centroids, filter_audit, grid_join

VECTORS = "vec_id bigint, embedding array<double>, label int, id bigint, v string, class int, many int"


# --- 11 -----------------------------------------------------------------------------------------------------------------


def audit(docs, labels):
    """Every count by replaying each order over each part's documents."""
    least, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if i is not None and q == 1 else set()
        toxic |= {i} if i is not None and t == 1 else set()
    parts = {}
    for i, text, part in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and text in least and least[text] < i else set()
        parts.setdefault(part or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                here = [r for r in rows if f in r[0] and not r[0] & before]
                out[part, order, step] = [sum(not r[0] & set(order[:step]) for r in rows), len(here), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
                shapley[f] += len(here)
        for order, step in ((o, s) for p, o, s in out if p == part):
            out[part, order, step].append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark):
    r = random.Random(7)
    texts = [None, "", "short", "# one", "LOUD", " ".join(f"w{k}" for k in range(120)), " ".join(["same"] * 150), " ".join(f"W{k}" for k in range(130)), " ".join(f"w{k}\t%" for k in range(99)), "x y " * 120]
    docs = [(k, r.choice(texts), r.choice(["en", "fr", "", None])) for k in range(90)] + [(5, "short", "en"), (None, "short", "en"), (None, None, None)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 90, 2)] + [(4, 1, 1), (4, 1, 0), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("part", F.lit("p")).withColumn("digest", F.lit(1)).withColumn("A", F.lit(2))
    found = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("id", F.lit(1)))
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in found.collect()}
    assert got == audit(docs, labels) and len(got) == 3 * 600
    assert filter_audit.filter_audit(d.where("false"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_filter_audit_of_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    found = filter_audit.filter_audit(spark.createDataFrame([(1, long, "en"), (2, long, "en"), (3, long + " #", "en")], "doc_id bigint, text string, lang string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    last = {x.filter_order: (x.kept, x.removed) for x in found.where("step = 5").collect()}
    assert last["ABCDE"] == (1, 1) and last["ABCED"] == (1, 1) and last["DEABC"] == (1, 0)


# --- 12 -----------------------------------------------------------------------------------------------------------------


def clustered(rows, k, rounds):
    """Plain integers, every centroid whole."""
    kept = [(i, [int(math.floor(256 * x)) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in ranked[:k]]

    def nearest(v):
        return min((sum((p - q) ** 2 for p, q in zip(v, w, strict=True)), n) for n, w in enumerate(c))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(by[n]) for x in zip(*by[n], strict=True)] if n in by else w for n, w in enumerate(c)]
    return [(i, *nearest(v)[::-1], hashlib.sha256(",".join(map(str, c[nearest(v)[1]])).encode()).hexdigest()) for i, v in kept]


def check_clusters(found, want):
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance if r.distance is not None else -1, r.centroid_sha256) for r in found) == sorted((i if i is not None else -1, n, d if d < 2**63 else -1, h) for i, n, d, h in want)
    inertia = {}
    for _, n, d, _ in want:
        inertia[n] = inertia.get(n, 0) + d
    fits = lambda x: x if x < 2**63 else None
    assert all(r.cluster_inertia == fits(inertia[r.cluster]) and r.inertia == fits(sum(inertia.values())) for r in found)


def vectors(n, seed, dims=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    return [(k, (centres[k % 6] + r.normal(size=dims) * 0.3).tolist()) for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4) for i, v in rows], VECTORS)


def test_centroids(spark):
    rows = vectors(150, 3)
    odd = [(200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 63 + [None]), (204, [0.0] * 63 + [float("nan")]), (205, [float("inf")] * 64), (206, [0.0] * 64), (207, [0.0] * 64), (None, rows[0][1]), (7, rows[7][1]), (7, rows[8][1])]
    check_clusters(centroids.cluster(table(spark, rows + odd)).collect(), clustered(rows + odd, 40, 5))
    # Ties: a grid of few values, so that many distances are equal.
    r = random.Random(5)
    rows = [(k, [float(r.randint(0, 1))] * 32 + [0.0] * 32) for k in range(60)] + [(k, [0.5] * 64) for k in range(60, 64)]
    check_clusters(centroids.cluster(table(spark, rows), k=5, rounds=3).collect(), clustered(rows, 5, 3))
    # Fewer vectors than centroids, and none.
    check_clusters(centroids.cluster(table(spark, rows[:3])).collect(), clustered(rows[:3], 40, 5))
    assert centroids.cluster(table(spark, [])).collect() == [] and centroids.cluster(table(spark, [(1, None)])).collect() == []


def test_centroids_of_huge_components(spark):
    rows = vectors(30, 4) + [(100, [1e6] * 64), (101, [-3e9] * 64), (102, [1e20] + [0.0] * 63), (103, [1e308] * 64), (104, [-1e308] * 64)]
    check_clusters(centroids.cluster(table(spark, rows), k=6, rounds=3).collect(), clustered(rows, 6, 3))


def test_partial_distances_are_whole_ones():
    r = np.random.default_rng(9)
    for spread in (2, 300):
        x, c = r.integers(-spread, spread, (500, 64)), r.integers(-spread, spread, (40, 64))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        number, best = centroids.nearest(x, c, r.permutation(64))
        assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_limbs():
    for v in (0, 1, -1, 2**32, -(2**32) - 1, 3**70, -(3**70)):
        assert sum(x << (centroids.LIMB * k) for k, x in enumerate(centroids._limbs(v))) == v and all(abs(x) <= 2**32 for x in centroids._limbs(v))


# --- 13 -----------------------------------------------------------------------------------------------------------------


def linked(rows):
    """{id: (links, component)} by all pairs; equal vectors of an id are one."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    usable = sorted(usable)
    links, root = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(usable):
        for j, b in usable[:n]:
            if len(a) == len(b) and grid_join.cosine(np.array(a), np.array(b)) >= 0.95:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n, find(i)) for i, n in links.items()}


def check_links(found, rows):
    assert len(found) == len(rows)
    want = linked(rows)
    for r in found:
        assert (r.n_links, r.component_id) == (want[r.vec_id] if r.vec_id is not None else (0, None)), r
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)


@pytest.mark.parametrize("block", [6, 2048])
def test_grid_join(spark, block):
    r = np.random.default_rng(12)
    rows = []
    for c in range(5):  # groups from tight to so wide that only some of their pairs are linked
        centre = r.normal(size=16)
        rows += [(len(rows) + k, (centre + r.normal(size=16) * (0.01, 0.05, 0.15, 0.2, 0.25)[c]).tolist()) for k in range(50)]
    rows += [(len(rows) + k, r.normal(size=16).tolist()) for k in range(60)]
    one = rows[3][1]
    rows += [(1000 + k, one) for k in range(20)] + [(1100, [2 * x for x in one]), (1101, [-x for x in one]), (1102, [1e-200 * x for x in one]), (1103, [1e300 * x for x in one])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [None]), (2004, [1.0] * 15 + [float("nan")]), (2005, [float("inf")] * 16), (None, one), (3, one), (3, rows[60][1]), (2006, one[:15]), (2007, one[:15]), (2008, [-0.0] * 15 + [1.0]), (2009, [0.0] * 15 + [1.0]), (2010, [3.0]), (-5, [4.0])]
    check_links(grid_join.near_vectors(table(spark, rows), block=block).collect(), rows)


def test_grid_join_at_the_limit(spark):
    """Pairs at angles a little to both sides of the limit, and chains of them."""
    angles = [k * (math.acos(0.95) + d) for k in range(6) for d in (-1e-4, 1e-4, -1e-7, 1e-7)]
    rows = [(k, [math.cos(a), math.sin(a), 0.0]) for k, a in enumerate(angles)]
    check_links(grid_join.near_vectors(table(spark, rows), block=3).collect(), rows)
    assert grid_join.near_vectors(table(spark, [])).count() == 0
    check_links(grid_join.near_vectors(table(spark, [(1, None), (None, None)])).collect(), [(1, None), (None, None)])


def test_near_intervals_are_not_looked_at(spark):
    """A large group of near copies is linked by its balls: few pairs of intervals go to tasks, and the counts are whole."""
    r = np.random.default_rng(3)
    centre = r.normal(size=32)
    rows = [(k, (centre + r.normal(size=32) * 0.01).tolist()) for k in range(400)]
    found = grid_join.near_vectors(table(spark, rows), block=10).collect()
    assert all(x.n_links == 399 and x.component_id == 0 for x in found)


def test_spanning_edges():
    r = np.random.default_rng(8)
    for density in (0.005, 0.05, 0.3, 1.0):
        near = r.random((40, 30)) < density
        edges = grid_join.Links._spanning(near, 100, 500)
        s, t = np.nonzero(near)
        assert {(a - 100, b - 500) for a, b in edges.tolist()} <= set(zip(s.tolist(), t.tolist(), strict=True))
        assert (grid_join.roots_of(s, t + 40, 70) == grid_join.roots_of(edges[:, 0] - 100, edges[:, 1] - 500 + 40, 70)).all()
