"""Near-duplicate vectors by an epsilon grid order join.

Vectors of length one are at most EPSILON apart if their cosine reaches the limit. They are turned onto their principal
dimensions (a rotation, which keeps distances) and sorted by the cells of a grid of that width over the leading ones. The
sorted sequence is cut into intervals of BLOCK vectors, over which stands a tree of FAN intervals to one. Pairs of intervals are
joined recursively, level by level, as equi joins with the tree: a pair that is provably distant (by the cells' extents, or by
balls around the means) is skipped; of a pair that is provably near (by the balls) all vectors are linked without a look at
them, so that a large group of near copies does not cost its square; all others are divided, down to the intervals of the
lowest level, which meet in tasks. There the recursion goes on in memory down to LEAF vectors, whose cosines are computed in
doubles. Nothing is approximate: every pair whose cosine reaches the limit is linked, and no other.

A task holds two intervals. No pairs are written: of each vector its count of links and one neighbour's component, and of a
pair of near intervals one edge. Equal vectors are one class with a count from the start.

Null and zero vectors and those with a null or non-finite component link with nothing (0 links, their own component), and so
do vectors of different lengths. Rows that repeat an id with an equal vector are one; with other vectors, each of these counts
as a vector of its own, and the id has the sum of their links and one component. Rows without an id link with nothing and
are kept. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise, small_batches
from .components import components

LEAST = 0.95
#: Leading principal dimensions whose cells order the vectors and bound the intervals.
LEADING = 16
BLOCK, FAN, LEAF = 2048, 16, 256
#: Intervals that one interval meets in a task, one after another.
PARTNERS = 16
#: Between this and the bounds, distances are not trusted to rounding; cosines so near to the limit are computed again.
SLACK = 1e-9
#: Vectors (half a KB each at 64 dimensions) that are broadcast at most.
BROADCAST_VECTORS = 40_000
#: Intervals of vectors of different lengths are this far apart in the first place of their extents.
APART = 10.0


def epsilon(least: float) -> float:
    return float(np.sqrt(2 - 2 * least))


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In doubles, component by component in order."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(sum(p * q for p, q in zip(a.tolist(), b.tolist(), strict=True)) / (sum(p * p for p in a.tolist()) * sum(q * q for q in b.tolist())) ** 0.5)


def roots_of(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1 joined by edges (p, q): the smallest node of each one's component."""
    root = np.arange(n)
    while len(p):
        low = np.minimum(root[p], root[q])
        np.minimum.at(root, root[p], low)
        np.minimum.at(root, root[q], low)
        while (new := root[root]).tobytes() != root.tobytes():
            root = new
        left = root[p] != root[q]
        p, q = p[left], q[left]
    return root


# --- in a task --------------------------------------------------------------------------------------------------------


class Links:
    """What a task finds between the vectors of intervals: counts of links and spanning edges."""

    def __init__(self, least: float) -> None:
        self.least, self.eps = least, epsilon(least) + SLACK

    def join(self, a: Interval, b: Interval, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(Links of a's vectors with b's, of b's with a's, ends of edges: places in a, and places in b). same: a is b; a vector is linked with itself."""
        to_a, to_b, edges = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64), []
        todo = [(0, len(a.ids), 0, len(b.ids))]
        while todo:
            i, j, p, q = todo.pop()
            if i >= j or p >= q or same and q <= i or self._distant(a.turned[i:j], b.turned[p:q]):
                continue
            if max(j - i, q - p) > LEAF:
                m, r = (i + j) // 2, (p + q) // 2
                todo += [(s, t, u, v) for s, t in ((i, m), (m, j)) for u, v in ((p, r), (r, q)) if not same or u >= s]
                continue
            near = self._near(a, b, i, j, p, q)
            to_a[i:j] += near @ b.many[p:q]
            if not same or p > i:
                to_b[p:q] += a.many[i:j] @ near
            edges.append(self._spanning(near, i, p))
        if same:
            to_a += to_b
            to_b[:] = 0
        ends = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        return to_a, to_b, ends[:, 0], ends[:, 1]

    def _distant(self, x: np.ndarray, y: np.ndarray) -> bool:
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        return float((gap * gap).sum()) > self.eps * self.eps

    def _near(self, a: Interval, b: Interval, i: int, j: int, p: int, q: int) -> np.ndarray:
        c = a.unit[i:j] @ b.unit[p:q].T
        near = c >= self.least
        for s, t in np.argwhere(np.abs(c - self.least) < SLACK).tolist():
            near[s, t] = cosine(a.raw[i + s], b.raw[p + t]) >= self.least
        if a is b and i == p:
            np.fill_diagonal(near, True)
        return near

    @staticmethod
    def _spanning(near: np.ndarray, i: int, p: int) -> np.ndarray:
        """Edges that connect what a matrix of links connects: of each row and column with a link one, and one for each two groups that meet."""
        s, t = np.nonzero(near)
        if len(s) <= near.shape[0] + near.shape[1]:
            return np.stack([s + i, t + p], axis=1)
        # A row's first link and a column's first link leave apart only what other links join: take those until none does.
        n = near.shape[0]
        first_of_row = np.unique(s, return_index=True)[1]
        first_of_column = np.unique(t, return_index=True)[1]
        kept = np.union1d(first_of_row, first_of_column)
        while True:
            root = roots_of(s[kept], t[kept] + n, n + near.shape[1])
            left = np.flatnonzero(root[s] != root[t + n])
            if not len(left):
                return np.stack([s[kept] + i, t[kept] + p], axis=1)
            pairs = np.stack([root[s[left]], root[t[left] + n]], axis=1)
            kept = np.union1d(kept, left[np.unique(pairs, axis=0, return_index=True)[1]])


class Interval:
    """The vectors of an interval of the sorted sequence: smallest id, count of equal ones, raw and unit components, leading turned ones."""

    def __init__(self, ids: bytes, many: bytes, raw: bytes, rotation: np.ndarray | None) -> None:
        self.ids, self.many = np.frombuffer(ids, np.int64), np.frombuffer(many, np.int64)
        self.raw = np.frombuffer(raw, np.float64).reshape(len(self.ids), -1)
        self.unit = unit(self.raw)
        self.turned = turn(self.unit, rotation)


def turn(x: np.ndarray, rotation: np.ndarray | None) -> np.ndarray:
    """The leading principal components; the leading components themselves of vectors that the rotation is not for."""
    return x[:, :LEADING] if rotation is None or len(rotation) != x.shape[1] else x @ rotation[:, :LEADING]


# --- the sequence -----------------------------------------------------------------------------------------------------


def principal(classes: DataFrame) -> np.ndarray | None:
    """Principal directions (columns, of falling variance) of the unit vectors of the most frequent length, from sums of all of them."""
    length = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return None
    dims = length["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for batch in batches:
            x = unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims))
            total[:dims] += x.T @ x
            total[dims] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "total"])

    # (dims + 1) * dims sums, whatever the number of vectors.
    sums = classes.where(F.size("v") == dims).select("v").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((dims + 1) * dims)
    for r in sums:
        total[r["at"]] = r["total"]
    total, n = total.reshape(dims + 1, dims), max(1, length["count"])
    mean = total[dims] / n
    _, directions = np.linalg.eigh(total[:dims] / n - np.outer(mean, mean))
    return directions[:, ::-1].copy()


def _keyed(classes: DataFrame, rotation: np.ndarray | None, eps: float) -> DataFrame:
    """Rows (cells, fine, id, many, raw) of classes (id, many, v): the length and the cells of the leading turned components, and the first of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                raw = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                t = turn(unit(raw), rotation)
                cells = np.concatenate([np.full((len(t), 1), d), np.floor(t / eps)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.list_(pa.int32())), pa.array(t[:, 0].copy()), part.column(0), part.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], ["cells", "fine", "id", "many", "raw"])

    return classes.select("id", "many", "v").mapInArrow(run, "cells array<int>, fine double, id bigint, many bigint, raw binary")


def _blocks(ordered: DataFrame, rotation: np.ndarray | None, block: int) -> DataFrame:
    """The intervals of the sorted sequence: part, place in it, payload (ids, many, raw) and summary (n, least, lo, hi, centre, radius).

    lo and hi: extents of the leading turned components behind APART times the vectors' length, in LEADING + 1 places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place = 0

        def packed() -> pa.RecordBatch:
            nonlocal place
            x = Interval(np.array([r[1] for r in held], np.int64).tobytes(), np.array([r[2] for r in held], np.int64).tobytes(), b"".join(r[3] for r in held), rotation)
            centre = x.unit.mean(axis=0)
            radius = float(np.sqrt(((x.unit - centre) ** 2).sum(axis=1).max()))
            box = np.zeros((2, LEADING + 1))
            box[:, 0] = APART * x.raw.shape[1]
            box[0, 1 : x.turned.shape[1] + 1], box[1, 1 : x.turned.shape[1] + 1] = x.turned.min(axis=0), x.turned.max(axis=0)
            out = [[place], [x.ids.tobytes()], [x.many.tobytes()], [x.raw.tobytes()], [int(x.many.sum())], [int(x.ids.min())], [box[0].tolist()], [box[1].tolist()], [centre.tolist()], [radius]]
            place += 1
            held.clear()
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["place", "ids", "many", "raw", "n", "least", "lo", "hi", "centre", "radius"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if held and (len(held) == block or len(held[0][3]) != len(row[3])):
                    yield packed()
                held.append(row)
        if held:
            yield packed()

    rows = ordered.select(F.col("cells")[0].alias("d"), "id", "many", "raw")
    packed = rows.mapInArrow(run, "place bigint, ids binary, many binary, raw binary, n bigint, least bigint, lo array<double>, hi array<double>, centre array<double>, radius double")
    return packed.withColumn("part", F.spark_partition_id().cast("bigint"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes (code, summary): at most FAN of them to one, with the union of extents and a ball around all balls."""
    gathered = nodes.groupBy(F.expr(f"code div {FAN}").alias("code")).agg(F.collect_list(F.struct("code", "n", "least", "lo", "hi", "centre", "radius")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for code, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of.sort(key=lambda r: r["code"])
                if len({len(r["centre"]) for r in of}) == 1 and all(r["radius"] >= 0 for r in of):
                    centres, n = np.array([r["centre"] for r in of]), np.array([r["n"] for r in of], float)
                    centre = (centres * n[:, None]).sum(axis=0) / n.sum()
                    radius = max(float(np.sqrt(((c - centre) ** 2).sum())) + r["radius"] for c, r in zip(centres, of, strict=True)) + SLACK
                else:
                    centre, radius = np.zeros(0), -1.0  # vectors of several lengths have no ball
                rows.append((code, sum(r["n"] for r in of), min(r["least"] for r in of), np.min([r["lo"] for r in of], axis=0).tolist(), np.max([r["hi"] for r in of], axis=0).tolist(), centre.tolist(), radius))
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["code", "n", "least", "lo", "hi", "centre", "radius"])

    return gathered.mapInArrow(run, "code bigint, n bigint, least bigint, lo array<double>, hi array<double>, centre array<double>, radius double")


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b: structs of nodes) with near, whether all vectors of both are near each other; the provably distant ones are left out."""
    square = lambda x: x * x
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    over = F.zip_with(F.col("a.lo"), F.col("b.hi"), lambda lo, hi: lo - hi)
    under = F.zip_with(F.col("b.lo"), F.col("a.hi"), lambda lo, hi: lo - hi)
    gap = total(F.zip_with(over, under, lambda p, q: square(F.greatest(F.lit(0.0), p, q))))
    balls = (F.col("a.radius") >= 0) & (F.col("b.radius") >= 0) & (F.size("a.centre") == F.size("b.centre"))
    between = F.when(balls, F.sqrt(total(F.zip_with("a.centre", "b.centre", lambda p, q: square(p - q)))))
    reach = F.col("a.radius") + F.col("b.radius")
    pairs = pairs.withColumn("gap", gap).withColumn("between", between).withColumn("reach", reach)
    limit = eps + SLACK
    pairs = pairs.where(F.col("gap") <= limit * limit).where(F.col("between").isNull() | (F.col("between") - F.col("reach") <= limit))
    return pairs.withColumn("near", F.coalesce(F.col("between") + F.col("reach") <= eps - SLACK, F.lit(False))).drop("gap", "between", "reach")


def _recursion(levels: list[DataFrame], eps: float) -> tuple[DataFrame, DataFrame]:
    """(Pairs (i, j), i <= j, of lowest intervals that must be looked at; rows (level, i, j, n_i, n_j, least_i, least_j) of near pairs at any level)."""
    struct = F.struct("code", "n", "least", "lo", "hi", "centre", "radius")
    top = levels[-1].select(struct.alias("node"))
    pairs = top.select(F.col("node").alias("a")).join(F.broadcast(top.select(F.col("node").alias("b"))), F.expr("a.code <= b.code"))  # the top level is one interval
    near_pairs = None
    for level in range(len(levels) - 1, -1, -1):
        judged = materialise(_judged(pairs, eps))
        near = judged.where("near").select(F.lit(level).alias("level"), *[F.col(f"{s}.{c}").alias(f"{k}") for s, c, k in (("a", "code", "i"), ("b", "code", "j"), ("a", "n", "n_i"), ("b", "n", "n_j"), ("a", "least", "least_i"), ("b", "least", "least_j"))])
        near_pairs = near if near_pairs is None else near_pairs.unionAll(near)
        left = judged.where("NOT near").select(F.col("a.code").alias("i"), F.col("b.code").alias("j"))
        if level:
            below = levels[level - 1].select(F.expr(f"code div {FAN}").alias("up"), struct.alias("node"))
            side = lambda up, name: below.select(F.col("up").alias(up), F.col("node").alias(name))  # noqa: B023, E731
            pairs = left.join(side("i", "a"), "i").join(side("j", "b"), "j").where("a.code <= b.code").select("a", "b")
    return left, near_pairs


def _compared(pairs: DataFrame, blocks: DataFrame, rotation: np.ndarray | None, least: float) -> DataFrame:
    """Rows (id, links, root) of the vectors of pairs (i, j) of intervals: how many are linked, and the smallest id that the pair's links reach."""
    payload = ["ids", "many", "raw"]
    groups = pairs.withColumn("chunk", F.expr(f"j div {PARTNERS}"))
    own = groups.select("i", "chunk").distinct().join(blocks.select(F.col("code").alias("i"), *payload), "i").select("i", "chunk", F.lit(-1).cast("bigint").alias("j"), *payload)
    others = groups.where("i != j").join(blocks.select(F.col("code").alias("j"), *payload), "j").select("i", "chunk", "j", *payload)
    itself = groups.where("i = j").select("i", "chunk", "j", *[F.lit(b"").alias(c) for c in payload])
    dealt = own.unionAll(others).unionAll(itself).repartition("i", "chunk").sortWithinPartitions("i", "chunk", "j")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(batch.column(c)[k] for c in range(6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links(least)
        of = lambda r: Interval(*(c.as_buffer() for c in r[3:]), rotation)
        for _, group in groupby(rows(batches), key=lambda r: (r[0].as_py(), r[1].as_py())):
            first = next(group)
            a, b = of(first), None
            for r in group:
                same = r[2].as_py() == r[0].as_py()
                b = a if same else of(r)
                to_a, to_b, p, q = links.join(a, b, same)
                n = len(a.ids)
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                many = to_a if same else np.concatenate([to_a, to_b])
                # Nodes in the order of their ids, so that a component's smallest node has its smallest id.
                rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                root = np.sort(ids)[roots_of(rank[p], rank[q if same else q + n], len(ids))][rank]
                linked = many > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(many[linked]), pa.array(root[linked])], ["id", "links", "root"])

    return dealt.mapInArrow(run, "id bigint, links bigint, root bigint")


def _all_near(near: DataFrame, blocks: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(Rows (id, links, root) of all vectors of intervals of near pairs; rows (a, b): one edge for each such pair)."""
    sides = near.select("level", F.col("i").alias("code"), F.col("n_j").alias("links"), F.col("least_j").alias("root"))
    sides = sides.unionAll(near.where("i != j").select("level", F.col("j").alias("code"), F.col("n_i").alias("links"), F.col("least_i").alias("root")))
    by_node = sides.groupBy("level", "code").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    ancestors = blocks.select("code", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"code div {FAN**k}L").alias("up")) for k in range(levels)])).alias("at"))
    found = ancestors.select(F.col("code").alias("block"), "at.level", F.col("at.up").alias("code")).join(by_node, ["level", "code"]).select(F.col("block").alias("code"), "links", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[k].as_buffer(), np.int64)
                same = lambda c: pa.array(np.full(len(ids), batch.column(c)[k].as_py(), np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(ids), same(1), same(2)], ["id", "links", "root"])

    rows = found.join(blocks.select("code", "ids"), "code").select("ids", "links", "root").mapInArrow(run, "id bigint, links bigint, root bigint")
    return rows, near.where("i != j").select(F.col("least_i").alias("a"), F.col("least_j").alias("b"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Rows (id, n_links, component_id, kept) of every row; kept: it is its component's smallest id. block: vectors of an interval."""
    spark, eps = vectors.sparkSession, epsilon(least)
    small_batches(spark, BLOCK)
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # Zeros of both signs are equal components.
    whole = materialise(rows.where(usable).select("id", F.transform("v", lambda x: x + 0.0).alias("v")))
    # Equal vectors: one class, told by its place in a written table. Grouped by the vector, with partial sums.
    classes = whole.distinct().groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("many"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()))
    shared = classes.where("many > 1").select("v", "class")
    members = classes.where("many = 1").select(F.col("first").alias("id"), "class")
    members = materialise(members.unionAll(whole.join(if_small(shared, BROADCAST_VECTORS), "v").select("id", "class").distinct()))
    rotation = principal(classes)
    keyed = materialise(_keyed(classes.select(F.col("class").alias("id"), "many", "v"), rotation, eps))
    parts = max(1, -(-classes.count() // (8 * block)))
    ordered = keyed.repartitionByRange(parts, "cells", "fine", "id").sortWithinPartitions("cells", "fine", "id")
    blocks = materialise(_blocks(ordered, rotation, block))
    span = blocks.agg(F.max("part"), F.max("place")).first()
    if span[0] is None:
        found = spark.createDataFrame([], "class bigint, links bigint, component bigint")
    else:
        wide = FAN
        while wide <= span[1]:
            wide *= FAN
        blocks = blocks.withColumn("code", F.col("part") * wide + F.col("place"))
        levels, most = [materialise(blocks.select("code", "n", "least", "lo", "hi", "centre", "radius"))], span[0] * wide + span[1]
        while most:
            levels.append(materialise(_parents(levels[-1])))
            most //= FAN
        small_batches(spark, 4)  # intervals of up to a few MB
        pairs, near = _recursion(levels, eps)
        compared = materialise(_compared(materialise(pairs), blocks, rotation, least))
        everywhere, edges = _all_near(materialise(near), blocks, len(levels))
        everywhere = materialise(compared.unionAll(everywhere))
        linked = everywhere.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(edges)
        of = components(linked).select(F.col("id").alias("class"), "component")
        found = everywhere.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links")).join(of, "class", "left")
    return _by_id(rows, members, found, id_col)


def _by_id(rows: DataFrame, members: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """From classes (members: id, class; found: class, links, component) to ids: a class's links, but for itself, are those of each member."""
    each = materialise(members.join(found, "class").select("id", (F.col("links") - 1).alias("links"), F.coalesce("component", "class").alias("component")))
    smallest = materialise(each.groupBy("component").agg(F.min("id").alias("least")))
    placed = each.join(if_small(smallest), "component").select("id", "links", "least")
    by_id = materialise(placed.groupBy("id").agg(F.sum("links").alias("links"), F.min("least").alias("component"), F.max("least").alias("other")))
    if by_id.where("component != other").head(1):
        # An id with several vectors joins their components.
        joined = components(placed.select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("component", "joined")
        by_id = by_id.join(joined, "id", "left").withColumn("component", F.coalesce("joined", "component"))
    out = rows.select("id").join(by_id.select("id", "links", "component"), "id", "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def oracle() -> str:
    """The same in SQL, over all pairs."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1),
c(id, root) AS (SELECT a, a FROM p UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.id WHERE c.root < p.b)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(m.root, e.vec_id), e.vec_id) AS component_id, coalesce(least(m.root, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN (SELECT id, min(root) AS root FROM c GROUP BY 1) m ON m.id = e.vec_id"""
