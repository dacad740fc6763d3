"""Centroid clustering of integer vectors by partial-distance search.

Every round is one pass of the table through numpy in Arrow batches and one aggregate of exact sums: the driver holds
nothing but the centroids (`k` times `dims` integers), and a round's partial sums are combined before they are shuffled.
Squared differences are accumulated over the dimensions of highest variance first, a few dimensions at a time; a centroid is
abandoned for a vector once its partial sum is strictly above the vector's best whole distance; survivors finish all
dimensions. Equal distances go to the smaller number, so the result does not depend on the order of the dimensions.

Kept are vectors of exactly `dims` components, none of them null or non-finite; others are in no cluster and not returned.
Rows that repeat an id are vectors of their own. Rows without an id are clustered, but start no centroid. With fewer
than `k` kept vectors that have an id there are as many centroids as those; without any there is no row. Sums and distances
are exact at any size of the components; a distance, or an inertia, that no long holds is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Dimensions that are added to the partial sums at once.
STEP = 8
#: Vectors that are searched at once.
ROWS = 4096
#: Integers up to here have sums of squared differences over 64 dimensions in a long; beyond, Python's integers do it.
LARGEST = 1 << 27
#: Sums go through Spark in limbs of so many bits, which a long can add up over a billion partial sums.
LIMB = 32
LONG = (1 << 63) - 1


def vectors_of(column: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and components, in doubles, of the vectors of a list column that are whole: `dims` of them, none null or non-finite."""
    column = column.cast(pa.large_list(pa.float64()))
    at = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dims)
    x = column.take(pa.array(at)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    whole = np.isfinite(x).all(axis=1)
    return at[whole], x[whole]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers where all are small, else as Python's."""
    y = np.floor(x * SCALE)
    if y.size and np.abs(y).max() > LARGEST:
        # A product beyond a double's range is taken from the component's own exact value.
        return np.array([[int(v) if np.isfinite(v) else int(u) * SCALE for u, v in zip(p, q, strict=True)] for p, q in zip(x, y, strict=True)], object)
    return y.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, of equal ones the smaller number.

    order: the dimensions, those of highest variance first. A first guess is the centroid that is nearest in the first
    `step` of them, whose whole distance is the best at the start.
    """
    n, kind = len(x), object if x.dtype == object or centroids.dtype == object else np.int64
    x, c = x[:, order].astype(kind), centroids[:, order].astype(kind)
    head = np.empty((len(c), n), kind)
    for k, row in enumerate(c):
        d = x[:, :step] - row[:step]
        head[k] = (d * d).sum(axis=1)
    number = head.argmin(axis=0) if n else np.zeros(0, np.int64)
    d = x - c[number]
    best = (d * d).sum(axis=1)
    for k, row in enumerate(c):
        at = np.flatnonzero((head[k] <= best) & (number != k))
        partial = head[k, at]
        for low in range(step, x.shape[1], step):
            if not len(at):
                break
            d = x[at, low : low + step] - row[low : low + step]
            partial = partial + (d * d).sum(axis=1)
            left = partial <= best[at]
            at, partial = at[left], partial[left]
        better = (partial < best[at]) | (number[at] > k)
        number[at[better]], best[at[better]] = k, partial[better]
    return number, best


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of the kept vectors of batches (id, embedding), at most ROWS at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            where, x = vectors_of(part.column(1), dims)
            yield part.column(0).take(pa.array(where)), integers(x)


def _limbs(total: int) -> list[int]:
    """A whole number in limbs of LIMB bits, the last of which has the sign."""
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _spread(rows: DataFrame, dims: int) -> np.ndarray:
    """The dimensions by falling variance: from sums of all kept vectors, which are combined on the map side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dims))
        for batch in batches:
            _, x = vectors_of(batch.column(1), dims)
            with np.errstate(over="ignore"):
                total += np.stack([np.full(dims, len(x), float), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(list(range(3 * dims)), pa.int32()), pa.array(total.ravel())], ["at", "total"])

    sums = {r["at"]: r["total"] for r in rows.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()}  # 3 * dims rows
    n, first, second = (np.array([sums.get(k * dims + j, 0.0) for j in range(dims)]) for k in range(3))
    with np.errstate(all="ignore"):
        spread = np.nan_to_num(second / np.maximum(n, 1) - (first / np.maximum(n, 1)) ** 2)
    return np.argsort(-spread, kind="stable")


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; those without a vector stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for _, x in _slices(batches, dims):
            number, _ = nearest(x, centroids, order)
            count += np.bincount(number, minlength=k)
            by = np.argsort(number, kind="stable")
            present, starts = np.unique(number[by], return_index=True)
            if len(present):
                total[present] += np.add.reduceat(x[by], starts, axis=0).astype(object)
        out = [(c, -1, 0, int(count[c])) for c in np.flatnonzero(count).tolist()]
        out += [(c, j, limb, v) for c in np.flatnonzero(count).tolist() for j in range(dims) for limb, v in enumerate(_limbs(int(total[c, j])))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["c", "j", "limb", "v"])

    sums = rows.mapInArrow(run, "c int, j int, limb int, v bigint").groupBy("c", "j", "limb").agg(F.sum("v").alias("v")).collect()  # k * dims rows, and limbs
    count, total = {r.c: r.v for r in sums if r.j < 0}, {}
    for r in sums:
        if r.j >= 0:
            total[r.c, r.j] = total.get((r.c, r.j), 0) + (r.v << (LIMB * r.limb))
    moved = [[total[c, j] // count[c] if c in count else int(centroids[c, j]) for j in range(dims)] for c in range(k)]
    return _fitting(moved, dims)


def _fitting(rows: list[list[int]], dims: int) -> np.ndarray:
    large = any(abs(v) > LARGEST for r in rows for v in r)
    return np.array(rows, object if large else np.int64).reshape(len(rows), dims)


def first_centroids(rows: DataFrame, k: int = K, dims: int = DIMS, seed: str = "2") -> np.ndarray:
    """The k kept vectors of the smallest SHA-256 of `seed:<id>` in hexadecimal, in that order (of equal ids the smaller vector first)."""
    e = F.col("embedding")
    whole = (F.size(e) == dims) & F.forall(e.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ranked = rows.where(F.col("id").isNotNull() & whole).select("embedding", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("rank"))
    chosen = ranked.orderBy("rank", "embedding").limit(k).collect()
    return _fitting([[int(v) for v in integers(np.array([r.embedding], float))[0]] for r in chosen], dims)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept vectors."""
    spark = vectors.sparkSession
    small_batches(spark, ROWS)
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].alias("embedding"))
    centroids = first_centroids(rows, k, dims)
    schema = "id bigint, cluster int, distance bigint"
    if not len(centroids):
        found = spark.createDataFrame([], schema)
    else:
        order = _spread(rows, dims)
        for _ in range(rounds):
            centroids = _moved(rows, centroids, order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _slices(batches, dims):
                number, best = nearest(x, centroids, order)
                distance = pa.array([int(v) if v <= LONG else None for v in best], pa.int64()) if best.dtype == object else pa.array(best)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), distance], ["id", "cluster", "distance"])

        found = materialise(rows.mapInArrow(run, schema))
    whole = lambda d: F.when(F.count("distance") == F.count("*"), F.expr(f"try_cast(sum(cast({d} AS decimal(38, 0))) AS bigint)"))
    digests = [(i, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for i, row in enumerate(centroids)]
    each = found.groupBy("cluster").agg(whole("distance").alias("cluster_inertia"))
    all_of = each.agg(F.when(F.count("cluster_inertia") == F.count("*"), F.expr("try_cast(sum(cast(cluster_inertia AS decimal(38, 0))) AS bigint)")).alias("inertia"))
    # k rows, broadcast to the assigned vectors.
    about = each.crossJoin(F.broadcast(all_of)).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    out = found.join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The same in SQL: one pair of tables for each round."""

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, (m).c AS cluster, (m).d AS distance FROM (
  SELECT vec_id, min({{'d': d, 'c': c}}) AS m FROM (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c ON c.j = v.j GROUP BY 1, 2) GROUP BY 1))"""

    def moved(r: int) -> str:
        return f"""c{r} AS MATERIALIZED (SELECT c.c, c.j, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{r - 1} c LEFT JOIN (
  SELECT a.cluster, v.j, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{r - 1} a JOIN v ON v.vec_id = a.vec_id GROUP BY 1, 2) s ON s.cluster = c.c AND s.j = c.j)"""

    tables = [assigned(0)]
    for r in range(1, rounds + 1):
        tables += [moved(r), assigned(r)]
    chain = ",\n".join(tables)
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS j, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT s.c, v.j, v.x FROM s JOIN v ON v.vec_id = s.vec_id WHERE s.c < {k}),
{chain},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY 1)
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN h ON h.c = a.cluster"""
