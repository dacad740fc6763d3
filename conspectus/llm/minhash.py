"""MinHash near-duplicate detection: universal hash minima, banding, verification, connected components.

Texts with equal sets of shingles are one class, found by a hash of the set. Classes that agree in a band of minima meet
in a bucket, whose smallest id is its pivot. Pairs are checked by their full sets, and only those that what is found so far
leaves apart: first each class with the one pivot that it meets in most bands, then with its other pivots, and at last all
members of buckets that are still divided. A pivot's set goes once to each CHUNK of its members. Divided buckets meet in
pairs of blocks, to which every member's full set goes once, so that no bucket has to fit in a task; there each two members
of different components are compared exactly, and only links that join components are written. So no candidate is dropped,
no pairs are written out, and a large group of near copies costs about one comparison each.
Null and empty texts, and those without a word, have an empty set and are linked with nothing; rows that repeat an id
share its links; rows without an id are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise, materialise_narrow, mix, row_slices, shingles_of, small_batches, space_table, text_buffer, words_of
from .components import components

#: Members of a block; buckets of more than BLOCKS such blocks have larger ones, up to MOST_ROWS.
BLOCK_ROWS, BLOCKS, MOST_ROWS = 256, 32, 2048
#: So many shingles count as one member more, so that a block's sets are bounded too.
WEIGHT = 4096
#: Members that are compared with their pivot in one go.
CHUNK = 64


@dataclass(frozen=True)
class Banding:
    """`bands` bands of `rows` minima; a pair counts from the Jaccard index at / of on."""

    rows: int = 7
    bands: int = 36
    at: int = 85
    of: int = 100
    shingle: int = 5

    @property
    def minima(self) -> int:
        return self.rows * self.bands

    def miss(self, similarity: float) -> float:
        """Probability that a pair of this similarity meets in no band."""
        return (1 - similarity**self.rows) ** self.bands


#: At 0.85 a pair is missed with probability 1e-6.
DOCUMENTS = Banding()
#: The pipeline's stage takes pairs from 0.8 on; there a pair is missed with probability 1e-6.
STAGE = Banding(rows=6, bands=46, at=80)


def _constants(b: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(417)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    return (draw(b.minima) >> np.uint64(31)).astype(np.uint32) | np.uint32(1), (draw(b.minima) >> np.uint64(31)).astype(np.uint32), draw(b.minima) | np.uint64(1)


def sets_of(raw: np.ndarray, offs: np.ndarray, b: Banding, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the bounds of the rows in them."""
    n = len(offs) - 1
    h, row, _, _ = words_of(raw, offs, lut)
    x, bounds = shingles_of(h, row, n, b.shingle)
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x[i:j].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    new[starts] = True
    counts = np.zeros(n + 1, np.int64)
    np.cumsum(new, out=(total := np.zeros(len(x), np.int64)))
    counts[1:] = np.concatenate([[0], total])[bounds[1:]]
    return x[new], counts


def signatures_of(x: np.ndarray, bounds: np.ndarray, b: Banding, constants: tuple) -> np.ndarray:
    """Minima (rows with a shingle, minima) of multiply-shift hashes of the shingles' leading 32 bits."""
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    out = np.empty((b.minima, len(starts)), np.uint32)
    if len(starts):
        v = (x >> np.uint64(32)).astype(np.uint32)
        t = np.empty_like(v)
        for k, (a, c) in enumerate(zip(constants[0], constants[1], strict=True)):
            np.multiply(v, a, out=t)
            np.add(t, c, out=t)
            np.minimum.reduceat(t, starts, out=out[k])
    return out.T


def signatures(items: DataFrame, b: Banding) -> DataFrame:
    """Rows (id, n, h1, h2, keys) of items (id, text): size and hash of the set, bands' keys."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants, lut = _constants(b), space_table()
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for i, j in row_slices(np.diff(offs)):
                x, bounds = sets_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], b, lut)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                h = np.zeros((2, j - i), np.uint64)
                keys: list = [None] * (j - i)
                if len(full):
                    starts = bounds[:-1][full]
                    h[0, full] = np.add.reduceat(mix(x), starts)
                    h[1, full] = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    s = signatures_of(x, bounds, b, constants)
                    band = (s.astype(np.uint64) * constants[2]).reshape(len(full), b.bands, b.rows).sum(axis=2)
                    band = mix(band + np.arange(1, b.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    for k, at in enumerate(full.tolist()):
                        keys[at] = band[k]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "h1", "h2", "keys"])

    return items.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>")


def _full_sets(items: DataFrame, b: Banding) -> DataFrame:
    """Rows (id, full): all shingle hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = space_table()
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for i, j in row_slices(np.diff(offs)):
                x, bounds = sets_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], b, lut)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["id", "full"])

    return items.mapInArrow(run, "id bigint, full binary")


def verify(pairs: DataFrame, items: DataFrame, b: Banding) -> DataFrame:
    """Those of the pairs (a, b; materialised) whose full sets reach the similarity. a's set goes once to each chunk of its partners."""
    ids = materialise_narrow(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct())
    many = materialise_narrow(pairs.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK))
    small_batches(items.sparkSession)
    full = _full_sets(items.join(if_small(ids), "id", "left_semi"), b)
    small_batches(items.sparkSession, 64)
    dealt = pairs.join(if_small(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("m") / CHUNK), F.lit(1))).alias("chunk"))
    others = dealt.join(full.withColumnRenamed("id", "b"), "b").select("a", "chunk", "b", "full")
    own = dealt.select("a", "chunk").distinct().join(full.withColumnRenamed("id", "a"), "a").select("a", "chunk", F.lit(None).cast("bigint").alias("b"), "full")
    rows = own.unionAll(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                q = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                if not batch.column(2)[k].is_valid:
                    p = q.copy()
                    keep.append(False)
                    continue
                if b.of * min(len(p), len(q)) < b.at * max(len(p), len(q), 1):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(b.of * same >= b.at * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 2)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def links_of(rows: list[tuple], across: bool, b: Banding) -> Iterator[tuple[int, int]]:
    """Links (a, b) that join components among rows (block, id, comp, pivot, keys, full set) that share a key, exact; across: of different blocks alone.

    Two that share several keys are compared under the first of them alone, and a pivot with none (it has been).
    """
    key = rows[0][0][0]
    own, ids, comp, pivot = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    keys, sets = np.array([r[5] for r in rows]), [np.frombuffer(r[6], np.uint64) for r in rows]
    n = np.array([len(x) for x in sets])
    ends = np.cumsum(n)
    starts = ends - n
    # Each shingle by its number: a set is marked in `held`, and looking up all others' shingles counts what they share.
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(values), bool)
    for k in np.flatnonzero(ids != pivot).tolist():
        may = (comp != comp[k]) & (ids > ids[k]) & (ids != pivot) & (np.minimum(n, n[k]) * b.of >= np.maximum(n, n[k]) * b.at)
        if across:
            may &= own != own[k]
        may = np.flatnonzero(may)
        if len(may):
            may = may[keys[k][(keys[may] == keys[k]).argmax(axis=1)] == key]
        if not len(may):
            continue
        mine = number[starts[k] : ends[k]]
        held[mine] = True
        if 4 * n[may].sum() > len(number):
            same = np.add.reduceat(held[number], starts, dtype=np.int64)[may]
        else:
            same = np.array([np.count_nonzero(held[number[starts[q] : ends[q]]]) for q in may.tolist()])
        held[mine] = False
        for q in may[b.of * same >= b.at * (n[k] + n[may] - same)].tolist():
            if comp[q] != comp[k]:
                yield int(ids[k]), int(ids[q])
                comp[comp == comp[q]] = comp[k]


def _compare_blocks(rest: DataFrame, b: Banding) -> DataFrame:
    """Links (a, b) between different components in pairs of blocks of rest (key, i, j, block, id, comp, pivot, keys, full)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                c = [batch.column(k).to_pylist() for k in range(9)]
                for key, i, j, *others in zip(*c, strict=True):
                    yield (key, i, j), *others

        for (_, i, j), group in groupby(rows(), key=lambda r: r[0]):
            found = list(links_of(list(group), i != j, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rest.select("key", "i", "j", "block", "id", "comp", "pivot", "keys", "full").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _placed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, pivot, id, comp) of the buckets' members with the components found so far."""
    return buckets.join(if_small(found), "id", "left").select("key", "pivot", "id", F.coalesce("component", "id").alias("comp"))


def _stars(found: DataFrame) -> DataFrame:
    """Links (a, b) of what is linked so far, each id with its component alone."""
    return found.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b"))


def near_components(items: DataFrame, b: Banding = DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(Rows (id, n) of all items (id bigint, text string); rows (id, component) of those that are linked with others)."""
    sig = materialise(signatures(items, b))
    sized = sig.where("n > 0 AND id IS NOT NULL")
    # Equal sets: one class each, its smallest id stands for it.
    # (Tables of shared keys are materialised before they are joined back, so that adaptive execution can split a key that very many rows share.)
    classes = materialise_narrow(sized.groupBy("h1", "h2", "n").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b != top").select("h1", "h2", "n", "b"))
    copies = materialise_narrow(sized.select("id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).where("id != b").select(F.col("id").alias("a"), "b").distinct())
    one = sized.join(if_small(copies.select(F.col("a").alias("id"))), "id", "left_anti")
    # First round: each bucket's members with its smallest id; of the pivots of a member first that of most buckets.
    keyed = one.select("id", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot != top").select("key", "pivot")
    buckets = materialise_narrow(keyed.join(materialise_narrow(met), "key"))
    star = materialise_narrow(buckets.where("id != pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("n")))
    likely = materialise_narrow(star.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"))
    first = materialise_narrow(components(materialise_narrow(verify(likely, items, b))))
    placed = _placed(buckets, first)
    strays = placed.groupBy("key").agg(F.min_by("comp", "id").alias("of_pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key", "of_pivot")
    strays = placed.join(materialise_narrow(strays), "key").where("comp != of_pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    apart = materialise_narrow(strays.join(likely, ["a", "b"], "left_anti"))
    if apart.head(1):
        first = materialise_narrow(components(_stars(first).unionAll(materialise_narrow(verify(apart, items, b)))))
        placed = _placed(buckets, first)
    # Second round: what is still divided in a bucket. Blocks are counted by members and their shingles.
    weighed = placed.join(one.select("id", "n", "keys"), "id").withColumn("w", F.lit(1) + F.floor(F.col("n") / WEIGHT))
    size = F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(MOST_ROWS), F.ceil(F.col("m") / BLOCKS)))
    divided = weighed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("w").alias("w")).where("lo != hi AND m > 2")
    divided = materialise_narrow(divided.select("key", F.ceil(F.col("w") / size).cast("int").alias("blocks")))
    if divided.head(1):
        rest = materialise(weighed.join(if_small(divided), "key").select("key", "pivot", "id", "comp", "keys", "blocks"))
        small_batches(items.sparkSession)
        full = _full_sets(items.join(if_small(materialise_narrow(rest.select("id").distinct())), "id", "left_semi"), b)
        small_batches(items.sparkSession, 64)
        rest = rest.join(full, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "comp", "pivot", "keys", "full")
        copies = copies.unionAll(materialise_narrow(_compare_blocks(rest, b)))
    return sig.select("id", "n"), components(_stars(first).unionAll(copies))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", b: Banding = DOCUMENTS) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) of every document; kept: it is its component's smallest id."""
    items = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    every, linked = near_components(items, b)
    found = every.join(linked, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", b: Banding = DOCUMENTS) -> DataFrame:
    """The documents of which each component keeps its smallest id; rows that repeat a kept id stay."""
    gone = near_duplicates(docs, id_col, text_col, b).where("NOT kept").select(id_col).distinct()
    return docs.join(if_small(materialise_narrow(gone)), id_col, "left_anti").select(docs.columns)
