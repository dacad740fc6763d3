"""What the operators of this package share: batches, shared storage, size-checked joins, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package

#: Rows that Spark hands to a Python worker at once; with texts of some KB a batch stays at a few MB.
BATCH_ROWS = 256
#: Bytes of text that the numpy kernels take at once (a longer text is taken alone).
SLICE_BYTES = 1 << 20
#: A side of at most this many narrow rows (ids or hashes, under 64 bytes each) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 400_000
#: Narrow rows that a task reads at least, of tables that have more than LEAST_PARTS partitions.
TASK_ROWS, LEAST_PARTS = 4096, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Readies a session for Python stages: workers can import this package, and Arrow batches (so, a worker's memory) are bounded."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df is computed once and kept in the shared folder, where a lost executor takes nothing with it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_for(rows: int) -> int:
    """Partitions for so many narrow rows."""
    return max(LEAST_PARTS, -(-rows // TASK_ROWS))


def materialise_narrow(df: DataFrame) -> DataFrame:
    """As materialise, for rows of a few numbers: however many partitions made them, few rows are read by few tasks.

    Each task that reads them and deals them on leaves files for its output, which for few rows are most of the disk.
    """
    seen = Observation()
    kept = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return kept.coalesce(parts_for(seen.get["rows"]))


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes what new_folder named, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (narrow, already materialised) with a broadcast hint if it is counted to be small; otherwise as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one with underscores behind it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo:
    """What a worker remembers of keys: two generations of at most `most` each, so that what recurs stays and memory is bounded."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """Those of the keys (which young lacks) that old lacks too; what old has is young again."""
        old, young = self.old, self.young
        out = []
        for k in keys:
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                young[k] = v
        return out

    def age(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


def row_slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes each, or of one row."""
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        before = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, before + most, "right"))
        to = max(to, at + 1)
        yield at, to
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (nulls: empty) and the n + 1 offsets of its rows in them."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


# --- hashing of words ------------------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[255] = 0
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), SLICE_BYTES + 1)
        for k, base in enumerate((_ODD, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def space_table() -> np.ndarray:
    """Byte to byte: A-Z lower-cased; 255, which UTF-8 never holds, for space and \\x09-\\x0D, which separate words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[32, 9, 10, 11, 12, 13]] = 255
    return t


def letter_table() -> np.ndarray:
    """As space_table, but every ASCII character other than letters and digits separates words."""
    t = space_table()
    for b in range(128):
        if not chr(b).isalnum():
            t[b] = 255
    return t


def words_of(raw: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in the rows: 64-bit hash, row, first byte and the byte after the last one."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    c = lut[raw]
    inside = c != 255
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside
    ends[:-1] &= (c[1:] == 255) | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[c] * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts])
    return h, np.searchsorted(offs, starts, "right") - 1, starts, ends


_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles_of(h: np.ndarray, row: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of a row, and the n_rows + 1 bounds of the rows in them.

    A row of fewer words, but at least one, has its whole sequence as its only shingle.
    """
    counts = np.bincount(row, minlength=n_rows)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.zeros(n_rows + 1, np.int64)
    np.cumsum(many, out=bounds[1:])
    out = np.zeros(bounds[-1], np.uint64)
    if not len(h):
        return out, bounds
    first_word = np.zeros(n_rows + 1, np.int64)
    np.cumsum(counts, out=first_word[1:])
    owner = np.repeat(np.arange(n_rows), many)
    at = np.arange(len(out)) - bounds[owner] + first_word[owner]
    take = np.minimum(counts[owner], size)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(size):
        step = _STEP[k % len(_STEP)] + np.uint64(2 * (k // len(_STEP)))
        term = padded[at + k] * step
        if k:
            term[take <= k] = 0
        out += term
    out += take.astype(np.uint64)
    return mix(out), bounds
