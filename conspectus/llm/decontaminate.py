"""Benchmark decontamination by spaced seeds.

Fixed masks of kept and ignored word positions slide over test items and training texts. The hashes of the kept words are
joined between both; around each hit the two texts are laid side by side and the longest stretch in which over 80 % of
the words agree is verified. It is a leak if at least LEAST words, or four fifths of a shorter item, agree in it, and
MIN_WORDS at least. Of an item of fewer than MIN_WORDS words every word must agree; one of fewer words than the shortest
mask has its whole sequence as its seed, as have texts so short, and leaks only where it is the whole text.
Words are runs of letters and digits (ASCII marks and white space part them), lower-cased.

The documents are scanned twice, whatever the benchmark's size: once for seeds that a filter of the benchmark's lets
through, once for the words of those texts that share a seed. The filter holds all seeds as long as they are few
(EXACT_KEYS), and otherwise a bitmap of MOST_BITS bits, which lets some others through, that the join then drops. Equal
texts are verified once. Words, items and hits meet in a stream sorted by text and item, of which a worker holds one text,
one item and one batch.

Null and empty texts and items, and those without a word, match nothing; repeated rows are reported each; rows without an
id are reported without one; of equally long stretches of a text and an item the first is told; a very long text is read
by itself. Empty tables give no rows. Only ids and texts are read, so that other columns, of any name, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, letter_table, materialise, mix, row_slices, small_batches, text_buffer, words_of

#: Kept (1) and ignored (0) positions of the seeds. Of 8 words in a row, any single one may differ.
MASKS = ("11111", "110111", "1101011", "11001011")
MIN_WORDS = 8
#: Words that must agree in the verified stretch (or four fifths of a shorter item's words).
LEAST = 13
#: Up to so many distinct seeds of the benchmark (8 bytes each) are broadcast; beyond, a bitmap of 2**MOST_BITS bits (16 MB).
EXACT_KEYS, MOST_BITS = 1_000_000, 27
_KEPT = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49) for m in MASKS]
_STEP = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LEADING = 20


def seeds_of(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of words: the hash, row and first word (counted over all rows) of every seed."""
    out = []
    for m, kept in enumerate(_KEPT):
        span = len(MASKS[m])
        n = len(h) - span + 1
        if n > 0:
            total = np.full(n, np.uint64(m + 1))
            for step, k in zip(_STEP, kept, strict=True):
                total += h[k : k + n] * step
            at = np.flatnonzero(row[:n] == row[span - 1 :])
            out.append((mix(total[at]), row[at], at))
    counts = np.bincount(row, minlength=n_rows)
    first = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < len(MASKS[0])))
    if len(few):
        total = np.full(len(few), np.uint64(len(MASKS) + 1)) + counts[few].astype(np.uint64)
        for k, step in enumerate(_STEP[:-1]):
            there = counts[few] > k
            total[there] += h[first[few][there] + k] * step
        out.append((mix(total), few, first[few]))
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def stretch(text: np.ndarray, item: np.ndarray, shift: int, hit: int) -> tuple[int, int, int] | None:
    """The stretch around the item's word `hit`, which the text has `shift` words further on: (first text word, words, agreeing words)."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    same = text[lo + shift : hi + shift] == item[lo:hi]
    at = hit - lo
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # For each end after the hit the earliest start up to it from which over four in five agree.
    ends = np.arange(at + 1, len(total))
    starts = np.searchsorted(-np.minimum.accumulate(total[: at + 1]), -total[ends], "right")
    fits = np.flatnonzero(starts <= at)
    if not len(fits):
        return None
    best = fits[(equal[ends[fits]] - equal[starts[fits]]).argmax()]
    start, to = int(starts[best]), int(ends[best])
    start, to = start + int(same[start:to].argmax()), to - int(same[start:to][::-1].argmax())
    agree = int(equal[to] - equal[start])
    if len(item) < len(MASKS[0]) and len(text) != len(item):
        return None
    if agree < (len(item) if len(item) < MIN_WORDS else max(MIN_WORDS, min(LEAST, -(-4 * len(item) // 5)))):
        return None
    return lo + shift + start, to - start, agree


class Filter:
    """The benchmark's seeds: those of a batch that may be among them."""

    def __init__(self, keys: np.ndarray | None, bitmap: np.ndarray, bits: int) -> None:
        self.keys, self.bitmap, self.bits = keys, bitmap, bits

    @classmethod
    def of(cls, seeds: DataFrame) -> Filter:
        """Of seeds (key); what is collected has EXACT_KEYS rows or 2**(MOST_BITS - 6) rows at most."""
        n = seeds.count()
        if n <= EXACT_KEYS:
            keys = np.unique(seeds.select("key").toArrow().column(0).to_numpy().view(np.uint64))
            bitmap = np.zeros(1 << (_LEADING - 6), np.uint64)
            place = keys >> np.uint64(64 - _LEADING)
            np.bitwise_or.at(bitmap, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            return cls(keys, bitmap, _LEADING)
        place = F.shiftrightunsigned("key", 64 - MOST_BITS)
        words = seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - MOST_BITS}) & 63 AS INT))")).alias("held")).toArrow()
        bitmap = np.zeros(1 << (MOST_BITS - 6), np.uint64)
        bitmap[words.column("word").to_numpy()] = words.column("held").to_numpy().view(np.uint64)
        return cls(None, bitmap, MOST_BITS)

    def passes(self, key: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be seeds of the benchmark."""
        place = key >> np.uint64(64 - self.bits)
        near = np.flatnonzero((self.bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
        if self.keys is None or not len(near):
            return near
        at = np.minimum(np.searchsorted(self.keys, key[near]), len(self.keys) - 1)
        return near[self.keys[at] == key[near]] if len(self.keys) else near[:0]


def _pieces(batch_text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of words, their rows) of slices of a column of texts."""
    raw, offs = text_buffer(pc.utf8_lower(batch_text))
    for i, j in row_slices(np.diff(offs)):
        h, row, _, _ = words_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], letter_table())
        yield i, j, h, row


def _with_words(rows: DataFrame, names: str) -> DataFrame:
    """Rows (..., text) with the hashes of the words in the place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[bytes] = []
            for i, j, h, row in _pieces(batch.column(batch.num_columns - 1)):
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                words += [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.binary())], [*batch.schema.names[:-1], "words"])

    return rows.mapInArrow(run, f"{names}, words binary")


def _seeds(rows: DataFrame, only: Filter | None) -> DataFrame:
    """Rows (h1, h2 or item, key, at) of the seeds of rows (h1, h2 or item, text), of all or of those that pass."""
    names = rows.columns[:-1]
    shared = rows.sparkSession.sparkContext.broadcast(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, row in _pieces(batch.column(batch.num_columns - 1)):
                key, owner, at = seeds_of(h, row, j - i)
                if shared:
                    passed = shared.value.passes(key)
                    key, owner, at = key[passed], owner[passed], at[passed]
                first = np.cumsum(np.bincount(row, minlength=j - i)) - np.bincount(row, minlength=j - i)
                take = pa.array(owner + i, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(names))), pa.array(key.view(np.int64)), pa.array(at - first[owner], pa.int64())], [*names, "key", "at"])

    return rows.mapInArrow(run, "".join(f"{n} bigint, " for n in names) + "key bigint, at bigint")


def _verified(stream: DataFrame) -> DataFrame:
    """Rows (h1, h2, item, first_word, n_words, n_same, item_words) of a stream (h1, h2, item, kind, shift, hit, words), sorted by all but the last.

    kind 0 brings a text's words, 1 an item's, 2 a hit.
    """
    names = ("h1", "h2", "item", "first_word", "n_words", "n_same", "item_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        text, item, best, pair, on, done = none, none, None, None, None, -1
        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for r, (h1, h2, of, kind, shift, hit) in enumerate(zip(*columns, strict=True)):
                if kind < 2:
                    if best:
                        found.append((*pair, *best, len(item)))
                    words = np.frombuffer(batch.column(6)[r].as_py(), np.uint64)
                    text, item = (words, none) if kind == 0 else (text, words)
                    best, pair, on, done = None, (h1, h2, of), None, -1
                    continue
                if shift != on:
                    on, done = shift, -1
                if hit < done:
                    continue  # inside the stretch that an earlier hit on this diagonal gave
                got = stretch(text, item, shift, hit)
                if got:
                    done = got[0] + got[1] - shift
                    if best is None or (-got[2], got[0]) < (-best[2], best[0]):
                        best = got
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))], list(names))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*pair, *best, len(item))], list(names))

    return stream.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _leaking(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(Rows (id, h1, h2) of the documents that share a seed, rows (h1, h2, item_id, first_word, ...) of the leaks of their texts)."""
    small_batches(docs.sparkSession)
    text = docs[text_col].cast("string")
    own = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")).where("text IS NOT NULL")
    # Items, numbered, as ids may repeat; the numbers are kept with them.
    items = benchmark.select(benchmark[item_col].cast("bigint").alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).where("text IS NOT NULL")
    items = materialise(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    seeds = materialise(_seeds(items.select("item", "text"), None))
    hits = _seeds(own.select("h1", "h2", "text"), Filter.of(seeds)).distinct().join(if_small(seeds.withColumnRenamed("at", "hit")), "key")
    hits = materialise(hits.select("h1", "h2", "item", (F.col("at") - F.col("hit")).alias("shift"), "hit").distinct())
    texts = materialise(hits.select("h1", "h2").distinct())
    held = materialise(_with_words(own.join(if_small(texts), ["h1", "h2"], "left_semi").select("id", "h1", "h2", "text"), f"id {docs.schema[id_col].dataType.simpleString()}, h1 bigint, h2 bigint"))
    nothing = F.lit(None).cast("binary")
    at_text = held.groupBy("h1", "h2").agg(F.first("words").alias("words")).select("h1", "h2", F.lit(-1).cast("bigint").alias("item"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("shift"), F.lit(0).cast("bigint").alias("hit"), "words")
    of_item = _with_words(items.select("item", "text"), "item bigint")
    at_item = hits.select("h1", "h2", "item").distinct().join(of_item, "item").select("h1", "h2", "item", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("shift"), F.lit(0).cast("bigint").alias("hit"), "words")
    at_hit = hits.select("h1", "h2", "item", F.lit(2).alias("kind"), "shift", "hit", nothing.alias("words"))
    stream = at_text.unionByName(at_item).unionByName(at_hit).repartition("h1", "h2").sortWithinPartitions("h1", "h2", "item", "kind", "shift", "hit")
    found = materialise(_verified(stream)).join(if_small(items.select("item", "item_id")), "item").drop("item")
    return held.select("id", "h1", "h2"), found


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each pair of a document and a benchmark item that it holds: where, how many words, how many agree."""
    rows, found = _leaking(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return rows.join(found, ["h1", "h2"]).select(F.col("id").alias(id_col), "item_id", "first_word", "n_words", "n_same", "item_words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: str) -> DataFrame:
    """The documents whose text holds no benchmark item; a row is judged by its own text, whatever rows share its id, or lack one."""
    how = {"item_col": "item_id", "item_text_col": "text"} | how
    _, found = _leaking(docs, benchmark, id_col, text_col, **how)
    leaks = if_small(materialise(found.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()))
    text = docs[text_col].cast("string")
    return docs.join(leaks, (F.xxhash64(text) == leaks["_h1"]) & (F.xxhash64(F.lit(1), text) == leaks["_h2"]), "left_anti")
