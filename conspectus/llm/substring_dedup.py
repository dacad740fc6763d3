"""Substring deduplication: paragraph windows that repeat across documents are found by MinHash bands, verified and cut.

Every run of WORDS words of a text is a paragraph (they overlap). Paragraphs of the Jaccard index 0.8 or more, whose
changes are in place, have a run of SEED equal words, so a paragraph's bands are the minima of BAND-word shingles over
each run of SEED words in it, and such paragraphs always meet, wherever they stand in their lines. Neighbouring runs
mostly share their minimum, which is written once: a dozen rows for a hundred words. In a bucket of up to FEW occurrences
each is joined to all others; in a larger one to the first (smallest document, then position), and all words around its
occurrences are joined by the hashes of their exact paragraphs. Keys that then still have occurrences in no passage are
refined: each occurrence meets those that share, besides the key, a shingle that an equal run beyond an edit could begin or end
with and that the key's first holder lacks there, by the same rule of FEW or the first. Occurrences of two documents are
verified together on the full word sequences, a holder's words going once to each CHUNK of documents: runs of equal words
are followed across gaps of at most GAP words on
either side, so over inserted and deleted words too, and of each chain the longest stretches count whose shingles have
the Jaccard index 0.8 or more, of WORDS words at least, from their first to their last SHINGLE equal words. Documents
that share one form components.
Null and empty texts, and those of fewer than WORDS words, hold nothing; passages that a document repeats only within
itself stay; rows that repeat an id count as one document's, and a passage is cut from those of them that hold it; rows
without an id stay as they are. Of equal passages that in the smallest document, and there the first, is kept. Very long
texts are taken by themselves, in parts; an empty table gives no rows. Other columns, of any name, pass through a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, if_small, materialise, materialise_narrow, mix, row_slices, shingles_of, small_batches, space_table, text_buffer, words_of
from .components import components

WORDS = 50
SHINGLE = 5
GAP = 3
#: Up to so many occurrences of a key are all compared with each other.
FEW = 8
#: Words of equal runs that every pair of paragraphs at AT / OF has at least: 41 of 51 shingles are equal, one place differs, and the longer side of it has 21 shingles.
SEED = 25
AT, OF = 80, 100
#: Words of a band's shingle.
BAND = 10
#: Shingles of a text whose places are told apart by the low bits of their hashes; longer texts are taken in overlapping parts.
PART = 1 << 22
#: Keys, of eight bytes each, of first holders that are broadcast at most.
FIRST_ROWS = 1_000_000
#: Documents that are compared with one holder's words in one go.
CHUNK = 64
#: Words of a diagonal that are compared at once around a place where two documents meet.
CELL = 512


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, in about log2(width) passes."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def bands_of(raw: np.ndarray, offs: np.ndarray, words: int = WORDS, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of SEED words in rows of `words` words or more, each distinct minimum once: key, row, first word of the minimum's run."""
    n = len(offs) - 1
    h, row, _, _ = words_of(raw, offs, space_table())
    h, row = (x[(np.bincount(row, minlength=n) >= words)[row]] for x in (h, row)) if len(h) else (h, row)
    width = SEED - BAND + 1
    x, bounds = shingles_of(h, row, n, BAND)
    none = np.zeros(0, np.int64)
    if len(x) < width:
        return none, none, none
    owner = np.repeat(np.arange(n), np.diff(bounds))
    low = np.uint64(2 * part - 1)
    found = []
    for start in range(0, len(x) - width + 1, part):
        some, of = x[start : start + part + width - 1], owner[start : start + part + width - 1]
        first = (_sliding_min((mix(some ^ np.uint64(0x243F6A8885A308D3)) & ~low) | np.arange(len(some), dtype=np.uint64), width) & low).astype(np.int64)
        found.append(start + first[of[: len(first)] == of[width - 1 :]])
    at = np.unique(np.concatenate(found))
    key, row, place = mix(x[at]).view(np.int64), owner[at], at - bounds[:-1][owner[at]]
    # Where a text repeats a phrase of fewer than BAND words over and over, the first and the last place will do.
    order = np.lexsort((place, key, row))
    key, row, place = key[order], row[order], place[order]
    near = (key[1:] == key[:-1]) & (row[1:] == row[:-1]) & (place[1:] - place[:-1] < BAND)
    ends = np.ones(len(key), bool)
    ends[1:-1] = ~(near[:-1] & near[1:])
    return key[ends], row[ends], place[ends]


class Nodes:
    """Places in documents as one number: the id, shifted by as many bits as the longest text's places need, and the place.

    The number is a bigint where all ids have room beside that, and a decimal of 38 digits otherwise.
    """

    def __init__(self, items: DataFrame) -> None:
        lo, hi, size = items.agg(F.min("id"), F.max("id"), F.max(F.octet_length("text"))).first()
        self.bits = max(16, (size or 0).bit_length())
        self.wide = lo is not None and max(abs(lo), abs(hi)).bit_length() + self.bits > 62
        self.kind = "decimal(38,0)" if self.wide else "bigint"

    def _many(self) -> Column:
        return F.lit(str(1 << self.bits)).cast(self.kind)

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows (key, id, at) as (key, node)."""
        return rows.select("key", (F.col("id").cast(self.kind) * self._many() + F.col("at").cast(self.kind)).cast(self.kind).alias("node"))

    def at(self, c: str) -> Column:
        return F.pmod(F.col(c), self._many()).cast("bigint") if self.wide else F.col(c).bitwiseAND(F.lit((1 << self.bits) - 1))

    def id(self, c: str) -> Column:
        if not self.wide:
            return F.shiftright(c, self.bits)
        many = f"{1 << self.bits}BD"  # what is divided is a multiple of it, so that the quotient is exact
        return F.expr(f"CAST(({c} - pmod({c}, {many})) div {many} AS BIGINT)")


def _bands(items: DataFrame) -> DataFrame:
    """Rows (key, id, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for i, j in row_slices(np.diff(offs)):
                key, row, at = bands_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column(0).take(pa.array(row + i, pa.int64())), pa.array(at, pa.int64())], ["key", "id", "at"])

    return items.mapInArrow(run, "key bigint, id bigint, at bigint")


def paragraphs_of(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of `words` words, by runs of powers of two."""
    size = 1
    while size * 2 <= words:
        h = mix(h[:-size] + mix(h[size:] + np.uint64(size)))
        size *= 2
    rest = words - size
    return mix(h[: len(h) - rest] + mix(h[rest:] + np.uint64(words))) if rest else h


def _paragraphs(items: DataFrame, around: DataFrame) -> DataFrame:
    """Rows (key, id, at) of the exact paragraphs of items (id, text) that hold the first word of a shingle of around (id, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for i, j in row_slices(np.diff(offs)):
                h, row, _, _ = words_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], space_table())
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                found = []
                for k in range(i, j):
                    own = h[ends[k - i] : ends[k - i + 1]]
                    if len(own) < WORDS:
                        continue
                    near = np.zeros(len(own) + 1, np.int64)
                    places = batch.column(2)[k].values.to_numpy()
                    np.add.at(near, np.maximum(places - WORDS + 1, 0), 1)
                    np.add.at(near, places + 1, -1)
                    at = np.flatnonzero(np.cumsum(near)[: len(own) - WORDS + 1])
                    found.append((paragraphs_of(own)[at].view(np.int64), np.full(len(at), batch.column(0)[k].as_py(), np.int64), at))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["key", "id", "at"])

    return items.join(around, "id").select("id", "text", "places").mapInArrow(run, "key bigint, id bigint, at bigint")


#: Where, from the place of a key, shingles may stand that end the equal run before, or begin the one behind, the equal run that
#: holds the key: it is the key of that run's first, or of its last, SEED words.
BESIDE = np.concatenate([np.arange(BAND - SEED - GAP - SHINGLE, 1 - SHINGLE), np.arange(BAND, SEED + GAP + 1)])


def _refined(items: DataFrame, around: DataFrame, most: int = 4096) -> DataFrame:
    """Rows (key, id, at) of items (id, text): the keys of around (id, places: at, key), each with each shingle beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for k in range(batch.num_rows):
                h, row, _, _ = words_of(raw[offs[k] : offs[k + 1]], np.array([0, offs[k + 1] - offs[k]]), space_table())
                x, _ = shingles_of(h, row, 1, SHINGLE)
                places = batch.column(2)[k].values
                ats, keys = places.field(0).to_numpy(), places.field(1).to_numpy()
                for i in range(0, len(ats), most):
                    at, key = ats[i : i + most, None], keys[i : i + most, None].view(np.uint64)
                    beside = at + BESIDE
                    ok = (beside >= 0) & (beside < len(x))
                    new = mix(key + mix(x[np.where(ok, beside, 0)])) if len(x) else np.zeros(ok.shape, np.uint64)
                    order = np.argsort(np.where(ok, new, 0), axis=1, kind="stable")  # a shingle that stands beside a place twice counts once
                    new, ok = np.take_along_axis(new, order, axis=1), np.take_along_axis(ok, order, axis=1)
                    ok[:, 1:] &= ~ok[:, :-1] | (new[:, 1:] != new[:, :-1])
                    at = np.broadcast_to(at, ok.shape)[ok]
                    new = new[ok].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(np.full(len(new), batch.column(0)[k].as_py(), np.int64)), pa.array(at, pa.int64())], ["key", "id", "at"])

    # Only the texts that hold such places are shuffled.
    held = items.join(if_small(around.select("id")), "id", "left_semi").join(around, "id")
    return held.select("id", "text", "places").mapInArrow(run, "key bigint, id bigint, at bigint")


def digest(words: np.ndarray) -> int:
    """Of a run of words' hashes, in order."""
    at = np.arange(1, len(words) + 1, dtype=np.uint64) << np.uint64(32)
    return int(mix(words.astype(np.uint64) + at).sum(dtype=np.uint64).view(np.int64))


def _word_hashes(items: DataFrame) -> DataFrame:
    """Rows (id, words): 32-bit hashes of all words, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for i, j in row_slices(np.diff(offs)):
                h, row, _, _ = words_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], space_table())
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                h = (h >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "words"])

    return items.mapInArrow(run, "id bigint, words binary")


def _jaccard_reached(a: np.ndarray, b: np.ndarray) -> bool:
    def grams(w: np.ndarray) -> np.ndarray:
        n = len(w) - SHINGLE + 1
        x = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            x = mix(x + w[k : k + n].astype(np.uint64) + np.uint64(k + 1))
        return np.unique(x)

    x, y = grams(a), grams(b)
    both = np.sort(np.concatenate([x, y]))
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return OF * same >= AT * (len(both) - same)


def _reach(a: np.ndarray, b: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, start in b) of equal words that follow each other from (i, j) on, with gaps of at most GAP words on either side."""
    out = []
    span = GAP + SHINGLE
    while True:
        x, y = a[i : i + span], b[j : j + span]
        if len(x) < SHINGLE or len(y) < SHINGLE:
            return out
        same = x[:, None] == y[None, :]
        n, m = len(x) - SHINGLE + 1, len(y) - SHINGLE + 1
        run = same[:n, :m].copy()
        for k in range(1, SHINGLE):
            run &= same[k : k + n, k : k + m]
        di, dj = np.nonzero(run)
        if not len(di):
            return out
        k = int(np.lexsort((np.abs(di - dj), di + dj))[0])
        i, j = i + int(di[k]), j + int(dj[k])
        n = _equal(a, b, i, j)
        out.append((i, i + n, j))
        i, j = i + n, j + n


def _equal(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Number of equal words from (i, j) on."""
    n, size = 0, 64
    while True:
        x, y = a[i + n : i + n + size], b[j + n : j + n + size]
        k = min(len(x), len(y))
        other = x[:k] != y[:k]
        if other.any():
            return n + int(other.argmax())
        n += k
        if k < size:
            return n
        size *= 2


def _stretches(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], words: int) -> list[tuple[int, int, int]]:
    """The longest stretches (start, end, start in b) of a chain of runs that reach the Jaccard index, none inside another."""
    s, e, sb = (np.array(c) for c in zip(*runs, strict=True))
    eb = sb + e - s
    if e[-1] - s[0] < words or eb[-1] - sb[0] < words:
        return []
    total = np.concatenate([[0], np.cumsum(e - s - SHINGLE + 1)])
    if len(runs) > 1 and _jaccard_reached(a[s[0] : e[-1]], b[sb[0] : eb[-1]]):
        return [(int(s[0]), int(e[-1]), int(sb[0]))]
    out, last = [], -1
    for p in range(len(runs)):
        same = total[p + 1 :] - total[p]
        own, theirs = e[p:] - s[p], eb[p:] - sb[p]
        fits = np.flatnonzero((own >= words) & (theirs >= words) & (OF * same >= AT * (own + theirs - 2 * (SHINGLE - 1) - same)))
        if len(fits) and p + fits[-1] > last:
            last = p + int(fits[-1])
            out.append((int(s[p]), int(e[last]), int(sb[p])))
    return out


def _ranges(cells: list[int]) -> Iterator[tuple[int, int]]:
    """Runs [first, last] of neighbouring numbers, in order."""
    first = last = None
    for c in sorted(cells):
        if last is None or c > last + 1:
            if last is not None:
                yield first, last
            first = c
        last = c
    if last is not None:
        yield first, last


def shared_passages(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]], words: int = WORDS) -> list[tuple[int, int, int]]:
    """Stretches [start, end) of a that b has from a third place on, found from the runs of equal words around `places`.

    A place (shift, cell) stands for CELL words of a, which b has `shift` words further left. A stretch of the Jaccard
    index AT / OF holds a run of SEED words, from which it is followed to both sides, across diagonals; of a diagonal only
    the cells are compared, and runs are followed beyond them.
    """
    found, seen = set(), set()
    by_shift: dict[int, list[int]] = {}
    for shift, cell in places:
        by_shift.setdefault(shift, []).append(cell)
    for shift, cells in sorted(by_shift.items()):
        least, most = max(0, shift), min(len(a), len(b) + shift)
        done = -1
        for first, last in _ranges(cells):
            lo, hi = max(least, first * CELL), min(most, (last + 1) * CELL + SEED)
            if hi <= lo:
                continue
            same = a[lo:hi] == b[lo - shift : hi - shift]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]]))) + lo
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if s < done:
                    continue
                if s == lo:
                    s -= _equal(a[:s][::-1], b[: s - shift][::-1], 0, 0)
                if e == hi:
                    e += _equal(a, b, e, e - shift)
                done = e
                if e - s < SEED or (s, e, s - shift) in seen:
                    continue
                back = _reach(a[:s][::-1], b[: s - shift][::-1], 0, 0)
                runs = [(s - y, s - x, s - shift - z - (y - x)) for x, y, z in reversed(back)] + [(s, e, s - shift)] + _reach(a, b, e, e - shift)
                seen.update(runs)
                found.update(_stretches(a, b, runs, words))
    return sorted(found)


def _verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Passages (id, start_word, n_words, kept_doc_id, kept_start_word, digest) of pairs (id, other, places; materialised); other's words go once to each chunk of ids."""
    spark = items.sparkSession
    small_batches(spark)
    ids = materialise_narrow(pairs.select("id").unionAll(pairs.select("other")).distinct())
    many = materialise_narrow(pairs.groupBy("other").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK))
    words = _word_hashes(items.join(if_small(ids), "id", "left_semi"))
    small_batches(spark, 64)
    dealt = pairs.join(if_small(many), "other", "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("m") / CHUNK), F.lit(1))))
    own = dealt.join(words, "id").select("other", "chunk", "id", "places", "words")
    held = dealt.select("other", "chunk").distinct().join(words.withColumnRenamed("id", "other"), "other")
    held = held.select("other", "chunk", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast(pairs.schema["places"].dataType).alias("places"), "words")
    rows = held.unionAll(own).repartition("other", "chunk").sortWithinPartitions("other", "chunk", F.col("id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first row of an id in a chunk may be one of several that repeat it; a holder's may be too, and then all of them are held.
        b: list[np.ndarray] = []
        holder = None
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                a = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint32)
                if not batch.column(2)[k].is_valid:
                    at = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                    b, holder = ([*b, a.copy()] if at == holder else [a.copy()]), at
                    continue
                places = batch.column(3)[k].values
                places = list(zip(places.field(0).to_pylist(), places.field(1).to_pylist(), strict=True))
                found += [(k, s, e - s, at, digest(a[s:e])) for x in b for s, e, at in shared_passages(a, x, places)]
            own, *others = zip(*found, strict=True) if found else ((), (), (), (), ())
            take, (start, n, at, words) = pa.array(own, pa.int64()), [pa.array(c, pa.int64()) for c in others]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(take), start, n, batch.column(0).take(take), at, words], ["id", "start_word", "n_words", "kept_doc_id", "kept_start_word", "digest"])

    passages = materialise_narrow(rows.mapInArrow(run, "id bigint, start_word bigint, n_words bigint, kept_doc_id bigint, kept_start_word bigint, digest bigint").distinct())
    small_batches(spark)
    return passages


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start_word, n_words, kept_doc_id, kept_start_word, digest): a passage of the document that an earlier document holds, and a hash of its words.

    The result is materialised.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    nodes = Nodes(items)
    meeting = lambda df: df.select(nodes.id("node").alias("id"), nodes.id("pivot").alias("other"), (nodes.at("node") - nodes.at("pivot")).alias("shift"), F.floor(nodes.at("node") / CELL).alias("cell")).where("id != other")
    held = lambda df: materialise_narrow(df.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top"), F.count("*").alias("m")).where(nodes.id("pivot") != nodes.id("top")).select("key", "pivot", "m"))
    pairs_of = lambda met: materialise(met.groupBy("id", "other").agg(F.collect_set(F.struct("shift", "cell")).alias("places")))

    def few_or_first(shared: DataFrame) -> DataFrame:
        """Of keys with few occurrences each with all before it, in all places; of others with the first."""
        some = shared.where(F.col("m").between(3, FEW)).groupBy("key").agg(F.collect_set("node").alias("nodes")).select("nodes", F.explode("nodes").alias("node"))
        every = some.select("node", F.explode(F.filter("nodes", lambda x: x < F.col("node"))).alias("pivot"))
        return meeting(shared.where(f"m = 2 OR m > {FEW}")).unionAll(meeting(every))

    keyed = nodes.of(_bands(items))
    shared = materialise_narrow(keyed.join(held(keyed), "key"))
    often = shared.where(F.col("m") > FEW).select("key", "pivot", "node", nodes.id("node").alias("id"), nodes.at("node").alias("at"))
    # Many: all words around by their exact paragraphs too; equality is transitive, so that the first holder of each will do.
    around = often.groupBy("id").agg(F.collect_set("at").alias("places"))
    exact = materialise_narrow(nodes.of(_paragraphs(items, around)))
    pairs = pairs_of(few_or_first(shared).unionAll(meeting(exact.join(held(exact), "key"))))
    passages = _verified(pairs, items)
    # What frequent keys leave: those with an occurrence, other than the first, that is in no passage yet are refined in all their occurrences.
    spans = passages.groupBy("id").agg(F.collect_set(F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end_word"))).alias("spans"))
    inside = F.exists("spans", lambda s: (F.col("at") >= s.start_word) & (F.col("at") + BAND <= s.end_word))
    left = often.join(materialise(spans), "id", "left").where((F.col("id") != nodes.id("pivot")) & ~F.coalesce(inside, F.lit(False)))
    open_keys = materialise_narrow(left.select("key").distinct())
    if open_keys.head(1):
        opened = often.join(if_small(open_keys), "key")
        by_id = lambda df: materialise(df.groupBy("id").agg(F.collect_set(F.struct("at", "key")).alias("places")))
        # What stands beside a key in its first holder is of no use: that has been compared. In copies and common lines it is nearly all.
        first = materialise_narrow(_refined(items, by_id(opened.where("node = pivot"))).select("key").distinct())
        refined = materialise_narrow(nodes.of(_refined(items, by_id(opened)).join(if_small(first, FIRST_ROWS), "key", "left_anti")))
        done = pairs.select("id", "other", F.explode("places").alias("place")).select("id", "other", "place.shift", "place.cell")
        met = few_or_first(materialise_narrow(refined.join(held(refined), "key"))).distinct()
        more = pairs_of(met.join(done, ["id", "other", "shift", "cell"], "left_anti"))
        if more.head(1):
            passages = materialise_narrow(passages.unionAll(_verified(more, items)).distinct())
    return passages.withColumnRenamed("id", id_col)


def outermost(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The passages that lie in no other one of the same document (of equal ones, that kept in the smallest document)."""
    side = Window.partitionBy(id_col).orderBy("start_word", F.desc("n_words"), "kept_doc_id", "kept_start_word")
    end = F.col("start_word") + F.col("n_words")
    before = F.max(end).over(side.rowsBetween(Window.unboundedPreceding, -1))
    return passages.withColumn("_before", before).where(F.col("_before").isNull() | (end > F.col("_before"))).drop("_before")


def passage_clusters(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The outermost passages with cluster_id, the smallest id of the documents that shared passages (all of them) connect, and n_links, the number of documents that the document is linked with."""
    pairs = materialise_narrow(passages.select(F.col(id_col).alias("a"), F.col("kept_doc_id").alias("b")).distinct())
    linked = components(pairs).select(F.col("id").alias(id_col), F.col("component").alias("cluster_id"))
    links = pairs.select(F.col("a").alias(id_col)).unionAll(pairs.select("b")).groupBy(id_col).agg(F.count("*").alias("n_links"))
    return outermost(passages, id_col).join(linked, id_col).join(links, id_col)


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with the passages' words cut out of their texts; one whose whole text goes is left out."""
    key, spans_of = fresh(docs, "cut_id"), fresh(docs, "cut_spans")
    spans = outermost(passages, id_col).groupBy(F.col(id_col).alias(key)).agg(F.sort_array(F.collect_set(F.struct("start_word", "n_words", "digest"))).alias(spans_of))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    joined = docs.join(spans, docs[id_col] == F.col(key), "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = space_table()
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), [True] * batch.num_rows
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not spans or texts[k] is None:
                    continue
                raw = texts[k].encode()
                h, _, starts, ends = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lut)
                h = (h >> np.uint64(32)).astype(np.uint32)
                out, done = [], 0
                for s in spans:
                    a, b = s["start_word"], s["start_word"] + s["n_words"]
                    if b <= len(starts) and digest(h[a:b]) == s["digest"]:
                        out.append(raw[done : max(done, starts[a])])
                        done = max(done, int(ends[b - 1]))
                out.append(raw[done:])
                texts[k] = b"".join(out).decode()
                keep[k] = bool(texts[k].strip())
            columns = [batch.column(c) for c in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
