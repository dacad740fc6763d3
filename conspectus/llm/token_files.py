"""Token-id output: texts to ids of a public tokenizer, written as Simple-8b segments in ascending order of the id column.

A file is a Parquet file whose rows are segments, so that Spark's committer writes it to any store and a lost executor
leaves no half file. A segment holds whole documents: a header, their ids and lengths, the block offsets, the words.
Each distinct piece between spaces is encoded by the tokenizers library once per worker, as white space always cuts.
Null and empty texts have the end id only; rows that repeat an id stand side by side, those without an id come first; a
very long text is encoded by itself and is a segment of its own. An empty table gives files without rows. Only the id and
the text column are read, so other columns, of any name, change nothing.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .bpe import byte_characters
from .common import Memo, new_folder, row_slices, small_batches
from .tokenizers_files import vocabulary

NAME = "word_bpe_49k.json"
END_ID = 1
MAGIC = 0x31423853
#: Ids after which a segment is closed (a longer document stands alone).
SEGMENT_IDS = 1 << 18
#: Bytes of text for a part, about.
PART_BYTES = 64 << 20
#: Distinct pieces (and pre-tokens) of a generation of what a worker remembers.
KEPT = 500_000

_FIELDS = "part int, seq int, n_docs int, n_ids bigint, start_in_part bigint, payload binary"


#: Stands between the ids of pieces: no four bytes of ids under 2**24 are these.
PIECE_END = b"\xff\xff\xff\xff"
#: Fixed value: how a vocabulary file says that white space parts words, case and composition are folded first, and no space is added.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splitting(settings: dict) -> str | None:
    """The pattern of pre-tokens, if the settings of a vocabulary file are those that Pieces knows how to take apart."""
    before = settings.get("pre_tokenizer") or {}
    first, *others = before.get("pretokenizers") or [{}]
    if settings.get("normalizer") != FOLDING or settings.get("post_processor") or others != [BYTES]:
        return None
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or settings["model"]["type"] != "BPE" or settings["model"].get("dropout"):
        return None
    return first["pattern"].get("Regex")


def _latin(text: str) -> bool:
    """Whether all characters of a lower-cased text are of Latin-1; those few that come from outside it are folded to the same letters by the library."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pieces:
    """Encodes texts by pieces between spaces and line ends, which no token spans.

    Each distinct piece is looked up once for a batch. A new one of printable Latin-1 characters, which lower-casing and
    normalisation treat one by one, is cut by the vocabulary's own pattern, and its pre-tokens, which recur more often
    than pieces do, go straight to the library's model; any other piece goes through the whole tokenizer. So does a whole
    text that holds an added token's string, in any case, as the library looks for those before all else, and every text
    where the vocabulary's settings are not those of `splitting`.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            pattern = splitting(json.load(f))
        known = pattern and self.whole.get_vocab_size() < 1 << 24
        self.split = regex.compile(f"{pattern}| ") if known else None
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.to_chars = dict(enumerate(byte_characters()))
        self.known, self.words = Memo(kept), Memo(kept)

    def _ids(self, w: str) -> bytes:
        chars = w if w.isalpha() and w.isascii() else w.encode().decode("latin-1").translate(self.to_chars)
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.model.tokenize(chars)]) else b""

    def _learn(self, pieces: list[str]) -> None:
        plain, line = pieces, " ".join(pieces)
        if not (line.isprintable() and _latin(line)):
            plain = [p for p in pieces if p.isprintable() and _latin(p)]
            odd = list(set(pieces).difference(plain))
            self.known.young.update(zip(odd, self._library(odd), strict=True))
            line = " ".join(plain)
        if not plain:
            return
        # All at once: pre-tokens, with a space and its mark where a piece ends.
        words, pre = self.words.young, self.split.findall(line.lower())
        for w in self.words.missing([w for w in set(pre) if w not in words]):
            words[w] = PIECE_END if w == " " else self._ids(w)
        self.known.young.update(zip(plain, b"".join([words[w] for w in pre]).split(PIECE_END), strict=True))
        self.words.age()

    def _library(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the whole tokenizer."""
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        lines, apart = [], []
        for k, text in enumerate(texts):
            folded = text.lower()
            if self.split is None or any(t in folded for t in self.added):
                apart.append(k)
                lines.append("")
            else:
                lines.append((folded if _latin(folded) else text).replace("\n", " "))
        pieces = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        known = self.known.young
        found = list(map(known.get, distinct))
        if None in found:
            self._learn(self.known.missing([p for p, ids in zip(distinct, found, strict=True) if ids is None]))
            found = list(map(known.get, distinct))
            self.known.age()
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)[pieces.offsets.to_numpy()]
        data = memoryview(ids.buffers()[2]) if ids.buffers()[2] is not None else b""
        out = [bytes(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k, x in zip(apart, self._library([texts[k] for k in apart]), strict=True):
            out[k] = x
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One for a worker process, whose tasks follow each other: what it remembers serves them all."""
    return Pieces(path)


def pack(keys: list[int | None], ids: list[bytes]) -> tuple[bytes, int]:
    """A segment of documents, and its number of ids."""
    lengths = np.array([len(x) // 4 for x in ids], np.uint32)
    values = np.frombuffer(b"".join(ids), "<u4")
    words, offsets = simple8b.encode(values)
    head = np.array([MAGIC, len(keys), len(values), len(offsets), len(words)], "<u8")
    null = np.array([k is None for k in keys], np.uint8)
    own = np.array([k or 0 for k in keys], "<i8")
    return b"".join([head.tobytes(), own.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()]), len(values)


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a segment."""
    magic, n_docs, n_ids, n_blocks, n_words = (int(x) for x in np.frombuffer(payload, "<u8", 5))
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = 40

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(payload, kind, n, at)
        at += x.nbytes
        return x

    keys, null, lengths, offsets, words = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("<u4", n_blocks), take("<u8", n_words)
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], lengths.astype(np.int64), simple8b.decode(words, offsets, n_ids)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_folder: str | None = None, name: str = NAME, end_id: int = END_ID) -> None:
    """Writes the documents' ids to `folder`. One shuffle: texts are dealt by ranges of the (integer) id and sorted in them.

    The number of ranges follows the bytes of all texts; ranges are of ids and hashes of texts, so that an id that very
    many rows repeat, or null, is dealt to several (exact copies of a row stay together).
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary(name, vocabulary_folder)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seq, start = pieces_of(path), TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, start, size
            payload, n = pack(keys, held)
            row = part, seq, len(keys), n, start, payload
            seq, start, size = seq + 1, start + n, 0
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_ids", "start_in_part", "payload"])

        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            sizes = np.array([len(x) for x in texts])
            for a, b in row_slices(sizes):
                for key, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), pieces.encode_batch(texts[a:b]), strict=True):
                    keys.append(key)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield segment()
        if keys:
            yield segment()

    own = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = F.col("id"), F.xxhash64("text")
    own.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _FIELDS).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32[, ids array<bigint>]) from the files that write_tokens left in `folder`.

    start counts the ids of all documents before: those of earlier parts (a sum over one row per part) and, from the
    segment itself, those before it in its own part.
    """
    small_batches(spark, 8)
    files = spark.read.schema(_FIELDS).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, lengths, ids = unpack(payload.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                each = [ids[b - n : b] for n, b in zip(lengths, ends, strict=True)]
                columns = {"id": pa.array(keys, pa.int64()), "start": pa.array(start + ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    placed = files.join(F.broadcast(before), "part").select((F.col("before") + F.col("start_in_part")).alias("start"), "payload")
    return placed.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """Writes the ids to a new folder in the shared one and reads them back: rows (id, start, n_tokens, ids_crc32)."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, id_col, text_col, **how)
    return read_tokens(docs.sparkSession, folder).withColumnRenamed("id", id_col)
