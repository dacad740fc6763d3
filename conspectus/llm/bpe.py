"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised from the vocabulary itself.

Every token of the rank file becomes a piece of mapped characters (one per byte), scored by its negative rank, so that
sentencepiece merges in the order of the ranks; the normaliser is the identity. Texts are cut where the pattern always
cuts (between a character and white space after it); each distinct cut is pre-tokenised by the pattern and its
pre-tokens are encoded once per worker, as they recur all the time. Decoding maps ids back to bytes.
Another pattern, or a text it matches in part only, is taken match by match. Null and empty texts have no ids; repeated
rows are encoded each, and an empty table gives none; a very long text is encoded in one go, in memory a few times its
size. Only the id and the text are read, so that other columns, of any name, change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, small_batches
from .tokenizers_files import pattern, vocabulary

NAME = "byte_bpe_multi_50k.tiktoken"
#: Distinct cuts, and pre-tokens, of a generation of what a worker remembers.
KEPT = 200_000
#: Pre-tokens that sentencepiece gets in one string, with a separator between them that is in no piece.
AT_ONCE, SEPARATOR = 256, "\n"
#: Fixed value: the characters of Unicode White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern of pre-tokens that is known to cut between a character and white space after it, and to keep a word of letters whole.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Texts with this are cut by _CUTS; the others have spaces and line ends only.
_OTHER = re.compile(f"[{WHITE.replace(' ', '')}]".replace("\t-\r", "\t\x0b-\r"))


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(prints) else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [found[k] for k in range(len(found))]


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    head = varint(number << 3 | kind)
    if kind == 2:
        return head + varint(len(value)) + value
    return head + (varint(value) if kind == 0 else value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """The protocol buffer of a sentencepiece BPE model; piece 0 is the unknown one, piece k + 1 the token of rank k."""
    chars = byte_characters()
    piece = lambda text, score, kind: _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, kind))
    out = [piece("<unk>", 0.0, 2)]
    out += [piece("".join(chars[b] for b in t), -float(k), 1) for k, t in enumerate(tokens)]
    trainer = _field(3, 0, 2) + _field(4, 0, len(tokens) + 1) + _field(40, 0, 0) + b"".join(_field(k, 0, (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, 2, b"identity") + b"".join(_field(k, 0, 0) for k in (3, 4, 5))
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class Coder:
    """Encodes texts to decimal ids and decodes them."""

    def __init__(self, ranks: str, split: str, kept: int = KEPT) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.split = regex.compile(split)
        self.cuts = split == SPLIT  # whether what is known of this pattern may be used
        self.to_chars = dict(enumerate(byte_characters())) | {255: SEPARATOR}  # UTF-8 has no byte 255
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known, self.words = Memo(kept), Memo(kept)

    def _pre_tokens(self, cut: str) -> list[str]:
        """What the pattern makes of a cut; at once where it is a word with at most one space before it and one of ".," after it."""
        end = len(cut) - (cut[-1] in ".,")
        if cut[cut[0] == " " : end].isalpha():
            return [cut[:end], cut[end:]] if end < len(cut) else [cut]
        return self.split.findall(cut)

    def _learn(self, cuts: list[str], keys: list[str]) -> None:
        pre = [self._pre_tokens(c) for c in cuts]
        words = self.words.young
        self._words(list(dict.fromkeys(p for x in pre for p in x)))
        for key, x in zip(keys, pre, strict=True):
            self.known.young[key] = ",".join([words[p] for p in x])
        self.words.age()

    def _words(self, pre: list[str]) -> None:
        """Sees to it that the ids of pre-tokens are known."""
        words = self.words.young
        new = self.words.missing([p for p in pre if p not in words])
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            line = b"\xff".join([p.encode() for p in some]).decode("latin-1").translate(self.to_chars)
            for p, ids in zip(some, " ".join([str(k - 1) for k in self.model.encode(line)]).split(" -1 "), strict=True):
                words[p] = ids.replace(" ", ",")

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        known = self.known.young
        line = text.replace("\n", " \n")
        if not self.cuts:  # another pattern: its matches, each by itself
            pre = self.split.findall(text)
            self._words(list(dict.fromkeys(pre)))
            code = ",".join([self.words.young[p] for p in pre])
            self.words.age()
            return code
        if text and not (line[0] == " " or line[-1] == " " or "  " in line or "\n " in line or _OTHER.search(text)):
            keys = line.split(" ")  # each but the first, or one with a line end, has a space before it
            keys[0] = f"\r{keys[0]}"
            cut_of = lambda key: key[1:] if key[0] == "\r" else key if key[0] == "\n" else f" {key}"
        else:
            keys = [f"\t{c}" for c in _CUTS.findall(text)]
            cut_of = lambda key: key[1:]
        found = list(map(known.get, keys))
        if None in found:
            new = self.known.missing(list({key for key, ids in zip(keys, found, strict=True) if ids is None}))
            self._learn(list(map(cut_of, new)), new)
            found = list(map(known.get, keys))
            self.known.age()
        return ",".join(found)

    def ids(self, code: str) -> np.ndarray:
        return np.fromstring(code, np.int32, sep=",") if code else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def coder_of(ranks: str, split: str) -> Coder:
    """One for a worker process, whose tasks follow each other: what it remembers serves them all."""
    return Coder(ranks, split)


def encode_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, name: str = NAME, split: str | None = None, with_ids: bool = True) -> DataFrame:
    """Rows (id, n_tokens, [ids array<int>,] ids_sha256, decoded_sha256) of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    ranks, split = vocabulary(name, folder), split or pattern()
    of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, split)
        for batch in batches:
            n, ids, of_ids, decoded = [], [], [], []
            for text in batch.column(1):
                code = coder.encode(text.as_py() or "")
                found = coder.ids(code)
                n.append(len(found))
                if with_ids:
                    ids.append(found)
                of_ids.append(hashlib.sha256(code.encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(found)).hexdigest())
            columns = {"id": batch.column(0), "n_tokens": pa.array(n, pa.int64())} | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}) | {"ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return found.mapInArrow(run, f"id {of_id}, n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
