"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of WINDOW bytes. In each window one gated unit layer reads forwards and one backwards; at
every byte a softmax over both states gives the languages' probabilities, and a document's are the mean over all bytes
of the whole text, weighted by how sure they are. Training is by backpropagation through time (Adam) on a bounded, hashed
sample of labelled rows, as many of each language, on the driver; of a long text in it pieces from all over are read. The
weights (a few KB) go to the workers. The answer is `und`, with score 0, for null texts and texts without a letter. Very
long texts are read window by window, in blocks. Predictions depend on the text alone, so repeated rows agree; among
languages of equal probability the first in the alphabet is told; rows that repeat an id and a language are one row of the
sample. Only id, text and language are read, so other columns, of any name, change nothing. An empty table gives no rows,
and without any labelled row every answer is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_slices, small_batches, text_buffer

#: Bytes of a window, at inference and in training.
WINDOW = 64
HIDDEN = 8
#: Bounds of the training sample: rows in all (chosen by a hash of their ids, as many of each language), and languages (the most frequent).
SAMPLE_ROWS, MOST_LANGUAGES = 3000, 500
#: A text in the sample of more characters than PIECES * PIECE gives so many pieces of so many characters, from hashed places all over it.
PIECES, PIECE = 16, 64
STEPS, ROWS_PER_STEP, RATE, SEED = 400, 192, 0.02, 7
UNKNOWN = "und"


@dataclass
class Network:
    """Weights by name. Gates stand in the order update, reset, candidate; d is the direction (0 forwards, 1 backwards)."""

    langs: list[str]
    hidden: int = HIDDEN
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in (0, 1):
            w[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))
            w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        w["out"] = rng.normal(0, 0.3, (len(langs), 2 * hidden))
        w["bias"] = np.zeros((len(langs), 1))
        return cls(langs, hidden, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, codes: np.ndarray, d: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, hidden, windows) of direction d over codes (time, windows), and what backpropagation needs."""
        steps, n = codes.shape
        k = self.hidden
        x, u = self.w[f"x{d}"], self.w[f"u{d}"]
        uzr, uc = u[: 2 * k], u[2 * k :]
        h = np.zeros((k, n), np.float32)
        out = np.empty((steps, k, n), np.float32)
        kept: list = [None] * steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = x.take(codes[t], axis=1)
            zr = a[: 2 * k]
            zr += uzr @ h
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[:k], zr[k:]
            c = a[2 * k :]
            rh = r * h
            c += uc @ rh
            np.tanh(c, out=c)
            if keep:
                kept[t] = (h, z, r, c, rh)
            h = h + z * (c - h)
            out[t] = h
        return out, kept

    def logits(self, forwards: np.ndarray, backwards: np.ndarray) -> np.ndarray:
        k = self.hidden
        return self.w["out"][:, :k] @ forwards + self.w["out"][:, k:] @ backwards + self.w["bias"]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, languages, windows)"""
        y = self.logits(self.states(codes, 0)[0], self.states(codes, 1)[0])
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the bytes under the mask, and its gradients by backpropagation through time."""
        k = self.hidden
        both = [self.states(codes, d, keep=True) for d in (0, 1)]
        y = self.logits(both[0][0], both[1][0])
        y -= y.max(axis=1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=1, keepdims=True)
        total = mask.sum()
        one = np.arange(len(self.langs))[:, None] == label[None, :]
        loss = float(-(np.log(np.maximum(p, 1e-9)) * one * mask[:, None, :]).sum() / total)
        dy = ((p - one) * mask[:, None, :] / total).astype(np.float32)
        g = {name: np.zeros_like(v) for name, v in self.w.items()}
        g["bias"] = dy.sum(axis=(0, 2))[:, None]
        for d in (0, 1):
            states, kept = both[d]
            g["out"][:, d * k : (d + 1) * k] = np.einsum("tln,tkn->lk", dy, states)
            dh_out = np.einsum("lk,tln->tkn", self.w["out"][:, d * k : (d + 1) * k], dy)
            u, gu, gx = self.w[f"u{d}"], g[f"u{d}"], g[f"x{d}"]
            carry = np.zeros_like(states[0])
            for t in range(len(codes) - 1, -1, -1) if d == 0 else range(len(codes)):
                h, z, r, c, rh = kept[t]
                dh = carry + dh_out[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = u[2 * k :].T @ dc
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dz, dr, dc])
                gu[: 2 * k] += da[: 2 * k] @ h.T
                gu[2 * k :] += dc @ rh.T
                for row in range(3 * k):
                    gx[row] += np.bincount(codes[t], da[row], 256)
                carry = dh * (1 - z) + drh * r + u[: 2 * k].T @ da[: 2 * k]
        return loss, g


def starts_of(offs: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First byte and row of each window. Every byte is in one window."""
    sizes = np.diff(offs)
    many = -(-sizes // width)
    row = np.repeat(np.arange(len(sizes)), many)
    return offs[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * width, row


def windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Codes (time, windows) of the windows from start on, and mask of those before end."""
    at = start[None, :] + np.arange(width)[:, None]
    inside = at < end[None, :]
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)], 32).astype(np.intp), inside


def train(texts: list[str], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Network:
    """A network for the distinct labels, fitted by Adam on random windows of the texts, each label as often as the others."""
    net = Network.fresh(sorted(set(labels)), hidden, seed)
    if len(net.langs) < 2 or not texts:
        return net
    raw, offs = text_buffer(pa.array(texts, pa.string()))
    start, row = starts_of(offs)
    if not len(row):
        return net
    codes, inside = windows(raw, start, offs[1:][row])
    which = np.array([net.langs.index(x) for x in labels])[row]
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(which == k) for k in range(len(net.langs))]
    by_label = [x for x in by_label if len(x)]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, -(-ROWS_PER_STEP // len(by_label))) for x in by_label])
        _, g = net.gradients(codes[:, pick], inside[:, pick].astype(np.float32), which[pick])
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, x in g.items():
            x = x / max(1.0, size)
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.001 * (x * x - v[k])
            net.w[k] = (net.w[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean probabilities (rows, languages) over all bytes of each row, each weighted by how far its best one is above a half.

    Bytes that tell little (marks, digits, a phrase of one text repeated without end) so don't drown those that tell much.
    """
    starts, row = starts_of(offs)
    n = len(offs) - 1
    total = np.zeros((n, len(net.langs)))
    for a in range(0, len(row), 4096):
        own = row[a : a + 4096]
        codes, inside = windows(raw, starts[a : a + 4096], offs[1:][own])
        p = net.probabilities(codes)
        sure = np.maximum(p.max(axis=1) - np.float32(0.5), np.float32(0.001)) ** 2
        np.add.at(total, own, np.einsum("tln,tn->nl", p, sure * inside))
    sums = total.sum(axis=1, keepdims=True)
    return total / np.where(sums > 0, sums, 1)


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES, **how: object) -> Network:
    """Trains on the rows of smallest hash of each language, among those with a text that are not held out.

    Rows are counted by language first, and those of larger hashes than about twice a language's share needs are left out
    before the rank; a row's pieces are cut by its executor. So one shuffle of two samples, and one sample to the driver,
    however long tables and texts are.
    """
    text = docs[text_col].cast("string")
    of_lang = docs.select(docs[id_col].cast("string").alias("id"), text.alias("text"), docs[lang_col].cast("string").alias("lang")).where(text.isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = of_lang.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return train([], [], **how)
    each = max(1, sample_rows // len(counts))
    most = [(r.lang, min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 2 * each / r.n)))) for r in counts]
    limits = F.broadcast(docs.sparkSession.createDataFrame(most, "lang string, most bigint"))
    rows = of_lang.withColumn("h", F.xxhash64("id", F.lit(SEED))).join(limits, "lang").where("h <= most")
    size = F.char_length("text")
    place = lambda i: F.pmod(F.xxhash64("h", i), size - PIECE + 1).cast("int") + 1
    pieces = F.when(size <= PIECES * PIECE, F.array("text")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.substr("text", place(i), F.lit(PIECE))))
    once = rows.select("lang", "h", pieces.alias("pieces")).groupBy("lang", "h").agg(F.min("pieces").alias("pieces"))
    first = once.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    found = first.select("lang", "h", "pieces").collect()
    found = sorted((r.h, r.lang, piece) for r in found for piece in r.pieces)
    return train([t for _, _, t in found], [x for _, x, _ in found], **how)


def told(net: Network, text: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    letter = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_pylist()
    lang, score = [], []
    raw, offs = text_buffer(text)
    if not net.langs:
        return [UNKNOWN] * len(text), [0.0] * len(text)
    for i, j in row_slices(np.diff(offs)):
        p = pooled(net, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        best = p.argmax(axis=1)
        lang += [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, letter[i:j], strict=True)]
        score += [float(min(max(x[k], 0.0), 1.0)) if ok else 0.0 for x, k, ok in zip(p, best, letter[i:j], strict=True)]
    return lang, score


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score); no shuffle."""
    small_batches(docs.sparkSession)
    of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = told(net, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return found.mapInArrow(run, f"id {of_id}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The documents whose language is told, with a score of `least` or more; each row is judged by its own text, whatever its id."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = told(net, batch.column(at).cast(pa.string()))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how: object) -> DataFrame:
    """Rows (id, held_out, lang_pred, score): fitted on the rows that are not held out, applied to every row."""
    found = identify(docs, fit(docs, id_col, text_col, lang_col, **how), id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
