"""Document fingerprints: a Merkle tree over sections, paragraphs and their clauses, in DataFrame functions only.

A section ends after an empty line, a paragraph after a line end, a clause after a word with a full stop, exclamation
or question mark, or after eight words; the clauses put together are the text, to the last space. A clause's hash is the
head of its SHA-256, a parent's that of its children's hashes. A fingerprint is
    root:section{paragraph[clause,clause];paragraph[...]}|section{...}
so that equal roots mean equal texts, and differing texts are compared from the root down, into differing branches only.
The likeness of two fingerprints is the Jaccard index of their sets of clauses: 1 for two empty texts, 0 for an empty and
another one. Null texts count as empty ones; very long texts are split by one regular expression and hashed piece by piece.
Of rows that repeat an id the one of smaller hash comes first, and they are neighbours; rows that repeat id and text give
equal rows; an empty table gives none. Only the id and the text are read, so that other columns, of any name, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Where sections and paragraphs end, and what a clause is.
SECTION_END, PARAGRAPH_END = r"(?<=\n\n)(?!\n)", r"(?<=\n)"
CLAUSE = r"\s*(?:\S*[^\s.!?]\s+){0,7}\S+\s*|\s+"
#: Rows that are laid side by side in a bucket of ids, about; buckets are a few times MOST_BUCKETS at most, at any size.
BUCKET_ROWS, MOST_BUCKETS = 256, 300_000


def _head(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def tree(text: Column) -> Column:
    """Sections of paragraphs of clauses' hashes."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), SECTION_END),
        lambda s: F.transform(F.split(s, PARAGRAPH_END), lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), _head)),
    )


def leaves(t: Column) -> Column:
    """The clauses of a tree, eight hexadecimal digits each."""
    return F.transform(F.flatten(F.flatten(t)), lambda x: F.substring(x, 1, 8))


def fingerprint(t: Column) -> Column:
    """The fingerprint of a tree."""
    sections = F.transform(
        F.transform(t, lambda s: F.transform(s, lambda p: F.concat(_head(F.concat_ws(",", p)), F.lit("["), F.concat_ws(",", F.transform(p, lambda x: F.substring(x, 1, 8))), F.lit("]")))),
        lambda s: F.concat(_head(F.concat_ws(";", F.transform(s, lambda p: F.substring(p, 1, 16)))), F.lit("{"), F.concat_ws(";", s), F.lit("}")),
    )
    root = F.sha2(F.concat_ws("|", F.transform(sections, lambda s: F.substring(s, 1, 16))).cast("binary"), 256)
    return F.concat(root, F.lit(":"), F.concat_ws("|", sections))


def leaves_of(fp: Column) -> Column:
    """The clauses of a fingerprint."""
    return F.regexp_extract_all(fp, F.lit(r"(?<=[\[,])([0-9a-f]{8})(?=[,\]])"), F.lit(1))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two lists of clauses."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def differing_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: structs (section, paragraph) from 0; nothing below equal roots or equal sections is read."""
    sections = lambda fp: F.split(F.substring(fp, 66, 2**31 - 1), r"\|")
    paragraphs = lambda s: F.split(F.regexp_extract(F.coalesce(s, F.lit("")), r"\{(.*)\}", 1), ";")
    node = lambda x: F.substring(x, 1, 16)
    at = lambda x, k: F.get(x, k)
    none = F.array().cast("array<struct<section:int,paragraph:int>>")

    def of_section(k: Column) -> Column:
        x, y = at(sections(a), k), at(sections(b), k)
        both = F.transform(F.arrays_zip(paragraphs(x).alias("x"), paragraphs(y).alias("y")), lambda p, i: F.struct(F.when(~node(p["x"]).eqNullSafe(node(p["y"])), i).alias("i")))
        differ = F.filter(both, lambda p: p["i"].isNotNull())
        return F.when(node(x).eqNullSafe(node(y)), none).otherwise(F.transform(differ, lambda p: F.struct(k.cast("int").alias("section"), p["i"].cast("int").alias("paragraph"))))

    most = F.greatest(F.size(sections(a)), F.size(sections(b)))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), most - 1), of_section)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, fingerprint); no shuffle."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col], F.char_length(text).cast("bigint").alias("n_chars"), tree(text).alias("tree")).select(id_col, "n_chars", fingerprint(F.col("tree")).alias("fingerprint"))


def _start(low: str, width: str, wide: bool) -> Column:
    """The least id of the bucket of even width that holds `id`, counted from `low` on."""
    whole = (lambda x: f"CAST({x} AS DECIMAL(38,0))") if wide else (lambda x: f"CAST({x} AS BIGINT)")
    return F.expr(f"CAST({whole(low)} + (({whole('id')} - {whole(low)}) div {whole(width)}) * {whole(width)} AS BIGINT)")


def buckets(ids: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """(A function that adds `start`, the bucket, to rows with an id; rows (start, first): each bucket and its smallest id).

    Buckets are of even width at first; those that then hold many more rows than others are divided evenly again, and so
    on, so that ids may lie as they like: only the rows of one id cannot be parted. Tables of buckets are counted to be
    a few times MOST_BUCKETS rows at most, and are broadcast.
    """
    lo, hi, n = ids.agg(F.min("id"), F.max("id"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    rows = max(BUCKET_ROWS, -(-n // MOST_BUCKETS))
    wide = hi - lo >= 2**62
    even = _start(str(lo), str((hi - lo) // max(1, -(-n // rows)) + 1), wide)
    divided: list[DataFrame] = []

    def place(df: DataFrame) -> DataFrame:
        df = df.withColumn("start", even)
        for big in divided:
            df = df.join(F.broadcast(big), "start", "left").withColumn("start", F.when(F.col("low").isNull(), F.col("start")).otherwise(_start("low", "width", wide))).drop("low", "width")
        return df

    while True:
        held = place(ids).groupBy("start").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        held = materialise(held)
        big = held.where(F.col("n") > 4 * rows).where("first != last")
        if not big.head(1):
            return place, held.select("start", "first")
        spread = "CAST(last AS DECIMAL(38,0)) - CAST(first AS DECIMAL(38,0))"
        divided.append(big.select("start", F.col("first").alias("low"), F.expr(f"CAST(({spread}) div CAST(ceil(n / {rows}) AS DECIMAL(38,0)) + 1 AS BIGINT)").alias("width")))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, is_next, start, next_text) of the rows with an id; is_next marks rows that only end a bucket.

    The first row of each bucket also goes to the bucket before it (that of the first bucket to the last), marked is_next,
    so that texts are shuffled once. Of rows with the same id, that with the smaller hash of its text comes first.
    """
    own = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL")
    place, firsts = buckets(docs.select(docs[id_col].cast("bigint").alias("id")).where("id IS NOT NULL"))
    whole = Window.orderBy("start")
    last = F.max("start").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to = firsts.select(F.col("first").alias("id"), F.coalesce(F.lag("start").over(whole), last).alias("start"))
    sentinels = own.join(F.broadcast(to), "id").select("id", "text", F.lit(1).alias("is_next"), "start")
    both = place(own).select("id", "text", F.lit(0).alias("is_next"), "start").unionByName(sentinels)
    return both.withColumn("next_text", F.lead("text").over(Window.partitionBy("start").orderBy("is_next", "id", F.xxhash64("text"))))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last quarter of code points replaced by the first as many (or all) of the next
    document's in ascending order of the id. Rows without an id have no next document, as if that were empty.
    """
    apart = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).where("id IS NULL")
    apart = _printed(apart.withColumn("next_text", F.lit(None).cast("string"))).withColumn("next", F.lit(None).cast("array<string>"))
    rows = _printed(beside_next(docs, id_col, text_col), "start", "is_next", F.xxhash64("text").alias("h"))
    after = Window.partitionBy("start").orderBy("is_next", "id", "h")
    rows = rows.withColumn("next", F.lead("own").over(after)).where("is_next = 0").drop("start", "is_next", "h").unionByName(apart)
    none = F.array().cast("array<string>")
    return rows.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.coalesce("next", none)).alias("near_next"))


def _printed(rows: DataFrame, *others: Column | str) -> DataFrame:
    """Of rows (id, text, next_text, others) the fingerprints and clauses of the text and of the edited text."""
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("edited", edited)
    rows = rows.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), tree(F.col("text")).alias("tree"), tree(F.col("edited")).alias("edited_tree"), *others)
    kept = [c for c in rows.columns if c not in ("tree", "edited_tree")]
    return rows.select(*kept, fingerprint(F.col("tree")).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"), leaves(F.col("tree")).alias("own"), leaves(F.col("edited_tree")).alias("new"))
