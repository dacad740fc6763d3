"""What each of five quality filters removes under every order in which they could be applied: a direct relational replay.

The documents' flags are crossed with the 120 orders (a broadcast table of fixed size), each pair is exploded into five
steps, the first failure along the order is computed, and the steps are counted conditionally with partial sums on the map
side, so that what is shuffled is at most 600 rows for each part and task, however many documents there are.

The filters: A, under 100 words; B, 100 * distinct words < 80 * words; C, 100 * capitals > 10 * code points; D, one of #$%&*|;
E, the text of a smaller id. Words are maximal runs of other characters than space and \\x09-\\x0D, case-sensitive.

Null texts are empty ones, which fail A and, but for the smallest id among them, E. Rows that repeat an id are documents of
their own, neither smaller than the other; rows without an id have no smaller one and fail E never. A null part is the
empty string. Labels that repeat an id count once, the larger value; labels without an id, and null values, count nothing.
An empty table has no part, and so no row. Texts are taken whole; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise

FILTERS = "ABCDE"
#: Documents whose 600 steps each are replayed by one task; the flags of so many are under 2 MB.
DOCUMENTS_A_TASK = 20_000
SPACES = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column) -> dict[str, Column]:
    """The conditions that a text fails by itself, by the filter's letter."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {"A": n < 100, "B": F.lit(100) * distinct < F.lit(80) * n, "C": F.lit(100) * capitals > F.lit(10) * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (id, part, A, B, C, D, E boolean, good, toxic int) of every document."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = own_failures(F.col("text"))
    read = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # Kept once: the whole texts are read, split and hashed a single time, and only this narrow table is joined.
    narrow = materialise(read.select("id", "part", *[own[k].alias(k) for k in own], F.sha2("text", 256).alias("digest")))
    shared = narrow.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("top")).where("least < top").select("digest", "least")
    # A text that very many documents hold is one row here; the join is broadcast when few are shared, and split by adaptive execution otherwise.
    known = narrow.join(if_small(materialise(shared)), "digest", "left").withColumn("E", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    judged = labels.select(labels["doc_id"].cast("bigint").alias("id"), *[(F.coalesce(labels[c], F.lit(0)) == 1).cast("int").alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    judged = judged.where("id IS NOT NULL AND (good = 1 OR toxic = 1)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    return known.join(judged, "id", "left").select("id", "part", *FILTERS, *[F.coalesce(k, F.lit(0)).alias(k) for k in ("good", "toxic")])


def orders(docs: DataFrame) -> DataFrame:
    """The 120 orders: filter_order, and in at_A to at_E the step of each filter in it."""
    rows = [("".join(p), *[p.index(f) + 1 for f in FILTERS]) for p in permutations(FILTERS)]
    return docs.sparkSession.createDataFrame(rows, "filter_order string, " + ", ".join(f"at_{f} int" for f in FILTERS))


def replay(flagged: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of flags()."""
    flagged = materialise(flagged.drop("id"))
    tasks = max(flagged.sparkSession.sparkContext.defaultParallelism, -(-flagged.count() // DOCUMENTS_A_TASK))
    never = len(FILTERS) + 1
    first = F.least(*[F.when(F.col(f), F.col(f"at_{f}")).otherwise(never) for f in FILTERS])
    crossed = flagged.repartition(tasks).crossJoin(F.broadcast(orders(flagged)))
    steps = crossed.withColumn("first", first).withColumn("fails", sum(F.col(f).cast("int") for f in FILTERS)).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, never)])))
    fails = F.lit(False)
    for f in FILTERS:
        fails = fails | (F.col(f) & (F.col(f"at_{f}") == F.col("step")))
    steps = steps.select("part", "filter_order", "step", "good", "toxic", "first", "fails", fails.alias("here"))
    count = lambda c: F.sum(c.cast("bigint"))
    removed = F.col("first") == F.col("step")
    out = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(removed).alias("removed"),
        count(F.col("here") & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("here") & (F.col("fails") == 1)).alias("unique_fails"),
        count(removed & (F.col("good") == 1)).alias("good_lost"),
        count(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    # 600 rows a part from here on.
    out = materialise(out.withColumn("filter", F.expr("substr(filter_order, step, 1)")))
    share = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay over documents (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    return replay(flags(docs, labels))


def oracle() -> str:
    """The same in SQL."""
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    position = " ".join(f"WHEN bits & {b} <> 0 AND step = strpos(filter_order, '{f}') THEN true" for f, b in bits.items())
    first = ", ".join(f"CASE WHEN bits & {b} <> 0 THEN strpos(filter_order, '{f}') ELSE 6 END" for f, b in bits.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT text, min(doc_id) AS least FROM t GROUP BY 1),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w.w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w.w)) < 80 * len(w.w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(w.doc_id > l.least, false) THEN 16 ELSE 0 END AS bits
  FROM w JOIN l ON l.text = w.text LEFT JOIN g ON g.doc_id = w.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
r AS (SELECT part, filter_order, step, good, toxic, bits, least({first}) AS first, CASE {position} ELSE false END AS here FROM f, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
s AS (SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (here AND first < step) AS redundant,
  count(*) FILTER (here AND bits IN (1, 2, 4, 8, 16)) AS unique_fails, count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost FROM r GROUP BY 1, 2, 3)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM s"""
