"""Relational kernels: aggregation, ranking, joins and reconciliation, each as a DataFrame-to-DataFrame function."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_dir, ship_package


def adoption(df: DataFrame, by: list[str], follows: Column) -> DataFrame:
    """A1, A2: total, adoption, confidence and weight of each group (combined on the map side)."""
    out = df.groupBy(*by).agg(F.count("*").alias("total_count"), F.count_if(follows).alias("adoption_count"))
    return out.withColumn("confidence", F.round(F.col("adoption_count") / F.col("total_count"), 6)).withColumn("weight", T.weight("confidence"))


def trend_by(df: DataFrame, by: list[str], seconds: str, now: int) -> DataFrame:
    """A3: discrete 90th percentile of commit times, and the trend."""
    p90 = F.expr(f"CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY {seconds}) AS BIGINT)")
    return df.groupBy(*by).agg(p90.alias("p90")).withColumn("trend", T.trend("p90", now))


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int = 1, name: str = "rank") -> DataFrame:
    """The first `most` rows of each group in a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def diverse_sample(df: DataFrame, group: str, order: list[Column], most: int = 20) -> DataFrame:
    """Round robin over the groups: all first rows, then all second rows, and so on, up to `most`."""
    dealt = ranked(df, [group], order, most, "round")
    return dealt.orderBy("round", group).limit(most)


def pivot_counts(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Fixed columns of counts, 0 where there is none; one pass."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values])


def most_used(df: DataFrame, by: str, item: str) -> DataFrame:
    """Distinct items, the most frequent one (ties: the smallest) and the total, for each group."""
    n = df.groupBy(by, item).agg(F.count("*").alias("n"))
    best = ranked(n, [by], [F.desc("n"), F.asc(item)], 1).select(by, F.col(item).alias("most_used"), F.col("n").alias("uses"))
    return n.groupBy(by).agg(F.count("*").alias("n_items"), F.sum("n").alias("total")).join(best, by)


def with_truncation(df: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, bool]:
    """The first `most` rows and whether there are more (reads most + 1 rows to tell)."""
    some = df.orderBy(*order).limit(most + 1)
    return some.limit(most), some.count() > most


def suffix_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every path suffix and the first path (in order) that has it; no nested loop, rows grow with the depth only."""
    parts = F.split(F.col(path), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return paths.select(path, F.explode(suffixes).alias("suffix")).groupBy("suffix").agg(F.min(path).alias(path))


def suffix_join(left: DataFrame, right: DataFrame, path: str, suffix: str) -> DataFrame:
    """Rows whose path equals the suffix or ends with it at a boundary, as an equi join on exploded suffixes."""
    parts = F.split(F.col(path), "/")
    exploded = left.withColumn("_s", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
    return exploded.join(right, F.col("_s") == F.col(suffix)).drop("_s")


def first_candidate(rows: DataFrame, key: str, candidates: str, known: DataFrame, known_key: str) -> DataFrame:
    """For each row the first of its candidate names that is known, or null."""
    each = rows.select(key, F.posexplode(candidates).alias("pos", "candidate"))
    hit = each.join(known.select(F.col(known_key).alias("candidate")).distinct(), "candidate").groupBy(key).agg(F.min_by("candidate", "pos").alias("resolved"))
    return rows.join(hit, key, "left")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its scan has fewer partitions than those, for costly work on each row; a longer table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a task where work on each row is costly, and rows that are worth a task of their own.
TASK_ROWS, LEAST_ROWS = 100_000, 2_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks of at most about `rows` rows of df (cheap to count): one for each core, where there are rows for them, and more as df grows."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, -(-n // LEAST_ROWS)), -(-n // rows))


#: A side that is counted to have at most so many narrow rows is broadcast.
FEW_ROWS = 200_000


def if_few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """df, cheap to compute twice, with a broadcast hint if it is counted to be short; beyond that the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bins of a span at most, but for one at its end; see interval_overlap.
BINS = 16


def interval_overlap(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int | None = None) -> DataFrame:
    """Pairs with equal keys whose half-open spans (of whole numbers, not empty) overlap.

    Spans are cut into bins of `width` (twice the mean span, where it is not given) and joined by key and bin, so that a key
    with very many spans is dealt to many tasks; a pair counts in the bin in which its later span starts. A span of more
    than BINS bins is cut into bins of BINS times the width, and so on; shorter spans then go to their one or two wider
    bins too, where they meet longer ones alone. So a span makes some BINS rows, however long it is.
    """
    span = lambda s: F.col(s[1]) - F.col(s[0])
    mean, most = a.agg(F.avg(span(a_span)), F.max(span(a_span))).first()
    most = max(most or 1, b.agg(F.max(span(b_span))).first()[0] or 1)
    width = max(1, int(2 * (mean or 1))) if width is None else width
    top = 0
    while most > BINS * width * BINS**top:
        top += 1
    wide = lambda level: F.lit(width) * F.pow(F.lit(BINS), level).cast("bigint")
    cell = lambda c, level: F.floor(c / wide(level)).cast("bigint")

    def cut(df: DataFrame, s: tuple[str, str]) -> DataFrame:
        own = sum((span(s) > BINS * width * BINS**k).cast("int") for k in range(top)) if top else F.lit(0)
        df = df.withColumn("_own", own)
        df = df.withColumn("_level", F.explode(F.sequence("_own", F.lit(top))) if top else F.lit(0))
        return df.withColumn("_bin", F.explode(F.sequence(cell(F.col(s[0]), F.col("_level")), cell(F.col(s[1]) - 1, F.col("_level")))))

    x, y = cut(a, a_span).alias("a"), cut(b, b_span).alias("b")
    keys = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*on, "_level", "_bin"]])
    later = F.greatest(F.col(f"a.{a_span[0]}"), F.col(f"b.{b_span[0]}"))
    meet = (F.col(f"a.{a_span[0]}") < F.col(f"b.{b_span[1]}")) & (F.col(f"b.{b_span[0]}") < F.col(f"a.{a_span[1]}")) & (cell(later, F.col("a._level")) == F.col("a._bin"))
    return x.join(y, keys & meet & (F.greatest("a._own", "b._own") == F.col("a._level")))


def tree_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Added, deleted, modified and unchanged keys by a full outer join."""
    o, n = old.select(key, F.col(version).alias("old_version")), new.select(key, F.col(version).alias("new_version"))
    status = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "deleted").when(F.col("old_version") != F.col("new_version"), "modified").otherwise("unchanged")
    return o.join(n, key, "full_outer").withColumn("status", status)


#: Rows and tokens of a side that is held by every task, as a table of tokens by rows in blocks of CELLS cells at most.
HELD_ROWS, HELD_TOKENS, CELLS = 4096, 1 << 20, 1 << 26


def jaccard_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_tokens: str, b_tokens: str, least: float, held_rows: int = HELD_ROWS) -> DataFrame:
    """(a_key, b_key, common, similarity): pairs whose token sets have a Jaccard index of `least`.

    Tokens must be distinct in each row, and keys distinct in each side. A b that is counted to be short is held by all
    tasks, which count the tokens that their rows share with all of it at once, without a shuffle; a longer one is joined
    on prefixes.
    """
    rows, tokens = b.agg(F.count("*"), F.sum(F.size(b_tokens))).first()
    if rows <= held_rows and (tokens or 0) <= HELD_TOKENS:
        return _held_jaccard(a, b, a_key, b_key, a_tokens, b_tokens, least)
    return _prefix_jaccard(a, b, a_key, b_key, a_tokens, b_tokens, least)


def _held_jaccard(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_tokens: str, b_tokens: str, least: float) -> DataFrame:
    held = b.where(F.size(b_tokens) > 0).select(b_key, b_tokens).toArrow().combine_chunks()
    keys, sets = held.column(0).combine_chunks(), held.column(1).combine_chunks()
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = sets.flatten()
    vocabulary = flat.unique()
    places, owner = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    step = max(1, CELLS // max(1, len(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.index_in(lists.flatten(), value_set=vocabulary)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)[known]
            token = found.drop_null().to_numpy(zero_copy_only=False)
            starts = np.searchsorted(row, np.arange(len(n) + 1))
            for low in range(0, len(sizes), step):
                some = (owner >= low) & (owner < low + step)
                table = np.zeros((len(vocabulary), min(step, len(sizes) - low)), np.uint8)
                table[places[some], owner[some] - low] = 1
                for i in range(0, len(n), 32):
                    j = min(i + 32, len(n))
                    full = i + np.flatnonzero(starts[i + 1 : j + 1] > starts[i:j])
                    if not len(full):
                        continue
                    common = np.add.reduceat(table[token[starts[i] : starts[j]]], starts[full] - starts[i], axis=0, dtype=np.int32)
                    similarity = common / (n[full, None] + sizes[None, low : low + step] - common)
                    p, q = np.nonzero((similarity >= least) & (common > 0))
                    if len(p):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full[p])), keys.take(pa.array(q + low)), pa.array(common[p, q].astype(np.int64)), pa.array(similarity[p, q])], [a_key, b_key, "common", "similarity"])

    return a.select(a_key, a_tokens).mapInArrow(run, f"{a_key} {dict(a.dtypes)[a_key]}, {b_key} {dict(b.dtypes)[b_key]}, common bigint, similarity double")


def _prefix_jaccard(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_tokens: str, b_tokens: str, least: float) -> DataFrame:
    """The pairs of jaccard_join by a join on prefixes.

    A pair that counts shares least * n tokens of
    either set, so one at least among the n - least * n + 1 that are rarest in b: only those are joined. Tokens that b
    lacks are the rarest of all and fill a's prefixes, so that frequent words rarely meet. Sizes that cannot reach the
    index are left out before, and the pairs that meet are verified on their whole sets.
    """
    rarity = b.select(F.explode(b_tokens).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    sizes = b.where(F.size(b_tokens) > 0).agg(F.min(F.size(b_tokens)), F.max(F.size(b_tokens))).first()
    if sizes[0] is None:
        sizes = 0, 0
    may = a.where((F.size(a_tokens) * least <= sizes[1]) & (F.size(a_tokens) >= sizes[0] * least))

    def prefixes(df: DataFrame, key: str, tokens: str) -> DataFrame:
        rows = df.select(key, F.size(tokens).alias("n"), F.explode(tokens).alias("token")).join(if_few(rarity), "token")
        w = Window.partitionBy(key)
        held = rows.withColumn("held", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("df", "token")))
        return held.where(F.col("k") <= F.col("held") - F.ceil(F.col("n") * least - 1e-9) + 1).select(key, F.col("n").alias(f"n_{key}"), "token")

    x, y = prefixes(may, a_key, a_tokens), prefixes(b, b_key, b_tokens)
    near = (F.col(f"n_{a_key}") * least <= F.col(f"n_{b_key}")) & (F.col(f"n_{b_key}") * least <= F.col(f"n_{a_key}"))
    met = x.join(y, "token").where(near).select(a_key, b_key).distinct()
    own, theirs = may.select(a_key, F.col(a_tokens).alias("_a")), b.select(b_key, F.col(b_tokens).alias("_b"))
    both = met.join(theirs, b_key).join(own, a_key).withColumn("common", F.size(F.array_intersect("_a", "_b")).cast("bigint"))
    return both.withColumn("similarity", F.col("common") / (F.size("_a") + F.size("_b") - F.col("common"))).where(F.col("similarity") >= least).select(a_key, b_key, "common", "similarity")


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SK1: new rows replace those of equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest_wins(current: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """U8: incoming rows win where they are strictly newer; columns of the incumbent plus action (inserted, updated, skipped)."""
    i = incoming.select(*[F.col(c).alias(f"_{c}") if c != key else F.col(c) for c in incoming.columns]).withColumn("_in", F.lit(True))
    joined = current.withColumn("_has", F.lit(True)).join(i, key, "full_outer")
    action = F.when(F.col("_in").isNull(), "kept").when(F.col("_has").isNull(), "inserted").when(F.col(f"_{at}") > F.col(at), "updated").otherwise("skipped")
    take = F.col("action").isin("inserted", "updated")
    return joined.withColumn("action", action).select(key, *[F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns if c != key], "action")


def best_of(parts: list[DataFrame], key: list[str], score: str) -> DataFrame:
    """A union in which each key keeps its row of highest score; on ties the earlier part wins."""
    union = reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    return ranked(union, key, [F.desc(score), F.asc("_part")], 1, "_rank").drop("_rank", "_part")


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair once."""
    return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def order_breaks(df: DataFrame, by: list[str], pos: str, rank: str) -> DataFrame:
    """For each group whether its ranks never fall, and how many runs of equal ranks it has."""
    w = Window.partitionBy(*by).orderBy(pos)
    last = F.lag(rank).over(w)
    steps = df.select(*by, F.when(F.col(rank) < last, 1).otherwise(0).alias("fall"), F.when(last.isNull() | (F.col(rank) != last), 1).otherwise(0).alias("run"))
    return steps.groupBy(*by).agg((F.sum("fall") == 0).alias("ordered"), F.sum("run").alias("runs"))


def one_run(df: DataFrame, by: list[str], pos: str, hit: Column) -> DataFrame:
    """For each group with a hit, whether its hits stand in a row."""
    return df.where(hit).groupBy(*by).agg(F.count("*").alias("n"), (F.max(pos) - F.min(pos) + 1 == F.count("*")).alias("contiguous"))


def trailing_count(df: DataFrame, by: list[str], seconds: Column, width: int) -> DataFrame:
    """Rows of the same group in the trailing window, this one included.

    Time is cut into cells of the window's width; a row also goes to the next cell, where it comes in before and goes out
    when the window has passed it, so that a window needs the rows of one cell and a large group is dealt to many tasks.
    What has come in less what has gone out is one running sum, whose cost does not depend on the rows of a window.
    """
    at, cell = seconds.cast("bigint"), F.floor(F.col("_s") / F.lit(max(width, 1)))
    steps = F.array(*[F.struct((cell + k).alias("_cell"), (F.col("_s") + late).alias("_at"), F.lit(n).alias("_n"), F.lit(k == 0).alias("_own")) for k, late, n in ((0, 0, 1), (1, 0, 1), (1, width + 1, -1))])
    cut = df.withColumn("_s", at).withColumn("_step", F.explode(steps)).select(*df.columns, "_step.*")
    side = Window.partitionBy(*by, "_cell").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("trailing", F.sum("_n").over(side)).where("_own").drop("_cell", "_at", "_n", "_own")


def ordered_top(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows in a total order, with their place from 1."""
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def capped_groups(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """Of each group the first `most` rows, and whether there are more (one row more is ranked to tell)."""
    some = ranked(df, by, order, most + 1)
    return some.withColumn("truncated", F.max("rank").over(Window.partitionBy(*by)) > most).where(F.col("rank") <= most)


def trim_examples(df: DataFrame, examples: str, most: int = 1) -> DataFrame:
    """T5: a list cut to its first entries, and whether that left some out."""
    return df.withColumn("trimmed", F.size(examples) > most).withColumn(examples, F.slice(examples, 1, most))


def first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first, and those of the second whose keys the first lacks; rows with an empty key all stay."""
    held = first.select(key).where(F.col(key).cast("string") != "").distinct()
    return first.unionByName(second.join(held, key, "left_anti").select(second.columns))


def ordered_distinct(df: DataFrame, key: str, at: str) -> DataFrame:
    """Each key once, with the first place where it stands."""
    return df.groupBy(key).agg(F.min(at).alias(at))


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """SK5: the rows whose keys are wanted; few keys are broadcast, many are joined."""
    return df.join(if_few(wanted.select(key).distinct()), key, "left_semi")


def top_groups(df: DataFrame, by: list[str], member: str, most: int) -> DataFrame:
    """Of each group its `most` most frequent members, with site_count and the group's total, ranked on counts alone."""
    n = df.groupBy(*by, member).agg(F.count("*").alias("site_count"))
    w = Window.partitionBy(*by).orderBy(F.desc("site_count"), member)  # one sort for both
    n = n.withColumn("total", F.sum("site_count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def gathered(df: DataFrame, groups: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The groups, each with its rows' values of a column, sorted; rows of other groups are left out before they are gathered."""
    kept = df.join(groups, by)
    rest = [c for c in groups.columns if c not in by]
    return kept.groupBy(*by, *rest).agg(F.sort_array(F.collect_list(column)).alias(name))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """SK11: consecutive numbers from 1 in the order of a column: places in sorted ranges, and the ranges' sizes, which are one row for each task."""
    shared_dir(df.sparkSession)
    placed = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return placed.join(F.broadcast(sizes.drop("_n")), "_part").withColumn(name, place + F.col("_before")).drop("_part", "_before")


def remap(df: DataFrame, ids: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """SK11: a column of ids (old) by their new ones."""
    new = ids.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(new, column, how).withColumn(column, F.col("_new")).select(df.columns)


def names_in_order(df: DataFrame, by: list[str], name: str, at: str) -> DataFrame:
    """Of each group its distinct names in the order of arrival."""
    first = df.groupBy(*by, name).agg(F.min(at).alias("_at"))
    rows = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_at", name))).alias("_rows"))
    return rows.select(*by, F.transform("_rows", lambda r: r[name]).alias("names"))


def count_tables(tables: dict[str, DataFrame], by: str) -> DataFrame:
    """Rows of each table by a column."""
    return reduce(DataFrame.unionByName, [df.groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit(kind).alias("kind"), "n") for kind, df in tables.items()])


def separated(df: DataFrame, by: list[str], pos: str, rank: str, line: str) -> DataFrame:
    """For each group whether its ranks change, and each time with a line between."""
    w = Window.partitionBy(*by).orderBy(pos)
    step = df.select(*by, (F.col(rank) != F.lag(rank).over(w)).alias("turn"), (F.col(line) - F.lag(line).over(w)).alias("gap"))
    return step.groupBy(*by).agg(((F.count_if("turn") > 0) & (F.count_if(F.col("turn") & (F.col("gap") <= 1)) == 0)).alias("separated"))


def first_match(df: DataFrame, others: DataFrame, on: list[str], order: str) -> DataFrame:
    """Each row with the first of the others of its key, or nulls."""
    rest = [c for c in others.columns if c not in on]
    first = others.groupBy(*on).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return df.join(first, on, "left").select(*df.columns, *[F.col(f"_first.{c}").alias(c) for c in rest])


def focused(df: DataFrame, hit: Column) -> DataFrame:
    """The rows that hit, or all of them where none does, and which it was; the count is one row."""
    hits = df.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("focus_matched"))
    return df.withColumn("_hit", F.coalesce(hit, F.lit(False))).join(F.broadcast(hits)).where("_hit OR NOT focus_matched").drop("_hit")


def diverse_files(df: DataFrame, path: str, by: list[str], most: int = 20) -> DataFrame:
    """Of each group up to `most` files, dealt from its folders in turn.

    Folders are told apart by their first part below what all of the group's paths share; package markers (__init__.py)
    count only where a group has nothing else.
    """
    keys = [F.col(k) for k in by]
    marker = F.regexp_extract(path, "([^/]*)$", 1) == "__init__.py"
    w = Window.partitionBy(*by)
    rows = df.withColumn("_all", F.min(marker.cast("int")).over(w)).where(~marker | (F.col("_all") == 1))
    # The first and the last path in order share exactly what all share.
    ends = rows.groupBy(*keys).agg(F.min(path).alias("_lo"), F.max(path).alias("_hi"))
    parts = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    shared = F.size(F.filter(F.transform(F.arrays_zip(parts("_lo").alias("x"), parts("_hi").alias("y")), lambda p, i: F.when(F.slice(parts("_lo"), 1, i + 1) == F.slice(parts("_hi"), 1, i + 1), True)), lambda x: x.isNotNull()))
    placed = rows.join(ends.select(*by, shared.alias("_depth")), by).withColumn("_folder", F.coalesce(F.get(parts(F.col(path)), F.col("_depth")), F.lit("")))
    turns = placed.withColumn("_turn", F.row_number().over(Window.partitionBy(*by, "_folder").orderBy(path)))
    return ranked(turns, by, [F.asc("_turn"), F.asc("_folder")], most).drop("_all", "_depth", "_folder", "_turn")


def composite(df: DataFrame, path: str, follows: str, by: list[str], most: int = 20) -> DataFrame:
    """A5: of each group one text: how many files match or violate it, up to `most` of them, those that violate it marked, and how many more there are.

    Package markers are left out of the list, and said to be, unless a group has nothing else.
    """
    marker = F.regexp_extract(path, "([^/]*)$", 1) == "__init__.py"
    n = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(follows).alias("adoption"), F.count_if(marker).alias("_markers"))
    some = diverse_files(df, path, by, most).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", path, follows))).alias("_rows"))
    total, adoption, markers, shown = F.col("total"), F.col("adoption"), F.col("_markers"), F.size("_rows")
    one, only = total == 1, F.col("_markers") == F.col("total")
    text = lambda x: x.cast("string")
    word = lambda w: F.when(one, F.lit(f"{w}es" if w == "match" else f"{w}s")).otherwise(F.lit(w))
    mixed = F.concat(word("reference"), F.lit(" this convention ("), text(adoption), F.lit(" follow / "), text(total - adoption), F.lit(" violate)"))
    verb = F.when(adoption == total, F.concat(word("match"), F.lit(" this convention"))).when(adoption == 0, F.concat(word("violate"), F.lit(" this convention"))).otherwise(mixed)
    listed = F.concat(F.lit(" (showing "), text(shown))
    note = (
        F.when(one, F.lit(""))
        .when(only, F.when(total == shown, F.lit(" (")).otherwise(F.concat(listed, F.lit("; "))))
        .when(markers > 0, F.concat(listed, F.lit(" informative; "), text(markers), F.lit(" __init__.py markers omitted)")))
        .when(total == shown, F.lit(""))
        .otherwise(F.concat(listed, F.lit(")")))
    )
    note = F.when(only & ~one, F.concat(note, F.lit("all are __init__.py markers)"))).otherwise(note)
    head = F.concat(F.lit("// "), text(total), F.when(one, F.lit(" file ")).otherwise(F.lit(" files ")), verb, note, F.lit(":"))
    lines = F.transform("_rows", lambda r: F.concat(F.lit("//   "), r[path], F.when(r[follows], F.lit("")).otherwise(F.lit("   [non-conforming]"))))
    rest = F.when(only, total).otherwise(F.greatest(total - markers, shown)) - shown
    more = F.when(rest > 0, F.concat(F.lit("\n// ... and "), text(rest), F.lit(" more (truncated)"))).otherwise(F.lit(""))
    return n.join(some, by).select(*by, "total", "adoption", F.concat(head, F.lit("\n"), F.array_join(lines, "\n"), more).alias("text"))


def anchored_sample(df: DataFrame, by: list[str], anchored: str, order: list[str], same: list[str], most: int = 20) -> DataFrame:
    """A4: of each group the first `most` rows in the order of arrival, anchored ones before others, each place (`same`) once."""
    best = Window.partitionBy(*by, *same).orderBy(F.desc(anchored), *order)
    once = df.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    return ranked(once, by, [F.desc(anchored), *[F.asc(c) for c in order]], most)


def matched_calls(symbols: DataFrame, calls: DataFrame, name: str, callee: str) -> DataFrame:
    """Symbols with the calls of their names: equal, or their last part after "::" or "."; joined on that part, the rest is a condition."""
    last = F.regexp_extract(callee, r"([^:.]+)$", 1)
    hit = calls.withColumn("_last", last)
    return symbols.join(hit, (F.col(name) == F.col("_last")) & T.callee_matches(callee, name)).drop("_last")


def unnested(df: DataFrame, column: str, fields: str) -> DataFrame:
    """A row for each entry of a JSON list of objects, with its fields beside the other columns; what is no such list gives none."""
    each = df.withColumn("_e", F.explode(F.from_json(column, f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ",")))).drop(column)
    return each.select(*[c for c in each.columns if c != "_e"], "_e.*")


#: Askers of a task: at least LEAST_ASKERS, until a list has SLOTS tasks, and at most ASKERS. Tasks in all. Bytes of the members of a chunk.
LEAST_ASKERS, SLOTS, ASKERS, MOST_TASKS, CHUNK_BYTES = 64, 64, 4096, 4096, 1 << 20


def _chunks(lists: DataFrame, most: int) -> DataFrame:
    """Rows (key, members): each key's members in order, in arrays of about `most` bytes that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, size = None, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([members], pa.list_(pa.string()))], ["key", "members"])
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if members and (k != key or size >= most):
                    yield row()
                    members, size = [], 0
                key = k
                members.append(m)
                size += len(m) + 1
        if members:
            yield row()

    return lists.repartitionByRange("key", "member").sortWithinPartitions("key", "member").mapInArrow(run, "key string, members array<string>")


class _Digests:
    """MD5 digests of one list, joined by commas, and of the list without one of its members, for each asker that is in it."""

    def __init__(self, askers: list[bytes]) -> None:
        self.askers, self.own, self.whole, self.n = sorted(askers), {}, hashlib.md5(usedforsecurity=False), 0

    def add(self, members: list[bytes]) -> None:
        """Members behind all before: what is before an asker's own place is hashed once for all."""
        text = b",".join(members)
        for h in self.own.values():  # of one whose place was the first there may be nothing yet
            if h[1]:
                h[0].update(b",")
            h[0].update(text)
            h[1] = True
        ends = list(accumulate(len(m) + 1 for m in members))
        view = memoryview(text)
        for asker in self.askers[bisect_left(self.askers, members[0]) : bisect_right(self.askers, members[-1])]:
            k = bisect_left(members, asker)
            if members[k] != asker:
                continue
            h, some = self.whole.copy(), self.n > 0
            for part in (view[: ends[k - 1] - 1] if k else None, view[ends[k] :] if k + 1 < len(members) else None):
                if part is not None:
                    if some:
                        h.update(b",")
                    h.update(part)
                    some = True
            self.own[asker] = [h, some]
        if self.n:
            self.whole.update(b",")
        self.whole.update(text)
        self.n += len(members)

    def of(self, asker: bytes) -> tuple[int, str]:
        h = self.own.get(asker)
        return (self.n - 1, h[0].hexdigest()) if h else (self.n, self.whole.hexdigest())


def list_digests(askers: DataFrame, lists: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (key, own, n, digest) of askers (key, own; each once): size and MD5 digest of the key's list without own, joined by commas.

    lists has rows (key, member), each once. The digests of lists that differ in one place cost as much as the lists are long,
    so this is quadratic in time, but no list is written out for an asker: its members go in order, in chunks, to each task of
    its askers, some ASKERS at most, whose states are all that it holds. An own that is null has the digest of no list.
    """
    ship_package(askers.sparkSession)
    known = askers.where("key IS NOT NULL AND own IS NOT NULL")
    sized = known.groupBy("key").agg(F.count("*").alias("m")).select("key", F.greatest(F.ceil(F.col("m") / ASKERS), F.least(F.lit(SLOTS), F.ceil(F.col("m") / LEAST_ASKERS))).cast("int").alias("slots"))
    n = max(1, min(sized.agg(F.sum("slots")).first()[0] or 1, MOST_TASKS))
    own = known.join(sized, "key").select("key", F.pmod(F.xxhash64("own"), F.col("slots")).cast("int").alias("slot"), "own", F.lit(None).cast("array<string>").alias("members"))
    chunks = _chunks(lists.where("key IS NOT NULL AND member IS NOT NULL").join(sized.select("key"), "key", "left_semi"), chunk_bytes)
    dealt = chunks.join(sized, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("string").alias("own"), "members")
    rows = own.unionAll(dealt).withColumn("part", F.pmod(F.hash("key") + F.col("slot"), F.lit(n)))
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("key", "slot", F.col("members").isNotNull(), F.element_at("members", 1)).select("key", "slot", "own", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = [(at[0], a.decode(), *held.of(a)) for a in held.askers]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["key", "own", "n", "digest"])

        at, asking, held = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if now != at:
                    if at:
                        held = held or _Digests(asking)
                        yield out()
                    at, asking, held = now, [], None
                if batch.column(2)[k].is_valid:
                    asking.append(batch.column(2)[k].as_py().encode())
                else:
                    held = held or _Digests(asking)
                    held.add([m.encode() for m in batch.column(3)[k].as_py()])
        if at:
            held = held or _Digests(asking)
            yield out()

    found = rows.mapInArrow(run, "key string, own string, n bigint, digest string")
    none = askers.where("key IS NULL OR own IS NULL").select("key", "own", F.lit(0).cast("bigint").alias("n"), F.md5(F.lit("").cast("binary")).alias("digest"))
    return found.unionAll(none)
