"""Graph kernels: bounded breadth-first search with witness chains over a (reverse) adjacency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package
from .relational import numbered, ranked

MAX_DEPTH = 10
MAX_DEPENDENTS = 500


def keep(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage in the shared checkpoint folder (in one JVM, where none is set, one of our own)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reverse_adjacency(imports: DataFrame) -> DataFrame:
    """(importer, target, names, line) from (importer, target, name, line): sorted distinct names, first line, no self loops."""
    return imports.where("importer != target").groupBy("importer", "target").agg(F.sort_array(F.collect_set("name")).alias("names"), F.min("line").alias("line"))


def dependents(edges: DataFrame, sources: DataFrame, depth: int = 3) -> DataFrame:
    """All nodes that reach a source against the edges (importer, target) in at most `depth` steps.

    Rows (source, node, depth, via): the fewest steps, and the chain of nodes between, the smallest one (joined by " > ")
    among those of that length. The edges are kept once; each level is one join of the frontier with them and one anti
    join with the levels before, and only the level is kept, so that neither lineage nor writing grows. A source is never
    its own dependent.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    e = keep(edges.where("importer != target").select("importer", "target").distinct())
    seen = keep(sources.select(F.col("node").alias("source"), "node").distinct().select("source", "node", F.lit(0).alias("depth"), F.lit("").alias("via")))
    frontier = seen
    for level in range(1, depth + 1):
        chain = F.when(F.col("depth") == 0, F.lit("")).when(F.col("via") == "", F.col("node").cast("string")).otherwise(F.concat_ws(" > ", "via", F.col("node").cast("string")))
        step = frontier.select("source", F.col("node").alias("target"), chain.alias("via")).join(e, "target").groupBy("source", F.col("importer").alias("node")).agg(F.min("via").alias("via"))
        frontier = keep(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(level).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


#: Numbers of nodes in a row.
NODES = 1 << 14


def _first_reached(rows: DataFrame, nodes: int, level: int, counted: bool) -> DataFrame:
    """Rows (source, level, nodes) of all levels up to this one to those nodes of it that none before has, or to their number.

    Rows come by source and level, and a task marks a source's nodes in one array, of a byte for each node there is.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marked, at, new = np.zeros(nodes, np.uint8), [], None, []

        def out() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(new) if new else np.zeros(0, np.int32)
            parts = [found[k : k + NODES] for k in range(0, len(found), NODES)] if not counted else [np.array([len(found)], np.int32)] if len(found) else []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(parts), kind) for x, kind in ((at, pa.int32()), (level, pa.int32()))] + [pa.array(parts, pa.list_(pa.int32()))], ["source", "level", "nodes"])

        for batch in batches:
            sources, levels, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for k in range(batch.num_rows):
                if sources[k] != at:
                    if at is not None:
                        yield from out()
                    for x in marked:
                        seen[x] = 0
                    at, new, marked = int(sources[k]), [], [np.array([sources[k]])]
                    seen[at] = 1
                some = column[k].values.to_numpy()
                some = np.unique(some[seen[some] == 0])
                seen[some] = 1
                marked.append(some)
                if levels[k] == level and len(some):
                    new.append(some)
        if at is not None:
            yield from out()

    return rows.repartition("source").sortWithinPartitions("source", "level").mapInArrow(run, "source int, level int, nodes array<int>")


def count_far_dependents(edges: DataFrame, sources: DataFrame, depth: int = 3) -> DataFrame:
    """(source, far): how many of `dependents` are more than one step away, without chains; sources that have none are left out.

    Nodes go as numbers, in arrays: the importers of a node as they are, so that a way costs four bytes, and what the last
    level reaches is counted where it is and not written.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    e = edges.where("importer != target").select("importer", "target").distinct()
    names = e.select(F.col("importer").alias("node")).unionAll(e.select(F.col("target").alias("node"))).distinct()
    ids = keep(numbered(names, "node", "id").select("node", (F.col("id") - 1).cast("int").alias("id")))
    nodes = ids.count()
    known = lambda df, column: df.join(ids.select(F.col("node").alias(column), "id"), column).drop(column).withColumnRenamed("id", column)
    numbers = known(known(e, "importer"), "target")
    near = keep(numbers.groupBy("target", F.floor(F.col("importer") / NODES).alias("part")).agg(F.sort_array(F.collect_list("importer")).alias("nodes")).select("target", "nodes"))
    start = known(sources.select(F.col("node").alias("source")).distinct(), "source")
    levels = [keep(start.join(near, start["source"] == near["target"]).select("source", F.lit(1).alias("level"), "nodes"))]
    for level in range(2, depth + 1):
        frontier = levels[-1].select("source", F.explode("nodes").alias("target"))
        step = frontier.join(near, "target").select("source", F.lit(level).alias("level"), "nodes")
        for held in levels:
            step = step.unionAll(held)
        found = _first_reached(step, nodes, level, level == depth)
        levels.append(found if level == depth else keep(found))
    n = [x.select("source", (F.get("nodes", F.lit(0)) if k == depth else F.size("nodes")).cast("bigint").alias("n")) for k, x in enumerate(levels[1:], 2)]
    if not n:
        return sources.select(F.col("node").alias("source"), F.lit(0).cast("bigint").alias("far")).where("false")
    every = n[0]
    for x in n[1:]:
        every = every.unionAll(x)
    far = every.groupBy("source").agg(F.sum("n").alias("far"))
    return far.join(ids, far["source"] == ids["id"]).select(F.col("node").alias("source"), "far")


def capped(found: DataFrame, most: int = MAX_DEPENDENTS) -> DataFrame:
    """Of each source the first `most` dependents by depth and name, and whether there are more."""
    n = found.groupBy("source").agg((F.count("*") > most).alias("truncated"))
    return ranked(found, ["source"], [F.asc("depth"), F.asc("node")], most, "rank").join(n, "source")
