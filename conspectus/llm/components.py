"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, if_small, materialise_narrow, parts_for

#: So many edges have at most BROADCAST_ROWS nodes.
FEW_EDGES = BROADCAST_ROWS // 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) for each node that has an edge to another one; component is the smallest id reachable.

    Each step is a minimum by node (combined on the map side) joined back to the edges. The minima are materialised before
    that: few of them are broadcast, and otherwise both sides are dealt anew, so that the adaptive join can split a node
    with very many neighbours. Every round is kept in the shared folder and ends the lineage. A round over at most FEW_EDGES
    is one job of a single plan, in which all minima are broadcast, and which deals its rows to few tasks, so that the
    driver plans and runs little for it and its shuffles leave few files.
    Edges from a node to itself, repeated edges and nulls are ignored; without edges the result is empty.
    """
    now = materialise_narrow(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    mark = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not found[0] or tuple(found) == mark:
            break
        mark = tuple(found)
        few = found[0] <= FEW_EDGES
        side = F.broadcast if few else if_small
        kept = (lambda df, n=parts_for(found[0]): df.coalesce(n)) if few else materialise_narrow
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = kept(both.join(side(kept(least)), "x").where("y > x AND y != m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(side(low), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialise_narrow(small.coalesce(parts_for(found[0])))
    roots = now.groupBy("u").agg(F.min("v").alias("v")).coalesce(parts_for(found[0]))
    return roots.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().coalesce(parts_for(found[0])))
