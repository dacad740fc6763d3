"""Conventions kept up to date by the differences that changed files make, and bursts of events on a path taken as one.

The state is a histogram: of each convention, whether it is followed, and date, how many findings there are. Histograms add up,
so that a change of files adds theirs and takes away the ones they had; counts, confidence and the discrete percentile of dates
follow from it exactly, without a look at files that did not change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import relational as R
from ..operators.graph import keep
from ..sources.store import TableStore

KEYS = ["detector", "description"]
CELL = [*KEYS, "nature", "follows", "date"]
#: The date of findings without one.
NO_DATE = -(2**63)


def histogram(findings: DataFrame) -> DataFrame:
    """Rows (CELL, n) of findings (path, detector, description, nature, follows, last_commit_date)."""
    return findings.groupBy(*KEYS, "nature", "follows", F.coalesce("last_commit_date", F.lit(NO_DATE)).alias("date")).agg(F.count("*").alias("n"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns one histogram into another: the cells whose counts change, and by how much."""
    both = new.unionByName(old.withColumn("n", -F.col("n")))
    return both.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n != 0")


def conventions(state: DataFrame, now: int = 0) -> DataFrame:
    """A1 to A3 from a histogram: (detector, description, nature, total_count, adoption_count, confidence, weight, p90, trend)."""
    n = state.groupBy(*KEYS).agg(F.min("nature").alias("nature"), F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(F.col("follows"), F.col("n"))), F.lit(0)).alias("adoption_count"))
    dated = state.where(F.col("date") != NO_DATE).groupBy(*KEYS, "date").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*KEYS)
    placed = dated.withColumn("so_far", F.sum("n").over(w.orderBy("date"))).withColumn("all", F.sum("n").over(w))
    p90 = placed.where(F.col("so_far") >= F.ceil(F.lit(0.9) * F.col("all"))).groupBy(*KEYS).agg(F.min("date").alias("p90"))
    out = n.join(p90, KEYS, "left").withColumn("confidence", F.round(F.col("adoption_count") / F.col("total_count"), 6))
    return out.select(*KEYS, "nature", "total_count", "adoption_count", "confidence", T.weight("confidence").alias("weight"), "p90", T.trend("p90", now).alias("trend"))


class ConventionState:
    """Findings by file and their histogram in a store; a change writes the findings of its files and the cells that it touches, in one commit."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def apply(self, findings: DataFrame, paths: DataFrame) -> None:
        """Puts findings (path, detector, description, nature, follows, last_commit_date) in the place of all that files (paths: path) had; without findings the files' go.

        The difference is taken to what is stored, so that a change that is applied once more changes nothing.
        """
        paths, findings = keep(paths.select("path").distinct()), keep(findings.select("path", *KEYS, "nature", "follows", "last_commit_date"))
        if not self.store.has("findings"):
            self.store.write_all({"findings": findings, "convention_counts": histogram(findings)})
            return
        old = self.store.read("findings").join(R.if_few(paths), "path", "left_semi")
        changed = keep(difference(histogram(old), histogram(findings)))
        held = self.store.read("convention_counts").join(R.if_few(changed.select(*CELL)), CELL, "left_semi")
        cells = changed.unionByName(held).groupBy(*CELL).agg(F.sum("n").alias("n")).where("n > 0")
        self.store.change({"findings": (findings, paths), "convention_counts": (cells, changed)}, {"findings": ["path"], "convention_counts": CELL})

    def conventions(self, now: int = 0) -> DataFrame:
        return conventions(self.store.read("convention_counts"), now)

    def evidence(self, some: DataFrame, sample: int = 20) -> DataFrame:
        """A4: of some conventions (detector, description) their first files with findings."""
        rows = self.store.read("findings").join(R.if_few(some.select(*KEYS).distinct()), KEYS, "left_semi").select(*KEYS, "path").distinct()
        return R.ranked(rows, KEYS, [F.asc("path")], sample).groupBy(*KEYS).agg(F.sort_array(F.collect_list("path")).alias("evidence"))


def incremental_tier(changes: DataFrame, detect: Callable[[DataFrame], DataFrame], state: ConventionState, checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """ST2, ST5: each micro-batch of events (path, ts, seq, kind) changes the conventions by what its files change; detect gets paths (path) and gives their findings."""

    def each(batch: DataFrame, _: int) -> None:
        last = keep(R.ranked(batch, ["path"], [F.desc("ts"), F.desc("seq")], 1).drop("rank"))
        if last.head(1):
            state.apply(detect(last.where("kind != 'remove'").select("path")), last)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def debounced(changes: DataFrame, wait_ms: int = 500) -> DataFrame:
    """ST3: of events (path, ts timestamp, seq bigint, kind) the last of each path, once the path has been quiet for wait_ms.

    Every path has a timer of its own, which each event starts afresh; the state is one event and goes when it is sent on.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, seq, kind = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(ts), seq, kind)], columns=["path", "ts", "seq", "kind"])
            return
        held = state.get if state.exists else None
        for f in frames:
            for ts, seq, kind in zip(f["ts"], f["seq"], f["kind"], strict=True):
                if held is None or (pd.Timestamp(ts), seq) >= (pd.Timestamp(held[0]), held[1]):
                    held = (pd.Timestamp(ts).to_pydatetime(), int(seq), kind)
        state.update(held)
        state.setTimeoutDuration(wait_ms)

    rows = changes.select("path", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "kind")
    return rows.groupBy("path").applyInPandasWithState(step, "path string, ts timestamp, seq bigint, kind string", "ts timestamp, seq bigint, kind string", "append", GroupStateTimeout.ProcessingTimeTimeout)
