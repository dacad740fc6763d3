"""Incremental maintenance on streams: the latest change of each path, and the bulk trigger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import relational as R
from ..operators.graph import keep
from ..session import ship_package
from ..sources.changes import changed_paths
from ..sources.store import TableStore

BULK, WITHIN_S = 20, 2.0


def hot_tier(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """ST1, ST3: each micro-batch (the debounce) is cut to the last event of each path; apply gets the upserts and the deletes."""

    def each(batch: DataFrame, _: int) -> None:
        last = R.ranked(batch, ["path"], [F.desc("ts"), F.desc("seq")], 1).drop("rank")
        apply(last.where("kind IN ('create', 'modify')"), last.where("kind = 'remove'"))

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def warm_tier(changes: DataFrame, recompute: Callable[[], None], checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """ST2, ST5: all aggregates are computed afresh once for each interval in which something changed, one run at a time.

    Micro-batches follow each other, so that no second run begins during one; what changes meanwhile is in the next batch.
    """

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            recompute()

    writer = changes.select(F.lit(1)).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def sync_trees(store: TableStore, branch: str, old: DataFrame, new: DataFrame, parse: Callable[[DataFrame], DataFrame], redetect: Callable[[], None] | None = None) -> dict[str, int]:
    """ST6: after HEAD has moved from one tree (path, oid) to another: changed files are parsed and stored, deleted ones go, and findings are made anew if anything changed.

    parse gets the changed paths (path, oid) and gives rows of schemas.FILE.
    """
    changes = keep(changed_paths(old, new))
    counts = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
    up = changes.where("status != 'deleted'")
    if counts.keys() - {"deleted"}:
        store.upsert_files(parse(up.select("path", F.col("new_oid").alias("oid"))))
    if counts.get("deleted"):
        store.delete_files(changes.where("status = 'deleted'").select(F.lit(branch).alias("branch_id"), "path"))
    if counts and redetect:
        redetect()
    return counts


def sync_metadata(syncing: bool, snapshot_of: str | None = None, head: str | None = None) -> dict[str, object]:
    """ST7: what an answer says of its data: being synchronised, that of another branch's snapshot, or of a detached head."""
    out: dict[str, object] = {}
    if syncing:
        out["syncing"] = True
    if snapshot_of:
        out["snapshot_based"] = snapshot_of
    if head is None:
        out["detached_head"] = True
    return out


def bulk_triggers(changes: DataFrame, by: str = "root", most: int = BULK, within: float = WITHIN_S) -> DataFrame:
    """ST4: (root, at, n): more than `most` events in the trailing `within` seconds (an event exactly that old counts); then the window starts afresh.

    The state of a root is the times of at most most + 1 events.
    """
    ship_package(changes.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times: list[float] = list(state.get[0]) if state.exists else []
        out = []
        for at in sorted(t for f in frames for t in f["ts"].astype("datetime64[ns]").astype("int64").tolist()):
            now = at / 1e9
            times = [t for t in times if now - t <= within] + [now]
            if len(times) > most:
                out.append((key[0], pd.Timestamp(at), len(times)))
                times = []
        state.update((times,))
        yield pd.DataFrame(out, columns=["root", "at", "n"])

    rows = changes.select(F.col(by).alias("root"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("root").applyInPandasWithState(step, "root string, at timestamp, n int", "times array<double>", "append", GroupStateTimeout.NoTimeout)
