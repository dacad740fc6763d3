"""Snapshot store over Parquet: keyed tables by branch, as snapshots and changes to them, each a folder, and a log of commits with one row for each.

A change holds the new rows of some keys, and the keys themselves, whose earlier rows go; a reader puts the changes since the
last snapshot over it, so that a commit writes as much as it changes. When changes amount to a quarter of the snapshot they are
folded into a new one, and many small ones are merged before that. A reader resolves the log once and reads immutable folders; a
commit of several tables is one file of the log, written by Spark's own committer, so that any store Spark writes to will
do, and a writer that dies before it leaves all tables as they were. One writer at a time.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import code as C
from ..functions import text as T
from ..operators import relational as R

LOG = "version bigint, name string, folder string, kind string, keys string, n bigint"
#: Changes of a table that are merged into one; its snapshot's rows over theirs from which on all are folded into a new snapshot.
MOST_CHANGES, FOLD = 16, 4


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._known: tuple[list[str], list[Row]] = ([], [])

    def _path(self, folder: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _log(self) -> list[Row]:
        """One row for each table of each commit since the last sweep; read anew only if there are other files than before."""
        fs, path = self._path(f"{self.root}/_commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
        if names != self._known[0]:
            self._known = names, self.spark.read.schema(LOG).parquet(f"{self.root}/_commits").collect()
        return self._known[1]

    def _entries(self, name: str | None = None) -> list[Row]:
        """What a table is made of: its last snapshot and the changes since, in order, or since the last merge of these; of all tables without a name."""
        out: dict[str, list[Row]] = {}
        for e in sorted((e for e in self._log() if name in (None, e.name)), key=lambda e: e.version):
            held = out.setdefault(e.name, [])
            if e.kind == "snapshot":
                held.clear()
            elif e.kind == "merged":
                del held[1:]
            held.append(e)
        return [e for held in out.values() for e in held]

    def has(self, name: str) -> bool:
        return bool(self._entries(name))

    def _changes(self, entries: list[Row]) -> DataFrame:
        """Rows of changes with _at, the number of their change, and _gone, whether they only name a key."""
        return reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), [self.spark.read.parquet(e.folder).withColumn("_at", F.lit(k)) for k, e in enumerate(entries)])

    def _latest(self, entries: list[Row]) -> DataFrame:
        """Of each key the rows of its last change."""
        keys, rows = entries[0].keys.split(","), self._changes(entries)
        return rows.join(rows.groupBy(*keys).agg(F.max("_at").alias("_last")), keys).where("_at = _last").drop("_at", "_last") if len(entries) > 1 else rows.drop("_at")

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        entries = self._entries(name)
        if not entries:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        base, changes = self.spark.read.parquet(entries[0].folder), entries[1:]
        if not changes:
            return base
        keys, latest = changes[0].keys.split(","), self._latest(changes)
        gone = latest.select(*keys).distinct()
        gone = F.broadcast(gone) if sum(e.n for e in changes) <= R.FEW_ROWS else gone
        return base.join(gone, keys, "left_anti").unionByName(latest.where("NOT _gone").drop("_gone"), allowMissingColumns=True)

    def _commit(self, parts: list[tuple[str, DataFrame, str, str | None]], partition_by: tuple[str, ...] = ()) -> None:
        rows = []
        for name, df, kind, keys in parts:
            folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.partitionBy(*partition_by).parquet(folder)
            rows.append((name, folder, kind, keys, self.spark.read.parquet(folder).count() if df.columns else 0))
        version = time.time_ns()
        self.spark.createDataFrame([(version, *r) for r in rows], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """SK4: a new snapshot of one table."""
        self.write_all({name: df}, partition_by)

    def write_all(self, tables: dict[str, DataFrame], partition_by: tuple[str, ...] = ()) -> None:
        """SK2: new snapshots of several tables, seen all at once or not at all."""
        self._commit([(name, df, "snapshot", None) for name, df in tables.items()], partition_by)

    def change(self, tables: dict[str, tuple[DataFrame | None, DataFrame]], by: list[str] | dict[str, list[str]]) -> None:
        """SK2, SK3: of each table (new rows or None, rows with the keys whose earlier rows go), in one commit that writes no more than these. by: the keys, of all tables or of each."""
        parts = []
        for name, (new, of) in tables.items():
            entries, keys = self._entries(name), by[name] if isinstance(by, dict) else by
            if not entries:
                parts += [(name, new, "snapshot", None)] if new is not None else []
                continue
            if any(e.keys != ",".join(keys) for e in entries[1:]):  # changes by other keys are folded first
                self.write(name, self.read(name))
            rows = of.select(*keys).distinct().withColumn("_gone", F.lit(True))
            parts.append((name, rows if new is None else new.withColumn("_gone", F.lit(False)).unionByName(rows, allowMissingColumns=True), "change", ",".join(keys)))
        if parts:
            self._commit(parts)
        for name in tables:
            self._fold(name)

    def _fold(self, name: str) -> None:
        entries = self._entries(name)
        if sum(e.n for e in entries[1:]) * FOLD >= max(1, entries[0].n) if entries[1:] else False:
            self.write(name, self.read(name))
        elif len(entries) > MOST_CHANGES:
            self._commit([(name, self._latest(entries[1:]), "merged", entries[1].keys)])

    def sweep(self, older_than_s: float = 86_400) -> int:
        """Deletes folders that no table is made of any more, and the log's old rows, if they are older than that, so that no reader still needs them; how many."""
        live, before, gone = self._entries(), (time.time() - older_than_s) * 1000, 0
        fs, top = self._path(self.root)
        log = [f.getPath() for f in fs.listStatus(self._path(f"{self.root}/_commits")[1]) if f.getModificationTime() < before] if live else []
        if len(log) > 1:
            # All that is live, said once more; then what said it before can go.
            again = [(e.version, e.name, e.folder, e.kind, e.keys, e.n) for e in live]
            self.spark.createDataFrame(again, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")
            for path in log:
                gone += fs.delete(path, False)
        held = {e.folder.rpartition("/")[2] for e in live}
        for table in fs.listStatus(top) if fs.exists(top) else ():
            if table.isDirectory() and not table.getPath().getName().startswith("_"):
                for folder in fs.listStatus(table.getPath()):
                    if folder.getPath().getName() not in held and folder.getModificationTime() < before:
                        gone += fs.delete(folder.getPath(), True)
        return gone

    def upsert_files(self, files: DataFrame) -> None:
        """SK2, SK17: files (schemas.FILE) and, in the same commit, their rows of both symbol tables."""
        from .code import symbol_definitions, symbol_imports

        definitions, imports = symbol_definitions(files), symbol_imports(files).withColumnRenamed("importer_file", "path")
        self.change({"files_ir": (files, files), "symbol_definitions": (definitions, files), "symbol_imports": (imports, files)}, ["branch_id", "path"])

    def delete_files(self, gone: DataFrame) -> list[str]:
        """SK3: the files (branch_id, path) and their symbols go, in one commit; the paths that were not there, whose symbols are swept all the same."""
        keys = ["branch_id", "path"]
        absent = sorted(r.path for r in gone.join(self.read("files_ir").select(*keys), keys, "left_anti").select("path").distinct().collect())
        self.change({n: (None, gone) for n in ("files_ir", "symbol_definitions", "symbol_imports") if self.has(n)}, keys)
        return absent

    def backfill_symbols(self) -> bool:
        """SK18: builds the symbol tables where files are there and definitions are not; whether it did."""
        from .code import symbol_definitions, symbol_imports

        if not self.has("files_ir") or self.has("symbol_definitions") and self.read("symbol_definitions").head(1):
            return False
        files = self.read("files_ir")
        self.write_all({"symbol_definitions": symbol_definitions(files), "symbol_imports": symbol_imports(files).withColumnRenamed("importer_file", "path")})
        return True

    def replace_conventions(self, branch: str, conventions: DataFrame, decided: DataFrame) -> None:
        """SK4: a branch's detected conventions are replaced by those on which nothing is decided; others' rows stay."""
        new = conventions.join(decided.select("description_hash").distinct(), "description_hash", "left_anti").withColumn("branch_id", F.lit(branch)).withColumn("source", F.lit("auto_detected"))
        if not self.has("nodes"):
            self.write("nodes", new)
            return
        stay = self.read("nodes").where((F.col("branch_id") != branch) | (F.col("source") != "auto_detected"))
        self.write("nodes", stay.unionByName(new, allowMissingColumns=True))

    def insert_edges(self, edges: DataFrame) -> None:
        """SK10: edges (branch_id, source, target, edge_type) that are not there yet."""
        keys = ["branch_id", "source", "target", "edge_type"]
        self.upsert("edges", edges.dropDuplicates(keys), keys)

    def edges(self, branch: str, **where: object) -> DataFrame:
        """SK10: a branch's edges by source, target or edge_type."""
        df = self.read("edges").where(F.col("branch_id") == branch)
        for k, v in where.items():
            df = df.where(F.col(k) == v)
        return df

    # --- branches and values by key

    def set_value(self, scope: str, key: str, value: str) -> None:
        """SK19"""
        self.upsert("values", self.spark.createDataFrame([(scope, key, value)], "scope string, key string, value string"), ["scope", "key"])

    def value(self, scope: str, key: str, default: str | None = None) -> str | None:
        row = self.read("values", "scope string, key string, value string").where((F.col("scope") == scope) & (F.col("key") == key)).first()
        return row.value if row else default

    def switch_branch(self, branch: str) -> None:
        """SK14"""
        self.set_value("", "current_branch", branch)

    def current_branch(self) -> str:
        return self.value("", "current_branch", "main")

    def list_branches(self, name: str = "files_ir") -> list[str]:
        """SK14: branches with rows in a table (one row each), and the current one."""
        found = {r[0] for r in self.read(name).select("branch_id").distinct().collect()} if self.has(name) else set()
        return sorted(found | {self.current_branch()})

    def load_branch(self, name: str, branch: str, most: int | None = None) -> DataFrame:
        """SC20, SC21: a branch's rows; `most` cuts them only where a caller asks for it."""
        df = self.read(name).where(F.col("branch_id") == branch)
        return df if most is None else df.limit(most)

    def delete_stale(self, name: str, column: str, before: int) -> int:
        """SK20: rows fetched before a time go; how many."""
        df = self.read(name)
        n = df.where(F.col(column) < before).count()
        if n:
            self.write(name, df.where(F.col(column) >= before))
        return n

    def upsert(self, name: str, new: DataFrame, keys: list[str]) -> None:
        """SK1, SK16, SK19, SK20, SK24"""
        self.change({name: (new, new)}, keys)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        """SK3, SK9, SK13: the rows whose keys are in `gone` go."""
        self.change({name: (None, gone)}, keys)

    def prune(self, name: str, current: DataFrame, keys: list[str]) -> None:
        """SK16, U5: only the rows whose keys are in `current` stay."""
        self.write(name, self.read(name).join(current.select(*keys).distinct(), keys, "left_semi"))

    def create_snapshot(self, tables: list[str], source: str, target: str) -> None:
        """SK12: every column of the source branch's rows under the new branch."""
        rows = {name: self.read(name) for name in tables}
        self.write_all({name: df.where(F.col("branch_id") != target).unionByName(df.where(F.col("branch_id") == source).withColumn("branch_id", F.lit(target))) for name, df in rows.items()})

    def delete_branch(self, tables: list[str], branch: str) -> None:
        """SK13"""
        self.write_all({name: self.read(name).where(F.col("branch_id") != branch) for name in tables})

    def orphan_branches(self, name: str, live: list[str], protected: tuple[str, ...] = ("main",)) -> list[str]:
        """SK15: branches of a table that neither live nor are protected (branches are few: one row each)."""
        return sorted(r[0] for r in self.read(name).select("branch_id").distinct().where(~F.col("branch_id").isin(*live, *protected)).collect())


def scan_changes(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """U4: unchanged, modified, added and deleted paths by content hash."""
    return R.tree_diff(stored, discovered, "path", "content_hash")


class Decisions:
    """Q-REC, Q-UPD, Q-REM, Q-REV, SK22, SC22: the project's decisions, keyed by the hash of their description."""

    def __init__(self, store: TableStore, now: int | None = None) -> None:
        self.store, self.now = store, now

    def all(self) -> DataFrame:
        return self.store.read("decisions", schemas.DECISION)

    def _row(self, description: str, state: str, nature: str, weight: str, category: str | None, reason: str | None, branch: str) -> DataFrame:
        at = self.now if self.now is not None else int(time.time())
        row = self.store.spark.createDataFrame([(description, state, nature, weight, category, reason, branch, at, at)], "description string, state string, nature string, weight string, category string, reason string, decided_on_branch string, decided_at bigint, updated_at bigint")
        return row.select(T.description_hash("description").alias("description_hash"), "*")

    def record(self, description: str, nature: str = "decision", weight: str = "strong", category: str | None = None, reason: str | None = None, branch: str = "main", state: str = "recorded") -> str:
        if not description.strip():
            raise ValueError("a decision needs a description")
        row = self._row(description, state, nature, weight, category, reason, branch)
        self.store.upsert("decisions", row, ["description_hash"])
        return row.first().description_hash

    def _recorded(self, key: str) -> dict:
        row = self.all().where(F.col("description_hash") == key).first()
        if row is None:
            raise KeyError(key)
        if row.state != "recorded":
            raise ValueError(f"only recorded decisions can be changed; this one is {row.state}")
        return row.asDict()

    def update(self, key: str, **changes: str) -> str:
        """Empty category or reason clears it; a changed description moves the row to its new hash, unless that is taken."""
        old = self._recorded(key)
        new = old | {k: (v or None) if k in ("category", "reason") else v for k, v in changes.items()}
        row = self._row(new["description"], "recorded", new["nature"], new["weight"], new["category"], new["reason"], new["decided_on_branch"]).withColumn("decided_at", F.lit(old["decided_at"]))
        moved = row.first().description_hash
        if moved != key and self.all().where(F.col("description_hash") == moved).head(1):
            raise ValueError("another decision has this description")
        rest = self.all().where(F.col("description_hash") != key)
        self.store.write("decisions", rest.where(F.col("description_hash") != moved).unionByName(row))
        return moved

    def remove(self, key: str) -> None:
        self._recorded(key)
        self.store.write("decisions", self.all().where(F.col("description_hash") != key))

    def review(self, conventions: DataFrame) -> DataFrame:
        """What is undecided, by confidence, with the hash of its extra data to be checked when it is decided."""
        return conventions.join(self.all().select("description_hash"), "description_hash", "left_anti").withColumn("seen", C.snapshot_hash("ext_data") if "ext_data" in conventions.columns else C.snapshot_hash(F.lit(None).cast("string"))).orderBy(F.desc("confidence"), "description_hash")

    def apply_review(self, actions: DataFrame, conventions: DataFrame) -> dict[str, int]:
        """Q-REV: actions (description_hash, action: confirm, reject or partial, seen) on conventions (description_hash, description, nature, weight, ext_data).

        Confirmed ones become approved, rejected ones rejected, others partial preferences; all in one commit. An action whose
        convention has changed since it was shown, or is gone, fails by itself. Counts by outcome.
        """
        shown = conventions.select("description_hash", "description", "nature", "weight", C.snapshot_hash("ext_data").alias("now"))
        judged = actions.join(shown, "description_hash", "left").withColumn("outcome", F.when(F.col("now").isNull(), "missing").when(F.col("seen") != F.col("now"), "changed").otherwise(F.col("action")))
        counts = {r.outcome: r["count"] for r in judged.groupBy("outcome").count().collect()}
        at = self.now if self.now is not None else int(time.time())
        state = F.when(F.col("outcome") == "confirm", "approved").when(F.col("outcome") == "reject", "rejected").otherwise("partial")
        rows = judged.where("outcome IN ('confirm', 'reject', 'partial')").select(
            "description_hash", "description", state.alias("state"), F.when(F.col("outcome") == "partial", "preference").otherwise(F.col("nature")).alias("nature"), "weight",
            F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("reason"), F.lit("main").alias("decided_on_branch"), F.lit(at).cast("bigint").alias("decided_at"), F.lit(at).cast("bigint").alias("updated_at"),
        )
        self.store.upsert("decisions", rows, ["description_hash"])
        return counts

    def export(self, path: str) -> None:
        self.all().write.mode("overwrite").json(path)

    def import_from(self, path: str, strict: bool = False) -> dict[str, int]:
        """U8: the later decided_at wins, strictly; in strict mode any conflict is an error and nothing is written."""
        incoming = self.store.spark.read.schema(schemas.DECISION).json(path)
        incoming = R.ranked(incoming, ["description_hash"], [F.desc("decided_at"), F.desc("updated_at"), F.asc("description"), F.asc("state")], 1).drop("rank")
        now = self.all()
        if strict:
            clash = [r[0] for r in now.join(incoming.select("description_hash"), "description_hash", "left_semi").select("description_hash").limit(100).collect()]
            if clash:
                raise ValueError(f"conflicting decisions: {', '.join(sorted(clash))}")
        merged = R.latest_wins(now, incoming, "description_hash", "decided_at")
        counts = {r.action: r["count"] for r in merged.groupBy("action").count().collect()}
        self.store.write("decisions", merged.drop("action"))
        return counts
