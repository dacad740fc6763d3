"""What surrounds a query's answer: scope, envelope and call log."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Envelope:
    """Q-ENV: a success or an error with its code."""

    tool: str
    repo: str
    data: dict | None = None
    metadata: dict = field(default_factory=dict)
    error: dict | None = None

    @classmethod
    def success(cls, tool: str, repo: str, data: dict, **metadata: object) -> Envelope:
        return cls(tool, repo, data, dict(metadata))

    @classmethod
    def failure(cls, tool: str, repo: str, code: str, message: str) -> Envelope:
        return cls(tool, repo, error={"code": code, "message": message})

    def to_json(self) -> str:
        body = {"status": "error", "error": self.error} if self.error else {"status": "ok", "data": self.data}
        return json.dumps({"tool": self.tool, "repo": self.repo, **body, "metadata": self.metadata}, default=str)


def resolve_scope(mounts: list[str], scope: str | None = None, file_path: str | None = None) -> str:
    """Q-SCOPE: the mount of a query ("" is the root): an explicit scope (a mount, or an unambiguous last component), else the longest mount that holds the file."""
    if scope:
        if scope in mounts:
            return scope
        short = [m for m in mounts if m.rpartition("/")[2] == scope]
        if len(short) == 1:
            return short[0]
        raise ValueError(f"{'ambiguous' if short else 'unknown'} scope {scope}")
    if file_path:
        parts = file_path.replace("\\", "/").split("/")
        if ".." in parts or file_path.startswith("/"):
            raise ValueError("paths are relative to the root")
        return max((m for m in mounts if file_path == m or file_path.startswith(f"{m}/")), key=len, default="")
    return ""


def check_inputs(query: str | None = None, depth: int | None = None, path: str | None = None) -> None:
    """what a query must not be: empty, deeper than ten steps or less than one, outside the project."""
    if query is not None and not query.strip():
        raise ValueError("a query needs some text")
    if depth is not None and not 1 <= depth <= 10:
        raise ValueError("depth must be 1 to 10")
    if path is not None and (not path.strip() or path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/") or path[1:3] in (":\\", ":/")):
        raise ValueError("paths are relative to the root")


def log_calls(spark: SparkSession, calls: list[dict], path: str) -> None:
    """SK23, A22: appends one JSON line for each call, with the sizes of the lists in its answer."""
    rows = [(c["tool"], c.get("error"), json.dumps({k: len(v) for k, v in (c.get("data") or {}).items() if isinstance(v, list)}, sort_keys=True)) for c in calls]
    spark.createDataFrame(rows, "tool string, error string, counts string").coalesce(1).write.mode("append").json(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tool string, error string, counts string").json(path)
