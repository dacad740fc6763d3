"""Where others plug in: parsers, detectors, embedding providers, package registries, progress."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detectors
from ..session import ship_package
from ..sources import code


def register_parser(extension: str, language: str, parse: Callable[[dict, str], None]) -> None:
    """Files of an extension are parsed by a function that fills a row of schemas.FILE (it must be importable on executors)."""
    code.LANGUAGES[extension] = language
    code.PARSERS[language] = parse


class Detector(Protocol):
    """Findings (schemas.FINDING) of files (schemas.FILE), each by itself and across files (edges: importer, target)."""

    name: str
    languages: tuple[str, ...]

    def per_file(self, files: DataFrame) -> DataFrame: ...

    def across_files(self, files: DataFrame, edges: DataFrame) -> DataFrame | None: ...


def detect_with(extra: list[Detector], files: DataFrame, edges: DataFrame) -> DataFrame:
    """The findings of the own detectors and of others, over the files of their languages."""
    parts = [detectors.detect(files, edges)]
    for d in extra:
        own = files.where(F.col("language").isin(*d.languages)) if d.languages else files
        parts += [x for x in (d.per_file(own), d.across_files(own, edges)) if x is not None]
    return reduce(DataFrame.unionByName, parts)


class EmbeddingProvider(Protocol):
    """P3, S-4: vectors of texts; made once in each worker."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingProvider:
    """Words hashed to signed places of a vector of length one; needs no model and gives the same everywhere."""

    def __init__(self, dimension: int = 384) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[k, h % self.dimension] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def embed(df: DataFrame, text: str, provider: Callable[[], EmbeddingProvider] = HashingProvider, batch: int = 32, name: str = "embedding") -> DataFrame:
    """S-4: df with the vectors of a text column; the provider is made once for each worker's task, and nulls count as empty."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = provider()
        for texts in columns:
            vectors = [v for k in range(0, len(texts), batch) for v in own.embed(texts[k : k + batch].fillna("").tolist()).astype("float32").tolist()]
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return df.withColumn(name, run(text))


def search_with_fallback(keyword: Callable[[], DataFrame], vector: Callable[[], DataFrame] | None, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """S-5: keyword and vector hits together, or the keywords' alone where the provider fails; which of them it was."""
    found = keyword()
    if vector is None:
        return found, "keyword"
    try:
        return merge(found, vector()), "hybrid"
    except (RuntimeError, ValueError, OSError):
        return found, "keyword"


#: Domains by registries' categories (and starts of categories), topics and keywords.
CRATE_CATEGORIES = {
    "web-programming::http-client": "HTTP", "web-programming::http-server": "web framework", "web-programming::websocket": "web framework", "development-tools::debugging": "logging",
    "development-tools::testing": "testing", "encoding": "serialization", "parser-implementations": "serialization", "database": "database", "database-implementations": "database",
    "command-line-interface": "CLI", "command-line-utilities": "CLI", "asynchronous": "async runtime", "concurrency": "async runtime", "cryptography": "crypto", "authentication": "crypto",
}
CRATE_STARTS = {"web-programming": "web framework", "database": "database"}
KEYWORD_DOMAINS = {
    "HTTP": "http-client http rest-client rest fetch", "web framework": "web-framework framework web-server webapp web-app websocket wasm", "logging": "logging logger tracing observability telemetry log",
    "testing": "testing test mock mocking assertion test-framework tdd bdd", "serialization": "serialization deserialization serde json yaml toml protobuf msgpack encoding codec csv",
    "database": "database sql orm nosql mongodb postgres mysql sqlite redis", "CLI": "cli command-line terminal argument-parser args",
    "async runtime": "async async-runtime futures non-blocking concurrency tokio asyncio", "crypto": "crypto cryptography encryption hashing tls ssl security",
}


def category_domain(category: Column) -> Column:
    """The domain of a registry's category; nested ones by their start."""
    out = F.lit(None).cast("string")
    for name, domain in CRATE_CATEGORIES.items():
        out = F.coalesce(out, F.when(category == name, F.lit(domain)))
    for start, domain in CRATE_STARTS.items():
        out = F.coalesce(out, F.when(category.startswith(start), F.lit(domain)))
    return out


def keyword_domain(keyword: Column) -> Column:
    """The domain that a package's keyword speaks for."""
    out = F.lit(None).cast("string")
    for domain, words in KEYWORD_DOMAINS.items():
        out = F.coalesce(out, F.when(F.lower(keyword).isin(*words.split()), F.lit(domain)))
    return out


class RegistryClient(Protocol):
    """What a package registry says of a package, as JSON; whoever has a network provides one."""

    def fetch(self, package: str) -> str: ...


def parse_metadata(registry: str, body: str) -> dict:
    """SC19: name, description, keywords and categories out of a registry's answer; empty where it cannot be read."""
    try:
        data = json.loads(body)
    except ValueError:
        return {}
    if registry == "crates":
        c = data.get("crate") or {}
        return {"name": c.get("id"), "description": c.get("description"), "keywords": c.get("keywords") or [], "categories": c.get("categories") or []}
    if registry == "npm":
        return {"name": data.get("name"), "description": data.get("description"), "keywords": data.get("keywords") or [], "categories": []}
    info = data.get("info") or {}
    words = info.get("keywords") or ""
    return {"name": info.get("name"), "description": info.get("summary"), "keywords": [w for w in words.replace(",", " ").split()], "categories": info.get("classifiers") or []}


@dataclass
class Progress:
    """Steps of a scan, told to whoever listens."""

    listeners: list[Callable[[str, dict], None]] = field(default_factory=list)

    def tell(self, step: str, **facts: object) -> None:
        for listener in self.listeners:
            listener(step, facts)
