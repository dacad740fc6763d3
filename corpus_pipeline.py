"""A training corpus from the documents table: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conspectus.llm.bpe import encode_bpe
from conspectus.llm.common import drop_folder, new_folder, table
from conspectus.llm.decontaminate import drop_leaks
from conspectus.llm.language_id import fit, keep_known
from conspectus.llm.minhash import STAGE, drop_near_duplicates
from conspectus.llm.substring_dedup import cut_passages, repeated_passages

#: Documents whose language is told with less than this are rejected; four languages at random have 0.25.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go; each row by its own text."""
    return keep_known(docs, fit(docs), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays."""
    return drop_near_duplicates(docs, b=STAGE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; n_chars follows the text."""
    cut = cut_passages(docs, repeated_passages(docs))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row by its own text."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return encode_bpe(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", decontaminate),
    ("byte_bpe", encode),
]

#: The stages are a fitted network, components and a tokenizer, which SQL cannot express; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            drop_folder(spark, before)
        before = folder
    return docs
