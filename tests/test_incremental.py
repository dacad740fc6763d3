"""Conventions by differences against a full recompute after random changes; a stream of changes; bursts of events."""

import random
import time

from pyspark.sql import functions as F

from conspectus.operators import relational as R
from conspectus.sources.store import TableStore
from conspectus.streaming import incremental

FINDINGS = "path string, detector string, description string, nature string, follows boolean, last_commit_date bigint"


def findings(r, path):
    return [(path, r.choice("xy"), r.choice("abc"), r.choice(["convention", "observation"]), r.random() < 0.6, r.choice([None, 1, 2, 3, 50])) for _ in range(r.randint(0, 5))]


def recomputed(spark, held):
    f = spark.createDataFrame([x for rows in held.values() for x in rows], FINDINGS)
    n = f.groupBy("detector", "description").agg(F.min("nature").alias("nature"), F.count("*").alias("total_count"), F.count_if("follows").alias("adoption_count"))
    return sorted(map(tuple, n.join(R.trend_by(f, ["detector", "description"], "last_commit_date", 100 * 86400), ["detector", "description"]).collect()), key=str)


def test_differences_equal_a_recompute(spark, tmp_path):
    r, held, state = random.Random(5), {}, incremental.ConventionState(TableStore(spark, str(tmp_path)))
    for step in range(5):
        changed = r.sample(range(30), 30 if not step else r.randint(1, 6))
        new = {f"f{k}": findings(r, f"f{k}") if step == 0 or r.random() < 0.7 else [] for k in changed}
        held |= new
        rows = spark.createDataFrame([x for v in new.values() for x in v], FINDINGS).coalesce(1)
        for _ in range(1 + (step == 2)):  # a change that is applied once more changes nothing
            state.apply(rows, spark.createDataFrame([(p,) for p in new], "path string").coalesce(1))
        got = sorted(map(tuple, state.conventions(100 * 86400).select("detector", "description", "nature", "total_count", "adoption_count", "p90", "trend").collect()), key=str)
        assert got == recomputed(spark, held)
    assert state.store.read("convention_counts").where("n <= 0").count() == 0
    some = spark.createDataFrame([("x", "a")], "detector string, description string")
    want = sorted({p for p, rows in held.items() for x in rows if x[1:3] == ("x", "a")})[:20]
    assert (state.evidence(some).collect() or [None])[0] == (("x", "a", want) if want else None)


def test_stream_of_changes(spark, tmp_path):
    state = incremental.ConventionState(TableStore(spark, f"{tmp_path}/store"))
    detect = lambda paths: paths.select("path", F.lit("d").alias("detector"), F.substring("path", 1, 1).alias("description"), F.lit("convention").alias("nature"), F.lit(True).alias("follows"), F.lit(None).cast("bigint").alias("last_commit_date"))
    schema = "path string, ts timestamp, seq bigint, kind string"
    for k, rows in enumerate(([("a1", 1, "create"), ("a2", 2, "create"), ("b1", 3, "create")], [("a2", 4, "modify"), ("a1", 5, "modify"), ("a1", 6, "remove"), ("b2", 7, "create")])):
        spark.createDataFrame(rows, "path string, seq bigint, kind string").withColumn("ts", F.timestamp_seconds("seq")).select("path", "ts", "seq", "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.incremental_tier(stream, detect, state, f"{tmp_path}/checkpoint", once=True).awaitTermination()
        assert sorted((c.description, c.total_count) for c in state.conventions().collect()) == ([("a", 2), ("b", 1)], [("a", 1), ("b", 2)])[k]


def test_bursts_across_batches(spark, tmp_path):
    """Events of one path in several micro-batches give one, the last, when the path is quiet; another path's timer is its own."""
    schema, folder = "path string, ts timestamp, seq bigint, kind string", f"{tmp_path}/in"

    def send(*rows):
        spark.createDataFrame(rows, "path string, seq bigint, kind string").withColumn("ts", F.timestamp_seconds("seq")).select("path", "ts", "seq", "kind").coalesce(1).write.mode("append").parquet(folder)

    send(("a", 1, "create"), ("b", 1, "create"), ("a", 3, "modify"), ("a", 2, "modify"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = incremental.debounced(stream, 12_000).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        for k in (4, 5):
            time.sleep(2)
            send(("a", k, "modify"))
        deadline = time.time() + 120
        while time.time() < deadline and spark.table("quiet").count() < 2:
            time.sleep(0.5)
        found = sorted((x.path, x.seq, x.kind) for x in spark.table("quiet").collect())
        assert found == [("a", 5, "modify"), ("b", 1, "create")]
        send(("a", 6, "remove"))  # a new burst after the state has gone
        while time.time() < deadline and spark.table("quiet").count() < 3:
            time.sleep(0.5)
        assert sorted((x.path, x.seq) for x in spark.table("quiet").collect()) == [("a", 5), ("a", 6), ("b", 1)]
    finally:
        query.stop()
