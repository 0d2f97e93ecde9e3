"""A stream over files gives what the batch operators give on the same rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import flows, signatures
from larkspur.session import table
from larkspur.streaming import sessions


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stream"))
    events = table(spark, "/root/testdata/sf0.001", "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.when(F.col("value") > 100, "HIGH").otherwise("LOW").alias("level"))
    for i, (low, high) in enumerate(((0, 300), (300, 700), (700, 10**9))):
        events.filter(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{at}/{i}")
    return at, events


def drained(spark, parts, build, mode, tmp_path):
    at, events = parts
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)
    name = f"out_{tmp_path.name}"
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_toxic_pairs(spark, parts, tmp_path):
    pairs = [(["view", "click"], ["purchase"], "A"), (["signup"], ["error"], "B")]
    got = drained(spark, parts, lambda s: sessions.toxic_pairs(s, pairs), "append", tmp_path)
    want = flows.adjacent(parts[1], pairs, order=("ts", "event_id"))
    assert got.count() == want.count() > 0


def test_signature_changes(spark, parts, tmp_path):
    got = drained(spark, parts, lambda s: sessions.signature_changes(s.withColumnsRenamed({"session_id": "tool_id", "tool": "signature"})), "append", tmp_path)
    want = signatures.statuses(parts[1], "session_id", "tool", ("ts", "event_id"))
    assert {(r.event_id, r.status) for r in got.collect()} == {(r.event_id, r.status) for r in want.collect()}


def test_rate_limit(spark, parts, tmp_path):
    got = drained(spark, parts, lambda s: sessions.rate_limit(s.withColumnRenamed("session_id", "client"), 2, 86400.0), "append", tmp_path)
    kept, want = {}, {}
    for r in parts[1].orderBy("ts", "event_id").collect():
        times = [t for t in kept.get(r.session_id, []) if t > r.ts.timestamp() - 86400.0]
        want[r.event_id] = len(times) < 2
        kept[r.session_id] = times + [r.ts.timestamp()] * want[r.event_id]
    assert {r.event_id: r.allowed for r in got.collect()} == want


def test_summaries(spark, parts, tmp_path):
    got = drained(spark, parts, lambda s: sessions.summaries(s), "update", tmp_path)
    assert got.groupBy("session_id", "start").agg(F.max("events").alias("n")).agg(F.sum("n")).first()[0] == parts[1].count()
