"""Streams with state against their batch forms, whatever the order of files."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleanery.operators import conversations
from gleanery.streaming import keyed as K

LATE = "2 hours"
SCHEMA = "key string, ts timestamp, id long, duration double, outcome string"


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").filter("user_id < 40").select(
        F.when(F.col("user_id") % 13 == 0, None).otherwise(F.col("user_id") % 9).cast("string").alias("key"), F.date_trunc("minute", "ts").alias("ts"), F.col("event_id").alias("id"),
        (F.col("value") % 50).alias("duration"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "blocked").otherwise("ok").alias("outcome"),
    )


@pytest.fixture(scope="module", params=[1, 2])
def stream(spark, sf, tmp_path_factory, request):
    """Events in files of about an hour's disorder each, read one by one, and the last moment that the watermark passes."""
    K.use_rocksdb(spark)
    rows = events(spark, sf).collect()
    rng = random.Random(request.param)
    rows.sort(key=lambda r: r.ts.timestamp() + rng.random() * 3500)
    folder = tmp_path_factory.mktemp(f"events{request.param}")
    step = -(-len(rows) // 4)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in order of their time
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return read, max(r.ts for r in rows).timestamp() - 7200


def result(df, tmp_path, name):
    out, check = str(tmp_path / name), str(tmp_path / f"{name}-state")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.read.parquet(out)


def test_rate_limits(spark, sf, stream, tmp_path):
    read, mark = stream
    e = events(spark, sf)
    got = sorted(tuple(r) for r in result(K.rate_limited(read, 2, 3600, LATE), tmp_path, "limits").collect())
    seconds = e.select("id", F.coalesce("key", F.lit("\x00")).alias("user"), F.col("ts").cast("long").alias("second"))
    want = sorted(tuple(r) for r in conversations.rate_limited(seconds, 2, 3600).join(e.filter(F.col("ts").cast("double") <= mark).select("id"), "id").collect())
    assert got == want and {ok for _, ok in got} == {True, False} and len(got) > 50


def test_alerts(spark, sf, stream, tmp_path):
    read, mark = stream
    rules = [("errors", "error_rate_above", 0.3), ("slow", "latency_above", 40), ("blocked", "block_rate_above", 0.4)]
    e = events(spark, sf)
    got = sorted((r.id, r.name, r.threshold, round(r.value, 6)) for r in result(K.alerts(read, rules, 7200, LATE), tmp_path, "alerts").collect())
    batch = K.alerts_of(e.withColumn("key", F.coalesce("key", F.lit("\x00"))), rules, 7200).join(e.filter(F.col("ts").cast("double") <= mark).select("id"), "id")
    assert got == sorted((r.id, r.name, r.threshold, round(r.value, 6)) for r in batch.collect()) and {g[1] for g in got} == {"errors", "slow", "blocked"}


def test_sessions(spark, sf, stream, tmp_path):
    read, mark = stream
    got = sorted(tuple(map(str, r)) for r in result(K.expired_sessions(read, "6 hours", LATE), tmp_path, "sessions").collect())
    want = sorted(tuple(map(str, r)) for r in K.expired_sessions(events(spark, sf), "6 hours").collect() if r.last_seen.timestamp() + 6 * 3600 <= mark)
    assert got == want and got


def test_limiter_by_hand():
    """Windows are open at their end; a refused request leaves no trace; state ends."""
    k = K.Limiter(2, 10)
    kept, out = k.step(("a",), [], [(0, 1, None, None), (0, 2, None, None), (0, 3, None, None)])
    assert [r.allowed for r in out] == [True, True, False] and len(kept) == 2
    kept, out = k.step(("a",), kept, [(9999, 4, None, None)])
    assert [r.allowed for r in out] == [False]
    kept, out = k.step(("a",), kept, [(10_000, 5, None, None)])
    assert [r.allowed for r in out] == [True] and kept == [(10_000, 5, None, None)]


def test_poller(spark, tmp_path):
    seen = []

    def tick():
        seen.append(1)
        if len(seen) == 2:
            raise ValueError("tick-failure")

    p = K.Poller(spark, tick)
    p.run_now()
    p.run_now()
    assert (p.status["runs"], p.status["successes"], p.status["failures"], p.status["last_error"]) == (2, 1, 1, "tick-failure")
    q = p.start(str(tmp_path / "poll"), 1)
    assert p.start(str(tmp_path / "poll"), 1) is q
    end = time.time() + 60
    while len(seen) < 4 and time.time() < end:
        time.sleep(0.2)
    p.stop()
    assert len(seen) >= 4 and p.status["last_error"] == "" and not q.isActive
