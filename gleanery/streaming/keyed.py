"""Streams with state per key: rate limits and alert rules in event time, sessions that expire, and polling.

Rows of a key wait in its state until the watermark has passed them, and are then taken in order of time and id. So the result does not depend on
the order in which rows arrive within the watermark, and equals the batch form's. Timers end a key's state once nothing
in it can matter any more. Both operators need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "ms long, id long, duration double, outcome string"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store; streams that are already running keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``step`` in order of (ms, id), in groups of one ms, once the watermark has passed them.

    ``kept`` are the rows that later ones still need. A key has one timer: at its earliest waiting row, else at the time when nothing of it is needed.
    """

    #: Milliseconds for which a taken row is needed.
    span: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.kept = handle.getListState("waiting", EVENT), handle.getListState("kept", EVENT)

    def step(self, key: tuple, kept: list[tuple], peers: list[tuple]) -> tuple[list[tuple], list[Row]]:
        """What is kept from now on, and the output, for the rows of one ms."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self.waiting.appendList([(r.ms, r.id, r.duration, r.outcome) for r in rows])
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def _taken(self, key, mark: int) -> Iterator[Row]:
        every = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in every if r[0] <= mark]
        kept = [tuple(r) for r in self.kept.get()]
        for _, peers in groupby(ready, key=lambda r: r[0]):
            kept, out = self.step(key, kept, list(peers))
            yield from out
        later = every[len(ready) :]
        kept = [r for r in kept if r[0] + self.span > (later[0][0] if later else mark)]
        for state, rows in ((self.waiting, later), (self.kept, kept)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if later or kept:
            self.handle.registerTimer(later[0][0] if later else kept[-1][0] + self.span)


class Limiter(InOrder):
    """G-3: at most ``most`` allowed requests of a key in any ``span``; refused ones do not count."""

    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, seconds * 1000

    def step(self, key, kept, peers):
        out = []
        for r in peers:
            kept = [x for x in kept if x[0] + self.span > r[0]]
            ok = len(kept) < self.most
            if ok:
                kept.append(r)
            out.append(Row(id=r[1], allowed=ok))
        return kept, out


class Alerter(InOrder):
    """ST-1: rules over what a key did in the ``span`` up to each request, requests of the same ms included."""

    def __init__(self, rules: list[tuple[str, str, float]], seconds: int):
        self.rules, self.span = rules, seconds * 1000

    def step(self, key, kept, peers):
        kept = [x for x in kept if x[0] + self.span >= peers[0][0]] + peers
        took = sorted(x[2] for x in kept)
        share = lambda kind: round(sum(x[3] == kind for x in kept) / len(kept) * 1000 + 1e-9) / 1000
        value = {"error_rate_above": share("error"), "block_rate_above": share("blocked"), "latency_above": took[-(-95 * len(took) // 100) - 1]}
        return kept, [Row(id=r[1], name=name, condition=c, threshold=float(limit), value=float(value[c])) for r in peers for name, c, limit in self.rules if value[c] > limit]


def _keyed(events: DataFrame, late: str):
    """(key, ts, id, and duration and outcome if there are any), by key. A null key is a key like any other."""
    own = {c: F.col(c) if c in events.columns else F.lit(None) for c in ("duration", "outcome")}
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.select(F.coalesce(F.col("key").cast("string"), F.lit("\x00")).alias("key"), "ts", F.unix_millis("ts").alias("ms"), F.col("id").cast("long").alias("id"), F.coalesce(own["duration"].cast("double"), F.lit(0.0)).alias("duration"), own["outcome"].cast("string").alias("outcome")).groupBy("key")


def rate_limited(requests: DataFrame, most: int = 60, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """G-3 as a stream: (key, ts, id) -> id, allowed."""
    return _keyed(requests, late).transformWithState(Limiter(most, seconds), "id long, allowed boolean", "append", "eventTime")


def alerts(requests: DataFrame, rules: list[tuple[str, str, float]], seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """ST-1 as a stream: (key, ts, id, duration, outcome) and rules (name, condition, threshold) -> id, name, condition, threshold, value of each rule that a
    request sets off. Conditions: error_rate_above, block_rate_above, latency_above (95th percentile, nearest rank)."""
    return _keyed(requests, late).transformWithState(Alerter(rules, seconds), "id long, name string, condition string, threshold double, value double", "append", "eventTime")


def alerts_of(requests: DataFrame, rules: list[tuple[str, str, float]], seconds: int = 300) -> DataFrame:
    """The same in batch."""
    from pyspark.sql import Window as W

    w = W.partitionBy("key").orderBy("ms").rangeBetween(-seconds * 1000, 0)
    e = requests.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    n = F.count("*").over(w)
    share = lambda kind: F.floor(F.sum((F.coalesce(F.col("outcome"), F.lit("")) == kind).cast("int")).over(w) / n * 1000 + 1e-9 + 0.5) / 1000
    took = F.sort_array(F.collect_list(F.coalesce(F.col("duration").cast("double"), F.lit(0.0))).over(w))
    e = e.select("id", share("error").alias("error_rate_above"), share("blocked").alias("block_rate_above"), F.element_at(took, F.ceil(n * 95 / 100).cast("int")).alias("latency_above"))
    out = None
    for name, c, limit in rules:
        one = e.filter(F.col(c) > limit).select("id", F.lit(name).alias("name"), F.lit(c).alias("condition"), F.lit(float(limit)).alias("threshold"), F.col(c).alias("value"))
        out = one if out is None else out.union(one)
    return out


def expired_sessions(turns: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """C-7 as a stream, and in batch: (key, ts) -> key, began, last_seen, n of sessions that saw nothing for ``gap``. State is one row per open session."""
    e = turns.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy("key", F.session_window("ts", gap)).agg(F.min("ts").alias("began"), F.max("ts").alias("last_seen"), F.count("*").alias("n")).select("key", "began", "last_seen", "n")


class Poller:
    """ST-3: calls ``tick`` every so often, never two at once, and counts how it went. An error of a tick is kept in ``status`` and the next one comes.

    Each call is a micro-batch, so that what runs, fails or lags is seen where other streams are.
    """

    def __init__(self, spark: SparkSession, tick: Callable[[], object]):
        self.spark, self.tick, self.query = spark, tick, None
        self.status = {"runs": 0, "successes": 0, "failures": 0, "last_run_at": None, "last_success_at": None, "last_error_at": None, "last_error": ""}

    def run_now(self) -> None:
        s = self.status
        s["runs"] += 1
        s["last_run_at"] = time.time()
        try:
            self.tick()
        except Exception as e:  # noqa: BLE001  whatever a tick raises is its result
            s["failures"] += 1
            s["last_error_at"], s["last_error"] = time.time(), str(e)
        else:
            s["successes"] += 1
            s["last_success_at"], s["last_error"] = time.time(), ""

    def start(self, checkpoint: str, seconds: float = 60) -> StreamingQuery:
        """At least a second apart; a poller that runs goes on."""
        if self.query is None or not self.query.isActive:
            clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            self.query = clock.writeStream.foreachBatch(lambda _, epoch: self.run_now()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1.0, seconds)} seconds").start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
