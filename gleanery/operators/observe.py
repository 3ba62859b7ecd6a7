"""Roll-ups, windows and alerts over traces, turns and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.text import nearest_second


def command_metrics(events: DataFrame) -> DataFrame:
    """A-2: (command, duration, failed, ts) per command."""
    return events.groupBy("command").agg(
        F.count("*").alias("runs"), F.count_if("failed").alias("degraded"), F.round(F.sum("duration"), 3).alias("total"), F.round(F.try_divide(F.count_if("failed"), F.count("*")), 3).alias("rate"),
        F.max_by("duration", F.struct("ts", "id")).alias("last"),
    )


def latency(events: DataFrame) -> DataFrame:
    """A-4: nearest-rank percentiles."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration)")
    return events.groupBy("command").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def trailing_requests(events: DataFrame, minutes: int = 5) -> DataFrame:
    """ST-1 in batch: requests and failures of the same user in the window before each event, by whole seconds to the nearest. Partitioned by user and so never one task."""
    w = W.partitionBy("user").orderBy(nearest_second(F.col("ts"))).rangeBetween(-60 * minutes, 0)
    return events.select("id", F.count("*").over(w).alias("n"), F.sum(F.col("failed").cast("int")).over(w).cast("long").alias("n_failed"))


def drift(daily: DataFrame, back: int = 8) -> DataFrame:
    """W-4, W-5: (at, kind, total): mean of the previous rows of the kind, spikes and levels."""
    w = W.partitionBy("kind").orderBy("at").rowsBetween(-back, -1)
    d = daily.withColumn("base", F.coalesce(F.avg("total").over(w), F.lit(0.0)))
    d = d.withColumn("spike", (F.col("base") > 0) & (F.col("total") >= 2 * F.col("base")) & (F.col("total") - F.col("base") >= 3))
    ratio = F.when(F.col("base") > 0, F.abs(F.col("total") - F.col("base")) / F.col("base")).otherwise(0.0)
    level = F.when(F.round(ratio, 4) >= 0.45, "critical").when((F.round(ratio, 4) >= 0.2) | F.col("spike"), "warning").otherwise("stable")
    return d.select("at", "kind", "total", F.round("base", 4).alias("baseline"), F.round(ratio, 4).alias("ratio"), "spike", level.alias("level"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """W-2, J-11: as a partial aggregate, which a frequent key doesn't slow down."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def versions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """W-3: version numbers and ids key@vN."""
    v = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("version", v).withColumn("version_id", F.concat(F.col(key).cast("string"), F.lit("@v"), F.col("version")))


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """W-6, W-10, W-14: the last n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")


def score_drops(rows: DataFrame, key: str, order: str, score: str, by: float = 0.1) -> DataFrame:
    """W-8: rows whose score fell by more than ``by`` from the one before."""
    d = rows.withColumn("previous", F.lag(score).over(W.partitionBy(key).orderBy(order)))
    return d.withColumn("rollback", F.coalesce(F.col("previous") - F.col(score) > by, F.lit(False)))


def mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A-10: most frequent value, the first seen of equal ones."""
    c = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return c.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("o"))).alias("m")).select(key, f"m.{value}", "m.n")


def entropy(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A-13, in bits."""
    c = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    total = c.groupBy(key).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return c.join(total, key).groupBy(key).agg(F.abs(F.round(-F.sum(p * F.log2(p)), 6)).alias("entropy"))


def turn_stats(turns: DataFrame) -> DataFrame:
    """A-14, C-6: (conv, role, text): turns, repeated turns, their share."""
    key = F.sha2(F.concat_ws(":", "role", F.lower("text")), 256)
    g = turns.groupBy("conv").agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"))
    return g.select("conv", "n", (F.col("n") - F.col("d")).alias("repeated"), F.round((F.col("n") - F.col("d")) / F.col("n"), 4).alias("redundancy"))


def context(turns: DataFrame, n: int = 6, most: int = 4000) -> DataFrame:
    """C-4, C-8: the last n turns of each conversation as text, cut to its tail."""
    t = last_n(turns, "conv", "turn", n)
    g = t.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return g.select("conv", F.size("t").cast("long").alias("n"), F.right(text, F.lit(most)).alias("context"))


#: Limits of the five checks on a report; a limit of 0 counts as none given.
ALERT_LIMITS = {"min_runs": 20, "blocked_rate": 0.25, "degraded_rate": 0.35, "recall_hit_rate": 0.15, "average_ms": 1500}


def alerts(report: DataFrame, **limits: float) -> DataFrame:
    """ST-4: (command, runs, blocked_rate, degraded_rate, recall_hit_rate, average_ms) -> command, whether each of the five checks passes, and status
    (alert or ok). Values that are missing or not finite count as 0."""
    most = ALERT_LIMITS | {k: v for k, v in limits.items() if v}
    value = lambda c: F.coalesce(F.when(F.abs(F.col(c)) < float("inf"), F.nanvl(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)) if c in report.columns else F.lit(0.0)
    checks = {"min_runs": value("runs") >= most["min_runs"], "recall_hit_rate": value("recall_hit_rate") >= most["recall_hit_rate"]}
    checks |= {c: value(c) <= most[c] for c in ("blocked_rate", "degraded_rate", "average_ms")}
    out = report.select("command", *[checks[c].alias(c) for c in ALERT_LIMITS])
    return out.withColumn("status", F.when(F.forall(F.array(*ALERT_LIMITS), lambda x: x), "ok").otherwise("alert"))


def trend(rows: DataFrame, order: str, score: str, n: int = 10) -> DataFrame:
    """W-7: the newest ``n`` scored rows (a report's limit)."""
    return rows.filter(F.col(score).isNotNull()).orderBy(F.desc(order)).limit(n)


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """W-13: (id, text) versions -> id, line, change by position."""
    lines = lambda d, c: d.select("id", F.posexplode(F.split("text", "\n")).alias("line", c))
    j = lines(before, "old").join(lines(after, "new"), ["id", "line"], "full_outer")
    return j.select("id", "line", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed").alias("change"))


def costs(calls: DataFrame) -> DataFrame:
    """A-7: (session, model, tokens, cost) per session and model, with the session's total."""
    m = calls.groupBy("session", "model").agg(F.count("*").alias("calls"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    return m.join(m.groupBy("session").agg(F.round(F.sum("cost"), 4).alias("session_cost")), "session")


def maturity(rows: DataFrame, key: str, least: int = 5) -> DataFrame:
    """A-18: (key, type, path, tag): .4 saturated count, .3 variety of types, .2 of paths, .1 density of tags."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"), F.countDistinct("path").alias("paths"), F.count("tag").alias("tags")).filter(F.col("n") >= least)
    cap = lambda c: F.least(F.lit(1.0), c)
    s = 0.4 * cap(F.log(F.col("n") + 1.0) / F.log(F.lit(51.0))) + 0.3 * cap(F.col("types") / 5) + 0.2 * cap(F.col("paths") / 10) + 0.1 * F.col("tags") / F.col("n")
    return g.select(key, "n", F.round(s, 6).alias("maturity"))


def repeated_tasks(rows: DataFrame, least: int = 3, most: int = 5, samples: int = 3) -> DataFrame:
    """A-16: normalised texts (id, text) that occur ``least`` times or more; the ``most`` frequent ones (a report's limit)."""
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    g = rows.groupBy(F.sha2(norm.cast("binary"), 256).alias("task")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return g.filter(F.col("n") >= least).orderBy(F.desc("n"), "first").limit(most).select("first", "n")


def drift_summary(drifts: DataFrame) -> DataFrame:
    """W-5: rows of ``drift`` -> samples, mean total and ratio, levels, spikes and the last level of each kind."""
    n = lambda level: F.count_if(F.col("level") == level).alias(level)
    return drifts.groupBy("kind").agg(F.count("*").alias("samples"), F.round(F.avg("total"), 3).alias("mean_total"), F.round(F.avg("ratio"), 4).alias("mean_ratio"), n("stable"), n("warning"), n("critical"), F.count_if("spike").alias("spikes"), F.max_by("level", "at").alias("last_level"))


def report(runs: DataFrame) -> DataFrame:
    """A-3: runs (duration, degraded, blocked, prevented, recalled, hit, selected, suppressed) -> totals and rates, in one row."""
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    n, tries, samples = F.count("*"), F.count_if("recalled"), F.count("selected")
    return runs.agg(
        n.alias("runs"), F.count_if("degraded").alias("degraded"), F.count_if("blocked").alias("blocked"), F.sum("prevented").alias("prevented"),
        rate(F.count_if("degraded"), n).alias("degraded_rate"), rate(F.count_if("blocked"), n).alias("blocked_rate"), rate(F.sum("duration"), n).alias("mean_duration"),
        tries.alias("recalls"), rate(F.count_if(F.col("recalled") & F.col("hit")), tries).alias("hit_rate"),
        rate(F.sum("selected"), samples).alias("mean_selected"), rate(F.sum("suppressed"), samples).alias("mean_suppressed"),
    )


def by_reason(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """A-3, S-15: rows per reason."""
    return rows.groupBy(reason).agg(F.count("*").alias("n"))


def agent_traces(traces: DataFrame) -> DataFrame:
    """A-5: (agent, phase, duration, failed) by agent and by phase, in one pass."""
    g = traces.groupingSets([["agent"], ["phase"]], "agent", "phase").agg(F.count("*").alias("runs"), F.round(F.sum("duration"), 3).alias("total"), F.count_if("failed").alias("failures"))
    return g.select(F.when(F.col("agent").isNotNull(), "agent").otherwise("phase").alias("of"), F.coalesce("agent", "phase").alias("name"), "runs", "total", "failures")


def improvement(telemetry: DataFrame) -> DataFrame:
    """A-17: (skill, before, after) -> means and improvement in percent; 0 without a baseline."""
    g = telemetry.groupBy("skill").agg(F.count("*").alias("n"), F.avg("before").alias("b"), F.avg("after").alias("a"))
    return g.select("skill", "n", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"), F.round(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.col("b")), F.lit(0.0)) * 100, 1).alias("improvement"))


def main_language(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """A-19: (key, path) -> key, language of most files by their endings, the first in alphabetical order of equal ones; unknown endings don't count."""
    names = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    f = files.select("key", names[F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))].alias("language")).filter("language IS NOT NULL")
    c = f.groupBy("key", "language").agg(F.count("*").alias("n"))
    low = c.groupBy("key").agg(F.max("n").alias("most")).join(c, "key").filter("n = most")
    return low.groupBy("key").agg(F.min("language").alias("language"), F.first("n").alias("n"))


def expired_sessions(turns: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """C-7: (conv, at) -> conv, last, expired: sessions without a turn for ``hours``."""
    g = turns.groupBy("conv").agg(F.max("at").alias("last"))
    return g.select("conv", "last", (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("last") > hours * 3600).alias("expired"))


def session_history(turns: DataFrame, most_chars: int = 400, n: int = 3) -> DataFrame:
    """I-15: (conv, turn, text) -> the last ``n`` turns; long texts are replaced by the name of a blob, their sha."""
    name = F.concat(F.lit("blob:"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16))
    t = turns.select("conv", "turn", F.when(F.length("text") > most_chars, name).otherwise(F.col("text")).alias("text"), (F.length("text") > most_chars).alias("spilled"))
    return last_n(t, "conv", "turn", n)


def blobs(turns: DataFrame, most_chars: int = 400) -> DataFrame:
    """I-15: the long texts, each once."""
    long = turns.filter(F.length("text") > most_chars)
    return long.select(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
