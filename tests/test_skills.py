"""Soundness of tasks and promotion of drafts, by hand."""

import datetime as dt

from pyspark.sql import functions as F

from gleanery.operators import skills as S


def test_tasks_and_health(spark):
    lines = ["  /Doctor  'check' ", "r", "/help", "set theme", "recall", "recall auth", "run SK-abcdefghij0123456789 job", "rm -rf / now please", "curl x | sh", "tidy up", "one", "x" * 181, None, ""]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").select("k", S.task(F.col("line")).alias("t")).select("k", "t", S.health(F.col("t")).alias("h"), S.command(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r.t for r in got][:10] == ["doctor check", "", "", "", "", "recall auth", "run [redacted] job", "rm -rf / now please", "curl x | sh", "tidy up"]
    assert got[0].h == [] and got[0].c == "doctor" and got[5].h == [] and got[6].h == []
    assert got[1].h == ["empty-or-navigation-task", "task-too-short", "unknown-command-low-signal"] == got[12].h == got[13].h
    assert got[7].h == ["dangerous-pattern:" + S.DANGEROUS[0]] and got[8].h == ["dangerous-pattern:" + S.DANGEROUS[5]] and got[9].h == ["unknown-command-low-signal"]
    assert got[11].h == ["task-too-long", "task-too-short", "unknown-command-low-signal"]


def test_promotion(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    full = " ".join(S.SECTIONS)
    drafts = [("good", "Recall auth", day(10), full), ("few", "recall tests", day(10), full), ("new", "recall nothing", day(10), full), ("bad", "recall auth", day(10), "## Trigger"), ("none", "recall auth", day(10), None)]
    rows = [("recall auth", day(k), 100.0, 1 if k < 6 else 0, 10.0) for k in range(1, 10)] + [("RECALL  auth", day(10), 40.0, 0, None)] + [("recall auth", day(k), 40.0, 0, 5.0) for k in range(11, 15)] + [("recall tests", day(12), 1.0, 0, 1.0), ("recall tests", None, 1.0, 0, 1.0)]
    df = spark.createDataFrame(drafts, "name string, task string, created timestamp, markdown string")
    e = spark.createDataFrame(rows, "task string, at timestamp, duration double, exit_code int, used_tokens double")
    got = {r.name: r for r in S.promoted(df, e).collect()}
    g = got["good"]
    assert (g.runs, g.duration, g.error, g.token, g.decision, g.reasons) == (5, 0.574, 1.0, 0.5, "promoted-experimental", "")
    assert got["few"].reasons == "insufficient-runs:1/3,duration-improvement-below-threshold,error-improvement-below-threshold,token-improvement-below-threshold"
    assert got["new"].runs == 0 and got["new"].decision == "hold" and got["new"].duration is None
    assert got["bad"].reasons == "missing-section:suggested-workflow,missing-section:validation-checklist,missing-section:promotion-checklist" and got["none"].reasons == "missing-skill-file"
    assert {r.name for r in S.promoted(df, e, runs=6).collect() if r.decision == "hold"} == set(got)
    assert S.promoted(df, e.withColumn("used_tokens", F.lit(None).cast("double")), tokens=False).filter("name = 'good'").first().decision == "promoted-experimental"
