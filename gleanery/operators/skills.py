"""M-3, M-4: whether drafted skills are sound and have helped, by what was recorded of their task before and after they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Lines that are no task (quick switches, navigation and its prefixes, commands that need an argument), and what hides a secret in a task.
QUICK = ["r", "t", "m", "d", "s", "1", "2", "3", "4", "5"]
NAVIGATION = ["help", "exit", "quit", "q", "status", "clear", "cls"]
PREFIXES = ["tab ", "set "]
BARE = ["recall", "teach", "remember", "doctor", "select"]
SECRET = "(?i)(sk-[a-z0-9]{16,}|ghp_[a-z0-9]{16,}|eyj[a-z0-9_-]{10,}\\.[a-z0-9_-]{10,}\\.[a-z0-9_-]{10,})"
#: Commands that are known to be safe, and patterns of tasks that are not.
SAFE = ["recall", "teach", "remember", "doctor", "select", "readme", "sync-knowledge", "ingest-security", "close"]
DANGEROUS = [
    "\\brm\\s+-rf\\b", "\\bdel\\s+\\/[a-z]", "\\bformat\\s+[a-z]:", "\\bshutdown\\b", "\\breboot\\b", "\\bcurl\\b.*\\|\\s*(sh|bash)", "\\b(wget|irm|invoke-webrequest)\\b.*\\|\\s*(iex|sh|bash)",
    "\\b(iex|invoke-expression)\\b", "\\bgit\\s+push\\s+--force\\b", "\\bgit\\s+reset\\s+--hard\\b", "\\bnpm\\s+publish\\b", "\\bsc\\s+delete\\b", "\\breg\\s+add\\b",
]
#: Sections of a skill's file, and what is asked of it: runs, and improvements of tokens, time and errors.
SECTIONS = ["## Trigger", "## Suggested workflow", "## Validation checklist", "## Promotion checklist"]
LEAST = {"runs": 3, "token": 0.2, "duration": 0.25, "error": 0.3}
LONGEST = 180


def task(line: Column) -> Column:
    """A task's line: one space between words, lower case, without a leading slash, quotes and secrets; empty if it is no task."""
    low = F.lower(T.compact(line))
    bare = F.regexp_replace(low, "^/", "")
    clean = T.compact(F.regexp_replace(F.regexp_replace(bare, "[\"']", ""), SECRET, "[redacted]"))
    away = low.isin(QUICK) | bare.isin(NAVIGATION) | F.startswith(bare, F.lit(PREFIXES[0])) | F.startswith(bare, F.lit(PREFIXES[1])) | clean.isin(BARE)
    return F.when(away, "").otherwise(clean)


def command(normal: Column) -> Column:
    first = F.get(F.split(normal, " "), F.lit(0))
    return F.when(first.isin(SAFE), first).otherwise("unknown")


def health(normal: Column) -> Column:
    """M-4: reasons against a normalised task, in order; none if it is sound."""
    words = F.size(F.split(normal, " "))
    danger = F.lit(None).cast("string")
    for p in reversed(DANGEROUS):
        danger = F.when(F.rlike(normal, F.lit(T.ascii_edges(p))), f"dangerous-pattern:{p}").otherwise(danger)
    return F.array_compact(F.array(
        F.when(normal == "", "empty-or-navigation-task"), F.when(F.length(normal) > LONGEST, "task-too-long"), F.when(words < 2, "task-too-short"), danger,
        F.when((command(normal) == "unknown") & (words < 3), "unknown-command-low-signal"),
    ))


def _missing(markdown: Column) -> Column:
    """Sections that a skill's file lacks."""
    each = [F.when(~F.contains(markdown, F.lit(s)), "missing-section:" + s.removeprefix("## ").lower().replace(" ", "-")) for s in SECTIONS]
    return F.when(F.coalesce(markdown, F.lit("")) == "", F.array(F.lit("missing-skill-file"))).otherwise(F.array_compact(F.array(*each)))


def promoted(skills: DataFrame, telemetry: DataFrame, tokens: bool = True, **least: float) -> DataFrame:
    """M-3: drafts (name, task, created, markdown) and telemetry (task, at, duration, exit_code, used_tokens) -> name, runs, the improvements of
    duration, error and tokens, decision (promoted-experimental or hold) and reasons.

    Before and after are windows around each draft's own time, which belongs to both. They are two conditional aggregates over one join by task, which Spark
    sums within tasks before the shuffle. A mean without values, or one of 0 before, gives no improvement, which is a reason to hold.
    """
    want = LEAST | least
    s = skills.select("name", task(F.col("task")).alias("task"), F.col("created").cast("timestamp").alias("created"), "markdown")
    e = telemetry.select(task(F.col("task")).alias("task"), F.col("at").cast("timestamp").alias("at"), "duration", (F.col("exit_code") != 0).alias("failed"), "used_tokens")
    j = s.select("name", "task", "created").join(e, "task", "left")
    was, now = F.col("at") <= F.col("created"), F.col("at") >= F.col("created")
    three = lambda x: F.round(x, 3)
    side = lambda cond, k: [
        F.count_if(cond).alias(f"n{k}"), three(F.avg(F.when(cond, F.col("duration")))).alias(f"duration{k}"), three(F.avg(F.when(cond, F.col("failed").cast("double")))).alias(f"error{k}"), three(F.avg(F.when(cond, F.col("used_tokens")))).alias(f"token{k}")
    ]
    g = j.groupBy("name").agg(*side(was, 0), *side(now, 1))
    gain = lambda k: three(F.when(F.col(f"{k}0") > 0, (F.col(f"{k}0") - F.col(f"{k}1")) / F.col(f"{k}0"))).alias(k)
    x = s.join(g.select("name", F.col("n1").alias("runs"), gain("duration"), gain("error"), gain("token")), "name")
    low = lambda k: F.when(F.coalesce(F.col(k) < want[k], F.lit(True)), f"{k}-improvement-below-threshold")
    told = F.array_compact(F.array(F.when(F.col("runs") < want["runs"], F.concat(F.lit("insufficient-runs:"), F.col("runs").cast("string"), F.lit(f"/{want['runs']}"))), low("duration"), low("error"), low("token") if tokens else F.lit(None)))
    reasons = F.concat(health(F.col("task")), _missing(F.col("markdown")), told)
    return x.select("name", "runs", "duration", "error", "token", F.when(F.size(reasons) == 0, "promoted-experimental").otherwise("hold").alias("decision"), F.array_join(reasons, ",").alias("reasons"))
