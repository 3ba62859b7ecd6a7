"""Compliance, teaching answers, tasks, registries and logs: small rules over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Severities in their order, and the risk of each.
SEVERITIES = ["info", "warning", "error", "critical"]
RISK_LEVELS = ["low", "medium", "high", "critical"]
#: Sections of a teaching answer.
SECTIONS = ["change", "reason", "concepts", "practice"]
#: Failures of a memory provider, the first that fits.
FAILURES = [
    ("binary-missing", "enoent|cannot find|not recognized as an internal or external command"),
    ("timeout", "etimedout|timed out|timeout|killed|sigterm"),
    ("malformed-output", "malformed|parse|unexpected output|unexpected token|invalid format"),
]


def compliance(rows: DataFrame) -> DataFrame:
    """G-16: (id, n_rules, blocked_by, actions: array of (type, rule)) -> id, violations, risk, compliant. ``blocked_by`` is null for inputs that passed."""
    v = lambda rule, sev: F.struct(rule.alias("rule"), F.lit(sev).alias("level"))
    before = F.when((F.col("n_rules") == 0) & F.col("blocked_by").isNull(), v(F.lit("input-guard-bypass"), 1)).when(F.col("blocked_by") == "rate-limit", v(F.lit("rate-limit-triggered"), 0)).when(F.col("blocked_by").isNotNull(), v(F.concat(F.lit("input-blocked-"), "blocked_by"), 1))

    def after(a: Column) -> Column:
        out = F.when((a["type"] == "block") & (a["rule"] == "secret-leak"), v(F.lit("secret-leak-detected"), 3)).when((a["type"] == "redact") & (a["rule"] == "pii-redaction"), v(F.lit("pii-redacted"), 0))
        return out.when(a["type"] == "block", v(F.concat(F.lit("output-blocked-"), a["rule"]), 2)).when(a["type"] == "warn", v(F.concat(F.lit("output-warn-"), a["rule"]), 1))

    every = F.when(F.col("actions").isNull(), F.array(before)).otherwise(F.concat(F.array(before), F.transform("actions", after)))
    rows = rows.select("id", F.filter(every, lambda x: x["rule"].isNotNull()).alias("every"))
    every = F.col("every")
    level = F.array_position(F.transform(F.array(*map(F.lit, range(4))), lambda k: F.exists(every, lambda x: x["level"] >= k)), False)
    highest = F.when(level == 0, 4).otherwise(level - 1).cast("int")
    risk = F.when(F.size(every) == 0, "none").otherwise(F.get(F.array(*map(F.lit, RISK_LEVELS)), highest - 1))
    return rows.select("id", F.array_join(F.transform(every, lambda x: x["rule"]), ",").alias("violations"), risk.alias("risk"), risk.isin("none", "low").alias("compliant"))


def teaching(text: Column) -> Column:
    """M-1: (valid, missing, score) of an answer, by a header of any of four forms for each section."""
    def held(s: str) -> Column:
        return F.rlike(F.coalesce(text, F.lit("")), F.lit(f"(?i)#+\\s*{s}|\\*\\*{s}\\*\\*|\\d+\\)\\s*{s}")) | F.rlike(F.coalesce(text, F.lit("")), F.lit(f"(?im)^{s}\\s*:"))

    missing = F.array_compact(F.array(*[F.when(~held(s), s) for s in SECTIONS]))
    return F.struct((F.size(missing) == 0).alias("valid"), F.array_join(missing, ",").alias("missing"), ((len(SECTIONS) - F.size(missing)) / len(SECTIONS)).alias("score"))


def failure_kind(message: Column) -> Column:
    """R-24, the classifier."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for kind, pattern in reversed(FAILURES):
        out = F.when(F.rlike(low, F.lit(pattern)), kind).otherwise(out)
    return out


def highlights(text: Column, most: int = 5) -> Column:
    """M-6: bullets of eight characters or more, the first ``most``; without any, the first 220 characters."""
    bullets = F.filter(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\\r?\\n"), lambda x: F.rlike(F.trim(x), F.lit("^[-*]\\s+\\S"))), lambda x: T.compact(F.regexp_replace(F.trim(x), "^[-*]\\s+", ""))), lambda x: F.length(x) >= 8)
    whole = F.substring(T.compact(text), 1, 220)
    return F.when(F.size(bullets) > 0, F.slice(bullets, 1, most)).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def error_fingerprints(errors: DataFrame) -> DataFrame:
    """M-10: (run, tool, code, message) -> run, fingerprint: the sorted errors of a run, each cut to 60 characters of its message; and how often it came before."""
    e = F.concat_ws(":", "tool", F.coalesce("code", F.lit("")), F.substring("message", 1, 60))
    g = errors.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(e)), "|").alias("fingerprint"))
    n = g.groupBy("fingerprint").agg(F.count("*").alias("runs"))
    return g.join(n, "fingerprint").select("run", F.md5(F.col("fingerprint").cast("binary")).alias("fingerprint"), "runs")


def lint_errors(logs: DataFrame) -> DataFrame:
    """M-11: (id, text) of ``path(line,col): severity CODE: message`` lines -> id, path, line, severity, code, message."""
    p = "^(.+?)\\((\\d+),(\\d+)\\): (error|warning) (\\w+): (.*)$"
    x = logs.select("id", F.explode(F.filter(F.split("text", "\\r?\\n"), lambda s: F.rlike(s, F.lit(p)))).alias("s"))
    part = lambda k: F.regexp_extract("s", p, k)
    return x.select("id", part(1).alias("path"), part(2).cast("int").alias("line"), part(4).alias("severity"), part(5).alias("code"), part(6).alias("message"))


def coverage_gate(rows: DataFrame, least_ratio: float = 1.0, least_kinds: int = 1) -> DataFrame:
    """M-9: (id, required, covered arrays) -> id, ratio, missing, passed."""
    n = F.size("required")
    missing = F.array_except("required", "covered")
    ratio = F.when(n > 0, F.round((n - F.size(missing)) / n, 3)).otherwise(0.0)
    return rows.select("id", ratio.alias("ratio"), F.array_join(missing, ",").alias("missing"), ((n >= least_kinds) & (ratio >= least_ratio)).alias("passed"))


def first_success(attempts: DataFrame) -> DataFrame:
    """M-14: (run, ord, provider, ok) -> run, tried providers without repeats, the one that answered first (null for none)."""
    g = attempts.groupBy("run").agg(F.min_by(F.when(F.col("ok"), F.col("provider")), F.when(F.col("ok"), F.col("ord"))).alias("answered"), F.countDistinct("provider").alias("tried"))
    return g.select("run", "tried", "answered")


def retry_delay(attempt: Column, base: float = 500.0, factor: float = 2.0, most: float = 10_000.0) -> Column:
    """M-17: milliseconds before the next attempt, without jitter."""
    return F.least(F.lit(most), base * F.pow(F.lit(factor), attempt))


def permission(tool: Column, allowed: list[str], blocked: list[str], default: str = "allow") -> Column:
    """M-20: blocked tools first, then allowed ones, else the default."""
    return F.when(tool.isin(blocked), "deny").when(tool.isin(allowed), "allow").otherwise(default)


def layers(spans: DataFrame) -> DataFrame:
    """M-18: (trace, layer, ms) -> layer, spans, total and share of the time."""
    g = spans.groupBy("layer").agg(F.count("*").alias("spans"), F.sum("ms").alias("t"))
    total = g.agg(F.sum("t").alias("all"))
    return g.join(F.broadcast(total)).select("layer", "spans", F.round("t", 3).alias("total"), F.round(F.try_divide("t", "all"), 4).alias("share"))  # a row per layer, one row of totals


def axiom_block(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """M-2: (project, ord, type, title) -> project, text: titles under their types in the stated order, the first ``n`` of a project (a prompt's limit)."""
    from pyspark.sql import Window as W

    place = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    r = rows.withColumn("place", place).filter("place > 0").withColumn("_n", F.row_number().over(W.partitionBy("project").orderBy("ord"))).filter(F.col("_n") <= n)
    lines = F.array_sort(F.collect_list(F.struct("place", "ord", F.concat_ws(": ", "type", "title").alias("line"))))
    return r.groupBy("project").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def structural_match(exports: Column, dependencies: Column, surface: Column, imports: list[str], files: list[str], focus: list[str]) -> Column:
    """P-18: mean of the checks that apply: targets' imports among the exports, exports in focus, dependencies on target files, declared names in focus."""
    low = lambda a: F.transform(a, F.lower)
    words = F.array(*[F.lit(f.lower()) for f in focus]) if focus else F.array().cast("array<string>")
    none, one = F.lit(None).cast("double"), F.lit(1.0)
    n = lambda cond: sum((c.cast("int") for c in cond), F.lit(0))
    a = F.when(F.lit(bool(imports)) & (F.size(exports) > 0), F.least(one, n([F.array_contains(low(exports), i.lower()) for i in imports]) / max(len(imports), 1))).otherwise(none)
    b = F.when(F.lit(bool(focus)) & (F.size(exports) > 0), F.size(F.filter(low(exports), lambda x: F.array_contains(words, x))) / F.size(exports)).otherwise(none)
    near = lambda d: n([F.contains(F.lit(f), d) | F.contains(d, F.lit(f.rsplit(".", 1)[0])) for f in files]) > 0
    c = F.when(F.lit(bool(files)) & (F.size(dependencies) > 0), F.least(one, F.size(F.filter(dependencies, near)) / max(len(files), 1))).otherwise(none)
    d = F.when(F.lit(bool(focus)) & (F.size(surface) > 0), F.size(F.filter(low(surface), lambda x: F.array_contains(words, x))) / F.size(surface)).otherwise(none)
    parts = F.array_compact(F.array(a, b, c, d))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)).otherwise(0.0)


def search_output(outputs: DataFrame) -> DataFrame:
    """I-20: (id, text) of ``[n] #name (type) - title`` blocks -> id, n, name, type, title, body, project. The last line of a block with a bar is its metadata."""
    head = "^\\[(\\d+)\\]\\s+#(\\S+)\\s+\\(([^)]+)\\)\\s+-\\s+(.+)$"
    blocks = F.filter(F.split(F.concat(F.lit("\n"), "text"), "\\n(?=\\[\\d+\\]\\s+#)"), lambda b: F.rlike(b, F.lit("^\\[\\d+\\]\\s+#")))
    x = outputs.select("id", F.explode(blocks).alias("b")).select("id", F.filter(F.transform(F.split("b", "\\n"), lambda s: F.trim(s)), lambda s: s != "").alias("l"))
    first, rest = F.get("l", F.lit(0)), F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))
    meta = F.coalesce(F.get(rest, F.size(rest) - 1), F.lit(""))
    body = F.when(F.contains(meta, F.lit("|")), F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    project = F.trim(F.regexp_extract(meta, "(?i)project:\\s*([^|]+)", 1))
    part = lambda k: F.regexp_extract(first, head, k)
    return x.select("id", part(1).cast("int").alias("n"), part(2).alias("name"), part(3).alias("type"), part(4).alias("title"), F.array_join(body, " ").alias("body"), F.when(project == "", "global").otherwise(project).alias("project"))


def cleaned_tasks(tasks: DataFrame, as_of: str, hours: int = 1, most: int = 2000) -> DataFrame:
    """M-8: (id, status, ended, error) without finished tasks that ended more than ``hours`` ago; errors are clipped."""
    old = F.col("status").isin("completed", "failed", "killed") & (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("ended") > 3600 * hours)
    return tasks.filter(~F.coalesce(old, F.lit(False))).select("id", "status", F.substring("error", 1, most).alias("error"))
