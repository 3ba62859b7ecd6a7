"""Security findings: normalised records, risks, learning units, and the metrics of their pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Risks in their order: id, severity, keywords.
RISKS = [
    ("secrets-exposure", "critical", ["secret", "token", "apikey", "api-key", "credential", "password", "private key"]),
    ("prompt-injection-executable", "critical", ["prompt injection", "ignore previous", "system prompt", "tool execution", "execute command"]),
    ("insecure-deserialization", "critical", ["deserialization", "deserialize", "pickle", "yaml.load", "objectinputstream"]),
    ("auth-bypass", "critical", ["auth bypass", "authorization bypass", "missing auth", "broken access control"]),
    ("path-traversal", "critical", ["path traversal", "../", "directory traversal", "unsafe path"]),
    ("command-injection", "critical", ["command injection", "shell injection", "exec(", "spawn(", "os.system", "popen"]),
    ("sql-injection", "high", ["sql injection", "union select", "or 1=1", "raw query"]),
    ("xss", "high", ["xss", "cross-site scripting", "innerhtml", "unsanitized html"]),
    ("ssrf", "high", ["ssrf", "server-side request forgery", "internal metadata endpoint"]),
    ("weak-crypto", "medium", ["md5", "sha1", "weak crypto", "insecure cipher", "ecb"]),
    ("dependency-vulnerability", "medium", ["dependency", "vulnerability", "cve", "advisory", "supply chain"]),
]
WEIGHT = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.45}
OTHER_RISK = "security-misconfiguration"
#: JSON paths of each field of a finding, the first that holds something wins.
FIELDS = {
    "title": ["$.metadata.CheckTitle", "$.Title", "$.title"],
    "check": ["$.metadata.CheckID", "$.GeneratorId", "$.check_id"],
    "severity": ["$.metadata.Severity.value", "$.metadata.Severity.Label", "$.Severity.Label", "$.severity", "$.severity_label"],
    "status": ["$.status.value", "$.Compliance.Status", "$.status"],
    "number": ["$.severity_id", "$.Severity.Normalized"],
}


def field(json: Column, name: str) -> Column:
    """F-11: the first of the field's paths with a text that isn't blank, trimmed."""
    at = [F.get_json_object(json, p) for p in FIELDS[name]]
    return F.coalesce(*[F.when((F.trim(x) != "") & ~F.startswith(x, F.lit("{")), F.trim(x)) for x in at])


def severity_score(label: Column, number: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    out = F.when(F.contains(low, F.lit("critical")), 1.0).when(F.contains(low, F.lit("high")), 0.92).when(F.contains(low, F.lit("medium")), 0.78).when(F.contains(low, F.lit("low")), 0.62)
    out = out.when(F.contains(low, F.lit("info")), 0.45)
    return out.when(number >= 80, 0.9).when(number >= 50, 0.76).when(number > 0, 0.58).otherwise(0.5)


def normalised(findings: DataFrame, keep: str = "non-pass", first: int | None = None) -> DataFrame:
    """G-9, I-13: (id, ord, json) -> id, title, check, status class, severity score. ``keep``: all, fail or non-pass; a limit of
    ``first`` rows by ord, if there is one, is applied before (it is the operator's own)."""
    if first is not None:
        findings = findings.orderBy("ord").limit(first)
    j = F.col("json")
    status = F.lower(F.coalesce(field(j, "status"), F.lit("")))
    kind = F.when(status.isin("pass", "passed", "ok", "success"), "pass").when(status.isin("fail", "failed", "error"), "fail").otherwise("unknown")
    out = findings.select("id", F.coalesce(field(j, "title"), F.lit("untitled")).alias("title"), T.slug(F.coalesce(field(j, "check"), F.lit(""))).alias("check"), kind.alias("status"), severity_score(field(j, "severity"), field(j, "number").try_cast("double")).alias("severity"))
    return out if keep == "all" else out.filter("status = 'fail'" if keep == "fail" else "status <> 'pass'")


def _hits(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def risk_of(text: Column) -> Column:
    """G-10: the first risk of the list with a keyword in the text."""
    low = F.lower(T.compact(text))
    out = F.lit(OTHER_RISK)
    for name, _, words in reversed(RISKS):
        out = F.when(_hits(low, words) > 0, name).otherwise(out)
    return out


def risk_ranks(rows: DataFrame) -> DataFrame:
    """G-12: (id, text) -> id, risk, hits, score, rank: hits times the weight of the severity; ties by hits, severity and the order of the list."""
    low = rows.select("id", F.lower(T.compact(F.col("text"))).alias("low"))
    each = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("risk"), _hits(F.col("low"), words).alias("hits"), F.lit(WEIGHT[sev]).alias("weight")) for k, (name, sev, words) in enumerate(RISKS)]
    r = low.select("id", F.explode(F.filter(F.array(*each), lambda x: x["hits"] > 0)).alias("r")).select("id", "r.*")
    w = W.partitionBy("id").orderBy(F.desc("score"), F.desc("hits"), F.desc("weight"), "place")
    return r.withColumn("score", F.round(F.col("hits") * F.col("weight"), 4)).select("id", "risk", "hits", "score", F.row_number().over(w).alias("rank"))


def learning_units(chunks: DataFrame) -> DataFrame:
    """G-10: (id, content, priority, certainty, severity) -> id, risk, confidence, critical."""
    part = lambda c, x, none: F.coalesce(T.clamp(F.col(c)) * x, F.lit(none))
    some = lambda c, x, none: F.when(F.col(c).isNotNull(), part(c, x, none)).otherwise(none)
    confidence = T.clamp(F.lit(0.48) + some("priority", 0.28, 0.12) + some("certainty", 0.2, 0.1) + F.col("severity") * 0.18)
    risk = risk_of(F.col("content"))
    critical = [name for name, sev, _ in RISKS if sev == "critical"]
    return chunks.select("id", risk.alias("risk"), F.round(confidence, 6).alias("confidence"), (risk.isin(critical) | (F.col("severity") >= 1)).alias("critical"))


def accepted(units: DataFrame, least: float = 0.72) -> DataFrame:
    """G-15: (risk, confidence) rolled up: units, accepted ones, their mean confidence."""
    ok = F.col("confidence") >= least
    return units.groupBy("risk").agg(F.count("*").alias("units"), F.count_if(ok).alias("accepted"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def pipeline_metrics(chunks: DataFrame, selected: int, least_findings: int = 1, least_selected: int = 1, least_priority: float = 0.84) -> DataFrame:
    """A-21: (priority) -> findings, greatest priority, whether the gate passes."""
    g = chunks.agg(F.count("*").alias("included"), F.coalesce(F.max(F.coalesce("priority", F.lit(0.0))), F.lit(0.0)).alias("max_priority"))
    return g.select("included", "max_priority", ((F.col("included") >= least_findings) & F.lit(selected >= least_selected) & (F.col("max_priority") >= least_priority)).alias("passed"))


def security_summary(rows: DataFrame) -> DataFrame:
    """A-15: (project, risk, confidence) -> project, its risks, mean confidence."""
    return rows.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("risk")), ",").alias("risks"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
