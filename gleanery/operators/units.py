"""G-11, G-13: which of equal learning units stays, and whether a security lesson blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import findings

SEGMENT = "key string, at long, records array<struct<confidence:double,severity:double,id:long,kept_confidence:double,kept_severity:double>>"


class Segment:
    """A stretch of a key's units in order, as what it does to a unit that comes before it.

    A unit is replaced by the next one that has more confidence or more severity. This is no order (each of two may replace the other), so
    that a stretch has to be known as a function: the first unit of it that beats what came before is one with more confidence or
    severity than all before it in the stretch. Only such units are kept (``records``), each with what becomes of it by the end of the stretch.
    """

    def __init__(self):
        self.records: list[tuple[float, float]] = []
        #: unit that is there now -> the records that have become it
        self.now: dict[tuple[int, float, float], list[int]] = {}
        self.most = (float("-inf"), float("-inf"))

    def add(self, i: int, confidence: float, severity: float) -> None:
        unit, beaten = (i, confidence, severity), []
        for held in [u for u in self.now if confidence > u[1] or severity > u[2]]:
            beaten += self.now.pop(held)
        if confidence > self.most[0] or severity > self.most[1]:
            beaten.append(len(self.records))
            self.records.append((confidence, severity))
            self.most = max(self.most[0], confidence), max(self.most[1], severity)
        if beaten:
            self.now.setdefault(unit, []).extend(beaten)

    def rows(self) -> list[dict]:
        became = {k: u for u, ks in self.now.items() for k in ks}
        return [{"confidence": c, "severity": s, "id": became[k][0], "kept_confidence": became[k][1], "kept_severity": became[k][2]} for k, (c, s) in enumerate(self.records)]


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, key, now, out = TaskContext.get().partitionId(), None, None, []
    for pdf in batches:
        for k, i, c, s in zip(pdf["key"], pdf["id"], pdf["confidence"], pdf["severity"], strict=True):
            if k != key:
                if now is not None:
                    out.append((key, part, now.rows()))
                key, now = k, Segment()
            now.add(i, c, s)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "records"])
            out = []
    if now is not None:
        yield pd.DataFrame([(key, part, now.rows())], columns=["key", "at", "records"])


def _folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """A key's segments one after another: as many as range partitions that it reaches into."""
    held = None
    for records in pdf.sort_values("at")["records"]:
        for r in records:
            if held is None or r["confidence"] > held[1] or r["severity"] > held[2]:
                held = (r["id"], r["kept_confidence"], r["kept_severity"])
                break
    return pd.DataFrame([(pdf["key"].iloc[0], held[0])], columns=["key", "id"])


def better(units: DataFrame, *keys: str) -> DataFrame:
    """G-11: units (id, ord, confidence, severity and the ``keys`` that make units equal: compared without case and with single spaces) -> key, id of the one
    that stays when they are taken by ord (ties by id), each replacing the one before if it has more confidence, or else more severity.

    A key is never one task's: rows are sorted in ranges of (key, ord), each range becomes a segment, and only segments meet. Values that are missing count as 0.
    """
    key = F.concat_ws("::", *[F.lower(T.compact(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys])
    u = units.select(key.alias("key"), "ord", F.col("id").cast("long").alias("id"), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("confidence", "severity")])
    order = ["key", "ord", "id"]
    s = u.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "id", "confidence", "severity").mapInPandas(_segments, SEGMENT)
    return s.groupBy("key").applyInPandas(_folded, "key string, id long")


#: Evidence of a critical risk in a text, critical risks, how sure a recovered unit must be, and the enforcement that may block.
EVIDENCE = [
    "-----begin\\s+(rsa|ec|private)\\s+key-----", "\\b(api[_-]?key|secret[_-]?key|private[_-]?key|access[_-]?token)\\b", "\\b(ignore\\s+previous\\s+instructions|prompt\\s+injection)\\b",
    "\\b(yaml\\.load|objectinputstream|deserialize)\\b", "\\b(exec\\(|spawn\\(|os\\.system|popen)\\b", "\\b(\\.\\.\\/|path\\s+traversal|directory\\s+traversal)\\b",
    "\\b(auth(?:entication|orization)?\\s+bypass|broken\\s+access\\s+control)\\b",
]
#: What a text must hold, in lower case, for a pattern of EVIDENCE to be tried at all.
_EVIDENCE_HINTS = [("-----begin",), ("key", "access"), ("ignore", "prompt"), ("yaml.load", "objectinputstream", "deserialize"), ("exec(", "spawn(", "os.system", "popen"), ("../", "traversal"), ("bypass", "broken")]
CRITICAL = ["secrets-exposure", "prompt-injection-executable", "insecure-deserialization", "auth-bypass", "path-traversal", "command-injection"]
SURE, ENFORCEMENT, LEAST_HITS = 0.78, "warn-block-critical", 2


def evidence(text: str, low: str) -> Column:
    """Whether a text (a column, and it in lower case) holds any of EVIDENCE; a pattern is tried only where one of its hints is found."""
    out = F.lit(False)
    for p, hints in zip(EVIDENCE, _EVIDENCE_HINTS, strict=True):
        hint = F.lit(False)
        for h in hints:
            hint = hint | F.contains(low, F.lit(h))
        out = out | (hint & F.rlike(text, F.lit("(?i)" + T.ascii_edges(p))))
    return out


def teaching(requests: DataFrame, recovered: DataFrame | None = None, enforcement: str = ENFORCEMENT) -> DataFrame:
    """G-13: requests (id, mode, text) and units ``recovered`` for them (id, risk, critical, confidence) -> id, enabled, risk, critical, blocked, reason.

    Nothing is said with mode off, nor with auto and no risk in the text; with mode on, a text without one counts as a misconfiguration. A critical
    risk blocks on evidence in the text, or if a sure unit about it was recovered; with auto that takes two of the risk's keywords in the text as well.
    """
    top = findings.risk_ranks(requests.select("id", "text")).filter("rank = 1").select("id", "risk", "hits")
    r = requests.select("id", F.coalesce("mode", F.lit("auto")).alias("mode"), T.compact(F.col("text")).alias("text")).withColumn("low", F.lower("text"))
    r = r.select("id", "mode", evidence("text", "low").alias("evidence")).join(top, "id", "left")
    r = r.withColumn("found", F.col("risk").isNotNull()).withColumn("risk", F.coalesce("risk", F.lit(findings.OTHER_RISK)))
    if recovered is not None:
        m = recovered.filter(F.col("critical") & (F.coalesce("confidence", F.lit(0.0)) >= SURE)).select("id", F.nullif(F.lower(F.trim("risk")), F.lit("")).alias("of"))
        m = m.groupBy("id").agg(F.max(F.col("of").isNull()).alias("sure"), F.collect_set("of").alias("of"))
        r = r.join(m, "id", "left").withColumn("sure", F.col("sure") | F.array_contains("of", F.col("risk")))
    else:
        r = r.withColumn("sure", F.lit(False))
    sure = F.coalesce("sure", F.lit(False))
    enabled = (F.col("mode") != "off") & (F.col("found") | (F.col("mode") != "auto"))
    critical = enabled & F.col("risk").isin(CRITICAL)
    block = critical & F.lit(enforcement == ENFORCEMENT) & (F.col("evidence") | (sure & ((F.col("mode") == "on") | (F.coalesce("hits", F.lit(0)) >= LEAST_HITS))))
    reason = F.when(block, F.concat(F.lit("critical-security-risk:"), "risk")).when(enabled & F.col("found"), F.concat(F.lit("security-advisory:"), "risk")).otherwise("")
    return r.select("id", enabled.alias("enabled"), F.when(enabled, F.col("risk")).alias("risk"), critical.alias("critical"), block.alias("blocked"), reason.alias("reason"))
