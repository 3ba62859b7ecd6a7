"""Input and output guards, redaction and sanitising."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import ascii_edges

#: Patterns of injections, personal data and secrets, with what replaces them.
INJECTIONS = [
    "(?i)ignore\\s+(all\\s+)?(previous|prior|above)\\s+(instructions?|prompts?|rules?)", "(?i)you\\s+are\\s+now\\s+(a|an|in)\\s+", "(?i)disregard\\s+(all\\s+)?(previous|prior|your)\\s+",
    "(?i)pretend\\s+(you\\s+are|to\\s+be|you're)\\s+", "(?i)act\\s+as\\s+(if|a|an|though)\\s+", "(?i)system\\s*:\\s*", "(?i)\\[INST\\]", "(?i)<<SYS>>", "(?i)```\\s*(system|assistant|user)\\s*",
    "(?i)('\\s*OR\\s+'|\\s+OR\\s+1\\s*=\\s*1|;\\s*DROP\\s+TABLE|UNION\\s+SELECT)", "(/\\*|\\*/|--\\s)", "\\.\\./", "\\x00", "\\\\u0000",
]
PII = [
    ("[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
    ("\\b\\d{3}-\\d{2}-\\d{4}\\b", "[REDACTED_SSN]"),
    ("\\b\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?\\d{4}\\b", "[REDACTED_CREDIT_CARD]"),
    ("(?:\\+?1[-.\\s]?)?(?:\\(?\\d{3}\\)?[-.\\s]?)?\\d{3}[-.\\s]?\\d{4}\\b", "[REDACTED_PHONE]"),
]
SECRETS = [
    "\\b(sk|pk)[-_](live|test|prod)?[A-Za-z0-9]{16,}\\b", "\\bAKIA[A-Z0-9]{16}\\b", "\\beyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9._-]{10,}\\.[A-Za-z0-9._-]{10,}\\b", "\\bghp_[A-Za-z0-9]{20,}\\b",
    "\\bgithub_pat_[A-Za-z0-9_]{20,}\\b", "\\bxox[baprs]-[A-Za-z0-9-]{10,}\\b", "(?:mongodb|postgres|mysql|redis|amqp)://[^\\s\"'`]+", "\\bBearer\\s+[A-Za-z0-9._-]{20,}\\b",
]
#: Redaction of assignments, keys and tokens, rebuilt from what tests of it expect: pattern and replacement, applied in order.
REDACTIONS = [
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY_BLOCK]"),
    ("\\beyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9._-]{10,}\\.[A-Za-z0-9._-]{10,}", "[REDACTED_JWT]"),
    ("(?i)\\b(password|passwd|secret|token|api_?key)(\\s*[:=]\\s*)[\"'][^\"'\\n]{6,}[\"']", "$1$2\"[REDACTED]\""),
    ("\\b(?:ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[A-Z0-9]{16}|sk-[A-Za-z0-9]{16,})", "[REDACTED_TOKEN]"),
]


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, F.lit(ascii_edges(p)))
    return out


def input_guard(rows: DataFrame, least: int = 3, most: int = 2000, blocked: list[str] | None = None) -> DataFrame:
    """G-1, G-2: (id, query) -> verdict and the rule that decided; the first blocking rule wins. Null counts as empty."""
    q = F.trim(F.coalesce("query", F.lit("")))
    words = F.lit(False)
    for w in blocked or []:
        words = words | F.contains(F.lower(q), F.lit(w.lower()))
    rule = F.when(F.length(q) < least, "too-short").when(F.length(q) > most, "too-long").when(_any(q, INJECTIONS), "injection").when(words, "keyword-block")
    return rows.select("id", F.when(rule.isNull(), "allow").otherwise("block").alias("verdict"), F.coalesce(rule, F.lit("")).alias("rule"))


#: What a text must hold for a pattern to be tried at all; cheap to look for.
_PII_HINTS = ["@", "[0-9]{3}-", "[0-9]{4}", "[0-9]{3}"]
_REDACTION_HINTS = ["-----BEGIN ", "eyJ", "[:=]\\s*[\"']", "ghp_|github_pat_|xox|AKIA|sk-"]
_SECRET_HINTS = [("sk-", "sk_", "pk-", "pk_"), ("AKIA",), ("eyJ",), ("ghp_",), ("github_pat_",), ("xox",), ("://",), ("Bearer",)]


def _hinted(text: Column, k: int) -> Column:
    return F.contains(text, F.lit("@")) if k == 0 else F.rlike(text, F.lit(_PII_HINTS[k]))


def redact_pii(text: Column) -> Column:
    """G-5, G-6: each pattern works on what the one before left."""
    for k, (pattern, to) in enumerate(PII):
        text = F.when(_hinted(text, k), F.regexp_replace(text, ascii_edges(pattern), to.replace("$", "\\$"))).otherwise(text)
    return text


def has_secret(text: Column) -> Column:
    """Any of the eight patterns; each is tried only where its first characters occur."""
    out = F.lit(False)
    for pattern, hints in zip(SECRETS, _SECRET_HINTS, strict=True):
        hint = F.lit(False)
        for h in hints:
            hint = hint | F.contains(text, F.lit(h))
        out = out | (hint & F.rlike(text, F.lit(ascii_edges(pattern))))
    return out


def output_guard(rows: DataFrame) -> DataFrame:
    """(id, text) -> blocked by a secret, personal data found per kind, and the redacted text's checksum."""
    count = lambda k: F.when(_hinted(F.col("text"), k), F.regexp_count("text", F.lit(ascii_edges(PII[k][0])))).otherwise(0).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(("email", "ssn", "card", "phone"))]
    out = rows.select("id", has_secret(F.col("text")).alias("blocked"), *counts, "text")
    for k in range(len(PII)):  # one projection each, so that no pattern runs twice
        pattern, to = PII[k]
        out = out.withColumn("text", F.when(_hinted(F.col("text"), k), F.regexp_replace("text", ascii_edges(pattern), to)).otherwise(F.col("text")))
    return out.select(*out.columns[:-1], F.md5(F.col("text").cast("binary")).alias("redacted_md5"))


def redact_secrets(text: Column) -> Column:
    """G-7. A pattern is tried only on texts with a hint of it; what replaces a secret begins and ends no hint, so that the text as it came tells."""
    as_it_came = text
    for (pattern, to), hint in zip(REDACTIONS, _REDACTION_HINTS, strict=True):
        text = F.when(F.rlike(as_it_came, F.lit(hint)), F.regexp_replace(text, ascii_edges(pattern), to)).otherwise(text)
    return text


#: Lines that address the model, and control tags.
ADDRESSED = ["system\\s*:", "ignore\\s+(?:previous|all|above)", "you\\s+are\\s+now", "disregard"]
CONTROL = "<\\|[^\\n]*?\\|>"


def sanitize(text: Column) -> Column:
    """G-20: lines that address the model, and control tags, become a mark."""
    t = F.coalesce(text, F.lit(""))
    for p in ADDRESSED:
        t = F.regexp_replace(t, f"(?i)(^|\\n)\\s*{p}[^\\n]*", "$1[SANITIZED]")
    return F.regexp_replace(t, CONTROL, "[SANITIZED]")


def scope_guard(rows: DataFrame, allowed_topics: list[str] = (), blocked_topics: list[str] = (), least_topics: int = 1, allowed_places: list[str] = (), blocked_places: list[str] = (), strict: bool = False) -> DataFrame:
    """G-2, domain-scope and jurisdiction: (id, query) -> verdict, rule. A blocked topic or place blocks; so do too few allowed topics;
    in strict mode a query that names no allowed place is warned of. The first block wins over any warning."""
    low = F.lower(F.coalesce("query", F.lit("")))
    held = lambda words: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    topic = (held(blocked_topics) > 0) | F.lit(bool(allowed_topics)) & (held(allowed_topics) < least_topics)
    place = held(blocked_places) > 0
    warn = F.lit(strict and bool(allowed_places)) & (held(allowed_places) == 0)
    rule = F.when(topic, "domain-scope").when(place, "jurisdiction").when(warn, "jurisdiction")
    return rows.select("id", F.when(topic | place, "block").when(warn, "warn").otherwise("allow").alias("verdict"), F.coalesce(rule, F.lit("")).alias("rule"))


#: Claims are numbers with a unit, of two characters or more, and dates.
CLAIM_NUMBER = "\\b\\d+(?:\\.\\d+)?(?:\\s*(?:%|percent|million|billion|thousand|dollars?|USD|EUR))?\\b"
CLAIM_DATE = "(?i)\\b(?:\\d{4}[-/]\\d{2}[-/]\\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{1,2}(?:,?\\s+\\d{4})?)\\b"


def claims(text: Column) -> Column:
    numbers = F.filter(F.regexp_extract_all(text, F.lit(ascii_edges(CLAIM_NUMBER)), F.lit(0)), lambda x: F.length(x) > 1)
    return F.concat(numbers, F.regexp_extract_all(text, F.lit(ascii_edges(CLAIM_DATE)), F.lit(0)))


def grounding(rows: DataFrame, most: int = 3) -> DataFrame:
    """G-6, hallucination-check: (id, text, sources) -> claims, claims that no source names, and whether they are too many."""
    loose = F.size(F.filter("claims", lambda c: ~F.contains(F.lower("sources"), F.lower(c)))).cast("long")
    out = rows.select("id", "sources", F.when(F.rlike("text", F.lit("[0-9]")), claims(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("claims"))
    return out.select("id", F.size("claims").cast("long").alias("n_claims"), loose.alias("ungrounded"), (loose > most).alias("warned"))


def length_check(text: Column, least: int = 10, most: int = 50_000) -> Column:
    """G-6, length-check: null for texts of a fitting length."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < least, "too-short").when(n > most, "too-long")


#: Keywords of the two domains that compact output may be held to.
DOMAIN_WORDS = {"security": ["security", "token", "auth", "authorization", "jwt", "secret"], "observability": ["observability", "metric", "trace", "dashboard", "alert", "logs"]}


def enforce(rows: DataFrame, secret_signal: bool = True, blocked_terms: list[str] = (), allowed_domains: list[str] = ()) -> DataFrame:
    """G-8: (id, text) -> action and reasons, in their order, comma-joined."""
    low = F.lower(F.coalesce("text", F.lit("")))
    reasons = []
    if secret_signal:
        reasons.append(F.when(F.rlike(low, F.lit(ascii_edges("sk-(?:live|test)-[a-z0-9]|\\b(?:api[_-]?key|authorization|bearer)\\b"))), "secret-signal-detected"))
    for term in (t.strip() for t in blocked_terms):
        if term:
            reasons.append(F.when(F.contains(low, F.lit(term.lower())), f"blocked-term:{term}"))
    if allowed_domains:
        for d, words in DOMAIN_WORDS.items():
            if d not in allowed_domains:
                hit = F.lit(False)
                for w in words:
                    hit = hit | F.contains(low, F.lit(w))
                reasons.append(F.when(hit, f"domain-scope-outside:{d}"))
    found = F.array_join(F.array_compact(F.array(*reasons)), ",") if reasons else F.lit("")
    return rows.select("id", F.when(found == "", "allow").otherwise("block").alias("action"), found.alias("reasons"))


def fixed_window_limits(requests: DataFrame, most: int = 30, seconds: int = 60) -> DataFrame:
    """G-4: (id, key, second) -> id, allowed. Windows of a key begin with its first request after the last window's end; ``most`` are allowed in each.

    A window's place depends on the one before, so that a key is one ordered pass, streamed in Arrow batches of a sorted partition; three numbers are kept.
    """

    def run(batches):
        key, start, n = None, 0, 0
        for pdf in batches:
            ok = []
            for k, s in zip(pdf["key"], pdf["second"], strict=True):
                if k != key or s - start >= seconds:
                    key, start, n = k, s, 0
                n += 1
                ok.append(n <= most)
            yield pd.DataFrame({"id": pdf["id"], "allowed": ok})

    ordered = requests.select("id", "key", "second").repartition("key").sortWithinPartitions("key", "second", "id")
    return ordered.mapInPandas(run, "id long, allowed boolean")


def audit_stats(log: DataFrame) -> DataFrame:
    """A-20, I-14: (blocked, modified, rules) -> name, n: totals, and how often each rule fired."""
    g = log.agg(F.count("*").alias("total"), F.count_if("blocked").alias("blocked"), F.count_if(~F.col("blocked") & F.col("modified")).alias("modified"), F.count_if(~F.col("blocked") & ~F.col("modified")).alias("passed"))
    totals = g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in g.columns])).alias("r")).select("r.*")
    return totals.union(log.select(F.explode("rules").alias("r")).groupBy(F.concat(F.lit("rule:"), F.col("r")).alias("name")).agg(F.count("*").alias("n")))
