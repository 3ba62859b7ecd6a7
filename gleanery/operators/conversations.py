"""Contradictions, retention and rate limits: operators on ordered turns and requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Words of claims: of refusal and of assent, words that a claim's key does without, words that make a sentence a claim.
NEGATIVE = [
    "no", "not", "never", "without", "sin", "off", "false", "disabled", "disable", "denied", "deny", "reject", "blocked", "bloqueado", "inactivo",
]
POSITIVE = [
    "yes", "enabled", "enable", "on", "true", "allow", "allowed", "active", "activo", "accept", "accepted",
]
STOPWORDS = [
    "a", "al", "an", "and", "are", "as", "at", "be", "by", "cada", "con", "de", "del", "el", "en", "es", "esta", "está", "for", "from", "in", "is",
    "la", "las", "los", "must", "para", "por", "que", "should", "the", "to", "un", "una", "with", "y",
]
SIGNALS = [
    "is", "are", "es", "esta", "está", "must", "should", "debe", "enabled", "disabled", "true", "false", "on", "off", "sin", "without", "con", "with",
    "no", "not",
]
#: Words of a key, least words of a sentence and of a key, characters of a sentence that count.
KEY_WORDS, LEAST_WORDS, LEAST_KEY, CLIP = 8, 3, 2, 220


def claims(turns: DataFrame) -> DataFrame:
    """(conv, turn, text) -> conv, turn, pos, key, polarity, value, unit: sentences that state something, or a number with a unit of time."""
    parts = F.filter(F.transform(F.split("text", "[.!?\n]+"), lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), lambda s: s != "")
    s = turns.select("conv", "turn", F.posexplode(parts).alias("pos", "s"))
    s = s.withColumn("s", T.compact(F.regexp_replace(F.regexp_replace("s", "^[-*]\\s+", ""), "^\\[[^\\]]+\\]\\s+", ""), CLIP)).withColumn("signal", T.numeric_signal(F.col("s")))
    w = F.filter(F.split(F.regexp_replace(F.lower("s"), "[^\\p{L}\\p{N}\\s]+", " "), "\\s+"), lambda x: x != "")
    s = s.select("conv", "turn", "pos", w.alias("w"), "signal").filter(F.size("w") >= LEAST_WORDS)
    has = lambda words: F.exists("w", lambda x: x.isin(words))
    key = F.slice(F.filter("w", lambda x: ~x.isin(STOPWORDS + NEGATIVE + POSITIVE) & ~F.rlike(x, F.lit("^\\d+$"))), 1, KEY_WORDS)
    s = s.filter(has(SIGNALS) | F.col("signal.value").isNotNull())
    s = s.select("conv", "turn", "pos", key.alias("k"), F.when(has(NEGATIVE), -1).when(has(POSITIVE), 1).otherwise(0).alias("polarity"), "signal.value", "signal.unit")
    return s.filter(F.size("k") >= LEAST_KEY).select("conv", "turn", "pos", F.array_join("k", " ").alias("key"), "polarity", "value", "unit")


def contradictions(turns: DataFrame) -> DataFrame:
    """C-5, J-10: pairs of an earlier and a later claim of a conversation with one key that conflict in polarity, or in value by the same unit."""
    c = claims(turns)
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.conv") == F.col("b.conv")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.turn") < F.col("b.turn")))
    polar = (F.col("a.polarity") * F.col("b.polarity")) < 0
    number = F.coalesce((F.col("a.value") != F.col("b.value")) & (F.col("a.unit") == F.col("b.unit")), F.lit(False))
    j = j.filter(polar | number)
    return j.select(F.col("a.conv").alias("conv"), F.col("a.key").alias("key"), F.col("a.turn").alias("earlier"), F.col("b.turn").alias("later"), F.when(polar, "polarity").otherwise("numeric").alias("kind")).distinct()


def retained(turns: DataFrame, every: int = 12, keep: int = 8, clip: int = 220, most: int = 8000) -> DataFrame:
    """C-2, C-3: after each ``every`` turns, all but the last ``keep`` go into a summary without repeats.

    One state machine per conversation, whose turns are few; conversations are spread over tasks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        live, summary, seen = [], [], set()
        for n, r in enumerate(pdf.sort_values("turn").itertuples(), 1):
            live.append(r)
            if n % every == 0 and len(live) > keep:
                for old in live[:-keep]:
                    line = f"{old.role}: {' '.join((old.text or '').split())[:clip]}"
                    if line.lower() not in seen:
                        seen.add(line.lower())
                        summary.append(line)
                live = live[-keep:]
        return pd.DataFrame({"conv": [pdf.conv.iloc[0]], "live": [len(live)], "summarised": [len(summary)], "summary": ["\n".join(summary)[-most:]]})

    return turns.groupBy("conv").applyInPandas(run, "conv long, live long, summarised long, summary string")


def budget_state(tokens: Column, window: int = 200_000, warn: int = 60_000, compact: int = 40_000, block: int = 10_000) -> Column:
    """C-1: state of a conversation by what is left of its window."""
    left = window - tokens
    return F.when(left <= block, "block").when(left <= compact, "compact").when(left <= warn, "warn").otherwise("ok")


def rate_limited(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """G-3: (id, user, second) -> id, allowed. At most ``most`` allowed requests of a user in any window; refused ones don't count.

    What is allowed depends on what was, so that a user's requests are one ordered pass. It is streamed in Arrow
    batches of a sorted partition, and only the open window is kept: a user with a third of all requests
    takes one task's time, but no memory. Requests without a user are one user's.
    """
    from collections import deque

    def run(batches):
        user, window = None, deque()
        for pdf in batches:
            ok = []
            for u, s in zip(pdf["user"], pdf["second"], strict=True):
                if u != user:
                    user, window = u, deque()
                while window and window[0] <= s - seconds:
                    window.popleft()
                ok.append(len(window) < most)
                if ok[-1]:
                    window.append(s)
            yield pd.DataFrame({"id": pdf["id"], "allowed": ok})

    user = F.coalesce(F.col("user").cast("string"), F.lit("\x00")).alias("user")
    ordered = requests.select("id", user, "second").repartition("user").sortWithinPartitions("user", "second", "id")
    return ordered.mapInPandas(run, "id long, allowed boolean")
