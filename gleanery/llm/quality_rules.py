"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of the vote patterns (at
most 3 ** rules of them, whatever the input) estimates how often a rule gives each vote on good and on
bad documents, without labels; its accuracy follows from that. The posterior probability of
good quality takes the place of a filter that all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENDINGS = ".!?"
MARKS = "!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"
GOOD, BAD, ABSTAIN = 1, -1, 0
ITERATIONS = 20
SMOOTHING = 0.5
#: Starting values: the share of good documents, and how a rule votes on good and on bad ones.
PRIOR = 0.8
START = {GOOD: (0.85, 0.7), ABSTAIN: (0.14, 0.1), BAD: (0.01, 0.2)}
KEEP = 0.5
#: Fixed value: the base test.
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

#: name, SQL condition of a bad vote, SQL condition of a good vote. All work on the counts below alone.
RULES = [
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("marks", "5 * n_marks > 2 * n_words", "10 * n_marks <= 3 * n_words"),
    ("bare_words", "20 * n_bare > n_words", "100 * n_bare <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines > 2"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    ("word_length", "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words", "10 * word_chars >= 35 * n_words AND word_chars <= 9 * n_words"),
    ("endings", "n_endings = 0 OR 2 * n_endings > n_words", "50 * n_endings >= n_words AND 3 * n_endings <= n_words"),
    ("variety", "10 * n_distinct < 2 * n_words AND n_words < 3000", "10 * n_distinct >= 4 * n_words"),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_endings", "n_marks", "n_distinct", "n_bare"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts (long) of each text.

    Repeated 3-word windows are found by sorting (64-bit hash of the window, place) in the row: nothing is
    shuffled, and the work on a text of n words is n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    d = docs.select("doc_id", text.alias("_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("_words"))
    n = F.size("_words")
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))
    lines = F.filter(F.split("_text", "\n"), lambda x: _without(x, SPACE) != "")
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(_without(F.col("_text"), SPACE)).cast("long").alias("word_chars"),
        *[(F.char_length("_text") - F.char_length(_without(F.col("_text"), c))).cast("long").alias(a) for a, c in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_endings", ENDINGS), ("n_marks", MARKS))],
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.size(F.filter("_words", lambda w: ~F.rlike(w, F.lit("\\p{L}")))).cast("long").alias("n_bare"),
        lines.alias("_lines"),
        F.when(n > 2, F.sort_array(hashed)).alias("_windows"),
    )
    found = F.filter("_windows", lambda x, k: (F.get("_windows", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("_windows", k - 1)["h"] == x["h"])))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    size = F.size("_lines").cast("long")
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (size - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_windows").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        size.alias("n_lines"),
        "n_upper",
        "n_endings",
        "n_marks",
        "n_distinct",
        "n_bare",
    )


def vote(bad: str, good: str) -> str:
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def ratio(shares: tuple[float, float]) -> float:
    return math.log(shares[0]) - math.log(shares[1])


def fit(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of good documents, and for each rule {vote: (share on good, share on bad documents)}.

    ``patterns``: the votes of all rules on documents that pass the base test, and how many documents have them. Each step is smoothed, so
    that votes that never occur keep a finite weight. Without documents the starting values stay.
    """
    prior, rules = PRIOR, [dict(START) for _ in RULES]
    total = sum(c for _, c in patterns)
    if not total:
        return prior, rules
    for _ in range(iterations):
        good = []
        for votes, c in patterns:
            x = math.log(prior / (1 - prior)) + sum(ratio(rules[j][v]) for j, v in enumerate(votes))
            good.append(c / (1 + math.exp(-max(-500.0, min(500.0, x)))))
        n_good = sum(good)
        n_bad = total - n_good
        prior = (n_good + SMOOTHING) / (total + 2 * SMOOTHING)
        for j in range(len(RULES)):
            for v in (GOOD, ABSTAIN, BAD):
                g = sum(q for (votes, _), q in zip(patterns, good, strict=True) if votes[j] == v)
                n = sum(c for votes, c in patterns if votes[j] == v)
                rules[j][v] = ((g + SMOOTHING) / (n_good + 3 * SMOOTHING), (n - g + SMOOTHING) / (n_bad + 3 * SMOOTHING))
    return prior, rules


def accuracy(prior: float, shares: dict[int, tuple[float, float]]) -> float:
    """How often a rule is right when it doesn't abstain."""
    right = prior * shares[GOOD][0] + (1 - prior) * shares[BAD][1]
    return right / (right + prior * shares[BAD][0] + (1 - prior) * shares[GOOD][1])


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """``docs`` (doc_id, text, and others that are not read) -> doc_id, the counts, a vote per rule, base_failed, quality, kept.

    One row per row of ``docs``. Null, empty and blank texts have no words, only abstentions, and fail
    the base test, as do all texts of fewer than 50 words. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    votes = [f"{vote(bad, good)} AS vote_{name}" for name, bad, good in RULES]
    names = [f"vote_{name}" for name, _, _ in RULES]
    counts = tables.table(counted(docs.select("doc_id", "text"))).selectExpr("*", *votes)
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in counts.filter(f"NOT ({FAILED})").groupBy(*names).count().collect()]
    prior, rules = fit(sorted(patterns))
    x = F.lit(math.log(prior / (1 - prior)))
    for name, shares in zip(names, rules, strict=True):
        x = x + F.when(F.col(name) == GOOD, ratio(shares[GOOD])).when(F.col(name) == BAD, ratio(shares[BAD])).otherwise(ratio(shares[ABSTAIN]))
    out = counts.withColumn("base_failed", F.expr(FAILED)).withColumn("quality", 1 / (1 + F.exp(-x)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def oracle() -> str:
    """The same in DuckDB: counts, votes, and each step of expectation-maximisation as a CTE."""
    names = [f"vote_{name}" for name, _, _ in RULES]
    case = {GOOD: "g", ABSTAIN: "a", BAD: "b"}
    col = lambda j, v: f"l{j}{case[v]}"
    llr = " + ".join(f"CASE {n} WHEN 1 THEN {col(j, GOOD)} WHEN -1 THEN {col(j, BAD)} ELSE {col(j, ABSTAIN)} END" for j, n in enumerate(names))
    start = ", ".join(f"{ratio(START[v])!r}::DOUBLE AS {col(j, v)}" for j in range(len(RULES)) for v in case)
    steps = [f"t0 AS (SELECT ln({PRIOR!r} / (1 - {PRIOR!r})) AS l, {start})"]
    for k in range(ITERATIONS):
        steps.append(f"q{k} AS MATERIALIZED (SELECT p.*, c / (1 + exp(-(l + {llr}))) AS g FROM patterns p, t{k})")
        s = SMOOTHING
        new = ", ".join(
            f"ln((coalesce(sum(g) FILTER ({n} = {v}), 0) + {s}) / (sum(g) + {3 * s})) - ln((coalesce(sum(c - g) FILTER ({n} = {v}), 0) + {s}) / (sum(c - g) + {3 * s})) AS {col(j, v)}" for j, n in enumerate(names) for v in case
        )
        steps.append(f"t{k + 1} AS MATERIALIZED (SELECT ln((sum(g) + {s}) / (sum(c - g) + {s})) AS l, {new} FROM q{k})")
    gone = lambda chars: f"length(text) - length(translate(text, '{chars}', ''))"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: translate(x, {space}, '') <> '') AS lines FROM d),
g AS (SELECT row_number() OVER () AS r, * FROM w),
e AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM g)),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM e) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counts AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(translate(text, {space}, ''))::BIGINT AS word_chars,
  ({gone(SYMBOLS)})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, {gone(UPPER)} AS n_upper, {gone(ENDINGS)} AS n_endings, {gone(MARKS)} AS n_marks, len(list_distinct(words)) AS n_distinct,
  len(list_filter(words, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) AS n_bare
  FROM g LEFT JOIN cov USING (r)),
v AS MATERIALIZED (SELECT *, {", ".join(f"{vote(b, a)} AS vote_{n}" for n, b, a in RULES)} FROM counts),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*)::DOUBLE AS c FROM v WHERE NOT ({FAILED}) GROUP BY ALL),
{", ".join(steps)},
j AS (SELECT v.*, ({FAILED}) AS base_failed, 1 / (1 + exp(-(l + {llr}))) AS quality FROM v, t{ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= {KEEP} AS kept FROM j"""
