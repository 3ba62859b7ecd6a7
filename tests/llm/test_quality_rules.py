import re
from collections import Counter

import duckdb

from gleanery.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\x0c\r "),
    (4, "a b c a b c d"),
    (5, "a a a a"),
    (6, "x y 　z\nline\nline\n line\nline"),
    (7, "é#*$ 😀 %&|<>"),
    (7, "é#*$ 😀 %&|<>"),
    (None, "one two three " * 40),
    (9, "w%d " * 1 % 3 + " ".join(f"w{i}" for i in range(200_000)) + " w0 w1 w2"),
]


def test_counts(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n_words int")
    out = Q.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((d, *plain(t))) for d, t in ROWS)
    assert Q.judge(df.limit(0)).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


def test_em_finds_the_accuracies():
    patterns = Counter()
    import random

    rng = random.Random(8)
    right = [0.95, 0.9, 0.85, 0.8, 0.95, 0.9, 0.85, 0.8, 0.9]
    truth = []
    for _ in range(6000):
        y = rng.random() < 0.7
        votes = tuple(Q.ABSTAIN if rng.random() < 0.2 else (1 if (rng.random() < a) == y else -1) for a in right)
        patterns[votes] += 1
        truth.append((y, votes))
    prior, rules = Q.fit(sorted(patterns.items()), 50)
    assert abs(prior - 0.7) < 0.03
    assert all(abs(Q.accuracy(prior, r) - a) < 0.04 for r, a in zip(rules, right, strict=True))


def test_oracle_and_labels(spark, sf):
    big = sf.replace("0.001", "0.01")
    df = Q.judge(spark.read.parquet(f"{big}/documents.parquet"))
    got = sorted(map(tuple, df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{big}/documents.parquet'")
    assert got == sorted(con.execute(Q.oracle()).fetchall())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    kept = {r[0]: r[7] for r in got if not r[6]}
    good = [kept[d] for d, y in labels.items() if y and d in kept]
    bad = [kept[d] for d, y in labels.items() if not y and d in kept]
    print(sum(good), len(good), sum(bad), len(bad))
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.2 * len(bad)


def test_names_that_clash_with_derived_columns(spark):
    """Only doc_id and text are read: columns named as any derived one change nothing."""
    rows = [(i, " ".join(f"word{(i * k) % 37}" for k in range(80)) + ".") for i in range(12)] + [(3, None), (3, None), (None, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    want = Q.judge(plain)
    names = [c for c in want.columns if c != "doc_id"] + ["_text", "_words", "_lines", "_windows", "count"]
    odd = plain.select("*", *[Q.F.lit("x").alias(c) for c in names])
    key = lambda r: (str(r[0]), str(r[1:]))
    assert sorted(map(tuple, Q.judge(odd).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert Q.judge(odd.limit(0)).collect() == []
