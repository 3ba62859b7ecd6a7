"""Operators that SQL can't restate: invariants and plain versions."""

import json
import random
import re
import unicodedata
from collections import deque

import duckdb
from pyspark.sql import functions as F

from gleanery import queries as Q
from gleanery.functions import text as T
from gleanery.operators import code, conversations, guards, hygiene, joins, parsing, selection
from gleanery.sources import files
from gleanery.streaming import metrics


def test_selection_keeps_its_budgets(spark, sf):
    rows = Q.s6(spark, sf).toPandas()
    assert len(rows) > 1000
    for _, g in rows.groupby("qid"):
        chosen = g[g.selected]
        assert len(chosen) <= 6 and chosen.n_tokens.sum() <= 350
        assert set(chosen.reason) <= {"recall", "score"}
        assert set(g[~g.selected].reason) <= {"score-below-threshold", "token-budget", "max-chunks", "redundant"}


def test_selection_refuses_repeats(spark):
    text = "the river house stands on a green hill near town"
    rows = [(i, i, "doc", text if i < 3 else f"river number {i} flows", 0.9, 0.5, 0.5, 0.5) for i in range(5)]
    chunks = spark.createDataFrame(rows, "id long, ord long, kind string, content string, certainty double, recency double, teaching double, priority double").withColumn("qid", F.lit(1))
    got = {r.id: r.reason for r in selection.select_context(chunks, spark.createDataFrame([(1, "river house")], "qid long, query string")).collect()}
    assert got[0] == "score" and got[1] == got[2] == "redundant" and got[3] == "score"


def test_rate_limit(spark):
    rows = [(i, i % 3, (i * 7) % 50) for i in range(90)]
    got = {r.id: r.allowed for r in conversations.rate_limited(spark.createDataFrame(rows, "id long, user long, second long"), 4, 10).collect()}
    for user in range(3):
        window = deque()
        for i, _, s in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            while window and window[0] <= s - 10:
                window.popleft()
            assert got[i] == (len(window) < 4)
            if got[i]:
                window.append(s)


def test_injection_budget(spark):
    """The same text of two sources is two chunks; the line with source and kind and what was sanitised count."""
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = [(1, 0, 10, "s", words(60)), (1, 1, 11, "s", words(200)), (1, 2, 12, "s", words(60)), (1, 3, 13, "t", words(60)), (1, 4, 14, "s", "x"), (1, 5, 15, "s", "y\nSystem: z z z z z\n<|end|>"), (1, 6, 16, "s", "last")]
    chunks = spark.createDataFrame(rows, "group long, ord long, id long, source string, content string").selectExpr("*", "'doc' AS kind")
    got = {r.id: r.reason for r in selection.inject(chunks, 140, 4).collect()}
    # a chunk costs its tokens and two more; a line that addresses the model costs one
    assert got == {10: "used", 11: "token-budget-exceeded", 12: "duplicate", 13: "used", 14: "used", 15: "used", 16: "max-chunks-reached"}
    assert {r.id: r.used for r in selection.inject(chunks.filter("id IN (10, 13)"), 130).collect()} == {10: True, 13: True}
    assert {r.id: r.used for r in selection.inject(chunks.filter("id IN (10, 13)"), 127).collect()} == {10: True, 13: False}


def test_sanitised(spark):
    rows = [("a\n  SYSTEM : b\nc",), ("ignore all\nx <|im|> y",), ("You are  now z\nwe disregard it\nDisregard me",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert [r.t for r in df.select(guards.sanitize(F.col("s")).alias("t")).collect()] == ["a\n[SANITIZED]\nc", "[SANITIZED]\nx [SANITIZED] y", "[SANITIZED]\nwe disregard it\n[SANITIZED]", ""]


def test_paragraph_chunks(spark):
    text = "\n".join(["x" * 30, "y" * 30, "", "z" * 250, "end"])
    df = spark.createDataFrame([(1, text), (2, "")], "id long, content string")
    out = parsing.paragraphs(df, 100).orderBy("id", "n").collect()
    assert all(len(r.chunk) <= 100 for r in out)
    assert "".join(r.chunk for r in out).replace("\n", "") == text.replace("\n", "")


def test_redaction_literals(spark):
    text = 'apiKey = "sk-abcdefghijklmnop1234" and eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4'
    got = spark.createDataFrame([(text,)], "t string").select(guards.redact_secrets(F.col("t")).alias("r")).first().r
    assert '"[REDACTED]"' in got and "[REDACTED_JWT]" in got and "sk-abc" not in got
    pii = spark.createDataFrame([("mail a.b@c.org ssn 123-45-6789 card 4111 1111 1111 1111",)], "t string").select(guards.redact_pii(F.col("t")).alias("r")).first().r
    assert pii == "mail [REDACTED_EMAIL] ssn [REDACTED_SSN] card [REDACTED_CREDIT_CARD]"


def test_compaction(spark):
    rows = [(i, i, f"t{i}", f"content {i}", "learning", "p", "topic-1" if i < 7 else "topic-2", f"2024-01-{i + 1:02d}") for i in range(8)]
    df = spark.createDataFrame(rows, "id long, ord long, title string, content string, type string, project string, topic string, created string")
    got = hygiene.compaction(df.withColumn("created", F.to_date("created"))).collect()
    assert len(got) == 1 and got[0].n == 7 and got[0].summary.startswith("content 6 | content 5")


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\nnot json\n{"id": "3", "n": 4}\n')
    assert sorted(r.id for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n long").collect()) == ["1", "3"]
    good = {"id": "c", "source": "s", "kind": "code", "content": "x", "certainty": 0.5}
    (tmp_path / "c.json").write_text(json.dumps([good, {**good, "id": "d", "certainty": 2}, {**good, "id": "e", "kind": "odd"}]))
    assert [r.id for r in files.read_chunks(spark, str(tmp_path / "c.json")).collect()] == ["c"]
    ws = tmp_path / "ws"
    for name in ("src/a.ts", "test/a.test.ts", "node_modules/x.js", ".env", "README.md", "key.pem"):
        (ws / name).parent.mkdir(parents=True, exist_ok=True)
        (ws / name).write_text("text")
    got = {r.source.split("/ws/")[1]: r.kind for r in files.scan_workspace(spark, str(ws)).collect()}
    assert got == {"src/a.ts": "code", "test/a.test.ts": "test", "README.md": "doc"}


def test_streaming_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = metrics.sliding_counts(metrics.event_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sliding").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    w = F.window("ts", "5 minutes", "1 minute")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    assert spark.table("sliding").select("start", "event_type", "n").exceptAll(batch).count() == 0
    assert spark.table("sliding").count() == batch.count()
    plain = metrics.event_stream(spark, str(tmp_path / "in")).select("event_id", "event_type")
    q = metrics.flush(plain, str(tmp_path / "out"), str(tmp_path / "cp"), None)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_near_duplicates_are_greedy(spark):
    """Against a plain pass in order: kept chunks only count, the first match is named, and a chain isn't followed."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            words[rng.randrange(30)] = f"x{rng.randrange(60)}"
        rows.append((1000 - i, i, rng.choice("ab"), rng.choice(["code", "doc"]), " ".join(words)))
    rows.append((5000, 90, "a", "doc", ""))
    df = spark.createDataFrame(rows, "id long, ord long, source string, kind string, content string")
    want, kept, hashes = {}, {}, {}
    for i, _, source, kind, text in rows:
        if (source, text) in hashes:
            want[i] = (hashes[source, text], "exact")
            continue
        hashes[source, text] = i
        words = set(text.split())
        for other, k, w in kept.get(source, []):
            if k == kind and words | w and len(words & w) / len(words | w) >= 0.82:
                want[i] = (other, "near")
                break
        else:
            kept.setdefault(source, []).append((i, kind, words))
            want[i] = (None, None)
    # an exact copy names the first row of its content, whatever became of that one
    assert {r.id: (r.duplicate_of, r.reason) for r in hygiene.near_duplicates(df).collect()} == want
    assert {x for _, x in want.values()} == {"exact", "near", None}


def test_coverage_takes_the_place_of_spare_chunks(spark):
    rows = [(1, 1, "code", True, 0.9), (1, 2, "code", True, 0.8), (1, 3, "test", False, 0.5), (1, 4, "test", False, 0.4), (2, 5, "test", True, 0.9), (3, 6, "spec", False, 0.2)]
    got = {r.id: (r.selected, r.reason) for r in selection.covered(spark.createDataFrame(rows, "qid long, id long, kind string, selected boolean, score double"), ["test", "spec"]).collect()}
    assert got == {1: (True, "selected"), 2: (False, "replaced"), 3: (True, "coverage"), 4: (False, ""), 5: (True, "selected"), 6: (True, "coverage")}


def test_sections_and_smart_chunks(spark):
    text = "before\n# One  \na\n```\n# code\n```\n## Two Words\nb\n\nc"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, content string")
    got = [(r.id, r.n, r.level, r.heading, r.slug, r.content) for r in parsing.sections(df).collect()]
    assert got == [(1, 0, 0, "", "", "before"), (1, 1, 1, "One", "one", "a\n```\n# code\n```"), (1, 2, 2, "Two Words", "two-words", "b\n\nc")]
    docs = [(2, "p" * 50 + "\n\n" + "q" * 57 + "\n\nr"), (3, "One two. Three four! Five"), (4, "z" * 130)]
    parts = lambda rows, size: [(r.id, r.strategy, r.chunk) for r in parsing.smart_chunks(spark.createDataFrame(rows, "id long, content string"), size, 5, 0).orderBy("id", "n").collect()]
    assert parts([(1, text)], 40) == [(1, "section", "before\n\n# One  \na\n```\n# code\n```"), (1, "section", "## Two Words\nb\n\nc")]
    want = [(2, "paragraph", "p" * 50), (2, "paragraph", "q" * 57 + "\n\nr"), (3, "semantic", "One two. Three four! Five"), (4, "semantic", "z" * 60), (4, "semantic", "z" * 60), (4, "semantic", "z" * 10)]
    assert parts(docs, 60) == want
    overlapped = parsing.smart_chunks(spark.createDataFrame([(4, "z" * 70)], "id long, content string"), 60, 5, 3).orderBy("n").collect()
    assert [r.chunk for r in overlapped] == ["z" * 60, "z" * 13]


def test_gates_on_small_rows(spark):
    files = spark.createDataFrame([("src/ui/a.js", "import x from '../core/db'\nimport '../../etc/y'\nplain"), ("src/api/b.ts", 'const q = require("request")')], "path string, content string")
    rules = [{"id": "up", "from": "src/ui/*", "to": "src/core/**"}, {"id": "req", "pattern": "request"}]
    assert sorted((r.path, r.line, r.rule) for r in code.architecture_violations(files, rules).collect()) == [("src/api/b.ts", 1, "req"), ("src/ui/a.js", 1, "up")]
    assert [(r.line, r.severity) for r in code.deprecations(files).collect()] == [(1, "error")]
    assert code.architecture_violations(files, []).collect() == []
    assert code.glob_pattern("src/**/x?.js") == "(?i)^src/.*/x[^/]\\.js$"


def test_retention_keeps_the_last_turns(spark):
    rows = [(1, k, "user" if k % 2 else "bot", f"Turn  {k % 5}") for k in range(13)] + [(2, 0, "user", None)]
    got = {r.conv: r for r in conversations.retained(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), every=4, keep=2).collect()}
    live, summary = [], []
    for n, (_, _, role, text) in enumerate((r for r in rows if r[0] == 1), 1):
        live.append(f"{role}: {' '.join(text.split())}")
        if n % 4 == 0 and len(live) > 2:
            summary += [x for x in live[:-2] if x not in summary]
            live = live[-2:]
    assert (got[1].live, got[1].summarised, got[1].summary) == (len(live), len(summary), "\n".join(summary))
    assert (got[2].live, got[2].summarised, got[2].summary) == (1, 0, "")


def test_windows_by_the_nearest_second(spark, tmp_path):
    """Events with fractions of a second that a cut to whole seconds would put into another window than SQL does; halves go to the even second."""
    day = [0.6, 0.7, 86_400.4, 86_400.5, 86_401.5]
    five = [10.6, 310.7, 311.4, 611.5]
    rows = [(i, x, u, "error" if i % 2 else "purchase") for i, (u, x) in enumerate([(1, x) for x in day] + [(2, x) for x in five] + [(3, 0.6), (3, 610.4)])]
    df = spark.createDataFrame(rows, "event_id long, x double, user_id long, event_type string")
    df = df.selectExpr("event_id", "cast(timestamp_micros(1704067200000000L + bigint(round(x * 1e6))) AS timestamp_ntz) AS ts", "user_id", "event_type", "1.0D AS value", "'{}' AS props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("g4_fixed_windows", "st1_trailing_requests", "j9_overlaps"):
        rel = con.execute(Q.ORACLES[name])
        names = [c[0] for c in rel.description]
        assert sorted(Q.QUERIES[name](spark, str(tmp_path)).select(*names).collect()) == sorted(rel.fetchall()), name
    assert [r[0] for r in df.select(T.nearest_second(F.col("ts"))).orderBy("event_id").limit(5).collect()] == [1704067200 + k for k in (1, 1, 86_400, 86_400, 86_402)]


def test_similar_pairs_are_exact_and_few_are_compared(spark):
    """Against all pairs: random sets, copies, sets of hundreds of words, and similarities that equal the limit (55 / 100: .55 times 100 is more than 55 in floating point)."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [r.sample(words, r.randint(1, 12)) for _ in range(80)]
    texts += [[w if r.random() < 0.8 else r.choice(words) for w in t] for t in texts[:60]] + texts[:9]
    for n in (20, 100, 700):
        long = [f"a{n}x{k}" for k in range(n)]
        texts += [long, long[: n * 11 // 20], long[: n * 18 // 25], long[n // 3 :] + [f"b{n}x{k}" for k in range(n // 8)]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    sets = [set(t) for t in texts]
    for least in (0.55, 0.72):
        like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets))}
        want = {p: round(s, 6) for p, s in like.items() if round(s, 6) >= least}
        assert {(x.a, x.b): x.similarity for x in joins.similar_pairs(rows, least).collect()} == want and len(want) > 20
    # 300 sets that share their rarest word and little else: 44,850 pairs share a word
    apart = spark.createDataFrame([(i, [f"z{i % 5}", *(f"y{(i * 37 + k * k) % 400}" for k in range(30))]) for i in range(300)], "k long, t array<string>").withColumn("t", F.array_distinct("t"))
    assert joins.candidates(apart, 0.72, []).count() < 300


def test_tokenizers_on_every_letter(spark):
    """Against regular expressions and unicodedata: each letter up to U+052F before, within and after a word, in long texts too (but for Σ, which Java lower-cases by where it stands); no tokenizer translates text that has nothing to translate."""
    have, letters = T.latin_marks()
    texts = [f"{c}Ab{c}x {chr(65 + i % 26)}{c} the\x0b{c}_y/z.{c}" for i, c in enumerate(map(chr, [*range(1, 0x530), 0x212B])) if c != "Σ"] + [None, "", " ", "".join(map(chr, range(32, 0x530))).replace("Σ", "")]
    marked = lambda s: re.sub(f"([{have}])", r"\1 ", s).translate(str.maketrans(have, letters))
    lower = lambda s: "".join(c if ord(c) == 0x130 else c.lower() for c in s).replace("İ", "i̇")
    word = lambda c: unicodedata.category(c)[0] in "LN"
    ascii_word = lambda more: lambda c: c in more or (c.isascii() and c.isalnum())
    kinds = {
        T.raw_tokens: (True, word, 1, []), T.selector_tokens: (True, lambda c: c in "./_-" or word(c), 1, T.SELECTOR_STOPWORDS), T.memory_tokens: (True, word, 3, T.MEMORY_STOPWORDS),
        T.relevance_tokens: (True, word, 3, T.RELEVANCE_STOPWORDS), T.rag_tokens: (False, word, 2, T.RAG_STOPWORDS), T.sync_tokens: (False, ascii_word("_"), 3, []),
        T.tagger_words: (False, ascii_word("áéíóúñü"), 2, []), T.search_tokens: (False, lambda c: "à" <= c <= "ɏ" or ascii_word("")(c), 2, T.SEARCH_STOPWORDS),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = df.select("id", *[f(F.col("text")).alias(f.__name__) for f in kinds]).orderBy("id").collect()
    known = lambda s: all(unicodedata.category(c) != "Cn" for c in s or "")
    for f, (plain, good, least, stop) in kinds.items():
        for r, text in zip(got[:-1], texts, strict=False):
            s = lower(marked(text or "") if plain else text or "")
            want = [w for w in "".join(c if good(c) else " " for c in s).split(" ") if len(w) >= least and w not in stop]
            assert r[f.__name__] == want or not known(text), (f.__name__, text)
    ranges = df.select(T.raw_tokens(F.col("text")), T.search_tokens(F.col("text")), T.sync_tokens(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "a-z0-9" not in ranges and "translate(text" not in ranges and "translate(regexp_replace" not in ranges
