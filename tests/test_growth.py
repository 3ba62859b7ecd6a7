"""What let the work of queries grow faster than their input, or their workers' memory with it."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from gleanery import batches
from gleanery.functions import text as T
from gleanery.operators import blocks, hygiene, joins, parsing, postings, recall, retrieval, structure, symbols, sync, tagging, units


def plan(df):
    return df._jdf.queryExecution().toString()


def test_doubles_file_by_file(spark):
    """files go through a task in batches, and a file that ends in another batch is still one."""
    rng = random.Random(5)
    words = [f"word{k}" for k in range(40)]
    rows = []
    for f in range(12):
        texts = []
        for n in range(rng.randint(1, 9)):
            text = rng.choice(texts).split() if texts and rng.random() < 0.6 else rng.choices(words, k=20)
            texts.append(" ".join([*text[1:], rng.choice(words)] if rng.random() < 0.5 else text))
            rows.append((f"{f}::{n}", n, f"f{f}.md", "doc", texts[-1]))
    kept, want = {}, set()
    for i, _, source, _, text in rows:
        s = set(text.split())
        of = next((j for j, u, t in kept.get(source, []) if t == text), None) or next((j for j, u, _ in kept.get(source, []) if len(s & u) / len(s | u) >= sync.NEAR), None)
        if of is None:
            kept.setdefault(source, []).append((i, s, text))
        else:
            want.add((i, source, of))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        d = sync.doubled(spark.createDataFrame(rows, "id string, n int, source string, kind string, content string").withColumn("checksum", F.md5(F.col("content"))))
        assert "FlatMapGroupsInPandas" not in plan(d)
        assert {(r.chunk_id, r.source, r.duplicate_of) for r in d.collect()} == want and len(want) > 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ends_and_tags_without_regular_expressions(spark):
    """what stands before a line separator at the end is no end of the text; tags go along without a join."""
    x = spark.createDataFrame([(1, "s", "doc", " \t\nab c \r\n"), (2, "s", "doc", "session ab   "), (3, "s", "doc", "")], "id int, source string, kind string, content string")
    assert [r[0] for r in x.orderBy("id").select(structure.stripped(F.col("content"))).collect()] == ["ab c", "session ab   ", ""]
    t = parsing.tagged(x)
    assert "Join" not in plan(t) and [(r.topic, r.domain) for r in t.orderBy("id").collect()] == [("general", "general"), ("auth-validation", "memory"), ("general", "general")]


def test_pairs_shuffle_no_words(spark):
    """words stay in the task of their set, texts are not shuffled to find copies, and pairs are those of plain Python."""
    rng = random.Random(7)
    words = [f"term{k}" for k in range(300)]
    rows, base = [], rng.sample(words, 30)
    for k in range(60):
        text = [*rng.sample(words, 30)] if k % 3 == 0 else [*base[: 30 - k % 4], *rng.sample(words, k % 4)]
        rows.append((k, " ".join(text), "ab"[k % 2]))
    rows += [(60, rows[1][1], "a"), (61, "", "a"), (62, None, "b")]
    sets = {i: (set((t or "").split()), g) for i, t, g in rows}
    want = {(i, j) for i, (s, g) in sets.items() for j, (u, h) in sets.items() if i < j and g == h and s and u and len(s & u) / len(s | u) >= 0.82}
    x = spark.createDataFrame(rows, "id long, text string, grp string")
    got = joins.similar_pairs(x, 0.82, "grp")
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 100
    often = F.broadcast(spark.createDataFrame([(1, 2)], "w long, df long"))
    s = spark.createDataFrame([(1, ["a", "b"], "g")], "k long, t array<string>, grp string").groupBy("k").agg(F.first("t").alias("t"), F.first("grp").alias("grp"))
    c = joins.candidates(s, 0.82, ["grp"], often)
    steps = c._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert steps.count("hashpartitioning(k#") + steps.count("hashpartitioning(ka#") == 3  # of the sets, once for each side, and of the pairs found


def test_batches_of_texts_are_small(spark, monkeypatch):
    """Workers get small batches, and rows of statements leave them in stretches."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    x = spark.createDataFrame([(i, f"export class C{i} {{ m() {{}} }}\nconst a{i} = 1, b = 2\nfoo()") for i in range(9)], "id long, content string")
    q = spark.createDataFrame([(1, "class foo")], "qid long, query string")
    try:
        whole = sorted(symbols.declarations(x).collect())
        for make in (lambda: symbols.declarations(x), lambda: parsing.smart_chunks(x), lambda: retrieval.bm25(x, q), lambda: retrieval.vector_top(*vectors(spark))):
            spark.conf.set(conf, "10000")
            make()
            assert int(spark.conf.get(conf)) == batches.ROWS
        monkeypatch.setattr(symbols, "MOST_ROWS", 2)
        assert sorted(symbols.declarations(x).collect()) == whole and len(whole) == 36
        spark.conf.set(conf, "2")
        assert sorted(symbols.declarations(x).collect()) == whole and spark.conf.get(conf) == "2"
    finally:
        spark.conf.set(conf, before)


def vectors(spark):
    rng = np.random.default_rng(3)
    v = [(i, [None if (i + k) % 29 == 0 else float(x) for k, x in enumerate(rng.integers(-3, 4, 3 + i % 3))]) for i in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0])]
    e = spark.createDataFrame(v, "id long, embedding array<float>")
    return e, e.filter("id % 4 = 0 AND embedding IS NOT NULL").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))


def test_vectors_by_groups_of_queries(spark, monkeypatch):
    """queries in groups, batches of vectors in small ones; what a task keeps is the best for each query."""
    monkeypatch.setattr(blocks, "GROUP", 3)
    e, q = vectors(spark)
    clean = lambda v: np.nan_to_num(np.array(v or [], np.float64))
    every, want = {r.id: clean(r.embedding) for r in e.collect()}, {}
    for r in q.collect():
        a, scores = clean(r.q), []
        for i, b in every.items():
            n = min(len(a), len(b))
            norm = np.linalg.norm(a[:n]) * np.linalg.norm(b[:n])
            s = round(float(a[:n] @ b[:n] / norm), 6) if norm else 0.0
            scores += [(-s, i)] if s > 0 else []
        want[r.qid] = [(i, -s) for s, i in sorted(scores)[:5]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        x = retrieval.vector_top(e.coalesce(2), q)
        got = {}
        for r in x.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: v for k, v in want.items() if v}


def test_topics_and_evidence(spark):
    """terms are counted without a shuffle, ties by first place. F23: hints leave out no evidence, in any case of letters."""
    x = spark.createDataFrame([(1, "delta beta beta delta gamma omega sigma zeta the"), (2, None)], "id long, content string")
    t = tagging.topics(x)
    assert "hashpartitioning" not in t._jdf.queryExecution().executedPlan().toString()
    assert [(r.term, r.n, r["rank"]) for r in t.orderBy("rank").collect()] == [("delta", 2, 1), ("beta", 2, 2), ("gamma", 1, 3), ("omega", 1, 4), ("sigma", 1, 5)]
    said = ["-----BEGIN RSA KEY-----", "API-Key", "Access_Token", "Ignore  previous instructions", "Prompt Injection", "x yaml.LOAD", "Deserialize", "a popen b", "x path Traversal", "Auth Bypass", "BROKEN access control", "nothing", "keys"]
    e = spark.createDataFrame(list(enumerate(said)), "id int, text string").withColumn("low", F.lower("text"))
    got = [r[0] for r in e.orderBy("id").select(units.evidence("text", "low")).collect()]
    assert got == [any(re.search("(?i)" + p, s, re.A) is not None for p in units.EVIDENCE) for s in said] and sum(got) >= 10


def test_memories_are_read_once(spark):
    """counts of fingerprints and topics don't search the texts again, and words are found as their patterns find them."""
    rng = random.Random(11)
    patterns = [hygiene._REASONS, hygiene._PLACES, hygiene._NOISE, hygiene._NOISE_PATH, hygiene._NOISE_TEXT, hygiene._GENERIC]
    pieces = [x for p in patterns for _, x, _ in hygiene.literals(p)]
    texts = [rng.choice([" ", "", "_", "é", "a", "/", "-"]).join(rng.choices([*pieces, "é", " ", "x", "."], k=rng.randint(1, 3))) for _ in range(1500)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, "", None])], "id int, x string")
    found = d.select("x", *[hygiene._found(F.col("x"), p).alias(f"f{k}") for k, p in enumerate(patterns)], *[F.coalesce(F.rlike("x", F.lit(T.ascii_edges(p))), F.lit(False)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for k in range(len(patterns)):
        assert [r[f"f{k}"] for r in found] == [r[f"p{k}"] for r in found] and 5 < sum(r[f"f{k}"] for r in found) < len(found)
    m = d.select("id", F.lit("t").alias("title"), F.col("x").alias("content"), F.lit("session").alias("type"), F.lit("p").alias("project"), F.lit("a").alias("topic"), F.to_date(F.lit("2024-01-01")).alias("created"))
    e = hygiene.evaluate(m, "2024-04-01")
    assert "RLIKE" not in plan(e).upper() and e.count() == len(found)


def test_files_of_chunks_are_scanned_once(spark):
    """chunks with and without lines read one scan's declarations."""
    f = spark.createDataFrame([(1, "class A {\n m() {}\n}\nconst v = 1\n"), (2, "enum E {}\n")], "id int, content string")
    c = spark.createDataFrame([(1, "1:1", 1, 3), (1, "1:4", 4, 4), (2, "2", 0, 0)], "id int, chunk_id string, start_line int, end_line int")
    out = symbols.of_chunks(symbols.declarations(f), c)
    assert "MapInPandas" not in plan(out)
    assert {(r.chunk_id, r.n, r.name) for r in out.collect()} == {("1:1", 1, "A"), ("1:1", 2, "m"), ("1:4", 1, "v"), ("2", 1, "E")}


def test_blend_splits_candidates_only(spark):
    """the texts of candidates are split above the join that finds them."""
    docs = spark.createDataFrame([(k, f"word{k} common text") for k in range(30)], "id long, content string")
    p = retrieval.overlap_blend(docs, spark.createDataFrame([(1, "word3 common")], "qid long, query string"))
    lines = p._jdf.queryExecution().optimizedPlan().toString().split("\n")
    seen = 0
    for k, line in enumerate(lines):
        if "LogicalRDD" in line and "content" in line:
            up = next(j for j in range(k, -1, -1) if "Join" in lines[j] or "MapInArrow" in lines[j])  # what is between them is above the table
            seen += "Join" in lines[up]
            assert "MapInArrow" in lines[up] or not any("split(" in x for x in lines[up:k])
    assert seen == 1 and {r.id for r in p.collect()} >= {3}


def test_staged_recall_scores_few_pairs(spark, monkeypatch):
    """F2, F3 of round 4: results are those of all rows for all queries, with ties, copies and one-word rows, but few pairs are scored, and queries of the same terms are one."""
    rng = random.Random(23)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 1, 2, 3, 5, 40, 90]))) for _ in range(1500)] + ["w0 w1"] * 30 + ["", "other"]
    docs = spark.createDataFrame([(7 * k % 9973, x) for k, x in enumerate(texts)], "id long, content string")
    asked = [" ".join(rng.choices([*words, "absent"], [*weights, 1], k=rng.randrange(7))) for _ in range(300)] + ["w0", "absent w0", "w0 w0", "w59 absent", "", "the"] * 4
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    rows, tuples = retrieval.tokenised(docs), lambda df: sorted(tuple(r) for r in df.select("qid", "rank", "id", "score").collect())
    monkeypatch.setattr(postings, "QUERIES", 37)  # in several goes
    monkeypatch.setattr(postings, "PAIRS", 50)
    for limit in (1, 4, 9):
        x = postings.index(rows, q.select(F.explode(T.search_tokens(F.col("query"))).alias("term")), limit)
        assert tuples(postings.tfidf(x, q, limit)) == tuples(retrieval.tfidf(docs, q, limit))
    assert tuples(postings.tfidf(x, q, 12)) == tuples(retrieval.tfidf(docs, q, 12)) and x.n == 1532
    assert postings.tfidf(x, q.limit(0), 9).count() == 0 and postings.tfidf(postings.index(rows.limit(0), q.select(F.lit("w0").alias("term")), 9), q, 9).count() == 0
    held = x.rows.toArrow().combine_chunks().to_batches()[0]
    bags = postings._bags(x, q, T.search_tokens(F.col("query"))).groupBy("bag").agg(F.min("qid").alias("lead")).collect()
    a = postings._asked(np.array([r.lead for r in bags]), np.array([len(r.bag) for r in bags]), np.array([t for r in bags for t in r.bag]), x, 9)
    lists = postings._lists(held)
    scored = sum(len(r) for r, _ in postings._candidates(*lists, a))
    assert len(bags) < len(asked) and scored < held.num_rows * len(bags) / 4


def test_relevance_of_found_memories_alone(spark):
    """F2 of round 4: memories that no request found aren't tokenised; repeats count in what a memory and its request share."""
    m = spark.createDataFrame([(1, "red fox", "fox fox dog", "note", "den", "2024-04-01"), (2, "tree", "leaf", "note", None, "2024-04-01"), (3, "never found", "fox", "note", "den", "2024-04-01")], "id long, title string, content string, type string, topic string, created string")
    r = spark.createDataFrame([(7, "fox hunt", None, None, ["src/den.ts"])], "id long, task string, objective string, focus string, files array<string>")
    found = spark.createDataFrame([(7, 1, 0, 1), (7, 2, 0, 2)], "id long, memory long, stage int, rank int")
    out = recall.relevant(r, found, m, "2024-04-01")
    # red fox fox fox dog note den: 4 of 7 are the request's, den is one of its files'
    assert [(x.memory, x.score) for x in out.orderBy("rank").collect()] == [(1, round(4 / 7 * 0.58 + 1 / 7 * 0.14 + 0.28, 4)), (2, 0.28)]
    assert "array_intersect" in plan(out) and "LeftSemi" in plan(out)


def test_long_sets_take_no_words_along_for_chance(spark, monkeypatch):
    """F4 of round 4: long texts that share a rare word are told apart by parities; word counts are bounded and their order free; chunks of the same words aren't paired."""
    rng = random.Random(31)
    words = [f"term{k}" for k in range(6000)]
    long = [rng.sample(words, 900) for _ in range(40)]
    texts = [" ".join(x) for x in long] + [" ".join(x[::-1]) for x in long[:20]] + [" ".join([*x[40:], *rng.sample(words, 30)]) for x in long[:15]] + ["one two " * k for k in range(1, 30)]
    left, likely = [], joins._likely
    monkeypatch.setattr(joins, "_likely", lambda p, s, least: left.append((p.count(), (out := likely(p, s, least)).count())) or out)
    monkeypatch.setattr(joins, "MOST_WORDS", 500)
    docs = spark.createDataFrame([(f"c{k}", k, "s", "doc", x) for k, x in enumerate(texts)], "id string, ord long, source string, kind string, content string")
    got = {r.id: r.duplicate_of for r in hygiene.near_duplicates(docs).collect()}
    sets, kept, want = [set(x.split()) for x in texts], [], {}
    for k, x in enumerate(sets):
        want[f"c{k}"] = next((f"c{j}" for j in kept if len(x & sets[j]) / len(x | sets[j]) >= 0.82), None)
        if want[f"c{k}"] is None:
            kept.append(k)
    assert got == want and sum(v is not None for v in want.values()) > 50
    assert joins.word_counts(docs.select(F.split("content", " ").alias("t"))).count() <= 500
    # of sets that are similar or share rare words, only similar ones are left: 15 of the edited texts at most
    assert left[0][1] <= 15 < 100 < left[0][0]
