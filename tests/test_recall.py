"""Recall plans and staged recall against plain Python; what memory search finds without terms, by project and about security."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery import queries as Q
from gleanery.functions import text as T
from gleanery.operators import axioms, blocks, conversations, memory, observe, recall, retrieval
from gleanery.operators import tagging


def terms(text):
    t = unicodedata.normalize("NFKD", text or "").lower()
    t = "".join(c if c.isalpha() or c.isnumeric() or c.isspace() or c in "/._-" else " " for c in t)
    return [w for w in re.split(r"[\s/._-]+", t) if w]


def useful(w):
    return len(w) >= 3 and w not in recall.RECALL_STOPWORDS and not re.fullmatch(r"v?\d+", w)


def plan(r):
    if (r.explicit or "").strip():
        return [r.explicit.strip()]

    def ranked(parts):
        score = {}
        for words, weight in parts:
            for w in filter(useful, words):
                more = [w[:-1] + "ion" if w.endswith("ate") else None, w[:-1] + "ation" if w.endswith("ize") else None, w[:-1] if w.endswith("ers") else None]
                score[w] = score.get(w, 0) + weight * 100
                for v in more:
                    if v and len(w) > 5 and useful(v):
                        score[v] = score.get(v, 0) + weight * 72
        return sorted(score, key=lambda w: (-score[w], -len(w)))

    files = r.files or []
    paths = lambda a, b: [x for f in files for x in ((terms(f), a), (terms(re.split(r"[\\/]", f)[-1]), b))]
    top = ranked([(terms(r.task), 1800), (terms(r.objective), 1550), (terms(r.focus), 1200), *paths(1350, 1600)])
    own = ranked(paths(1200, 1500))
    task, objective, focus = ([w for w in terms(x) if useful(w)] for x in (r.task, r.objective, r.focus))
    noun = [w for w in top if re.search("(ion|ity|ment|ance|ence|order|auth|cli|memory|engram)$", w)]
    derived = [w for w in top if re.search("(ion|ity|ment|ance|ence)$", w)]
    made = lambda n, *p: " ".join(list(dict.fromkeys(w for q in p for w in q))[:n])
    seven = [made(4, own[:2], derived[:1], top[:1]), made(4, own[:2], noun[:2], top[:1]), made(4, top[:3], noun[:2]), made(5, task[:2], objective[:3], own[:2]), made(6, top[:5], own[:2]), made(6, focus[:6]), made(6, task[:6], objective[:4])]
    return [q for q in dict.fromkeys(seven) if " " in q][:5]


HAND = [
    (1, "Harden authenticate middleware", "validate handlers 2024 v2", None, ["src/auth/validate-token.ts", "docs\\organize.md"], None), (2, None, None, None, None, None), (3, "x", "y", "z", [], "  as said  "),
    (4, "Migración de sesión über naïve", "normalize normalize", "teach the task", ["a/b.ts"], ""), (5, "memory", None, None, None, None), (6, "alpha alpha beta", "beta gamma", "alpha", None, None),
]
SCHEMA = "id long, task string, objective string, focus string, files array<string>, explicit string"


def test_plans(spark, sf):
    for rows in (spark.createDataFrame(HAND, SCHEMA), Q.queries_docs._recall_requests(spark, sf)):
        got = {}
        for r in recall.plans(rows).orderBy("id", "n").collect():
            got.setdefault(r.id, []).append(r.query)
        want = {r.id: plan(r) for r in rows.collect()}
        assert got == {i: p for i, p in want.items() if p} and len(got) > 3


def search(docs, query, limit, newest):
    tok = lambda x: [w for w in re.split(r"\s+", re.sub("[^a-z0-9à-ɏ]+", " ", (x or "").lower())) if len(w) >= 2 and w not in T.SEARCH_STOPWORDS]
    q = Counter(tok(query))
    if not q:
        return newest[:limit]
    bags = {i: Counter(tok(x)) for i, x in docs.items()}
    df = Counter(w for b in bags.values() for w in b)
    score = {i: round(sum(k * b[w] / b.total() * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, k in q.items() if w in b), 6) for i, b in bags.items()}
    return [i for i in sorted(score, key=lambda i: (-score[i], i)) if score[i] > 0][:limit]


def test_staged_recall(spark, sf):
    """Requests leave once they have enough; the first query that finds a memory counts."""
    requests, m = Q.queries_docs._recall_requests(spark, sf).filter("id < 25"), Q.memories(spark, sf)
    rows = m.collect()
    docs = {r.id: f"{r.title} {r.content}" for r in rows}
    newest = [r.id for r in sorted(rows, key=lambda r: (r.created, r.ord), reverse=True)]
    want = set()
    for r in requests.collect():
        seen = {}
        for k, q in enumerate(plan(r)[:3]):
            for i in search(docs, q, 6, newest):
                seen.setdefault(i, (k, q))
            if len(seen) >= 6:
                break
        want |= {(r.id, i, k, q) for i, (k, q) in seen.items()}
    found = recall.recall(requests, m, limit=2)
    assert {(r.id, r.memory, r.stage, r.query) for r in found.collect()} == want and {x[2] for x in want} > {0}
    status = {r.id: r.status for r in recall.report(requests.union(spark.createDataFrame([(999, None, None, None, None, None)], requests.schema)), found).collect()}
    assert status[999] == "skipped" and set(status.values()) >= {"recalled"}
    near = recall.relevant(requests, found, m, Q.AS_OF, limit=2, shown=m.filter("id % 2 = 0").select("id"))
    assert all(r.memory % 2 == 1 for r in near.collect())
    full = recall.relevant(requests, found, m, Q.AS_OF, limit=2, shown=m.filter("id % 2 = 0").select("id"), resurface=True)
    assert full.count() > near.count() and {r.shown for r in full.filter("rank = 1").collect()} >= {False}


def test_search_without_terms(spark):
    m = spark.createDataFrame([(1, 1, "a", "red fox", "2024-01-01"), (2, 2, "b", "blue", "2024-03-01"), (3, 3, "c", "red", "2024-03-01")], "id long, ord long, title string, content string, created string")
    q = spark.createDataFrame([(1, "red"), (2, ""), (3, "the of"), (4, "none")], "qid long, query string")
    got = sorted(tuple(r) for r in memory.search(m, q, 2).select("qid", "rank", "id").collect())
    assert got == [(1, 1, 3), (1, 2, 1), (2, 1, 3), (2, 2, 2), (3, 1, 3), (3, 2, 2)]


@pytest.mark.parametrize("first", [(20_000, 1_000), (7, 5)])
def test_all_projects_are_searched(spark, monkeypatch, first):
    """1,200 projects, each by its own statistics, in the order of their names."""
    monkeypatch.setattr(memory, "FIRST_ROWS", first[0])
    monkeypatch.setattr(memory, "FIRST_PROJECTS", first[1])
    rows = [(k, k, "t", "rare fox" if k % 1190 == 1189 else f"word{k % 7} dog", f"p{k:04d}") for k in range(1200)] + [(5000 + k, k, "t", "dog dog cat" if k % 2 else "cat", "p0003") for k in range(30)] + [(9999, 1, "t", "fox", None)]
    m = spark.createDataFrame(rows, "id long, ord long, title string, content string, project string").withColumn("created", F.lit("2024-01-01"))
    q = spark.createDataFrame([(1, "fox"), (2, "dog"), (3, "absent")], "qid long, query string")
    got = {}
    for r in memory.search_all(m, q, 10).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    want = {}
    for i, text in ((1, "fox"), (2, "dog")):
        out = []
        for p in sorted({r[4] for r in rows if r[4]}):
            out += search({r[0]: f"t {r[3]}" for r in rows if r[4] == p}, text, 10, [])
        want[i] = list(dict.fromkeys(out))[:10]
    assert got == want


def test_security_terms(spark):
    rows = [(1, "security", "critical", 1.0), (2, "security", None, None), (3, "note", "low", 2.0), (4, "note", None, None), (5, "My-Security", "unknown", 0.0)]
    m = spark.createDataFrame([(i, i, "t", "x", k, s, c) for i, k, s, c in rows], "id long, ord long, title string, content string, type string, severity string, confidence double").withColumn("project", F.lit("p")).withColumn("created", F.lit("2024-04-01"))
    assert [round(r.w, 6) for r in m.select(memory.security_weight(m).alias("w")).collect()] == [1.0, 0.56, 0.73, 0.0, 0.36]
    q = spark.createDataFrame([(1, "nothing here")], "qid long, query string")
    for only, share, off in ((False, 0.14, 0.0), (True, 0.28, -0.65)):
        got = {r.id: r.score for r in memory.ranked(m, q, "2024-04-01", 5, security_only=only).collect()}
        assert got == {i: pytest.approx(round(0.2 + share * w + (off if w == 0 else 0), 4), abs=1e-4) for i, w in zip(range(1, 6), [1.0, 0.56, 0.73, 0.0, 0.36], strict=True)}
    assert {r.id for r in memory.gate(m, security_only=True).collect()} == {1, 2, 3, 5}


def test_more_queries_than_at_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_QUERIES", 9)
    docs = spark.createDataFrame([(k, f"w{k % 5} w{k % 3}") for k in range(30)], "id long, content string")
    q = spark.createDataFrame([(k, f"w{k % 6}") for k in range(20)], "qid long, query string")
    got = sorted(tuple(r) for r in retrieval.bm25(docs, q, 3).collect())
    monkeypatch.setattr(blocks, "MOST_QUERIES", 99)
    assert got == sorted(tuple(r) for r in retrieval.bm25(docs, q, 3).collect()) and len(got) > 30


def test_word_lists(spark):
    """Values of the fixtures: what is a stopword where."""
    df = spark.createDataFrame([("Se validó LA sesión por how it was para",)], "s string")
    get = lambda f: df.select(f(F.col("s")).alias("t")).first().t
    assert get(T.memory_tokens) == ["valido", "sesio", "por", "how", "para"]
    assert get(T.relevance_tokens) == ["valido", "sesio", "por", "how", "was", "para"]
    assert get(T.raw_tokens) == ["se", "valido", "la", "sesio", "n", "por", "how", "it", "was", "para"]
    assert (len(tagging.ENGLISH_STOPWORDS), len(tagging.SPANISH_STOPWORDS), len(T.RELEVANCE_STOPWORDS), len(recall.RECALL_STOPWORDS)) == (122, 84, 31, 70)
    top = tagging.topics(spark.createDataFrame([(1, "this have not these cada tiene token token")], "id long, content string")).collect()
    assert [r.term for r in top] == ["token"]


def test_claims(spark):
    said = ["The cache service is enabled", "- the cache service is blocked", "Cache service debe wait 30 seconds", "[note] cache service should wait 5 segundos", "cache service should wait 5 minutes", "cache service with 7 things", "cache service allow", "a is no"]
    turns = spark.createDataFrame([(1, k, s) for k, s in enumerate(said)], "conv long, turn long, text string")
    c = {r.turn: (r.key, r.polarity, r.value, r.unit) for r in conversations.claims(turns).collect()}
    assert c[0] == ("cache service", 1, None, "") and c[1] == ("cache service", -1, None, "") and c[2] == ("cache service debe wait seconds", 0, 30, "s") and c[4] == ("cache service wait minutes", 0, 5, "m")
    assert c[5] == ("cache service things", 0, None, "") and 6 not in c and 7 not in c
    got = {(r.earlier, r.later, r.kind) for r in conversations.contradictions(turns).collect()}
    assert got == {(0, 1, "polarity")}


def test_rate_limit_without_user(spark):
    r = spark.createDataFrame([(k, None, k) for k in range(6)], "id long, user string, second long")
    assert [x.allowed for x in conversations.rate_limited(r, 2, 60).orderBy("id").collect()] == [True, True, False, False, False, False]


def test_similar_names(spark):
    rng = random.Random(4)
    words = ["river", "house", "green", "hill", "town", "licence", "terms", "of-use", "a"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))
    n, c = [(k, name()) for k in range(120)], [(k, name()) for k in range(60)]
    got = {(r.id, r.cid): r.score for r in axioms.ranked_similar(spark.createDataFrame(n, "id long, name string"), spark.createDataFrame(c, "cid long, name string")).collect()}
    slug = lambda s: re.sub("[^a-z0-9]+", "-", s.lower()).strip("-")
    tok = lambda s: {w for w in re.split(r"\W+", s.lower()) if len(w) > 1 and w not in T.RAG_STOPWORDS}
    want = {}
    for i, a in n:
        for j, b in c:
            s, u = slug(a), slug(b)
            if not s or not u:
                continue
            x = 1.0 if s == u else 0.9 if (s in u or u in s) and min(len(s), len(u)) >= 8 else round(len(tok(a) & tok(b)) / max(1, len(tok(a) | tok(b))), 4)
            if x >= 0.72:
                want[i, j] = x
    assert got == want and {0.9, 1.0} < set(want.values())


def test_alert_limits(spark):
    r = spark.createDataFrame([("a", 20, 0.25, 0.35, 0.15, 1500.0), ("b", 19, 0.26, 0.36, 0.14, 1501.0), ("c", 50, None, float("nan"), float("inf"), 1.0)], "command string, runs int, blocked_rate double, degraded_rate double, recall_hit_rate double, average_ms double")
    got = [tuple(x) for x in observe.alerts(r).orderBy("command").collect()]
    assert got == [("a", True, True, True, True, True, "ok"), ("b", False, False, False, False, False, "alert"), ("c", True, True, True, False, True, "alert")]
    assert observe.alerts(r, blocked_rate=0, min_runs=100).first().status == "alert"


def test_memories_are_tokenised_once(spark, monkeypatch):
    """For all stages, and for more queries than are asked at once."""
    calls = []
    tokenised = retrieval.tokenised
    monkeypatch.setattr(retrieval, "tokenised", lambda *a, **k: calls.append(1) or tokenised(*a, **k))
    monkeypatch.setattr(blocks, "MOST_QUERIES", 4)
    m = spark.createDataFrame([(k, k, f"note {k}", f"billing invoice{k} ledger", "decision", "p", "t", "2024-01-01") for k in range(6)], "id long, ord long, title string, content string, type string, project string, topic string, created string")
    r = spark.createDataFrame([(k, f"billing invoice{k} export", "ledger totals wrong", "rounding problem", None, None) for k in range(6)], "id long, task string, objective string, focus string, files array<string>, explicit string")
    got = recall.recall(r, m)
    # six of nine wanted candidates are found, so that a second query is asked, each time in two goes
    assert got.groupBy("id").count().filter("count = 6").count() == 6 and recall.plans(r).filter("n = 1").count() == 6
    assert len(calls) == 1
