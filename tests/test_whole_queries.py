"""Retrieval over whole tables, against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from gleanery import queries as Q
from gleanery.functions import text as T
from gleanery.operators import blocks, retrieval, selection


def tokens(text):
    return [w for w in re.split(r"\s+", re.sub("[^a-z0-9à-ɏ]+", " ", text.lower())) if len(w) >= 2 and w not in T.SEARCH_STOPWORDS]


def test_bm25_asks_every_item(spark, sf):
    docs = {r.doc_id: Counter(tokens(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    asked = {r.item_id: Counter(tokens(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    want = {}
    for q, terms in asked.items():
        for d, c in docs.items():
            norm = 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(k * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + norm) for w, k in terms.items() if w in c)
            want[q, d] = s
    got = Q.QUERIES["r1_bm25"](spark, sf).collect()
    assert {r.qid for r in got} == set(asked) and max(asked) >= 5
    for r in got:
        assert abs(r.score - want[r.qid, r.id]) < 2e-6
    for q in asked:
        best = sorted((want[q, d] for d in docs if want[q, d] > 0), reverse=True)[:10]
        assert [r.score for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == pytest.approx(best, abs=2e-6)


def test_vectors_ask_every_hundredth(spark, sf):
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = Q.QUERIES["r8_vector_top"](spark, sf).collect()
    asked = {i for i in e if i % 100 == 0}
    assert {r.qid for r in got} == asked and len(asked) > 1
    for q in asked:
        best = sorted((e[q] @ v / (np.linalg.norm(e[q]) * np.linalg.norm(v)) for v in e.values()), reverse=True)[:5]
        assert sorted((r.score for r in got if r.qid == q), reverse=True) == pytest.approx(best, abs=2e-6)


def test_diff_and_ranking_cover_all_rows(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = Q.QUERIES["w13_line_diff"](spark, sf).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {i: len(t.split("\n")) + 1 for i, t in docs.items()}
    assert {r.qid for r in Q.QUERIES["e1_ranking"](spark, sf).collect()} == items


def test_queries_in_groups_and_odd_rows(spark, monkeypatch):
    """More queries than are scored together; null, empty and repeated texts, queries without tokens, ties by id."""
    monkeypatch.setattr(blocks, "GROUP", 2)
    monkeypatch.setattr(blocks, "CELLS", 7)
    docs = spark.createDataFrame([(5, "red fox"), (1, "red fox"), (2, "blue fox runs"), (3, None), (4, "")], "id long, content string")
    queries = spark.createDataFrame([(1, "red"), (2, "fox fox"), (3, ""), (4, "blue"), (5, "nothing")], "qid long, query string")
    got = sorted((r.qid, r["rank"], r.id) for r in retrieval.bm25(docs, queries).collect())
    assert got == [(1, 1, 1), (1, 2, 5), (2, 1, 1), (2, 2, 5), (2, 3, 2), (4, 1, 2)]
    assert retrieval.bm25(docs.limit(0), queries).collect() == [] and retrieval.tfidf(docs, queries.limit(0)).collect() == []


def test_selection_is_greedy_per_query(spark, sf):
    """The choice among each item's candidates, against a plain loop over them."""
    scored = selection.scored(Q._requests(spark, sf), Q.asked(spark, sf)).collect()
    got = {(r.qid, r.id): (r.selected, r.reason, r.score) for r in Q.QUERIES["s6_select_context"](spark, sf).collect()}
    assert len(got) == len(scored)
    for q in {r.qid for r in scored}:
        rows = sorted((r for r in scored if r.qid == q), key=lambda r: (-r.score, r.ord))
        taken, used, want = [], 0, {}
        early = {r.id: "score-below-threshold" if r.score < 0.25 else "token-budget" if r.n_tokens > 350 else None for r in rows}
        for memory in (True, False):
            for r in rows:
                if r.id in want or early[r.id] or (memory and (r.kind != "memory" or used + r.n_tokens > 0.15 * 350)):
                    continue
                t = set(r.tokens)
                like = max((len(t & x) / len(t | x) if t | x else 0 for x in taken), default=0)
                reason = "max-chunks" if len(taken) >= 6 else "token-budget" if used + r.n_tokens > 350 else "redundant" if like > 0.65 else "recall" if memory else "score"
                if reason in ("recall", "score"):
                    taken.append(t)
                    used += r.n_tokens
                want[r.id] = (reason in ("recall", "score"), reason, pytest.approx(max(0, r.score - 0.22 * like), abs=2e-6))
        for r in rows:
            assert got[q, r.id] == (want[r.id] if not early[r.id] else (False, early[r.id], r.score))
