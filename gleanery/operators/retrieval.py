"""Lexical, hybrid and vector retrieval."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery import stored
from gleanery.batches import small
from gleanery.functions import text as T
from gleanery.operators import blocks

K1, B = 1.5, 0.75


def query_terms(queries: DataFrame, tokens=T.search_tokens) -> DataFrame:
    """(qid, query) -> qid, term, qn: how often the query has the term, as repeats count."""
    return queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))


def tokenised(docs: DataFrame, tokens=T.search_tokens) -> DataFrame:
    """(id, content) -> id, t. Written once by callers that read it several times."""
    return docs.select("id", tokens(F.col("content")).alias("t"))


def top(scores: DataFrame, limit: int, by: str = "score", key: str = "qid") -> DataFrame:
    """W-1: the best ``limit`` rows of each query, ties by id; adds rank."""
    w = W.partitionBy(key).orderBy(F.col(by).desc(), F.col("id"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def _in_goes(search: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``search`` (docs, queries, ...) for any number of queries: as many as are asked at once, and the others after them."""

    @wraps(search)
    def whole(docs: DataFrame, queries: DataFrame, *args, **more) -> DataFrame:
        goes = -(-queries.count() * 10 // (blocks.MOST_QUERIES * 9))  # shares by hash are not quite even
        if goes <= 1:
            return search(docs, queries, *args, **more)
        out = None
        for k in range(goes):
            one = search(docs, queries.filter(F.pmod(F.xxhash64("qid"), F.lit(goes)) == k), *args, **more)
            out = one if out is None else out.union(one)
        return out

    return whole


@_in_goes
def bm25(docs: DataFrame, queries: DataFrame, limit: int = 10, digits: int = 6, tokens=T.search_tokens) -> DataFrame:
    """R-1, R-2: qid, id, score, rank, for a stated set of queries. All rows are scored, in blocks; only the best of each leave it."""
    rows, groups = tokenised(docs, tokens), blocks.asked(queries, tokens(F.col("query")))
    c = blocks.frequencies(rows, groups)
    mean = c.mean

    def score(tf, size, g, _):
        norm = K1 * (1 - B + B * size / mean)[:, None] if mean else 1.0
        return (tf * (K1 + 1) / (tf + norm)) @ (np.log((c.n - g.df + 0.5) / (g.df + 0.5) + 1)[:, None] * g.counts)

    return blocks.top(rows, groups, score, limit, digits)


@_in_goes
def tfidf(docs: DataFrame, queries: DataFrame, limit: int = 10, tokens=T.search_tokens, rows: DataFrame | None = None) -> DataFrame:
    """R-3, R-6: idf = ln((N + 1) / (df + 1)) + 1, tf = count / length. ``rows``: ``docs`` as ``tokenised`` with ``tokens``, where a caller has them."""
    rows, groups = tokenised(docs, tokens) if rows is None else rows, blocks.asked(queries, tokens(F.col("query")))
    c = blocks.frequencies(rows, groups)

    def score(tf, size, g, _):
        return (tf / np.maximum(size, 1)[:, None]) @ ((np.log((c.n + 1) / (g.df + 1)) + 1)[:, None] * g.counts)

    return blocks.top(rows, groups, score, limit)


def of_candidates(candidates: DataFrame, docs: DataFrame, *columns) -> DataFrame:
    """Columns of the few rows that are candidates (qid, id, ...; so many for each stated query): no row of ``docs`` is shuffled."""
    return docs.select("id", *columns).join(F.broadcast(candidates), "id")


def hybrid(docs: DataFrame, queries: DataFrame, limit: int = 10, kinds: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """R-4: BM25 candidates (3 x limit), kinds filtered afterwards, TF-IDF with idf over the candidates only,
    signals averaged; each part divided by its maximum, weighted .4, .3, .3.

    ``docs``: id, content, kind, certainty, teachingValue, priority.
    """
    cand = stored.table(bm25(docs, queries, 3 * limit).select("qid", "id", F.col("score").alias("bm25")))  # read several times
    cand = of_candidates(cand, docs, "content", "kind", ((F.col("certainty") + F.col("teachingValue") + F.col("priority")) / 3).alias("signal"))
    if kinds is not None:
        cand = cand.filter(F.col("kind").isin(kinds))
    tok = cand.select("qid", "id", T.search_tokens(F.col("content")).alias("t"))
    post = tok.withColumn("dl", F.size("t")).select("qid", "id", "dl", F.explode("t").alias("term")).groupBy("qid", "id", "dl", "term").agg(F.count("*").alias("tf"))
    post = post.join(query_terms(queries), ["qid", "term"])
    n = cand.groupBy("qid").agg(F.count("*").alias("n"))
    df = post.groupBy("qid", "term").agg(F.count("*").alias("df"))
    part = F.col("qn") * F.col("tf") / F.col("dl") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    tf = post.join(df, ["qid", "term"]).join(n, "qid").groupBy("qid", "id").agg(F.sum(part).alias("tfidf"))
    w = W.partitionBy("qid")
    share = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(0.0)
    s = cand.join(tf, ["qid", "id"], "left").fillna(0.0, ["tfidf"])
    s = s.select("qid", "id", "kind", F.round(0.4 * share("bm25") + 0.3 * share("tfidf") + 0.3 * share("signal"), 6).alias("score"))
    return top(s.filter(F.col("score") >= least), limit)


def overlap_blend(docs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """R-5, J-3: .75 BM25 (of its top 10, else 0) + .25 share of the raw query tokens, repeats kept."""
    ten = stored.table(bm25(docs, queries, 10).select("qid", "id", F.col("score").alias("bm25")))
    groups = blocks.asked(queries, T.raw_tokens(F.col("query")))

    def share(tf, size, g, _):
        return (tf > 0).astype(np.float64) @ g.counts / np.maximum(g.sizes, 1)

    # beyond the ten, only the share counts: with ten more by share than asked for, none of the best is missed
    by_share = blocks.top(tokenised(docs, T.raw_tokens), groups, share, limit + 10, digits=12).select("qid", "id")
    q = F.broadcast(queries.select("qid", T.raw_tokens(F.col("query")).alias("qt")))
    # candidates are split once they are found, not all rows before; raw_tokens stays above the join
    every = of_candidates(ten.select("qid", "id").union(by_share).distinct(), docs, "content").select("qid", "id", T.raw_tokens(F.col("content")).alias("t")).join(q, "qid")
    hit = F.size(F.filter("qt", lambda x: F.array_contains(F.col("t"), x))) / F.greatest(F.size("qt"), F.lit(1))
    s = every.select("qid", "id", hit.alias("o")).join(ten, ["qid", "id"], "left").fillna(0.0, ["bm25"])
    return top(s.select("qid", "id", F.round(0.75 * F.col("bm25") + 0.25 * F.col("o"), 6).alias("score")).filter("score > 0"), limit)


@_in_goes
def vector_top(vectors: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """R-7, R-8: exact cosine neighbours of a stated query set (qid, q), rounded to 6, above 0.

    A stated set in blocks: batches of vectors times the matrix of queries, as many queries at a time as ``blocks.GROUP`` says; a task keeps the best for each query.
    Vectors of another length than the queries' are compared over the common length; numbers that aren't finite count as 0.
    """
    asked = queries.select("qid", "q").orderBy("qid").limit(blocks.MOST_QUERIES + 1).collect()
    if len(asked) > blocks.MOST_QUERIES:
        raise ValueError(f"more than {blocks.MOST_QUERIES} queries")
    width = max((len(r.q) for r in asked), default=1)
    clean = lambda v: np.nan_to_num(np.array(v, np.float64), posinf=0.0, neginf=0.0)
    q = np.zeros((len(asked), width))
    for k, r in enumerate(asked):
        q[k, : len(r.q)] = clean(r.q)
    full = np.array([len(r.q) for r in asked], np.int64)
    ids = np.array([r.qid for r in asked], np.int64)

    def matrices(batch):
        """(ids, vectors) of a batch's vectors of each length."""
        names = batch.column(0).to_numpy()
        size = np.asarray(pc.list_value_length(batch.column(1)), np.int64)
        at = np.cumsum(size) - size
        flat = pc.fill_null(batch.column(1).flatten(), np.nan).to_numpy(zero_copy_only=False)
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            yield names[own], clean(flat[at[own][:, None] + np.arange(min(n, width))])

    def best(q_at, name, score):
        """The first ``limit`` of each query, by score and id."""
        order = np.lexsort((name, -score, q_at))
        q_at = q_at[order]
        first = np.searchsorted(q_at, q_at)  # where each one's query begins
        keep = order[np.arange(len(order)) - first < limit]
        return q_at[np.arange(len(order)) - first < limit], name[keep], score[keep]

    def run(parts):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in parts:
            for name, m in matrices(batch):
                for low in range(0, len(ids), blocks.GROUP):
                    some = slice(low, low + blocks.GROUP)
                    scores = np.zeros((len(name), len(ids[some])))
                    width_of = np.minimum(full[some], m.shape[1])
                    for n in np.unique(width_of).tolist():
                        own = np.flatnonzero(width_of == n)
                        x, y = m[:, :n], q[some][own, :n]
                        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                        scores[:, own] = np.where(norm > 0, x @ y.T / np.where(norm > 0, norm, 1), 0.0)
                    scores = np.round(scores, 6)
                    row, k = blocks._best(scores, [name], np.zeros(len(name), np.int64), limit, 0.0)
                    held = tuple(np.concatenate(x) for x in zip(held, (k + low, name[row], scores[row, k]), strict=True))
            held = best(*held)
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["qid", "id", "score"])

    rows = small(vectors.select("id", F.coalesce("embedding", F.array().cast(vectors.schema["embedding"].dataType))))
    return top(rows.mapInArrow(run, "qid long, id long, score double"), limit)


def phrase_score(content: Column, query: Column) -> Column:
    """R-10: 1 if the whole query is found, else the share of its token bigrams that are."""
    low = F.lower(content)
    t = T.rag_tokens(query)
    pairs = F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(t, i + 1)))
    hit = F.size(F.filter(pairs, lambda p: F.contains(low, p)))
    return F.when(F.contains(low, F.lower(F.trim(query))), 1.0).when(F.size(pairs) > 0, hit / F.size(pairs)).otherwise(0.0)


def keep_first(rows: DataFrame, key: Column, ord_: str = "ord") -> DataFrame:
    """R-12, U-2: the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(ord_))).filter("_n = 1").drop("_n")


#: Weights of the lexical and of the embedding rerank, of the parts of the semantic score, and the prior of kinds there.
RERANK = {"retrieval": 0.65, "semantic": 0.35}
EMBEDDED = {"retrieval": 0.6, "similarity": 0.4}
SEMANTIC = {"overlap": 0.5, "phrase": 0.2, "source": 0.1, "kind": 0.2}


def rerank(candidates: DataFrame, queries: DataFrame, kind_prior, head: int = 12) -> DataFrame:
    """R-9: candidates (qid, id, source, kind, content, score, rank) -> qid, id, score, rank.

    The first ``head`` of each query are ranked anew by .65 retrieval and .35 semantic score; the rest keep their places.
    """
    q = F.broadcast(queries.select("qid", "query", F.array_distinct(T.rag_tokens(F.col("query"))).alias("qt")))
    c = candidates.join(q, "qid")
    share = lambda t: F.when(F.size("qt") > 0, F.size(F.array_intersect("qt", t)) / F.size("qt")).otherwise(0.0)
    parts = {"overlap": share(T.rag_tokens(F.col("content"))), "phrase": phrase_score(F.col("content"), F.col("query")), "source": share(T.rag_tokens(F.col("source"))), "kind": kind_prior(F.col("kind"))}
    semantic = sum((SEMANTIC[k] * v for k, v in parts.items()), F.lit(0.0))
    in_head = F.col("rank") <= head
    c = c.select("qid", "id", F.col("rank").alias("was"), in_head.alias("head"), F.round(F.when(in_head, RERANK["retrieval"] * F.col("score") + RERANK["semantic"] * semantic).otherwise(F.col("score")), 6).alias("score"))
    w = W.partitionBy("qid").orderBy(F.desc("head"), F.when(F.col("head"), -F.col("score")).otherwise(0.0), "was")
    return c.select("qid", "id", "score", F.row_number().over(w).alias("rank"))


def embedding_rerank(candidates: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """R-11: candidates (qid, id, score), vectors (id, embedding), query_vectors (qid, q): .6 retrieval + .4 (cosine + 1) / 2. Without a vector, a row keeps its score."""
    c = of_candidates(candidates.select("qid", "id", "score"), vectors, "embedding").join(F.broadcast(query_vectors), "qid")
    c = c.select("qid", "id", F.round(EMBEDDED["retrieval"] * F.col("score") + EMBEDDED["similarity"] * (T.cosine(F.col("embedding"), F.col("q")) + 1) / 2, 6).alias("new"))
    s = candidates.select("qid", "id", "score").join(c, ["qid", "id"], "left").select("qid", "id", F.coalesce("new", "score").alias("score"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w))


def quality_proxy(graded: DataFrame, k: int = 6, least: float = 0.2) -> DataFrame:
    """R-13: ranked rows (qid, rank, relevance) -> MRR, recall and nDCG of the first ``k``; relevant are those graded ``least`` or more."""
    good, top_k = F.col("relevance") >= least, F.col("rank") <= k
    ideal = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("relevance"), "rank"))
    gain = lambda at: F.col("relevance") / F.log2(at + F.lit(1.0))
    g = graded.withColumn("best", ideal).groupBy("qid").agg(
        F.round(F.coalesce(1 / F.min(F.when(good & top_k, F.col("rank"))), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.coalesce(F.try_divide(F.count_if(good & top_k), F.count_if(good)), F.lit(0.0)), 4).alias("recall"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(top_k, gain(F.col("rank"))).otherwise(0.0)), F.sum(F.when(F.col("best") <= k, gain(F.col("best"))).otherwise(0.0))), F.lit(0.0)), 4).alias("ndcg"),
    )
    return g


def context_for(explicit: DataFrame, ranked: DataFrame, limit: int = 6) -> DataFrame:
    """R-14: explicit (qid, ord, id, source, content) and ranked (qid, rank, id, source, content) chunks -> qid, ord, id, explicit.

    Queries with explicit chunks retrieve nothing more; others get the first ``limit`` ranked ones. Repeats go, by id and by source and beginning.
    """
    own = explicit.select("qid").distinct()
    more = ranked.filter(F.col("rank") <= limit).join(own, "qid", "left_anti")
    both = explicit.select("qid", "ord", "id", "source", "content", F.lit(True).alias("explicit")).union(more.select("qid", "rank", "id", "source", "content", F.lit(False)))
    order = [F.desc("explicit"), F.col("ord")]
    for key in (["id"], ["source", F.substring("content", 1, 160)]):
        both = both.withColumn("_n", F.row_number().over(W.partitionBy("qid", *key).orderBy(*order))).filter("_n = 1").drop("_n")
    return both.select("qid", F.row_number().over(W.partitionBy("qid").orderBy(*order)).alias("ord"), "id", "explicit")
