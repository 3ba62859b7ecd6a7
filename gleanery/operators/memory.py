"""Gated search and ranking of memories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery import stored
from gleanery.functions import text as T
from gleanery.operators import blocks, postings, retrieval

#: Weights of the hybrid memory rank, and of the ranking of relevant memories.
HYBRID = {"lexical": 0.5, "path": 0.16, "recency": 0.2, "language": -0.48, "security": 0.14, "security_only": 0.28, "not_security": -0.65}
RELEVANT = {"lexical": 0.58, "path": 0.14, "recency": 0.28, "surfaced": -0.45}


#: How grave a memory about security is, by a word in its severity; without one; and the shares of that and of its confidence.
SEVERITY = {"critical": 1.0, "high": 0.9, "medium": 0.7, "low": 0.55}
NO_SEVERITY, NO_CONFIDENCE = 0.6, 0.5
SHARES = {"severity": 0.6, "confidence": 0.4}


def is_security(memories: DataFrame) -> Column:
    """About security: by type, or if there are such columns, by a risk or a severity."""
    out = F.contains(F.lower("type"), F.lit("security")) if "type" in memories.columns else F.lit(False)
    if "risk" in memories.columns:
        out = out | (F.trim("risk") != "")
    if "severity" in memories.columns:
        out = out | F.lower(F.trim("severity")).isin(list(SEVERITY))
    return F.coalesce(out, F.lit(False))


def security_weight(memories: DataFrame) -> Column:
    """R-17: severity and confidence of a memory about security, 0 for others."""
    grave = F.lit(NO_SEVERITY)
    if "severity" in memories.columns:
        for word, value in reversed(SEVERITY.items()):
            grave = F.when(F.contains(F.lower("severity"), F.lit(word)), value).otherwise(grave)
    sure = F.when(F.col("confidence").isNotNull() & ~F.isnan("confidence"), T.clamp(F.col("confidence"))).otherwise(NO_CONFIDENCE) if "confidence" in memories.columns else F.lit(NO_CONFIDENCE)
    return F.when(is_security(memories), grave * SHARES["severity"] + sure * SHARES["confidence"]).otherwise(0.0)


def gate(memories: DataFrame, project: str | None = None, types: list[str] | None = None, scope: str | None = None, security_only: bool = False, language: str | None = None, strict: bool = False) -> DataFrame:
    """R-20: what may be found at all; applied before any statistics, which are those of the gated set.

    A strict language gate drops memories without a language, a relaxed one keeps them.
    """
    if project is not None:
        memories = memories.filter(F.col("project") == project)
    if types is not None:
        memories = memories.filter(F.col("type").isin(types))
    if scope is not None:
        memories = memories.filter(F.col("scope") == scope)
    if security_only:
        memories = memories.filter(is_security(memories))
    if language is not None:
        same = F.col("language") == language
        memories = memories.filter(same if strict else same | F.col("language").isNull())
    return memories


def search_rows(memories: DataFrame, **gates) -> DataFrame:
    """(id, t): what ``search`` looks at, tokenised, for callers that make postings of it."""
    return retrieval.tokenised(gate(memories, **gates).select("id", F.concat_ws(" ", "title", "content").alias("content")))


def search(memories: DataFrame, queries: DataFrame, limit: int = 10, index: postings.Index | None = None, **gates) -> DataFrame:
    """R-15: TF-IDF over the gated set. Queries without a term find what is newest (by created, then ord), with score 1. ``index``: postings of ``search_rows`` with
    the same gates, for very many queries."""
    m = gate(memories, **gates)
    found = retrieval.tfidf(m.select("id", F.concat_ws(" ", "title", "content").alias("content")), queries, limit) if index is None else postings.tfidf(index, queries, limit)
    empty = queries.filter(F.size(T.search_tokens(F.col("query"))) == 0).select("qid")
    newest = m.orderBy(F.desc("created"), F.desc("ord")).select("id").limit(limit).collect()
    if not newest:
        return found
    kind = m.schema["id"].dataType
    listed = F.posexplode(F.array(*[F.lit(r.id).cast(kind) for r in newest])).alias("at", "id")
    return found.unionByName(empty.select("qid", listed).select("qid", "id", F.lit(1.0).alias("score"), (F.col("at") + 1).alias("rank")))


#: Memories that the first round of ``search_all`` looks at, and projects; each round four times as many.
FIRST_ROWS, FIRST_PROJECTS = 20_000, 1_000


def _by_project(memories: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(qid, project, id, score, rank): the best of each project by its own statistics, from the postings of the queries' terms."""
    m = memories.select("project", "id", T.search_tokens(F.concat_ws(" ", "title", "content")).alias("t"))
    terms = queries.select("qid", F.explode(T.search_tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
    p = m.select("project", "id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("project", "id", "dl", "term").agg(F.count("*").alias("tf"))
    idf = p.groupBy("project", "term").agg(F.count("*").alias("df")).join(m.groupBy("project").agg(F.count("*").alias("n")), "project")
    idf = idf.select("project", "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    s = p.join(idf, ["project", "term"]).join(terms, "term").groupBy("qid", "project", "id").agg(F.round(F.sum(F.col("qn") * F.col("tf") / F.col("dl") * F.col("idf")), 6).alias("score")).filter("score > 0")
    return s.withColumn("rank", F.row_number().over(W.partitionBy("qid", "project").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= limit)


def search_all(memories: DataFrame, queries: DataFrame, limit: int = 10, **gates) -> DataFrame:
    """R-26: each project searched on its own, with its own statistics; results one project after another, by name, without repeats; the first ``limit``.

    As projects come in order of their names, a query is done once it has ``limit`` results. So projects are looked at in rounds, each over four
    times as many memories as the one before, and only with the queries that are still open, which are those with rare
    terms. A round with one project is scored in blocks, one with several from postings. Memories without a project are found by none.
    """
    m = gate(memories, **gates).filter("project IS NOT NULL")
    sizes = stored.table(m.groupBy("project").agg(F.count("*").alias("n")))
    found, still, last, rows, names = None, queries, None, FIRST_ROWS, FIRST_PROJECTS
    while following := (sizes if last is None else sizes.filter(F.col("project") > last)).orderBy("project").limit(names).collect():
        taken, total = [], 0
        for r in following:
            if taken and total + r.n > rows:
                break
            taken.append(r.project)
            total += r.n
        last = taken[-1]
        if len(taken) == 1:
            one = retrieval.tfidf(m.filter(F.col("project") == last).select("id", F.concat_ws(" ", "title", "content").alias("content")), still, limit).withColumn("project", F.lit(last))
        else:
            one = _by_project(m.filter(F.col("project").between(taken[0], last)), still, limit)
        one = one.select("qid", "project", "id", "score", "rank")
        found = stored.table(one if found is None else found.union(one))
        full = found.groupBy("qid").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= limit)
        still = stored.table(queries.join(full, "qid", "left_anti"))
        if not still.limit(1).count():
            break
        rows, names = rows * 4, names * 4
    if found is None:
        return search(m, queries, limit).limit(0)
    first = found.groupBy("qid", "id").agg(F.min(F.struct("project", "rank", "score")).alias("r"))
    w = W.partitionBy("qid").orderBy("r.project", "r.rank", "id")
    return first.select("qid", "id", "r.score", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= limit)


def entry_overlap(query: Column, tokens: Column) -> Column:
    """R-19: hits over the entry's own tokens, repeats counted."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda x: F.array_contains(query, x))) / F.size(tokens)).otherwise(0.0)


def _age(as_of: str) -> Column:
    return F.datediff(F.to_date(F.lit(as_of)), F.to_date("created")).cast("double")


def _rows(memories: DataFrame, as_of: str) -> DataFrame:
    """What ranking reads of memories; ``newer`` orders by time, newest first."""
    names = {"id", "ord", "project", "language"} & set(memories.columns)
    return memories.select(*sorted(names), T.memory_tokens(F.concat_ws(" ", "title", "content")).alias("t"), _age(as_of).alias("age"), (-F.unix_date(F.to_date("created"))).alias("newer"), security_weight(memories).alias("security"), *[c for c in ("shown",) if c in memories.columns])


def _overlap(tf, size, g):
    """R-19 for all rows and queries: the share of a row's tokens, repeats counted, that the query has."""
    return tf @ (g.counts > 0).astype(float) / np.maximum(size, 1)[:, None]


def _decay(age, days: float):
    return np.exp(-np.log(2.0) * np.maximum(age, 0.0) / days)[:, None]


def ranked(memories: DataFrame, queries: DataFrame, as_of: str, limit: int = 5, security_only: bool = False) -> DataFrame:
    """R-17: lexical share, project named in the query, recency with a half-life of 21 days, how grave a memory about security is (others are
    pushed back if ``security_only``), and, where both have one, a language that differs; a total order by score, time and ord. All memories are scored for the stated queries, in blocks."""
    groups = blocks.asked(queries, T.memory_tokens(F.col("query")), "query", *[c for c in ("language",) if c in queries.columns])
    strings = "language" in memories.columns and "language" in queries.columns

    def score(tf, size, g, more):
        named = {p: np.array([p.lower() in (r.query or "").lower() for r in g.rows], float) for p in set(more["project"]) if p is not None}
        none = np.zeros(len(g.rows))
        s = HYBRID["lexical"] * _overlap(tf, size, g) + HYBRID["path"] * np.array([named.get(p, none) for p in more["project"]]) + HYBRID["recency"] * _decay(more["age"], 21)
        grave = more["security"]
        s = s + (HYBRID["security_only" if security_only else "security"] * grave + (HYBRID["not_security"] * (grave == 0) if security_only else 0.0))[:, None]
        if strings:
            other = {x: np.array([r.language is not None and x is not None and r.language != x for r in g.rows], float) for x in set(more["language"])}
            s = s + HYBRID["language"] * np.array([other[x] for x in more["language"]])
        return s

    extra = ("project", "age", "security", *(("language",) if strings else ()))
    return blocks.top(_rows(memories, as_of), groups, score, limit, 4, above=-np.inf, ties=("newer", "ord"), extra=extra)


def relevant(memories: DataFrame, queries: DataFrame, surfaced: DataFrame, as_of: str, limit: int = 5) -> DataFrame:
    """R-18: memories not shown before come first; ones shown before are ranked lower and marked."""
    m = memories.join(surfaced.select("id", F.lit(True).alias("shown")), "id", "left").withColumn("shown", F.coalesce("shown", F.lit(False)).cast("int"))
    groups = blocks.asked(queries, T.memory_tokens(F.col("query")), "query")

    def score(tf, size, g, more):
        named = {p: np.array([p.lower() in (r.query or "").lower() for r in g.rows], float) for p in set(more["project"]) if p is not None}
        path = np.array([named.get(p, np.zeros(len(g.rows))) for p in more["project"]])
        return RELEVANT["lexical"] * _overlap(tf, size, g) + RELEVANT["path"] * path + RELEVANT["recency"] * _decay(more["age"], 14) + (RELEVANT["surfaced"] * more["shown"])[:, None]

    out = blocks.top(_rows(m, as_of), groups, score, limit, 4, above=-np.inf, ties=("newer", "ord"), first="shown", extra=("project", "age"))
    return out.select("qid", "id", (F.col("shown") == 1).alias("shown"), "score", "rank")


def as_chunks(memories: DataFrame) -> DataFrame:
    """H-14: a project's first memory gets priority .9, others .82."""
    first = memories.groupBy("project").agg(F.min("ord").alias("first"))
    return memories.join(first, "project").select("id", F.lit("memory").alias("kind"), F.when(F.col("ord") == F.col("first"), 0.9).otherwise(0.82).alias("priority"))


def retry_state(letters: DataFrame, as_of: str, ttl_days: int = 30, base_minutes: int = 5, most_minutes: int = 1440) -> DataFrame:
    """I-19: (id, attempts, created) dead letters -> wait in minutes, and keep, retry or quarantine."""
    wait = F.least(F.lit(float(most_minutes)), base_minutes * F.pow(F.lit(2.0), F.col("attempts") - 1))
    return letters.select("id", wait.alias("wait"), F.when(_age(as_of) > ttl_days, "quarantine").when(_age(as_of) * 1440 < wait, "keep").otherwise("retry").alias("state"))
