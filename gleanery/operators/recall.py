"""R-21, R-22: planning what to search memories for, and searching in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery import stored
from gleanery.functions import text as T
from gleanery.operators import memory, postings

#: Words that no query is made of.
RECALL_STOPWORDS = [
    "a", "an", "and", "app", "are", "as", "at", "be", "before", "by", "client", "close", "code", "context", "day", "do", "docs", "during", "each",
    "feeds", "file", "files", "for", "from", "how", "in", "into", "is", "it", "its", "js", "json", "md", "now", "of", "on", "or", "packet", "project",
    "readme", "remember", "route", "run", "scope", "session", "so", "src", "system", "task", "teach", "teaching", "test", "tests", "that", "the",
    "their", "them", "this", "through", "to", "ts", "txt", "uses", "using", "what", "when", "where", "why", "with", "workspace",
]
#: Weights of a term by where it stands, in thousandths (so that sums are exact); of a variant of it, in hundredths of that.
WEIGHTS = {"task": 1800, "objective": 1550, "focus": 1200, "path": 1350, "name": 1600}
FILE_WEIGHTS = {"path": 1200, "name": 1500}
VARIANT = 72
#: Endings of words that often are nouns, and of derived ones.
NOUNS = "(?:ion|ity|ment|ance|ence|order|auth|cli|memory|engram)$"
DERIVED = "(?:ion|ity|ment|ance|ence)$"
#: Queries of a plan, queries that are tried, candidates per result.
QUERIES, TRIED, CANDIDATES = 5, 3, 3


def split_terms(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(T.decomposed(text)), "[^\\p{L}\\p{N}\\s/._-]", " ")
    return F.filter(F.split(clean, "[\\s/._-]+"), lambda x: x != "")


def useful(term: Column) -> Column:
    return (F.length(term) >= 3) & ~term.isin(RECALL_STOPWORDS) & ~F.rlike(term, F.lit("^v?\\d+$"))


def variants(term: Column) -> Column:
    """The term, and what it is derived from or to: -ate to -ation, -ize to -ization, -ers to -er; words of six letters and more."""
    long, cut = F.length(term) > 5, F.substr(term, F.lit(1), F.length(term) - 1)
    end = lambda e, to: F.when(long & F.endswith(term, F.lit(e)), to)
    return F.filter(F.array_compact(F.array(term, end("ate", F.concat(cut, F.lit("ion"))), end("ize", F.concat(cut, F.lit("ation"))), end("ers", cut))), useful)


def _ranked(terms: DataFrame, name: str) -> DataFrame:
    """(id, place, at, term, weight) -> id, ``name``: each term once, by the sum of its weights, then length, then where it came first."""
    v = terms.select("id", "place", "at", "weight", F.posexplode_outer(variants(F.col("term"))).alias("v", "word")).filter("word IS NOT NULL")
    w = F.when(F.col("v") == 0, F.col("weight") * 100).otherwise(F.col("weight") * VARIANT)
    s = v.groupBy("id", "word").agg(F.sum(w).alias("score"), F.min(F.struct("place", "at", "v")).alias("first"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.length("word")).alias("b"), F.col("first").alias("c"), "word")))
    return s.groupBy("id").agg(F.transform(rows, lambda r: r["word"]).alias(name))


def plans(requests: DataFrame, most: int = QUERIES) -> DataFrame:
    """R-21: (id, task, objective, focus, files array, explicit) -> id, n (from 0), query: what to search for, best first.

    Terms are weighed by where they stand and ranked; seven templates make queries of them, of which those of two words and more stay, each
    once. A request with an explicit query has that one only; one without any useful term has none.
    """
    r = requests.select("id", "task", "objective", "focus", F.coalesce("files", F.array()).alias("files"), F.trim(F.coalesce("explicit", F.lit(""))).alias("explicit"))
    term = lambda c: F.filter(split_terms(c), useful)
    field = lambda c, k: r.select("id", F.lit(k).alias("place"), F.posexplode(term(F.col(c))).alias("at", "term"), F.lit(WEIGHTS[c]).alias("weight"))
    f = r.select("id", F.posexplode("files").alias("k", "file"))
    base = F.element_at(F.split("file", "[\\\\/]"), -1)
    path = lambda w: f.select("id", (F.col("k") * 2 + 10).alias("place"), F.posexplode(term(F.col("file"))).alias("at", "term"), F.lit(w["path"]).alias("weight")).union(f.select("id", F.col("k") * 2 + 11, F.posexplode(term(base)), F.lit(w["name"])))
    ranked = _ranked(field("task", 0).union(field("objective", 1)).union(field("focus", 2)).union(path(WEIGHTS)), "ranked")
    files = _ranked(path(FILE_WEIGHTS), "of_files")
    x = r.join(ranked, "id", "left").join(files, "id", "left")
    none = F.array().cast("array<string>")
    x = x.select("id", "explicit", *[F.coalesce(c, none).alias(c) for c in ("ranked", "of_files")], *[term(F.col(c)).alias(c) for c in ("task", "objective", "focus")])
    head = lambda c, n: F.slice(c, 1, n)
    like = lambda p: F.filter("ranked", lambda w: F.rlike(w, F.lit(p)))
    made = lambda n, *parts: F.array_join(F.slice(F.array_distinct(F.concat(*parts)), 1, n), " ")
    files2 = head("of_files", 2)
    templates = F.array(
        made(4, files2, head(like(DERIVED), 1), head("ranked", 1)), made(4, files2, head(like(NOUNS), 2), head("ranked", 1)), made(4, head("ranked", 3), head(like(NOUNS), 2)),
        made(5, head("task", 2), head("objective", 3), files2), made(6, head("ranked", 5), files2), made(6, head("focus", 6)), made(6, head("task", 6), head("objective", 4)),
    )
    planned = F.slice(F.filter(F.array_distinct(templates), lambda q: F.contains(q, F.lit(" "))), 1, most)
    # outer, here and above: of other generators Spark infers a filter that makes all arrays once more
    return x.select("id", F.posexplode_outer(F.when(F.col("explicit") != "", F.array("explicit")).otherwise(planned)).alias("n", "query")).filter("query IS NOT NULL")


def recall(requests: DataFrame, memories: DataFrame, limit: int = 3, tried: int = TRIED, multiple: int = CANDIDATES, **gates) -> DataFrame:
    """R-22: each request's queries one stage after another, until it has ``multiple`` times ``limit`` candidates: id, memory, stage, rank, query.

    A stage asks one query of each request that is still open, all at once. Of a memory that several queries find, the first one
    counts. A stage's number is that of its query in the plan. Memories are tokenised once, and reduced once to the terms of all queries that may be tried.
    """
    want = limit * multiple
    plan, rows = stored.table(plans(requests)), memory.search_rows(memories, **gates)
    words = plan.filter(F.col("n") < tried).select(F.explode(T.search_tokens(F.col("query"))).alias("term"))
    index = postings.index(rows, words, want)
    still, found = plan.select("id").distinct(), None
    for k in range(tried):
        ask = plan.filter(F.col("n") == k).join(still, "id", "left_semi")
        if not ask.limit(1).count():
            break
        hits = memory.search(memories, ask.select(F.col("id").alias("qid"), "query"), want, index, **gates)
        hits = hits.select(F.col("qid").alias("id"), F.col("id").alias("memory"), F.lit(k).alias("stage"), "rank").join(ask.select("id", "query"), "id")
        if found is not None:
            hits = found.unionByName(hits.join(found.select("id", "memory"), ["id", "memory"], "left_anti"))
        found = stored.table(hits)
        full = found.groupBy("id").count().filter(F.col("count") >= want)
        still = plan.select("id").distinct().join(full, "id", "left_anti")
    return found if found is not None else plan.select("id", F.lit(None).cast(memories.schema["id"].dataType).alias("memory"), F.lit(0).alias("stage"), F.lit(0).alias("rank"), "query").limit(0)


def report(requests: DataFrame, found: DataFrame) -> DataFrame:
    """R-22: id, status (recalled, empty, or skipped without a query), candidates, first_match (the first stage with a hit), queries_matched."""
    g = found.groupBy("id").agg(F.count("*").alias("candidates"), F.min("stage").alias("first_match"), F.countDistinct("stage").alias("queries_matched"))
    asked = plans(requests).select("id").distinct().withColumn("asked", F.lit(True))
    j = requests.select("id").join(g, "id", "left").join(asked, "id", "left")
    status = F.when(F.col("asked").isNull(), "skipped").when(F.col("candidates") > 0, "recalled").otherwise("empty")
    return j.select("id", status.alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("first_match", F.lit(-1)).alias("first_match"), F.coalesce("queries_matched", F.lit(0)).alias("queries_matched"))


def relevant(requests: DataFrame, found: DataFrame, memories: DataFrame, as_of: str, limit: int = 3, shown: DataFrame | None = None, resurface: bool = False, tools: list[str] = ()) -> DataFrame:
    """R-18 over the candidates of each request: id, memory, shown, score, rank. Memories (id, title, content, type, topic, created) that were ``shown`` (id) lose
    .45, and are left out unless ``resurface`` fills up with them; ones that name a tool in use lose .16."""
    mine = T.relevance_tokens(F.substring(F.concat_ws(" ", "title", "content", "type", "topic"), 1, 12_000))
    memories = memories.join(stored.bounded(found.select(F.col("memory").alias("id")).distinct()), "id", "left_semi")  # only these are tokenised
    m = memories.select(F.col("id").alias("memory"), mine.alias("t"), F.datediff(F.to_date(F.lit(as_of)), F.to_date("created")).cast("double").alias("age"), F.to_date("created").alias("day"))
    m = m.join(shown.select(F.col("id").alias("memory"), F.lit(True).alias("shown")), "memory", "left") if shown is not None else m.withColumn("shown", F.lit(None).cast("boolean"))
    files = F.array_join(F.coalesce("files", F.array().cast("array<string>")), " ")
    q = requests.select("id", T.relevance_tokens(F.concat_ws(" ", "task", "objective", "focus", files)).alias("q"), T.relevance_tokens(files).alias("p"))
    j = found.select("id", "memory", "stage", F.col("rank").alias("was")).join(m, "memory").join(q, "id")
    # what both have is found by hashing, once for a pair; repeats are counted among these few
    hits = lambda c: F.get(F.transform(F.array(F.array_intersect("t", c)), lambda both: F.size(F.filter("t", lambda x: F.array_contains(both, x)))), F.lit(0))
    over = lambda c: F.when(F.size("t") > 0, hits(c) / F.size("t")).otherwise(0.0)
    used = F.lit(False)
    for word in tools:
        used = used | F.array_contains("t", word.lower())
    s = over(F.col("q")) * 0.58 + over(F.col("p")) * 0.14 + T.half_life(F.greatest("age", F.lit(0.0)), 14) * 0.28 - F.when(F.col("shown"), 0.45).otherwise(0.0) - F.when(used, 0.16).otherwise(0.0)
    j = j.select("id", "memory", F.coalesce("shown", F.lit(False)).alias("shown"), F.round(s, 4).alias("score"), "day", "stage", "was")
    j = j if resurface else j.filter("NOT shown")
    w = W.partitionBy("id").orderBy("shown", F.desc("score"), F.desc("day"), "stage", "was")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("id", "memory", "shown", "score", "rank")
