"""Registered queries over the driver's tables and their DuckDB equivalents.

Chunks are documents: id and ord are doc_id, the kind follows from doc_id, signals too. Queries are the whole texts of
all benchmark items; they are put to all documents. Operators that work on the chunks of a request (rerank, selection) get the
candidates that retrieval has for each item. Memories are documents as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import stored
from gleanery.functions import text as T
from gleanery.operators import conversations, evals, guards, hygiene, joins, memory, observe, parsing, retrieval, selection, tagging
from gleanery.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KINDS = ["code", "test", "spec", "memory", "doc", "chat", "log"]
TYPES = ["decision", "architecture", "pattern", "learning", "bugfix", "session"]
AS_OF = "2024-04-01"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = " ".join(sql.split("\n")) if "--" not in sql else sql
        return f

    return put


# ---- tables -------------------------------------------------------------------------------------


#: Tables of texts up to this size (bytes on disk) are dealt to all cores once they are read: a small file is one row group, and so one task.
SMALL_TABLE = 64 << 20


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    if name in ("documents", "pages") and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_TABLE:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def pick(index, values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return t(spark, d, "documents").select(i.alias("id"), i.alias("ord"), "source", F.col("text").alias("content"), pick(i, KINDS).alias("kind"), (i % 10 / 10).alias("certainty"), (i % 5 / 5).alias("teachingValue"), (i % 4 / 4).alias("priority"), F.lit(0.5).alias("recency"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


#: Candidates of a request: the best by BM25.
CANDIDATES = 30


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(qid, score, rank) and the columns of chunks."""
    best = stored.table(retrieval.bm25(chunks(spark, d), asked(spark, d), CANDIDATES))
    c = chunks(spark, d)
    return retrieval.of_candidates(best, c, *[x for x in c.columns if x != "id"])


def memories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    topic = F.concat(F.lit("topic-"), (i % 50).cast("string"))
    return t(spark, d, "documents").select(i.alias("id"), i.alias("ord"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), pick(i, TYPES).alias("type"), F.col("source").alias("project"), topic.alias("topic"), F.date_add(F.to_date(F.lit("2024-01-01")), (i % 90).cast("int")).alias("created"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("user"), F.col("event_type").alias("command"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tok(kind: str, x: str) -> str:
    """A tokenizer in DuckDB."""
    drop, least, stop = {
        "search": ("[^a-z0-9à-ɏ]+", 2, T.SEARCH_STOPWORDS), "raw": ("[^\\p{L}\\p{N}]+", 1, []), "selector": ("[^\\p{L}\\p{N}\\s./_-]+", 1, T.SELECTOR_STOPWORDS),
        "rag": ("[^\\p{L}\\p{N}]+", 2, T.RAG_STOPWORDS), "sync": ("[^a-z0-9_]+", 3, []), "tagger": ("[^a-záéíóúñü0-9\\s]", 2, []), "memory": ("[^\\p{L}\\p{N}\\s]+", 3, T.MEMORY_STOPWORDS), "relevance": ("[^\\p{L}\\p{N}\\s]+", 3, T.RELEVANCE_STOPWORDS),
    }[kind]
    if kind in ("selector", "raw", "memory", "relevance"):
        have, plain = T.latin_marks()
        x = f"translate(regexp_replace(coalesce({x}, ''), '([{have}])', '\\1 ', 'g'), '{have}', '{plain}')"
    if kind in ("memory", "relevance"):
        x = f"regexp_replace({x}, '[/._-]+', ' ', 'g')"
    no = f" AND w NOT IN ({_list(stop)})" if stop else ""
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '{drop}', ' ', 'g'), '\\s+'), lambda w: length(w) >= {least}{no})"


CHUNKS = f"SELECT doc_id AS id, doc_id AS ord, source, text AS content, ([{_list(KINDS)}])[doc_id % 7 + 1] AS kind, doc_id % 10 / 10 AS certainty, doc_id % 5 / 5 AS teachingValue, doc_id % 4 / 4 AS priority FROM documents"
ASKED = "SELECT item_id AS qid, text AS query FROM benchmark"
MEMORIES = f"SELECT doc_id AS id, doc_id AS ord, substr(text, 1, 40) AS title, text AS content, ([{_list(TYPES)}])[doc_id % 6 + 1] AS type, source AS project, 'topic-' || (doc_id % 50) AS topic, DATE '2024-01-01' + (doc_id % 90)::INT AS created FROM documents"
EVENTS = "SELECT event_id AS id, ts, user_id AS usr, event_type AS command, value AS duration, event_type = 'error' AS failed FROM events"
COMPACT = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


def _bm25_ctes(limit: int, name: str = "b") -> str:
    return f"""
c AS ({CHUNKS}), q AS ({ASKED}),
tk AS (SELECT id, {tok("search", "content")} AS t FROM c),
cor AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({tok("search", "query")}) AS term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT qid, id, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM p JOIN qt USING (term) JOIN dfs USING (term), cor GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {limit})"""


# ---- retrieval ----------------------------------------------------------------------------------


@query("r1_bm25", f"WITH {_bm25_ctes(10)} SELECT qid, id, score, rank FROM b")
def r1(spark, d):
    return retrieval.bm25(chunks(spark, d), asked(spark, d))


_TFIDF = f"""WITH {_bm25_ctes(10)}, s2 AS (SELECT qid, id, round(sum(qn * tf / dl * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM p JOIN qt USING (term) JOIN dfs USING (term), cor GROUP BY ALL)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s2 WHERE score > 0 QUALIFY rank <= 10"""


@query("r3_tfidf", _TFIDF)
def r3(spark, d):
    return retrieval.tfidf(chunks(spark, d), asked(spark, d))


_HYBRID = f"""WITH {_bm25_ctes(30)},
k AS (SELECT qid, id, b.score AS bm25, content, kind, (certainty + teachingValue + priority) / 3 AS signal FROM b JOIN c USING (id)),
kp AS (SELECT qid, id, dl, term, count(*) AS tf FROM (SELECT qid, id, len(t) AS dl, unnest(t) AS term FROM (SELECT qid, id, {tok("search", "content")} AS t FROM k)) GROUP BY ALL),
kq AS (SELECT * FROM kp JOIN qt USING (qid, term)), kd AS (SELECT qid, term, count(*) AS df FROM kq GROUP BY ALL), kn AS (SELECT qid, count(*) AS n FROM k GROUP BY qid),
tf AS (SELECT qid, id, sum(qn * tf / dl * (ln((n + 1) / (df + 1)) + 1)) AS tfidf FROM kq JOIN kd USING (qid, term) JOIN kn USING (qid) GROUP BY ALL),
x AS (SELECT qid, id, kind, bm25, coalesce(tfidf, 0) AS tfidf, signal FROM k LEFT JOIN tf USING (qid, id)),
y AS (SELECT qid, id, kind, round(0.4 * coalesce(bm25 / nullif(max(bm25) OVER w, 0), 0) + 0.3 * coalesce(tfidf / nullif(max(tfidf) OVER w, 0), 0) + 0.3 * coalesce(signal / nullif(max(signal) OVER w, 0), 0), 6) AS score FROM x WINDOW w AS (PARTITION BY qid))
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM y QUALIFY rank <= 10"""


@query("r4_hybrid", _HYBRID)
def flagship(spark, d):
    return retrieval.hybrid(chunks(spark, d), asked(spark, d))


@query("r5_overlap_blend", f"""WITH {_bm25_ctes(10)}, o AS (SELECT qid, id, len(list_filter(qt, lambda x: list_contains(ct, x))) / greatest(len(qt), 1) AS o
FROM (SELECT qid, {tok("raw", "query")} AS qt FROM q), (SELECT id, {tok("raw", "content")} AS ct FROM c)),
z AS (SELECT qid, id, round(0.75 * coalesce(b.score, 0) + 0.25 * o, 6) AS score FROM o LEFT JOIN b USING (qid, id))
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM z WHERE score > 0 QUALIFY rank <= 10""")  # fmt: skip
def r5(spark, d):
    return retrieval.overlap_blend(chunks(spark, d), asked(spark, d))


_VEC = """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5"""


@query("r8_vector_top", _VEC)
def r8(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_top(e, e.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("q")))


_CAND = f"{_bm25_ctes(30)}, k AS (SELECT b.qid, b.score AS retrieval, b.rank, c.*, query FROM b JOIN c USING (id) JOIN q USING (qid))"
_PHRASE = f"list_transform(range(1, len({tok('rag', 'query')})), lambda i: {tok('rag', 'query')}[i] || ' ' || {tok('rag', 'query')}[i + 1])"


@query("r10_phrase_score", f"""WITH {_CAND}, x AS (SELECT qid, id, lower(content) AS low, lower(trim(query)) AS lq, {tok("rag", "query")} AS qt FROM k),
y AS (SELECT *, list_transform(range(1, len(qt)), lambda i: qt[i] || ' ' || qt[i + 1]) AS ps FROM x)
SELECT qid, id, CASE WHEN contains(low, lq) THEN 1.0::DOUBLE WHEN len(ps) > 0 THEN round(len(list_filter(ps, lambda p: contains(low, p))) / len(ps), 6) ELSE 0.0 END AS score FROM y""")  # fmt: skip
def r10(spark, d):
    x = candidates(spark, d).join(F.broadcast(asked(spark, d)), "qid")
    return x.select("qid", "id", F.round(retrieval.phrase_score(F.col("content"), F.col("query")), 6).alias("score"))


_SEMANTIC = f"""x AS (SELECT *, list_distinct({tok("rag", "query")}) AS u, {tok("rag", "query")} AS qt, {tok("rag", "content")} AS ct, {tok("rag", "source")} AS st, lower(content) AS low FROM k),
y AS (SELECT *, CASE WHEN len(u) > 0 THEN len(list_intersect(u, ct)) / len(u) ELSE 0 END AS o, CASE WHEN len(u) > 0 THEN len(list_intersect(u, st)) / len(u) ELSE 0 END AS so,
  list_transform(range(1, len(qt)), lambda i: qt[i] || ' ' || qt[i + 1]) AS ps FROM x),
z AS (SELECT *, CASE WHEN contains(low, lower(trim(query))) THEN 1.0 WHEN len(ps) > 0 THEN len(list_filter(ps, lambda p: contains(low, p))) / len(ps) ELSE 0.0 END AS ph, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in tagging.KIND_PRIOR.items())} ELSE 0 END AS kp FROM y),
rr AS (SELECT qid, id, rank AS was, round(CASE WHEN rank <= 12 THEN 0.65 * retrieval + 0.35 * (0.5 * o + 0.2 * ph + 0.1 * so + 0.2 * kp) ELSE retrieval END, 6) AS score FROM z),
re AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY was <= 12 DESC, CASE WHEN was <= 12 THEN -score ELSE 0 END, was) AS rank FROM rr)"""


def _reranked(spark, d):
    return retrieval.rerank(candidates(spark, d), asked(spark, d), tagging.kind_prior)


@query("r9_rerank", f"WITH {_CAND}, {_SEMANTIC} SELECT qid, id, score, rank FROM re")
def r9(spark, d):
    return _reranked(spark, d)


_VECTOR = "list_transform(range(1, 9), lambda i: (doc_id * i % 97)::DOUBLE + length(text) % (i + 6))"


@query("r11_embedding_rerank", f"""WITH {_bm25_ctes(30)}, v AS (SELECT doc_id AS id, {_VECTOR} AS e FROM documents), qv AS (SELECT item_id AS qid, {_VECTOR.replace("doc_id", "item_id")} AS q FROM benchmark),
s AS (SELECT b.qid, b.id, round(0.6 * b.score + 0.4 * (list_cosine_similarity(e, qv.q) + 1) / 2, 6) AS score FROM b JOIN v USING (id) JOIN qv USING (qid)) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s""")  # fmt: skip
def r11(spark, d):
    vector = lambda i: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.col(i) * k % 97).cast("double") + F.length("text") % (k + 6))
    v = t(spark, d, "documents").select(F.col("doc_id").alias("id"), vector("doc_id").alias("embedding"))
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), vector("item_id").alias("q"))
    return retrieval.embedding_rerank(candidates(spark, d), v, q)


_GRADE = f"CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {tok('rag', 'content')})) / len(qt) ELSE 0 END"


@query("r13_quality_proxy", f"""WITH {_CAND}, x AS (SELECT qid, id, rank, content, list_distinct({tok("rag", "query")}) AS qt FROM k), r AS (SELECT qid, id, rank, round({_GRADE}, 6) AS rel FROM x),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS best FROM r)
SELECT qid, round(coalesce(1 / min(rank) FILTER (rel >= 0.2 AND rank <= 6), 0), 4) AS mrr, round(coalesce(count(*) FILTER (rel >= 0.2 AND rank <= 6) / nullif(count(*) FILTER (rel >= 0.2), 0), 0), 4) AS recall,
round(coalesce(sum(CASE WHEN rank <= 6 THEN rel / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN best <= 6 THEN rel / log2(best + 1) ELSE 0 END), 0), 0), 4) AS ndcg FROM y GROUP BY qid""")  # fmt: skip
def r13(spark, d):
    x = candidates(spark, d).join(F.broadcast(asked(spark, d)), "qid")
    return retrieval.quality_proxy(x.select("qid", "rank", F.round(T.overlap(T.rag_tokens(F.col("content")), T.rag_tokens(F.col("query"))), 6).alias("relevance")))


@query("r14_rag_context", f"""WITH {_CAND}, {_SEMANTIC}, ex AS (SELECT doc_id % 8 AS qid, doc_id AS ord, doc_id AS id, source, text AS content FROM documents WHERE doc_id % 8 IN (SELECT qid FROM q WHERE qid % 8 = 3)),
a AS (SELECT *, true AS explicit FROM ex UNION ALL SELECT qid, re.rank AS ord, id, source, content, false FROM re JOIN c USING (id) WHERE re.rank <= 6 AND qid NOT IN (SELECT qid FROM ex)),
oo AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY explicit DESC, ord) = 1), pp AS (SELECT * FROM oo QUALIFY row_number() OVER (PARTITION BY qid, source, substr(content, 1, 160) ORDER BY explicit DESC, ord) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY explicit DESC, ord) AS ord, id, explicit FROM pp""")  # fmt: skip
def r14(spark, d):
    c = chunks(spark, d)
    explicit = c.select((F.col("id") % 8).alias("qid"), "ord", "id", "source", "content").join(F.broadcast(asked(spark, d).filter("qid % 8 = 3")), "qid", "left_semi")
    return retrieval.context_for(explicit, retrieval.of_candidates(_reranked(spark, d), c, "source", "content"))


@query("r12_keep_first", "SELECT min(doc_id) AS id, source FROM documents GROUP BY source, substr(text, 1, 160)")
def r12(spark, d):
    c = chunks(spark, d)
    return retrieval.keep_first(c, F.concat("source", F.lit("\x1f"), F.substring("content", 1, 160))).select("id", "source")


# ---- tags and scalar functions ------------------------------------------------------------------


@query("t1_t8_tokenizers", "SELECT doc_id AS id, " + ", ".join(f"len({tok(k, 'text')})::BIGINT AS n_{k}, md5(array_to_string({tok(k, 'text')}, ' ')) AS h_{k}" for k in ("search", "raw", "selector", "rag", "sync", "tagger", "memory")) + " FROM documents")
def t1(spark, d):
    f = {"search": T.search_tokens, "raw": T.raw_tokens, "selector": T.selector_tokens, "rag": T.rag_tokens, "sync": T.sync_tokens, "tagger": T.tagger_words, "memory": T.memory_tokens}
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), *[g(F.col("text")).alias(k) for k, g in f.items()])
    return x.select("id", *[c for k in f for c in (F.size(k).cast("long").alias(f"n_{k}"), F.md5(F.array_join(k, " ").cast("binary")).alias(f"h_{k}"))])


_C60 = COMPACT.format("text")


@query("f1_f5_scalars", f"""SELECT doc_id AS id, CASE WHEN length({_C60}) > 60 THEN rtrim(substr({_C60}, 1, 57)) || '...' ELSE {_C60} END AS short, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
substr(sha256(text), 1, 12) AS fp, ceil(length(text) / 4)::BIGINT AS tokens, round(exp(-ln(2) * (doc_id % 90) / 21), 6) AS decay, round(greatest(0.45, least(1, 1 - (doc_id % 90) / 30)), 6) AS linear FROM documents""")  # fmt: skip
def f1(spark, d):
    x, age = F.col("text"), (F.col("doc_id") % 90).cast("double")
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.compact(x, 60).alias("short"), F.md5(T.slug(x).cast("binary")).alias("slug"), T.fingerprint(x).alias("fp"), T.estimated_tokens(x).alias("tokens"), F.round(T.half_life(age, 21), 6).alias("decay"), F.round(T.linear_decay(age, 30, 0.45), 6).alias("linear"))


def _hits(words) -> str:
    return f"len(list_filter(w, lambda x: x IN ({_list(dict.fromkeys(words))})))"


def _moods(words) -> str:
    return " + ".join(f"contains(lower(c), '{w}')::INT" for w in words)


_DOMS = list(tagging.DOMAINS)
_TAGS = f"""WITH x AS (SELECT doc_id AS id, coalesce(text, '') AS c, {tok("tagger", "text")} AS w, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: trim(s, ' ')), lambda s: length(s) > 0) AS s FROM documents),
y AS (SELECT *, {_hits(tagging.SPANISH_MARKERS)} AS es, {_hits(tagging.ENGLISH_MARKERS)} AS en, {", ".join(f"{_hits(tagging.DOMAINS[k])} AS d_{k}" for k in _DOMS)}, len(w) AS n, len(list_distinct(w)) AS u, len(s) AS ns, list_sum(list_transform(w, lambda z: length(z))) AS chars, len(list_filter(w, lambda z: length(z) > 8)) AS lng, {_moods(tagging.POSITIVE)} AS p, {_moods(tagging.NEGATIVE)} AS g FROM x),
m AS (SELECT *, greatest({", ".join("d_" + k for k in _DOMS)}) AS most FROM y)
SELECT id, CASE WHEN es > en * 1.2 THEN 'es' WHEN en > es * 1.2 THEN 'en' WHEN es > 0 AND en = 0 THEN 'es' ELSE 'en' END AS language,
CASE WHEN most < 2 THEN 'general' {" ".join(f"WHEN d_{k} = most THEN '{k}'" for k in _DOMS)} END AS "domain",
CASE WHEN n / nullif(ns, 0) / 20 + u / nullif(n, 0) * 2 > 2.0 THEN 'high' WHEN n / nullif(ns, 0) / 20 + u / nullif(n, 0) * 2 > 1.2 THEN 'medium' ELSE 'low' END AS complexity,
CASE WHEN chars / nullif(n, 0) > 6.5 OR lng / nullif(n, 0) > 0.25 THEN 'advanced' WHEN chars / nullif(n, 0) > 5.0 OR lng / nullif(n, 0) > 0.12 THEN 'intermediate' ELSE 'basic' END AS reading_level,
CASE WHEN p > g + 1 THEN 'positive' WHEN g > p + 1 THEN 'negative' ELSE 'neutral' END AS sentiment, n::BIGINT AS word_count FROM m"""


@query("p9_tags", _TAGS)
def p9(spark, d):
    return tagging.tags(chunks(spark, d))


@query("p12_topics", f"""WITH x AS (SELECT doc_id AS id, {tok("tagger", "text")} AS w FROM documents), e AS (SELECT id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM x),
g AS (SELECT id, term, count(*) AS n, min(pos) AS pos FROM e WHERE length(term) >= 3 AND term NOT IN ({_list(tagging.ENGLISH_STOPWORDS + tagging.SPANISH_STOPWORDS)}) GROUP BY ALL)
SELECT id, term, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS rank FROM g QUALIFY rank <= 5""")  # fmt: skip
def p12(spark, d):
    return tagging.topics(chunks(spark, d))


@query("i2_p20_paths", """SELECT page_id AS id, regexp_matches(lower(url), '\\.(js|ts|jsx|tsx|mjs|cjs|json|md|mdx|txt|py|go|rs|java|yml|yaml|toml|sql|sh|html|css)$') AS candidate FROM pages""")
def i2(spark, d):
    return t(spark, d, "pages").select(F.col("page_id").alias("id"), files.is_candidate(F.col("url")).alias("candidate"))


@query("i5_head", "SELECT doc_id AS id, md5(array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10))) AS h FROM documents")
def i5(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(files.head(F.col("text"), 3).cast("binary")).alias("h"))


# ---- hygiene and sync ---------------------------------------------------------------------------


def _sum_when(*pairs) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in pairs)


_EVAL = f"""WITH m AS ({MEMORIES}), a AS (SELECT *, {COMPACT.format("title")} AS ct, {COMPACT.format("content")} AS cc FROM m),
b AS (SELECT *, lower(ct) || '::' || lower(cc) || '::' || type || '::' || project AS fp FROM a),
n AS (SELECT *, count(*) OVER (PARTITION BY fp) AS fnn, count(*) OVER (PARTITION BY topic) AS tnn FROM b),
s AS (SELECT *, round(greatest(CASE WHEN fnn > 1 THEN least(1.0, 0.4 + (fnn - 1) * 0.25) ELSE 0 END, CASE WHEN tnn > 1 THEN least(0.9, 0.25 + (tnn - 1) * 0.2) ELSE 0 END)::DOUBLE, 3) AS duplicate,
round(least(1, (0.25 + {_sum_when(("length(ct) >= 12", 0.12), ("length(ct) >= 24", 0.08), ("length(cc) >= 80", 0.14), ("length(cc) >= 160", 0.16), ("length(cc) >= 260", 0.1), ("regexp_matches(cc, '\\bwhy\\b|\\bpor qu[eé]\\b|\\bporque\\b|\\bwhere\\b|\\bd[oó]nde\\b|\\bfiles?\\b|\\bpath\\b')", 0.08), ("regexp_matches(cc, 'src[/\\\\]|docs[/\\\\]|test[/\\\\]|\\.md\\b|\\.ts\\b|\\.js\\b')", 0.1), ("trim(topic) <> ''", 0.09), ("trim(project) <> ''", 0.04))})::DOUBLE), 3) AS signal,
CASE WHEN type IN ('decision', 'architecture', 'pattern') THEN 0.96 WHEN type IN ('learning', 'bugfix') THEN 0.62 WHEN type = 'session' THEN 0.12 ELSE 0.4 END::DOUBLE AS durability,
regexp_matches(lower(ct || ' ' || cc || ' ' || topic || ' ' || project), '{hygiene._NOISE}') OR regexp_matches(lower(ct || ' ' || topic), '{hygiene._NOISE_PATH}') AS noise,
regexp_matches(lower(ct || ' ' || cc), '{hygiene._GENERIC}') AS generic FROM n),
h AS (SELECT *, signal < 0.46 AS low, signal * 0.35 + durability * 0.25 + least(1.0, len({tok("memory", "title || ' ' || content || ' ' || topic")}) / 18) * 0.2 + greatest(0.15, least(1.0, 1 - date_diff('day', created, DATE '{AS_OF}') / 90)) * 0.1 - duplicate * 0.3 - CASE WHEN generic THEN 0.1 ELSE 0 END - CASE WHEN noise THEN 0.4 ELSE 0 END AS hs FROM s),
p AS (SELECT *, type IN ('decision', 'architecture', 'pattern') AND NOT noise AND NOT generic AND NOT low AND duplicate < 0.6 AS protected FROM h),
r AS (SELECT id, type, signal, durability, duplicate, round(greatest(0.0, least(1.0, hs))::DOUBLE, 3) AS health, protected, NOT protected AND (noise OR duplicate >= 0.6 OR (generic AND low)) AS quarantine,
array_to_string(list_filter([CASE WHEN noise THEN 'test-noise' END, CASE WHEN duplicate >= 0.6 THEN 'duplicate' END, CASE WHEN low THEN 'low-signal' END, CASE WHEN generic THEN 'generic' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p)"""


@query("h2_h7_hygiene", f"{_EVAL} SELECT * FROM r")
def h7(spark, d):
    return hygiene.evaluate(memories(spark, d), AS_OF)


@query("a8_hygiene_stats", f"""{_EVAL} SELECT count(*) AS n, round(sum(round(signal * 1000)::BIGINT) / count(*) / 1000, 6) AS avg_signal, round(sum(round(health * 1000)::BIGINT) / count(*) / 1000, 6) AS avg_health, count(*) FILTER (durability = 0.96) AS durable, count(*) FILTER (durability = 0.62) AS reviewable, count(*) FILTER (durability = 0.12) AS disposable, count(*) FILTER (quarantine) AS quarantined FROM r""")
def a8(spark, d):
    return hygiene.hygiene_stats(hygiene.evaluate(memories(spark, d), AS_OF))


@query("h1_exact_duplicates", "SELECT doc_id AS id, source, min(doc_id) OVER (PARTITION BY source, text) AS keeper, doc_id <> min(doc_id) OVER (PARTITION BY source, text) AS is_duplicate FROM documents")
def h1(spark, d):
    return hygiene.exact_duplicates(chunks(spark, d))


_SNAP = "WITH a AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)"


def _snapshots(spark, d):
    x = t(spark, d, "documents")
    a = x.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("hash"))
    b = x.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("hash"))
    return a, b


@query("h17_changes", f"{_SNAP} SELECT id, CASE WHEN a.h IS NULL THEN 'created' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id)")
def h17(spark, d):
    return hygiene.changes(*_snapshots(spark, d))


@query("h19_tombstones", f"{_SNAP} SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)")
def h19(spark, d):
    a, b = _snapshots(spark, d)
    return a.join(b, "id", "left_anti").select("id")


@query("i12_upsert", f"{_SNAP} SELECT id, h AS hash FROM b UNION ALL SELECT id, h FROM a WHERE id NOT IN (SELECT id FROM b)")
def i12(spark, d):
    return hygiene.upsert(*_snapshots(spark, d))


_KEY = ", ".join(f"lower({COMPACT.format(c)})" for c in ("project", "type", "title")) + f", substr(lower({COMPACT.format('content')}), 1, 240)"


@query("u3_keep_newest", f"WITH m AS ({MEMORIES}) SELECT id, type FROM m QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY created DESC, ord DESC) = 1")
def u3(spark, d):
    return hygiene.newest(memories(spark, d)).select("id", "type")


@query("h11_compaction", f"""WITH m AS (SELECT *, substr({COMPACT.format('content')}, 1, 80) AS s FROM ({MEMORIES}) WHERE type IN ('learning', 'bugfix')), g AS (SELECT topic, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM m GROUP BY topic HAVING count(*) >= 2),
k AS (SELECT topic, s, row_number() OVER (PARTITION BY topic ORDER BY created DESC, ord) AS r FROM m QUALIFY r <= 5), u AS (SELECT topic, s, min(r) AS r FROM k GROUP BY topic, s), j AS (SELECT topic, string_agg(s, ' | ' ORDER BY r) AS summary FROM u GROUP BY topic) SELECT topic, n, summary, first_id, last_id FROM g JOIN j USING (topic)""")
def h11(spark, d):
    return hygiene.compaction(memories(spark, d))


# ---- observation, windows, aggregates -----------------------------------------------------------


@query("a2_command_metrics", f"WITH e AS ({EVENTS}) SELECT command, count(*) AS runs, count(*) FILTER (failed) AS degraded, round(sum(duration), 3) AS total, round(count(*) FILTER (failed) / count(*), 3) AS rate, arg_max(duration, (ts, id)) AS last FROM e GROUP BY command")
def a2(spark, d):
    return observe.command_metrics(events(spark, d))


@query("a4_latency", f"WITH e AS ({EVENTS}) SELECT command, count(*) AS n, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95, quantile_disc(duration, 0.99) AS p99 FROM e GROUP BY command")
def a4(spark, d):
    return observe.latency(events(spark, d))


@query("a6_top_commands", f"WITH e AS ({EVENTS}) SELECT command, count(*) AS runs FROM e GROUP BY command ORDER BY runs DESC, command LIMIT 3")
def a6(spark, d):
    return events(spark, d).groupBy("command").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "command").limit(3)


@query("st1_trailing_requests", f"WITH e AS (SELECT *, epoch(ts)::BIGINT AS s FROM ({EVENTS})) SELECT id, count(*) OVER w AS n, (sum(failed::INT) OVER w)::BIGINT AS n_failed FROM e WINDOW w AS (PARTITION BY usr ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)")
def st1(spark, d):
    return observe.trailing_requests(events(spark, d))


_DAILY = f"SELECT ts::DATE AS at_day, command AS kind, count(*) AS total FROM ({EVENTS}) GROUP BY ALL"


@query("w4_drift", f"""WITH y AS ({_DAILY}), b AS (SELECT *, coalesce(avg(total) OVER (PARTITION BY kind ORDER BY at_day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) AS base FROM y),
r AS (SELECT *, base > 0 AND total >= 2 * base AND total - base >= 3 AS spike, CASE WHEN base > 0 THEN abs(total - base) / base ELSE 0 END AS ratio FROM b)
SELECT at_day AS "at", kind, total, round(base, 4) AS baseline, round(ratio, 4) AS ratio, spike, CASE WHEN round(ratio, 4) >= 0.45 THEN 'critical' WHEN round(ratio, 4) >= 0.2 OR spike THEN 'warning' ELSE 'stable' END AS level FROM r""")  # fmt: skip
def w4(spark, d):
    daily = events(spark, d).groupBy(F.to_date("ts").alias("at"), F.col("command").alias("kind")).agg(F.count("*").alias("total"))
    return observe.drift(daily)


@query("w2_latest", f"SELECT usr AS \"user\", arg_max(id, (ts, id)) AS id, arg_max(command, (ts, id)) AS command FROM ({EVENTS}) GROUP BY usr")
def w2(spark, d):
    e = events(spark, d).select("user", "id", "command", F.struct("ts", "id").alias("o"))
    return observe.latest(e, "user", "o").select("user", "id", "command")


@query("w3_versions", f"SELECT id, row_number() OVER (PARTITION BY usr ORDER BY ts, id)::INT AS version, usr || '@v' || row_number() OVER (PARTITION BY usr ORDER BY ts, id) AS version_id FROM ({EVENTS})")
def w3(spark, d):
    e = events(spark, d).withColumn("o", F.struct("ts", "id"))
    return observe.versions(e, "user", "o").select("id", "version", "version_id")


@query("w6_last_n", f"SELECT usr AS \"user\", id FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY usr ORDER BY ts DESC, id DESC) <= 3")
def w6(spark, d):
    e = events(spark, d).withColumn("o", F.struct("ts", "id"))
    return observe.last_n(e, "user", "o", 3).select("user", "id")


@query("w8_score_drops", f"SELECT id, coalesce(lag(duration) OVER (PARTITION BY usr ORDER BY ts, id) - duration > 0.1, false) AS rollback FROM ({EVENTS})")
def w8(spark, d):
    e = events(spark, d).withColumn("o", F.struct("ts", "id"))
    return observe.score_drops(e, "user", "o", "duration").select("id", "rollback")


@query("a10_mode", f"SELECT usr AS \"user\", arg_max(command, (n, -o)) AS command, max(n) AS n FROM (SELECT usr, command, count(*) AS n, min(id) AS o FROM ({EVENTS}) GROUP BY ALL) GROUP BY usr")
def a10(spark, d):
    return observe.mode(events(spark, d), "user", "command", "id")


@query("a11_a12_distinct", "SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct, round((count(*) - count(DISTINCT text)) / count(*), 4) AS duplicate_rate FROM documents GROUP BY source")
def a11(spark, d):
    g = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(F.sha2(F.col("text").cast("binary"), 256)).alias("n_distinct"))
    return g.withColumn("duplicate_rate", F.round((F.col("n") - F.col("n_distinct")) / F.col("n"), 4))


@query("a13_entropy", "WITH c AS (SELECT conv_id AS conv, role, count(*) AS n FROM conversations GROUP BY ALL), p AS (SELECT conv, n / sum(n) OVER (PARTITION BY conv) AS p FROM c) SELECT conv, abs(round(-sum(p * log2(p)), 6)) AS entropy FROM p GROUP BY conv")
def a13(spark, d):
    return observe.entropy(turns(spark, d), "conv", "role")


@query("a14_c6_turn_stats", "SELECT conv_id AS conv, count(*) AS n, count(*) - count(DISTINCT role || ':' || lower(text)) AS repeated, round((count(*) - count(DISTINCT role || ':' || lower(text))) / count(*), 4) AS redundancy FROM conversations GROUP BY conv_id")
def a14(spark, d):
    return observe.turn_stats(turns(spark, d))


@query("c4_context", "WITH x AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) SELECT conv_id AS conv, count(*) AS n, right(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 4000) AS context FROM x GROUP BY conv_id")
def c4(spark, d):
    return observe.context(turns(spark, d))


@query("st4_alerts", f"WITH e AS ({EVENTS}), m AS (SELECT command || '-' || usr % 9 AS command, count(*) AS runs, count(*) FILTER (duration > 40) / count(*) AS b, count(*) FILTER (failed) / count(*) AS g, count(*) FILTER (duration < 3) / count(*) AS h, avg(duration * 40) AS a FROM e GROUP BY ALL), c AS (SELECT command, runs >= 20 AS min_runs, b <= 0.25 AS blocked_rate, g <= 0.35 AS degraded_rate, h >= 0.15 AS recall_hit_rate, a <= 1500 AS average_ms FROM m) SELECT *, CASE WHEN min_runs AND blocked_rate AND degraded_rate AND recall_hit_rate AND average_ms THEN 'ok' ELSE 'alert' END AS status FROM c")
def st4(spark, d):
    share = lambda c: F.count_if(c) / F.count("*")
    e = events(spark, d).groupBy(F.concat("command", F.lit("-"), (F.col("user") % 9).cast("string")).alias("command"))
    return observe.alerts(e.agg(F.count("*").alias("runs"), share(F.col("duration") > 40).alias("blocked_rate"), share(F.col("failed")).alias("degraded_rate"), share(F.col("duration") < 3).alias("recall_hit_rate"), F.avg(F.col("duration") * 40).alias("average_ms")))


# ---- guards, evaluation, selection --------------------------------------------------------------


def _re(p: str) -> str:
    return p.replace("'", "''")


@query("g1_input_guard", f"""WITH x AS (SELECT conv_id * 1000 + turn AS id, trim(coalesce(text, ''), ' ') AS q FROM conversations), r AS (SELECT id, CASE WHEN length(q) < 3 THEN 'too-short' WHEN length(q) > 2000 THEN 'too-long' WHEN {" OR ".join(f"regexp_matches(q, '{_re(p)}')" for p in guards.INJECTIONS)} THEN 'injection' WHEN contains(lower(q), 'thea') THEN 'keyword-block' END AS rule FROM x)
SELECT id, CASE WHEN rule IS NULL THEN 'allow' ELSE 'block' END AS verdict, coalesce(rule, '') AS rule FROM r""")  # fmt: skip
def g1(spark, d):
    return guards.input_guard(t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query")), blocked=["thea"])


_PII = [_re(p) for p, _ in guards.PII]


@query("g6_output_guard", "SELECT doc_id AS id, " + " OR ".join(f"regexp_matches(text, '{_re(p)}')" for p in guards.SECRETS) + " AS blocked, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS n_{k}" for p, k in zip(_PII, ("email", "ssn", "card", "phone"), strict=True)) + ", md5(" + "regexp_replace(" * len(_PII) + "text" + "".join(f", '{_re(p)}', '{r}', 'g')" for p, r in guards.PII) + ") AS redacted_md5 FROM documents")
def g6(spark, d):
    return guards.output_guard(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("g7_redaction", "SELECT doc_id AS id, md5(" + "regexp_replace(" * len(guards.REDACTIONS) + "text" + "".join(f", '{_re(p)}', '{r.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')" for p, r in guards.REDACTIONS) + ") AS h FROM documents")
def g7(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(guards.redact_secrets(F.col("text")).cast("binary")).alias("h"))


@query("e2_classifier", "WITH x AS (SELECT quality AS e, (n_chars > 500)::INT AS p FROM labels JOIN documents USING (doc_id)), f AS (SELECT l, 2 * count(*) FILTER (e = l AND p = l) / (count(*) FILTER (e = l) + count(*) FILTER (p = l)) AS f1 FROM x, (SELECT DISTINCT e AS l FROM x) GROUP BY l) SELECT count(*) AS n, round(avg((e = p)::INT), 4) AS accuracy, (SELECT round(avg(f1), 4) FROM f) AS macro_f1 FROM x")
def e2(spark, d):
    x = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id")
    return evals.classifier_metrics(x.select(F.col("quality").alias("expected"), (F.col("n_chars") > 500).cast("int").alias("predicted")))


@query("e10_consistency", f"WITH x AS (SELECT conv_id AS key, turn AS ord, list_distinct({tok('rag', 'text')}) AS t FROM conversations), p AS (SELECT a.key, CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS j FROM x a JOIN x b ON a.key = b.key AND a.ord < b.ord), g AS (SELECT key, count(*) AS pairs, round(avg(j), 4) AS consistency FROM p GROUP BY key) SELECT *, CASE WHEN consistency >= 0.65 THEN 'high' WHEN consistency >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM g")
def e10(spark, d):
    return evals.consistency(t(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), "text"))


@query("e1_ranking", f"""WITH {_bm25_ctes(10)}, e AS (SELECT qid, doc_id AS id FROM q, documents WHERE doc_id % 40 = qid % 40),
h AS (SELECT b.qid, count(*) AS found, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM b JOIN e ON b.qid = e.qid AND b.id = e.id GROUP BY b.qid), k AS (SELECT qid, count(*) AS k FROM b GROUP BY qid), w AS (SELECT qid, count(*) AS want FROM e GROUP BY qid)
SELECT qid, round(coalesce(found, 0) / want, 4) AS recall, round(coalesce(1 / f, 0), 4) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, greatest(least(coalesce(k, 0), want), 1) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg FROM w LEFT JOIN k USING (qid) LEFT JOIN h USING (qid)""")  # fmt: skip
def e1(spark, d):
    q = asked(spark, d)
    wanted = t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("k")).join(F.broadcast(q.select("qid", (F.col("qid") % 40).alias("k"))), "k")
    return evals.ranking_metrics(retrieval.bm25(chunks(spark, d), q), wanted.select("qid", "id"))


@query("s2_scores", f"""WITH {_CAND}, x AS (SELECT qid, id, kind, certainty, teachingValue, priority, {tok("selector", "content")} AS tk, list_distinct({tok("selector", "query")}) AS f FROM k)
SELECT qid, id, len(tk)::BIGINT AS n_tokens, round(least(1, 0.28 * CASE WHEN len(f) > 0 THEN len(list_intersect(f, tk)) / len(f) ELSE 0 END + 0.15 * CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in tagging.KIND_PRIOR.items())} ELSE 0 END + 0.03 * CASE WHEN len(tk) > 0 THEN len(list_distinct(tk)) / len(tk) ELSE 0 END + 0.12 * certainty + 0.08 * 0.5 + 0.10 * teachingValue + 0.06 * priority), 6) AS score FROM x""")  # fmt: skip
def s2(spark, d):
    return selection.scored(_requests(spark, d), asked(spark, d)).select("qid", "id", "n_tokens", "score")


def _requests(spark, d):
    return candidates(spark, d).drop("score", "rank").withColumnRenamed("teachingValue", "teaching")


@query("s6_select_context")
def s6(spark, d):
    return selection.select_context(_requests(spark, d), asked(spark, d))


@query("s16_impact")
def s16(spark, d):
    return selection.impact(selection.select_context(_requests(spark, d), asked(spark, d)))


@query("s1_compress", f"""WITH {_CAND}, sp AS (SELECT qid, id, list_distinct({tok("selector", "query")}) AS f, string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM k),
e AS (SELECT qid, id, f, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM sp), x AS (SELECT *, {tok("selector", "s")} AS tk FROM e WHERE s <> ''),
y AS (SELECT *, round(-(0.7 * CASE WHEN len(f) > 0 THEN len(list_intersect(f, tk)) / len(f) ELSE 0 END + 0.3 * CASE WHEN len(tk) > 0 THEN len(list_distinct(tk)) / len(tk) ELSE 0 END), 6) AS g FROM x),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY g, pos) <= 3) SELECT qid, id, string_agg(s, ' ' ORDER BY pos) AS summary FROM z GROUP BY qid, id""")  # fmt: skip
def s1(spark, d):
    return selection.compress(candidates(spark, d), asked(spark, d))


# ---- joins and extensions -----------------------------------------------------------------------


@query("j1_inner", "SELECT doc_id AS id, quality FROM documents JOIN labels USING (doc_id)")
def j1(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "quality")


@query("j3_left_default", "SELECT d.doc_id AS id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j4_semi", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j4(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"))


@query("j5_anti", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@query("ext_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def ext_rollup(spark, d):
    return t(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("ext_session_windows", """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def ext_sessions(spark, d):
    e = t(spark, d, "events")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# ---- memories, parsing, further joins and roll-ups ----------------------------------------------

_MT = f"{tok('memory', "title || ' ' || content")}"
_AGE = f"date_diff('day', created, DATE '{AS_OF}')"
_OVER = "CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: list_contains(q, x))) / len(t) ELSE 0 END"


@query("r15_memory_search", f"""WITH m AS (SELECT * FROM ({MEMORIES}) WHERE type IN ('decision', 'learning')), q AS ({ASKED}), tk AS (SELECT id, {tok("search", "title || ' ' || content")} AS t FROM m), n AS (SELECT count(*) AS n FROM tk),
p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({tok("search", "query")}) AS term FROM q) GROUP BY ALL),
s AS (SELECT qid, id, round(sum(qn * tf / dl * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM p JOIN d USING (term) JOIN qt USING (term), n GROUP BY ALL)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")  # fmt: skip
def r15(spark, d):
    return memory.search(memories(spark, d), asked(spark, d), types=["decision", "learning"])


@query("r17_memory_rank", f"""WITH m AS (SELECT *, {_MT} AS t FROM ({MEMORIES})), q AS (SELECT qid, {tok("memory", "query")} AS q, lower(query) AS lq FROM ({ASKED})),
s AS (SELECT qid, id, ord, created, round(0.5 * {_OVER} + 0.16 * contains(lq, lower(project))::INT + 0.2 * exp(-ln(2) * {_AGE} / 21), 4) AS score FROM m, q)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, created DESC, ord) AS rank FROM s QUALIFY rank <= 5""")  # fmt: skip
def r17(spark, d):
    return memory.ranked(memories(spark, d), asked(spark, d), AS_OF)


@query("r18_relevant", f"""WITH m AS (SELECT *, {_MT} AS t, id % 3 = 0 AS shown FROM ({MEMORIES})), q AS (SELECT qid, {tok("memory", "query")} AS q, lower(query) AS lq FROM ({ASKED})),
s AS (SELECT qid, id, ord, created, shown, round(0.58 * {_OVER} + 0.14 * contains(lq, lower(project))::INT + 0.28 * exp(-ln(2) * {_AGE} / 14) + CASE WHEN shown THEN -0.45 ELSE 0 END, 4) AS score FROM m, q)
SELECT qid, id, shown, score, row_number() OVER (PARTITION BY qid ORDER BY shown, score DESC, created DESC, ord) AS rank FROM s QUALIFY rank <= 5""")  # fmt: skip
def r18(spark, d):
    m = memories(spark, d)
    return memory.relevant(m, asked(spark, d), m.filter("id % 3 = 0"), AS_OF)


@query("h14_memory_chunks", f"SELECT id, 'memory' AS kind, CASE WHEN ord = min(ord) OVER (PARTITION BY project) THEN 0.9 ELSE 0.82 END::DOUBLE AS priority FROM ({MEMORIES})")
def h14(spark, d):
    return memory.as_chunks(memories(spark, d))


@query("i19_dead_letters", f"SELECT id, least(1440, 5 * 2 ** (id % 9))::DOUBLE AS wait, CASE WHEN {_AGE} > 30 THEN 'quarantine' WHEN {_AGE} * 1440 < least(1440, 5 * 2 ** (id % 9)) THEN 'keep' ELSE 'retry' END AS state FROM ({MEMORIES})")
def i19(spark, d):
    return memory.retry_state(memories(spark, d).select("id", (F.col("id") % 9 + 1).alias("attempts"), "created"), AS_OF)


@query("h12_expiry", f"SELECT id FROM ({MEMORIES}) WHERE id % 4 = 0 OR created + 60 > DATE '{AS_OF}'")
def h12(spark, d):
    m = memories(spark, d)
    return hygiene.alive(m.withColumn("expires", F.when(F.col("id") % 4 != 0, F.date_add("created", 60).cast("timestamp"))), AS_OF).select("id")


@query("p7_entities", "WITH x AS (SELECT doc_id AS id, list_distinct(list_concat(" + ", ".join(f"list_transform(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'), lambda v: '{k}' || chr(1) || lower(v))" for k, p in parsing.ENTITIES.items()) + ")) AS l FROM documents), e AS (SELECT id, unnest(l) AS v FROM x) SELECT id, split_part(v, chr(1), 1) AS type, split_part(v, chr(1), 2) AS value FROM e")
def p7(spark, d):
    return parsing.entities(chunks(spark, d))


@query("p4_fixed_windows", "SELECT id, n, substr(c, (n * 900 + 1)::BIGINT, 1000) AS chunk FROM (SELECT doc_id AS id, text AS c, unnest(range(0, greatest(ceil((length(text) - 1000) / 900), 0)::INT + 1))::INT AS n FROM documents WHERE length(text) > 0)")
def p4(spark, d):
    return parsing.windows_of(chunks(spark, d), 1000, 900)


@query("p5_paragraph_chunks")
def p5(spark, d):
    return parsing.paragraphs(chunks(spark, d))


@query("p16_flags", "SELECT doc_id AS id, regexp_matches(text, '```|=>|function |class |def ') AS has_code, regexp_matches(text, '(?i)art[ií]culo\\s+\\d+|section\\s+\\d+|§') AS has_legal, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def p16(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), parsing.flags(F.col("text")).alias("f")).select("id", "f.has_code", "f.has_legal", "f.words")


@query("p17_symbols", "WITH x AS (SELECT page_id AS id, html AS s FROM pages) SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(s, 'from\\s+[\"'']([^\"'']+)[\"'']', 1))), ',') AS imports, array_to_string(list_sort(list_distinct(regexp_extract_all(s, 'function\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1))), ',') AS functions, array_to_string(list_sort(list_distinct(regexp_extract_all(s, 'class\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1))), ',') AS classes FROM x")
def p17(spark, d):
    return t(spark, d, "pages").select(F.col("page_id").alias("id"), parsing.symbols(F.col("html")).alias("s")).select("id", "s.imports", "s.functions", "s.classes")


@query("j7_similar_pairs", f"WITH x AS (SELECT conv_id * 1000 + turn AS id, list_distinct({tok('rag', 'text')}) AS t FROM conversations), e AS (SELECT id, t, unnest(t) AS w FROM x), c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.t AS ta, b.t AS tb FROM e a JOIN e b ON a.w = b.w AND a.id < b.id) SELECT a, b, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS similarity FROM c WHERE similarity >= 0.72")
def j7(spark, d):
    return joins.similar_pairs(t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


_IV = "SELECT event_id AS id, user_id AS key, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + 600 + event_id % 3000 AS e, event_type AS k FROM events"


@query("j9_overlaps", f"WITH v AS ({_IV}) SELECT a.id AS id1, b.id AS id2 FROM v a JOIN v b ON a.key = b.key AND a.s <= b.e AND b.s <= a.e WHERE a.k = 'error' AND b.k = 'purchase'")
def j9(spark, d):
    s = T.nearest_second(F.col("ts"))
    v = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), s.alias("start"), (s + 600 + F.col("event_id") % 3000).alias("end"), F.col("event_type").alias("k"))
    return joins.overlapping(v.filter("k = 'error'"), v.filter("k = 'purchase'"), 3600)


@query("ext_as_of", "SELECT a.event_id AS id, b.value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def ext_as_of(spark, d):
    e = t(spark, d, "events")
    right = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("id")), right, "user_id", "ts")


@query("w7_trend", f"SELECT id, duration FROM ({EVENTS}) ORDER BY id DESC LIMIT 10")
def w7(spark, d):
    return observe.trend(events(spark, d), "id", "duration").select("id", "duration")


@query("w13_line_diff", "WITH a AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS o, unnest(range(0, len(string_split(text, chr(10)))))::INT AS line FROM documents), b AS (SELECT doc_id AS id, unnest(string_split(text || chr(10) || 'x', chr(10))) AS n, unnest(range(0, len(string_split(text || chr(10) || 'x', chr(10)))))::INT AS line FROM documents) SELECT id, line, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN o = n THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id, line)")
def w13(spark, d):
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return observe.line_diff(x, x.select("id", F.concat("text", F.lit("\nx")).alias("text")))


@query("a7_costs", f"WITH m AS (SELECT usr AS session, command AS model, count(*) AS calls, round(sum(id % 100), 4) AS tokens, round(sum(duration), 4) AS cost FROM ({EVENTS}) GROUP BY ALL) SELECT *, round(sum(cost) OVER (PARTITION BY session), 4) AS session_cost FROM m")
def a7(spark, d):
    return observe.costs(events(spark, d).select(F.col("user").alias("session"), F.col("command").alias("model"), (F.col("id") % 100).cast("double").alias("tokens"), F.col("duration").alias("cost")))


@query("a16_repeated_tasks", "SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') HAVING count(*) >= 3 ORDER BY n DESC, first LIMIT 5")
def a16(spark, d):
    return observe.repeated_tasks(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("a18_maturity", f"WITH g AS (SELECT project AS key, count(*) AS n, count(DISTINCT type) AS types, count(DISTINCT topic) AS paths FROM ({MEMORIES}) GROUP BY project HAVING count(*) >= 5) SELECT key, n, round(0.4 * least(1, ln(n + 1) / ln(51)) + 0.3 * least(1, types / 5) + 0.2 * least(1, paths / 10) + 0.1, 6) AS maturity FROM g")
def a18(spark, d):
    return observe.maturity(memories(spark, d).select(F.col("project").alias("key"), "type", F.col("topic").alias("path"), F.col("title").alias("tag")), "key")


@query("a1_u1_counts", "SELECT kind, count(*) AS n FROM (SELECT lang AS kind FROM documents UNION ALL SELECT role FROM conversations) GROUP BY kind")
def a1(spark, d):
    return t(spark, d, "documents").select(F.col("lang").alias("kind")).unionByName(t(spark, d, "conversations").select(F.col("role").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("i18_limited_search", "SELECT id FROM (SELECT doc_id AS id, text FROM documents ORDER BY doc_id LIMIT 100) WHERE contains(lower(text), 'thea')")
def i18(spark, d):
    first = t(spark, d, "documents").orderBy("doc_id").limit(100)
    return first.filter(F.contains(F.lower("text"), F.lit("thea"))).select(F.col("doc_id").alias("id"))


# ---- conversations, limits, gates ---------------------------------------------------------------

_NEG, _POS, _STOP, _SIG = (_list(x) for x in (conversations.NEGATIVE, conversations.POSITIVE, conversations.STOPWORDS, conversations.SIGNALS))
_CLAIMED = "text || '. The ' || role || ' gateway cache ' || CASE length(text) % 3 WHEN 0 THEN 'is not there' WHEN 1 THEN 'is enabled' ELSE 'waits ' || length(text) % 50 || ' seconds' END || '.'"
_UNIT = " ".join(f"WHEN regexp_matches(u, '^(?:{p})$') THEN '{k}'" for k, p in T._UNITS.items())


@query("c5_contradictions", f"""WITH s AS (SELECT conv_id AS conv, turn, unnest(list_filter(list_transform(regexp_split_to_array({_CLAIMED}, '[.!?\\n]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) AS s FROM conversations),
n AS (SELECT conv, turn, regexp_replace(regexp_replace(s, '^[-*]\\s+', ''), '^\\[[^\\]]+\\]\\s+', '') AS s FROM s), k AS (SELECT conv, turn, CASE WHEN length(s) > 220 THEN rtrim(substr(s, 1, 217)) || '...' ELSE s END AS s FROM n),
w AS (SELECT conv, turn, list_filter(regexp_split_to_array(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w, regexp_extract(lower(s), '(?:^|[^a-z0-9_])(\\d{{1,4}})\\s*({"|".join(T._UNITS.values())})(?:[^a-z0-9_]|$)', ['v', 'u']) AS g FROM k),
c AS (SELECT conv, turn, list_slice(list_filter(w, lambda x: x NOT IN ({_STOP}, {_NEG}, {_POS}) AND NOT regexp_matches(x, '^\\d+$')), 1, 8) AS k, CASE WHEN len(list_filter(w, lambda x: x IN ({_NEG}))) > 0 THEN -1 WHEN len(list_filter(w, lambda x: x IN ({_POS}))) > 0 THEN 1 ELSE 0 END AS p, TRY_CAST(g.v AS INT) AS v, g.u AS u, len(w) AS n, len(list_filter(w, lambda x: x IN ({_SIG}))) > 0 AS sig FROM w),
f AS (SELECT conv, turn, array_to_string(k, ' ') AS key, p, v, CASE {_UNIT} ELSE '' END AS unit FROM c WHERE n >= 3 AND len(k) >= 2 AND (sig OR v IS NOT NULL))
SELECT DISTINCT a.conv, a.key, a.turn AS earlier, b.turn AS later, CASE WHEN a.p * b.p < 0 THEN 'polarity' ELSE 'numeric' END AS kind FROM f a JOIN f b ON a.conv = b.conv AND a.key = b.key AND a.turn < b.turn WHERE a.p * b.p < 0 OR coalesce(a.v <> b.v AND a.unit = b.unit, false)""")  # fmt: skip
def c5(spark, d):
    n = F.length("text")
    said = F.when(n % 3 == 0, "is not there").when(n % 3 == 1, "is enabled").otherwise(F.concat(F.lit("waits "), (n % 50).cast("string"), F.lit(" seconds")))
    return conversations.contradictions(turns(spark, d).withColumn("text", F.concat("text", F.lit(". The "), "role", F.lit(" gateway cache "), said, F.lit("."))))


@query("c2_retention")
def c2(spark, d):
    return conversations.retained(turns(spark, d), every=2, keep=2)


@query("c1_budget_states", "SELECT conv_id AS conv, CASE WHEN 500 - t <= 10 THEN 'block' WHEN 500 - t <= 100 THEN 'compact' WHEN 500 - t <= 200 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT conv_id, sum(ceil(length(text) / 4)) AS t FROM conversations GROUP BY conv_id)")
def c1(spark, d):
    g = turns(spark, d).groupBy("conv").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("t"))
    return g.select("conv", conversations.budget_state(F.col("t"), 500, 200, 100, 10).alias("state"))


@query("g3_rate_limit")
def g3(spark, d):
    return conversations.rate_limited(t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), T.nearest_second(F.col("ts")).alias("second")), 3, 86_400)


_RANK = "CASE {0} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE -1 END"
_LEVELS = "(['low', 'medium', 'high', 'critical', 'unknown'])[{0} + 1]"


@query("e3_risk", f"WITH x AS (SELECT {_RANK.format(_LEVELS.format('doc_id % 4'))} AS e, {_RANK.format(_LEVELS.format('n_chars % 5'))} AS p FROM documents) SELECT count(*) AS n, round(count(*) FILTER (e >= 2 AND p >= 2) / count(*) FILTER (e >= 2), 4) AS high_recall, round(count(*) FILTER (e >= 0 AND p >= 0 AND p < e) / count(*), 4) AS under_rate, round(count(*) FILTER (p < 0) / count(*), 4) AS unknown_rate FROM x")
def e3(spark, d):
    names = ["low", "medium", "high", "critical", "unknown"]
    x = t(spark, d, "documents").select(pick(F.col("doc_id") % 4, names).alias("expected"), pick(F.col("n_chars") % 5, names).alias("predicted"))
    return evals.risk_metrics(x, {"low": 0, "medium": 1, "high": 2, "critical": 3})


_RW = "SELECT text AS original, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 5 + (item_id % 10)::INT), ' ') AS rewritten, list_slice(regexp_split_to_array(text, '\\s+'), 3, 9) AS keywords FROM benchmark"
_W = "list_filter(regexp_split_to_array(lower(trim({0}, ' ')), '\\s+'), lambda w: w <> '')"


@query("e4_rewrites", f"WITH x AS ({_RW}), y AS (SELECT *, list_distinct({_W.format('original')}) AS o, list_distinct({_W.format('rewritten')}) AS r, {_W.format('original')} AS ow, {_W.format('rewritten')} AS rw FROM x) SELECT count(*) AS n, round(avg(CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda k: contains(lower(rewritten), lower(k)))) / len(keywords) ELSE 1 END), 4) AS keyword_recall, round(avg((lower(trim(original, ' ')) <> lower(trim(rewritten, ' ')))::INT), 4) AS rewrite_rate, round(avg((len(list_intersect(o, r)) / greatest(len(o), 1) >= 0.25)::INT), 4) AS intent_rate, round(max(len(rw) / greatest(len(ow), 1)), 4) AS length_ratio FROM y")
def e4(spark, d):
    w = F.split("text", "\\s+")
    x = t(spark, d, "benchmark").select(F.col("text").alias("original"), F.array_join(F.slice(w, F.lit(1), (F.col("item_id") % 10 + 5).cast("int")), " ").alias("rewritten"), F.slice(w, 3, 7).alias("keywords"))
    return evals.rewrite_metrics(x)


@query("e11_gate", "WITH x AS (SELECT source AS domain, unnest(['chars', 'docs', 'langs']) AS metric, unnest([avg(n_chars), count(*)::DOUBLE, count(DISTINCT lang)::DOUBLE]) AS v, unnest([2000.0, 5.0, 2.0]) AS h, unnest([true, false, false]) AS m FROM documents GROUP BY source), y AS (SELECT domain, metric, CASE WHEN m THEN v <= h ELSE v >= h END AS ok FROM x) SELECT domain, bool_and(ok) AS passed, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (NOT ok), '') AS failing FROM y GROUP BY domain")
def e11(spark, d):
    g = t(spark, d, "documents").groupBy(F.col("source").alias("domain")).agg(F.avg("n_chars").alias("chars"), F.count("*").cast("double").alias("docs"), F.countDistinct("lang").cast("double").alias("langs"))
    row = lambda m, h, most: F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(h).alias("threshold"), F.lit(most).alias("at_most"))
    return evals.gate(g.select("domain", F.explode(F.array(row("chars", 2000.0, True), row("docs", 5.0, False), row("langs", 2.0, False))).alias("r")).select("domain", "r.*"))


@query("e12_answers", f"WITH x AS (SELECT conv_id * 1000 + turn AS id, text AS a, lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations), y AS (SELECT id, lower(trim(a, ' ')) = lower(trim(e, ' ')) AS exact, list_distinct({tok('raw', 'a')}) AS ta, list_distinct({tok('raw', 'e')}) AS te FROM x) SELECT id, exact, round(CASE WHEN len(ta) + len(te) > 0 THEN 2 * len(list_intersect(ta, te)) / (len(ta) + len(te)) ELSE 0 END, 4) AS f1 FROM y")
def e12(spark, d):
    from pyspark.sql import Window as W

    c = t(spark, d, "conversations")
    x = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), F.lag("text", 1, "").over(W.partitionBy("conv_id").orderBy("turn")).alias("expected"))
    return evals.quality_drop(x)


@query("s14_inject")
def s14(spark, d):
    c = t(spark, d, "conversations")
    return selection.inject(c.select(F.col("conv_id").alias("group"), F.col("turn").alias("ord"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("source"), F.lit("chat").alias("kind"), F.col("text").alias("content")), 300, 4)


from gleanery import queries_docs, queries_more  # noqa: E402, F401  register more queries with what is defined above
