"""Axioms: merging, storing, matching; agents and rollbacks, which are chosen by similar scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import text as T


def merged(axioms: DataFrame) -> DataFrame:
    """H-16: (ord, source, topic, statement, priority, domains) -> key, statement, source, priority, domains: one per topic or, without one, per
    normalised statement. An axiom of the vault is preferred, then the lower priority, then the earlier one; domains are united."""
    key = F.when(F.coalesce(F.col("topic"), F.lit("")) != "", F.col("topic")).otherwise(T.plain_statement(F.col("statement")))
    order = F.struct((F.col("source") != "obsidian").alias("a"), F.col("priority").alias("b"), F.col("ord").alias("c"))
    g = axioms.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct("statement", "source", "priority"), order).alias("r"), F.collect_set(F.array_join("domains", ",")).alias("d"))
    domains = F.array_sort(F.array_distinct(F.flatten(F.transform("d", lambda x: F.split(x, ",")))))
    return g.select("key", "r.statement", "r.source", "r.priority", F.array_join(domains, ",").alias("domains"))


def saved(existing: DataFrame, new: DataFrame) -> DataFrame:
    """H-15: new axioms (title, body, ...) under the sha of title and body, without those there already and without repeats."""
    sha = F.substring(F.sha2(F.concat_ws("\x1f", "title", "body").cast("binary"), 256), 1, 12)
    new = new.withColumn("id", sha).dropDuplicates(["id"])
    return new.join(existing.withColumn("id", sha).select("id"), "id", "left_anti")


def match_score(language: Column, path: Column, framework: Column, text: Column, context: dict) -> Column:
    """R-25: mean of three or four checks; a star or nothing counts half."""

    def check(c: Column, hit: Column) -> Column:
        return F.when((F.coalesce(c, F.lit("")) == "") | (c == "*"), 0.5).when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)

    terms = context.get("terms") or []
    s = check(language, language == context.get("language")) + check(path, F.startswith(F.lit(context.get("path") or ""), path) & F.lit(bool(context.get("path")))) + check(framework, framework == context.get("framework"))
    if terms:
        low = F.lower(text)
        s = s + F.least(F.lit(1.0), sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) / len(terms))
    return s / (3 + bool(terms))


def query(axioms: DataFrame, context: dict, as_of: str, least: float = 0.5, limit: int = 5) -> DataFrame:
    """R-25: live axioms (id, ord, type, language, path, framework, title, body, expires) that match a context, best first (ties by ord)."""
    a = axioms.filter(F.col("expires").isNull() | (F.col("expires") > F.to_timestamp(F.lit(as_of))))
    if context.get("types"):
        a = a.filter(F.col("type").isin(context["types"]))
    s = match_score(F.col("language"), F.col("path"), F.col("framework"), F.concat_ws(" ", "title", "body"), context)
    return a.select("id", "ord", F.round(s, 6).alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), "ord").limit(limit).select("id", "score")


def routed(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """R-27: requests (id, language, framework), agents (ord, agent, language, framework; a stated list) -> id, agent, score.

    Two points for the language, three for the framework; the first of equal ones; requests without points get none.
    """
    a = agents.select("ord", "agent", F.col("language").alias("l"), F.col("framework").alias("f"))
    # one equi-join for each kind of hit; an agent that fits by both is met twice, with the same points
    j = requests.join(a, F.col("language") == F.col("l")).union(requests.join(a, F.col("framework") == F.col("f")))
    points = F.coalesce((F.col("language") == F.col("l")).cast("int") * 2, F.lit(0)) + F.coalesce((F.col("framework") == F.col("f")).cast("int") * 3, F.lit(0))
    best = j.withColumn("score", points).groupBy("id").agg(F.max_by(F.struct("agent", "score"), F.struct("score", -F.col("ord"))).alias("r"))
    return best.select("id", "r.agent", "r.score")


def rollback_plan(versions: DataFrame, least: float = 0.75) -> DataFrame:
    """W-9: (key, version, score) -> key, version, score, status: of versions with ``least`` or more, the best older than the newest one, else the best."""
    newest = versions.groupBy("key").agg(F.max("version").alias("newest"))
    v = versions.join(newest, "key").withColumn("score", T.clamp(F.col("score")))
    order = F.struct((F.col("version") < F.col("newest")).alias("older"), "score", "version")
    g = v.groupBy("key").agg(F.max_by(F.when(F.col("score") >= least, F.struct("version", "score")), F.when(F.col("score") >= least, order)).alias("r"))
    return g.select("key", "r.version", "r.score", F.when(F.col("r").isNull(), "no-candidate").otherwise("rollback-ready").alias("status"))


def ranked_similar(names: DataFrame, candidates: DataFrame, least: float = 0.72) -> DataFrame:
    """H-21: names (id, name) against candidates (cid, name): 1 for equal slugs, .9 if one slug holds the other (8 characters or more), else word Jaccard.

    Pairs come from three equi-joins: of slugs, of the rarest eight-character piece of a slug with all such pieces of another (one that holds it holds
    that piece), and of a word in the prefix that two sets of words of that similarity must share. Each pair is judged once, by all rules.
    """
    n, c = (x.select(F.col(i).alias(i), T.slug(F.col("name")).alias(f"s{e}"), F.array_sort(F.array_distinct(T.rag_tokens(F.col("name")))).alias(f"w{e}")) for x, i, e in ((names, "id", "1"), (candidates, "cid", "2")))
    n, c = n.filter("s1 <> ''"), c.filter("s2 <> ''")
    grams = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 7), lambda k: F.substr(s, k, F.lit(8))))
    g1, g2 = (x.filter(F.length(s) >= 8).select(i, F.explode(grams(F.col(s))).alias("g")) for x, i, s in ((n, "id", "s1"), (c, "cid", "s2")))
    often = g1.select("g").union(g2.select("g")).groupBy("g").agg(F.count("*").alias("often"))
    rare = lambda x, i: x.join(often, "g").groupBy(i).agg(F.min_by("g", F.struct("often", "g")).alias("g"))
    t1, t2 = (x.select(i, F.size(w).alias("m"), F.explode(w).alias("w")) for x, i, w in ((n, "id", "w1"), (c, "cid", "w2")))
    df = t1.select("w").union(t2.select("w")).groupBy("w").agg(F.count("*").alias("df"))

    def prefix(x: DataFrame, i: str) -> DataFrame:
        o = x.join(df, "w").groupBy(i, "m").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
        return o.select(i, F.explode(F.slice("o", F.lit(1), F.col("m") - F.ceil(F.col("m") * F.lit(least)).cast("int") + 1)).alias("x")).select(i, "x.w")

    pairs = n.join(c, n.s1 == c.s2).select("id", "cid").union(rare(g1, "id").join(g2, "g").select("id", "cid")).union(rare(g2, "cid").join(g1, "g").select("id", "cid")).union(prefix(t1, "id").join(prefix(t2, "cid"), "w").select("id", "cid"))
    held = (F.contains("s1", F.col("s2")) | F.contains("s2", F.col("s1"))) & (F.least(F.length("s1"), F.length("s2")) >= 8)
    score = F.when(F.col("s1") == F.col("s2"), 1.0).when(held, 0.9).otherwise(F.round(T.jaccard(F.col("w1"), F.col("w2")), 4))
    return pairs.distinct().join(n, "id").join(c, "cid").select("id", "cid", score.alias("score")).filter(F.col("score") >= least)


def top_per(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
