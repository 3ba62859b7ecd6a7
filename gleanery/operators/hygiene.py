"""Memory hygiene: scores, duplicates, expiry, compaction, change detection."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery import stored
from gleanery.functions import text as T
from gleanery.operators import joins

#: Types of memories by how long they last.
DURABLE, REVIEWABLE, DISPOSABLE = ["decision", "architecture", "pattern"], ["learning", "bugfix"], ["session"]


#: Words that make a text worth more, and places.
_REASONS = "\\bwhy\\b|\\bpor qu[eé]\\b|\\bporque\\b|\\bwhere\\b|\\bd[oó]nde\\b|\\bfiles?\\b|\\bpath\\b"
_PLACES = "src[/\\\\]|docs[/\\\\]|test[/\\\\]|\\.md\\b|\\.ts\\b|\\.js\\b"
#: Words of memories that come from tests, such paths, and phrases of memories that say little.
_NOISE = "\\btest\\b|\\bfixture\\b|\\bfallback\\b|\\blocal-only\\b|\\bsmoke\\b|\\bdummy\\b|\\bexample\\b|\\bmock\\b"
_NOISE_PATH = "[/\\\\]test[/\\\\]|[/\\\\]fixtures?[/\\\\]|\\.spec\\.|\\.test\\."
_NOISE_TEXT = "\\btest memory\\b|\\bfixture memory\\b|\\bfallback memory write\\b|\\blocal-only memory\\b"
_GENERIC = "\\bintegration\\b|\\bquick patch\\b|\\bfallback memory write\\b|\\blocal-only memory\\b|\\bcli integration memory\\b"


def literals(pattern: str) -> list[tuple[bool, str, bool]]:
    """(word edge before, string, word edge after) of all strings that a pattern like those above fits: alternatives of characters, classes of a few, and characters that may be absent."""
    out = []
    for one in pattern.split("|"):
        parts = re.findall(r"\[(?:\\.|[^\]])+\]|\\.|.", one.replace("\\b", "\0"))
        choices = []
        for x in parts:
            if x == "?":
                choices[-1] = [*choices[-1], ""]
            elif x != "\0":
                choices.append([c[-1] for c in re.findall(r"\\.|.", x[1:-1])] if x[0] == "[" else [x[-1]])
        out += [(parts[0] == "\0", "".join(c), parts[-1] == "\0") for c in product(*choices)]
    return out


def _found(text: Column, words: str) -> Column:
    """Whether a text has one of the words (ASCII edges): each is searched as a plain string first, and for its edges only where it is there."""
    found = F.lit(False)
    word = "[A-Za-z0-9_]"
    inner = lambda c: re.match(word, c) is not None
    for before, x, after in literals(words):
        has, quoted = F.contains(text, F.lit(x)), re.escape(x)
        if before or after:
            left = f"(?<{'!' if inner(x[0]) else '='}{word}{quoted})" if before else ""
            right = f"(?{'!' if inner(x[-1]) else '='}{word})" if after else ""
            has = has & F.rlike(text, F.lit(f"{quoted}{left}{right}"))
        found = found | has
    return F.coalesce(found, F.lit(False))


def signal(title: Column, content: Column, topic: Column, project: Column) -> Column:
    """H-2, of a title and a content with single spaces."""
    t, n = F.length(title), F.length(content)
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    s = 0.25 + add(t >= 12, 0.12) + add(t >= 24, 0.08) + add(n >= 80, 0.14) + add(n >= 160, 0.16) + add(n >= 260, 0.1)
    s = s + add(_found(content, _REASONS), 0.08) + add(_found(content, _PLACES), 0.1)
    s = s + add(F.trim(F.coalesce(topic, F.lit(""))) != "", 0.09) + add(F.trim(F.coalesce(project, F.lit(""))) != "", 0.04)
    return F.round(T.clamp(s), 3)


def durability(kind: Column) -> Column:
    """H-3."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin(DURABLE), 0.96).when(k.isin(REVIEWABLE), 0.62).when(k.isin(DISPOSABLE), 0.12).otherwise(0.4)


def duplicate_scores(rows: DataFrame) -> DataFrame:
    """H-4: (fp, tk, ...) with ``duplicate``, by how often the fingerprint and the topic occur. Counts are aggregated first and joined
    back to rows without texts, so that one frequent fingerprint never meets in one window; a frequent topic's count is one small row."""
    c = rows.groupBy("fp").agg(F.count("*").alias("fn")).filter("fn > 1")  # what occurs once needs no partner
    t = rows.filter("tk <> ''").groupBy("tk").agg(F.count("*").alias("tn")).filter("tn > 1")
    m = rows.join(c, "fp", "left").join(t, "tk", "left")
    by_fp = F.when(F.col("fn") > 1, F.least(F.lit(1.0), 0.4 + (F.col("fn") - 1) * 0.25)).otherwise(0.0)
    by_topic = F.when(F.col("tn") > 1, F.least(F.lit(0.9), 0.25 + (F.col("tn") - 1) * 0.2)).otherwise(0.0)
    return m.withColumn("duplicate", F.round(F.greatest(by_fp, by_topic), 3)).drop("fp", "tk", "fn", "tn")


def evaluate(memories: DataFrame, as_of: str) -> DataFrame:
    """H-5 to H-9: scores, reasons and verdict of each memory (id, title, content, type, project, topic, created, and scope and source_kind if there are such columns).

    Texts are read once: what is found in them is written without them, and read for the counts of fingerprints and topics and for the verdict."""
    more = [F.col(c) if c in memories.columns else F.lit(None).cast("string").alias(c) for c in ("scope", "source_kind")]
    m = memories.select("id", "type", "topic", "project", "created", *more, T.compact(F.col("title")).alias("title"), T.compact(F.col("content")).alias("content"))
    m = m.select(
        "*", F.lower("title").alias("low_title"), F.lower("content").alias("low_content"), F.lower(F.concat_ws(" ", "title", "content", "topic", "project", "scope")).alias("every"),
        F.lower(F.concat_ws(" ", "title", "content")).alias("low"), F.lower(F.concat_ws(" ", "title", T.compact(F.col("topic")), T.compact(F.col("source_kind")))).alias("name"),
    )
    fp = F.sha2(F.concat_ws("::", "low_title", "low_content", F.lower(F.trim("type")), F.lower(F.trim("project")), F.lower(F.trim("scope"))), 256)
    # a memory without a kind of source is a test's if anything of it says so
    said = F.coalesce(F.trim("source_kind"), F.lit("")) != ""
    noise = _found(F.col("name"), _NOISE) | (~said & _found(F.col("every"), _NOISE)) | _found(F.col("low_content"), _NOISE_TEXT) | _found(F.col("name"), _NOISE_PATH)
    m = m.select(
        "id", "type", "created", signal(F.col("title"), F.col("content"), F.col("topic"), F.col("project")).alias("signal"), durability(F.col("type")).alias("durability"), noise.alias("noise"),
        _found(F.col("low"), _GENERIC).alias("generic"), F.size(T.memory_tokens(F.concat_ws(" ", "title", "content", "topic"))).alias("n_tokens"), fp.alias("fp"), F.lower(T.compact(F.col("topic"))).alias("tk"),
    )
    m = stored.table(m)
    m = duplicate_scores(m).withColumn("low", F.col("signal") < 0.46)
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("created"))
    recency = F.greatest(F.lit(0.15), F.least(F.lit(1.0), 1 - age / 90))
    specific = F.least(F.lit(1.0), F.col("n_tokens") / 18)
    health = F.col("signal") * 0.35 + F.col("durability") * 0.25 + specific * 0.2 + recency * 0.1 - F.col("duplicate") * 0.3
    health = health - F.when(F.col("generic"), 0.1).otherwise(0.0) - F.when(F.col("noise"), 0.4).otherwise(0.0)
    dup = F.col("duplicate") >= 0.6
    protected = F.col("type").isin(DURABLE) & ~F.col("noise") & ~F.col("generic") & ~F.col("low") & ~dup
    out = ~protected & (F.col("noise") | dup | (F.col("generic") & F.col("low")))
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("noise"), "test-noise"), F.when(dup, "duplicate"), F.when(F.col("low"), "low-signal"), F.when(F.col("generic"), "generic"))), ",")
    return m.select("id", "type", "signal", "durability", "duplicate", F.round(T.clamp(health), 3).alias("health"), protected.alias("protected"), out.alias("quarantine"), reasons.alias("reasons"))


def hygiene_stats(evaluated: DataFrame) -> DataFrame:
    """A-8, A-9. Scores have three digits, so that their sums are those of whole numbers and free of order."""
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 1000).cast("long")) / F.count("*") / 1000, 6)
    return evaluated.agg(
        F.count("*").alias("n"), mean("signal").alias("avg_signal"), mean("health").alias("avg_health"),
        F.count_if(F.col("durability") == 0.96).alias("durable"), F.count_if(F.col("durability") == 0.62).alias("reviewable"),
        F.count_if(F.col("durability") == 0.12).alias("disposable"), F.count_if("quarantine").alias("quarantined"),
    )


def alive(memories: DataFrame, as_of: str) -> DataFrame:
    """H-12: without expired rows."""
    return memories.filter(F.col("expires").isNull() | (F.col("expires") > F.to_timestamp(F.lit(as_of))))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """H-1, first step: per source and content hash, the row of least ord stays; (id, keeper, is_duplicate)."""
    d = docs.withColumn("h", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    first = d.groupBy("source", "h").agg(F.min("ord").alias("keeper"))
    return d.join(first, ["source", "h"]).select("id", "source", "keeper", (F.col("ord") != F.col("keeper")).alias("is_duplicate"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """H-17, J-6: (id, hash) snapshots -> id, change."""
    j = before.select("id", F.col("hash").alias("h0")).join(after.select("id", F.col("hash").alias("h1")), "id", "full_outer")
    return j.select("id", F.when(F.col("h0").isNull(), "created").when(F.col("h1").isNull(), "deleted").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed").alias("change"))


def newest(memories: DataFrame) -> DataFrame:
    """U-3: the newest row by id, then by meaning (project, scope, type and language, as far as there are such columns, title and content); of equal times the later row."""
    w = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("created"), F.desc("ord"))
    one = memories.withColumn("_n", F.row_number().over(w("id"))).filter("_n = 1").drop("_n")
    key = [F.lower(T.compact(F.col(c))) for c in ("project", "scope", "type", "language", "title") if c in memories.columns] + [F.substring(F.lower(T.compact(F.col("content"))), 1, 240)]
    return one.withColumn("_n", F.row_number().over(w(*key))).filter("_n = 1").drop("_n")


def compaction(memories: DataFrame) -> DataFrame:
    """H-11: reviewable memories by topic, two or more: newest five snippets, and the first and last id of what they replace."""
    m = memories.filter(F.col("type").isin(REVIEWABLE)).select("id", "topic", "ord", F.unix_date("created").alias("day"), F.substring(T.compact(F.col("content")), 1, 80).alias("s"))
    counts = m.groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n >= 2")
    top = m.withColumn("_n", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("day"), "ord"))).filter("_n <= 5")  # cut before the shuffle
    top = top.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("_n", "s"))).alias("s"))
    return counts.join(top, "topic").select("topic", "n", F.array_join(F.array_distinct(F.transform("s", lambda x: x["s"])), " | ").alias("summary"), "first_id", "last_id")


def superseded(memories: DataFrame) -> DataFrame:
    """H-11: (id, topic) of the memories that a topic's summary replaces; rows, as a topic may have very many."""
    m = memories.filter(F.col("type").isin(REVIEWABLE)).select("id", "topic")
    return m.join(m.groupBy("topic").count().filter("count >= 2").select("topic"), "topic", "left_semi").select("id", "topic")


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """I-12: new rows replace existing ones with the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def _kept_partners(pairs: DataFrame) -> DataFrame:
    """Of similar pairs (a, b), a before b, those whose a is kept: nodes are settled from the first on. Each round settles all nodes
    without an open node before them, and there are as many rounds as the longest chain of similar nodes has."""
    state = stored.table(pairs.select(F.col("a").alias("x")).union(pairs.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while state.filter("kept IS NULL").limit(1).count():
        before = pairs.join(state.select(F.col("x").alias("a"), F.col("kept").alias("ka")), "a").groupBy(F.col("b").alias("x"))
        known = before.agg(F.max(F.coalesce(F.col("ka"), F.lit(False))).alias("near"), F.max(F.col("ka").isNull()).alias("open"))
        s = state.join(known, "x", "left").withColumn("near", F.coalesce("near", F.lit(False))).withColumn("open", F.coalesce("open", F.lit(False)))
        state = stored.table(s.select("x", F.coalesce("kept", F.when(F.col("near"), False).when(~F.col("open"), True)).alias("kept")))
    return pairs.join(state.filter("kept").select(F.col("x").alias("a")), "a", "left_semi")


def write_gate(memories: DataFrame, as_of: str) -> DataFrame:
    """H-8, H-20: each memory judged on its own, as if it were the only one: accept or quarantine, with reasons."""
    own = memories.withColumn("topic", F.concat_ws("\x1f", "topic", "id")).withColumn("title", F.col("title"))
    return evaluate(own.withColumn("project", F.concat_ws("\x1f", "project", "id")), as_of).select("id", F.when(F.col("quarantine"), "quarantine").otherwise("accept").alias("action"), "reasons")


def doctor(evaluated: DataFrame, n: int = 20) -> DataFrame:
    """H-9: the ``n`` memories that need a look most (a report's limit): quarantined ones first, then the worst health."""
    return evaluated.orderBy(F.desc("quarantine"), "health", "id").limit(n).select("id", "quarantine", "health")


def pruned(memories: DataFrame, evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H-10: (kept, quarantined) rows of ``memories``; a dry run looks at them, another writes them to their places."""
    bad = evaluated.filter("quarantine").select("id")
    return memories.join(bad, "id", "left_anti"), memories.join(bad, "id", "left_semi")


def deleted(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """H-13: without the memories named."""
    return memories.join(ids.select("id"), "id", "left_anti")


def recent(memories: DataFrame, n: int = 5) -> DataFrame:
    """H-13: the first ``n`` of each project in the order of their file."""
    return memories.withColumn("_n", F.row_number().over(W.partitionBy("project").orderBy("ord"))).filter(F.col("_n") <= n).drop("_n")


def near_duplicates(chunks: DataFrame, least: float = 0.82, tokens=T.rag_tokens) -> DataFrame:
    """H-1, both steps: (id, ord, source, kind, content) -> id, duplicate_of, reason (exact, near or null for chunks that are kept).

    Within a source, the first chunk of each content is looked at, in order of ord; one is near if a kept chunk of its kind before it has a word
    Jaccard of ``least`` or more, and the first such chunk is named. Candidates come from the prefix join, and the order is settled in
    rounds: a chunk is kept once all similar ones before it are known to be duplicates, and is a duplicate once one is kept. Of chunks with
    the same words only the first can be kept, and the others are duplicates of it or of what it duplicates, so that they are never paired. No
    source is ever one task's. Copies are told by hashes; texts are not shuffled for that, if the copies to leave out are few enough to broadcast.
    """
    d = chunks.select("id", "ord", "source", "kind", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("h"))
    first = d.groupBy("source", "h").agg(F.min("ord").alias("keeper"))
    d = stored.table(d.join(first, ["source", "h"]))
    one = d.filter("ord = keeper")
    copies = stored.bounded(d.filter("ord <> keeper").select("ord"))
    group = F.sha2(F.concat_ws("\x1f", "source", "kind"), 256)
    # in a pair, a is the earlier chunk
    sets, pairs = joins.similar_firsts(chunks.join(copies, "ord", "left_anti").select(F.col("ord").alias("id"), F.col("content").alias("text"), group.alias("grp")), least, "grp", tokens)
    near = _kept_partners(stored.table(pairs))
    near = stored.table(near.groupBy("b").agg(F.min("a").alias("of")))
    later = sets.filter("id <> first").join(near.select(F.col("b").alias("first"), "of"), "first", "left")
    near = near.union(later.select("id", F.coalesce("of", "first")))
    names = one.select(F.col("ord").alias("o"), F.col("id").alias("name"))
    out = d.join(near, d.keeper == near.b, "left").select("id", "ord", F.when(F.col("ord") != F.col("keeper"), F.col("keeper")).otherwise(F.col("of")).alias("o"), F.when(F.col("ord") != F.col("keeper"), "exact").when(F.col("of").isNotNull(), "near").alias("reason"))
    return out.join(names, "o", "left").select("id", F.col("name").alias("duplicate_of"), "reason")
