"""Context selection under token budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import guards
from gleanery.operators.tagging import kind_prior

#: Weights of the scorer's terms.
WEIGHTS = {"overlap": 0.28, "kind": 0.15, "certainty": 0.12, "recency": 0.08, "teaching": 0.10, "priority": 0.06, "density": 0.03, "redundancy": 0.22}
REDUNDANCY_CUT = 0.65


def static_score(tokens: Column, focus: Column, kind: Column) -> Column:
    """S-2 without what depends on earlier choices: overlap, kind, signals (columns certainty, recency, teaching, priority) and density."""
    signal = lambda name, default: WEIGHTS[name] * F.coalesce(F.col(name), F.lit(default))
    density = F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)
    s = WEIGHTS["overlap"] * T.overlap(tokens, focus) + WEIGHTS["kind"] * kind_prior(kind) + WEIGHTS["density"] * density
    return T.clamp(s + signal("certainty", 0.7) + signal("recency", 0.5) + signal("teaching", 0.5) + signal("priority", 0.5))


def scored(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates (qid, id, ord, kind, content and signals) scored for their queries (qid, query), which are a stated set."""
    q = queries.select("qid", T.selector_tokens(F.col("query")).alias("focus"))
    c = candidates.withColumn("tokens", T.selector_tokens(F.col("content"))).join(F.broadcast(q), "qid")
    return c.select("qid", "id", "ord", "kind", "tokens", F.size("tokens").cast("long").alias("n_tokens"), F.round(static_score(F.col("tokens"), F.col("focus"), F.col("kind")), 6).alias("score"))


def greedy(rows: pd.DataFrame, budget: int = 350, most: int = 6, reserve: float = 0.15) -> pd.DataFrame:
    """S-6, S-7: one query's candidates -> status and reason of each.

    Memory chunks first, up to their reserve (one that passes it waits); then all others by score. A chunk is
    refused for the number of chunks, the budget, or its likeness to one already taken. Its score falls by
    its greatest Jaccard similarity with them.
    """
    rows = rows.sort_values(["score", "ord"], ascending=[False, True], kind="stable")
    taken, used, out = [], 0, {}

    def likeness(t: frozenset) -> float:
        return max((len(t & x) / len(t | x) if t | x else 0.0 for x in taken), default=0.0)

    for memory_pass in (True, False):
        for r in rows.itertuples():
            if r.id in out or (memory_pass and r.kind != "memory"):
                continue
            tokens = frozenset(r.tokens)
            like = likeness(tokens)
            if memory_pass and used + r.n_tokens > reserve * budget:
                continue
            if len(taken) >= most:
                reason = "max-chunks"
            elif used + r.n_tokens > budget:
                reason = "token-budget"
            elif like > REDUNDANCY_CUT:
                reason = "redundant"
            else:
                reason = "recall" if memory_pass else "score"
                taken.append(tokens)
                used += r.n_tokens
            out[r.id] = (reason in ("recall", "score"), reason, round(max(0.0, r.score - WEIGHTS["redundancy"] * like), 6))
    got = [out[i] for i in rows.id]
    return pd.DataFrame({"qid": rows.qid, "id": rows.id, "selected": [g[0] for g in got], "reason": [g[1] for g in got], "score": [g[2] for g in got], "n_tokens": rows.n_tokens})


def select_context(candidates: DataFrame, queries: DataFrame, budget: int = 350, most: int = 6, least: float = 0.25) -> DataFrame:
    """S-6: qid, id, selected, reason, score, n_tokens for every candidate (qid, id, ...) of a query.

    Rows that can't be chosen are settled in Spark, exactly: those below ``least`` (likeness only lowers a score) and those
    larger than the whole budget. The rest of a query is one sequential choice over the candidates that retrieval gave it; queries are spread.
    """
    s = scored(candidates, queries)
    early = F.when(F.col("score") < least, "score-below-threshold").when(F.col("n_tokens") > budget, "token-budget")
    s = s.withColumn("early", early)
    run = lambda pdf: greedy(pdf, budget, most)
    done = s.filter("early IS NULL").drop("early").groupBy("qid").applyInPandas(run, "qid long, id long, selected boolean, reason string, score double, n_tokens long")
    rest = s.filter("early IS NOT NULL").select("qid", "id", F.lit(False).alias("selected"), F.col("early").alias("reason"), "score", "n_tokens")
    return done.union(rest)


def impact(selected: DataFrame) -> DataFrame:
    """S-15, S-16: chunks and tokens before and after."""
    return selected.groupBy("qid").agg(
        F.count("*").alias("chunks"), F.count_if("selected").alias("kept"), F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("selected"), F.col("n_tokens")).otherwise(0)).alias("kept_tokens"),
    ).withColumn("saving", F.round(100 * (1 - F.try_divide("kept_tokens", "tokens")), 1))


def compress(candidates: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """S-1: the ``n`` sentences of a candidate's text (qid, id, content) that suit the query best (.7 overlap, .3 density), in their order."""
    q = queries.select("qid", T.selector_tokens(F.col("query")).alias("focus"))
    parts = F.split(F.regexp_replace("content", "([.!?])\\s+", "$1\x01"), "\x01")
    s = candidates.select("qid", "id", F.posexplode(parts).alias("pos", "s")).filter("s <> ''").join(F.broadcast(q), "qid")
    t = T.selector_tokens(F.col("s"))
    density = F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0)
    s = s.select("qid", "id", F.struct(F.round(-(0.7 * T.overlap(t, F.col("focus")) + 0.3 * density), 6).alias("k"), "pos", "s").alias("x"))
    g = s.groupBy("qid", "id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, n).alias("x"))
    return g.select("qid", "id", F.array_join(F.transform(F.array_sort(F.transform("x", lambda y: F.struct(y["pos"].alias("pos"), y["s"].alias("s")))), lambda y: y["s"]), " ").alias("summary"))


def inject(chunks: DataFrame, budget: int = 520, most: int = 8) -> DataFrame:
    """S-14: (group, ord, id, source, kind, content) -> id, used, reason. Repeats (of source and content) go; then chunks are taken in order while they fit, and one
    that doesn't is skipped. A chunk costs the tokens of what is shown of it: a line with its source and kind, and its sanitised content.

    A fold over the ordered chunks of a prompt, which are few by the contract of the operator. The budget is 80 at least.
    """
    from pyspark.sql import Window as W

    budget, most = max(80, budget), max(1, most)
    shown = F.concat(F.lit("[source="), F.coalesce("source", F.lit("")), F.lit(" kind="), F.coalesce("kind", F.lit("")), F.lit("]\n"), F.trim(guards.sanitize(F.col("content"))))
    signature = F.sha2(F.concat_ws("::", F.coalesce("source", F.lit("")), F.coalesce("content", F.lit(""))), 256)
    first = chunks.withColumn("rep", F.row_number().over(W.partitionBy("group", signature).orderBy("ord")) > 1)
    first = first.withColumn("tokens", F.size(F.filter(T.selector_tokens(shown), lambda w: w != "")))
    item = F.struct("ord", "id", "rep", "tokens")
    g = first.groupBy("group").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<struct<id:bigint,reason:string>>")

    def step(acc: Column, x: Column) -> Column:
        reason = F.when(x["rep"], "duplicate").when(acc["n"] >= most, "max-chunks-reached").when(acc["used"] + x["tokens"] > budget, "token-budget-exceeded").otherwise("used")
        took = reason == "used"
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), reason.alias("reason")))).alias("out"), (acc["n"] + took.cast("int")).alias("n"), (acc["used"] + F.when(took, x["tokens"]).otherwise(0)).alias("used"))

    start = F.struct(empty.alias("out"), F.lit(0).alias("n"), F.lit(0).alias("used"))
    return g.select("group", F.explode(F.aggregate("items", start, step)["out"]).alias("r")).select("group", "r.id", (F.col("r.reason") == "used").alias("used"), "r.reason")


#: Weights of the terms that depend on changed files, and what a changed file adds by the chunk's kind.
FILE_WEIGHTS = {"affinity": 0.12, "fit": 0.14, "test": 0.05, "source_penalty": 0.2, "narrative": 0.18, "runner": 0.34}
ANCHOR = {"code": 0.16, "test": 0.09}
OTHER_ANCHOR, ANCHOR_WEIGHT = 0.12, 1.05


def origin(kind: Column, source: Column) -> Column:
    """S-8."""
    s = F.lower(source)
    return F.when((F.lower(kind) == "chat") | F.startswith(s, F.lit("chat://")), "chat").when(F.rlike(s, F.lit("^(engram|memory)://")), "memory").otherwise("workspace")


def _best(changed: Column, score) -> Column:
    """The greatest score of any changed file; 0 without one."""
    return F.coalesce(F.array_max(F.transform(changed, score)), F.lit(0.0))


def source_affinity(source: Column, changed: Column) -> Column:
    """S-3: 1 for a changed file itself, .93 for its stem, else .76 for its folder or .82 of the share of its terms."""
    src, own, where, terms = F.lower(source), T.stem(source), T.folder(source), T.path_terms(source)

    def one(c: Column) -> Column:
        share = 0.82 * T.overlap(terms, T.path_terms(c))
        near = F.when((where != "") & (where == T.folder(c)), F.greatest(F.lit(0.76), share)).otherwise(share)
        return F.when(src == F.lower(c), 1.0).when((own != "") & (own == T.stem(c)), 0.93).otherwise(near)

    return T.clamp(_best(changed, one))


def change_anchor(source: Column, changed: Column) -> Column:
    """S-3."""
    return _best(changed, lambda c: F.when(F.lower(source) == F.lower(c), 1.0).when((T.stem(source) != "") & (T.stem(source) == T.stem(c)), 0.86).otherwise(0.0))


def test_relationship(source: Column, changed: Column) -> Column:
    """S-3: how a test belongs to a changed file; 0 for what isn't a test."""
    src, own, terms = F.lower(source), T.stem(source), T.path_terms(source)

    def one(c: Column) -> Column:
        other = T.stem(c)
        share = 0.9 * T.overlap(terms, T.path_terms(c))
        held = F.when(F.contains(own, other), 0.95).otherwise(0.0)
        named = F.when(F.contains(src, F.regexp_replace(F.lower(c), "^src/", "")), 0.88).otherwise(0.0)
        return F.when(F.endswith(own, F.element_at(F.split(other, "/"), -1)), 1.0).otherwise(F.greatest(held, named, share))

    return F.when(F.rlike(src, F.lit("(\\.test\\.|\\.spec\\.|^test/)")), T.clamp(_best(changed, one))).otherwise(0.0)


def _holds(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def file_terms(chunks: DataFrame, changed: list[str]) -> DataFrame:
    """S-2 (what changed files add), S-3, S-4, J-8: (id, source, kind, content) -> the terms of each chunk for a stated list of changed files, and their weighted sum."""
    files = F.array(*map(F.lit, changed)) if changed else F.array().cast("array<string>")
    any_file = F.lit(bool(changed))
    c = chunks.select("id", "kind", F.lower("source").alias("source"), F.lower("content").alias("low"))
    c = c.select("*", source_affinity(F.col("source"), files).alias("affinity"), change_anchor(F.col("source"), files).alias("anchor"), test_relationship(F.col("source"), files).alias("test"))
    a, r, k = F.col("affinity"), F.col("test"), F.col("kind")
    fit = F.when(k == "code", 0.3 + a * 0.7).when(k == "test", 0.36 + a * 0.42 + r * 0.28).when(k == "spec", 0.12 + a * 0.5).when(k == "memory", 0.08 + a * 0.38).when(k == "doc", 0.05 + a * 0.28).otherwise(a * 0.2)
    generic = _holds(F.col("source"), "run-tests", "test/index", "test/setup") | _holds(F.col("low"), "whole repository", "portable checks", "across the repository")
    bias = 1.0 if changed else 0.45
    s = F.col("source")
    broad = F.when(a >= 0.9, 0.0).when(s == "readme.md", 0.92 * bias).when(s == "agents.md", 0.56 * bias).when(s == "package.json", 0.26 * bias).when(F.startswith(s, F.lit("docs/")), 0.24 * bias).otherwise(0.0)
    c = c.select(
        "id", "affinity", "anchor", "test", F.when(any_file, T.clamp(fit)).otherwise(0.0).alias("fit"), broad.alias("source_penalty"),
        F.when((k == "test") & any_file & generic & (r < 0.45), 0.85).otherwise(0.0).alias("runner"), F.when((k == "memory") & _holds(F.col("low"), "session close summary", "closed at", " learned ", " next "), 0.34).otherwise(0.0).alias("narrative"),
        F.when(k == "code", ANCHOR["code"]).when(k == "test", ANCHOR["test"]).otherwise(OTHER_ANCHOR).alias("w"),
    )
    f = FILE_WEIGHTS
    total = f["affinity"] * F.col("affinity") + f["fit"] * F.col("fit") + f["test"] * F.col("test") + ANCHOR_WEIGHT * F.col("w") * F.col("anchor")
    total = total - f["source_penalty"] * F.col("source_penalty") - f["narrative"] * F.col("narrative") - f["runner"] * F.col("runner")
    names = ["affinity", "anchor", "test", "fit", "source_penalty", "runner", "narrative"]
    return c.select("id", *[F.round(n, 6).alias(n) for n in names], F.round(total, 6).alias("total"))


def shadow(selected: DataFrame, baseline: DataFrame) -> DataFrame:
    """S-17: mean scores of what was selected and of a baseline (qid, score), and their difference."""
    a = selected.filter("selected").groupBy("qid").agg(F.avg("score").alias("a"), F.count("*").alias("n"))
    b = baseline.groupBy("qid").agg(F.avg("score").alias("b"), F.count("*").alias("m"))
    j = b.join(a, "qid", "left").fillna(0, ["a", "n"])
    return j.select("qid", F.round("b", 4).alias("baseline"), F.round("a", 4).alias("selected"), F.round(F.col("a") - F.col("b"), 4).alias("gain"), (F.col("m") - F.col("n")).alias("fewer"))


def covered(selected: DataFrame, required: list[str]) -> DataFrame:
    """S-9: (qid, id, kind, selected, score) with a chunk of each required kind: for a kind that is missing, the best chunk of it joins, and, if the
    choice is full, takes the place of the selected chunk of least score whose kind isn't required or is there twice. -> qid, id, selected, reason.

    One sequential choice per query over its candidates, which are few by the retrieval's limit.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        on, reason = pdf.selected.tolist(), ["selected" if x else "" for x in pdf.selected]
        kinds = pdf.kind.tolist()
        for want in required:
            if any(o and k == want for o, k in zip(on, kinds, strict=True)):
                continue
            new = next((i for i, k in enumerate(kinds) if k == want and not on[i]), None)
            if new is None:
                continue
            now = [k for o, k in zip(on, kinds, strict=True) if o]
            spare = [i for i in range(len(on)) if on[i] and (kinds[i] not in required or now.count(kinds[i]) > 1)]
            if spare:
                out = min(spare, key=lambda i: (pdf.score[i], i))
                on[out], reason[out] = False, "replaced"
            elif now:
                continue
            on[new], reason[new] = True, "coverage"
        return pd.DataFrame({"qid": pdf.qid, "id": pdf.id, "selected": on, "reason": reason})

    return selected.select("qid", "id", "kind", "selected", "score").groupBy("qid").applyInPandas(run, "qid long, id long, selected boolean, reason string")
