"""Evaluation of rankings and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T


def ranking_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """E-1, W-11, W-12: ranked (qid, id, rank), expected (qid, id) -> recall, MRR, nDCG per case."""
    hits = ranked.join(expected.select("qid", "id"), ["qid", "id"], "left_semi")
    h = hits.groupBy("qid").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    k = ranked.groupBy("qid").agg(F.count("*").alias("k"))
    e = expected.groupBy("qid").agg(F.countDistinct("id").alias("want"))
    j = e.join(k, "qid", "left").join(h, "qid", "left").fillna(0, ["k", "found"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("k", "want"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return j.select("qid", F.round(F.col("found") / F.col("want"), 4).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 4).alias("ndcg"))


def classifier_metrics(rows: DataFrame) -> DataFrame:
    """E-2, E-3: (expected, predicted) -> n, accuracy, macro-F1 over the expected labels."""
    c = rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    tp = c.filter("expected = predicted").select(F.col("expected").alias("label"), F.col("n").alias("tp"))
    f = c.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("support")).join(tp, "label", "left").join(c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said")), "label", "left")
    f = f.fillna(0, ["tp", "said"]).withColumn("f1", 2 * F.col("tp") / (F.col("support") + F.col("said")))
    return f.agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"))


def consistency(rows: DataFrame) -> DataFrame:
    """E-10, J-7: mean Jaccard similarity of all pairs of responses of a case (key, ord, text); a case's responses are few by definition."""
    t = rows.select("key", "ord", F.array_distinct(T.rag_tokens(F.col("text"))).alias("t"))
    a, b = t.alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.ord") < F.col("b.ord"))).select(F.col("a.key").alias("key"), T.jaccard(F.col("a.t"), F.col("b.t"), 1.0).alias("j"))
    return p.groupBy("key").agg(F.count("*").alias("pairs"), F.round(F.avg("j"), 4).alias("consistency")).withColumn("level", F.expr("CASE WHEN consistency >= 0.65 THEN 'high' WHEN consistency >= 0.45 THEN 'medium' ELSE 'low' END"))


def risk_metrics(rows: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """E-3: (expected, predicted) -> recall of high risks, share rated too low, share unknown."""
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(c))
    high = max(ranks.values()) - 1
    e, p = F.coalesce(rank("expected"), F.lit(-1)), F.coalesce(rank("predicted"), F.lit(-1))
    share = lambda c, of: F.round(F.try_divide(F.count_if(c), of), 4)
    n = F.count("*")
    return rows.agg(n.alias("n"), F.coalesce(share((e >= high) & (p >= high), F.count_if(e >= high)), F.lit(1.0)).alias("high_recall"), share((e >= 0) & (p >= 0) & (p < e), n).alias("under_rate"), share(p < 0, n).alias("unknown_rate"))


def rewrite_metrics(rows: DataFrame) -> DataFrame:
    """E-4: (original, rewritten, keywords) -> share of keywords kept, of rewrites, of meaning kept (.25 of the words), longest ratio."""
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), "\\s+"), lambda w: w != "")
    o, r = F.array_distinct(words("original")), F.array_distinct(words("rewritten"))
    found = F.when(F.size("keywords") > 0, F.size(F.filter("keywords", lambda k: F.contains(F.lower("rewritten"), F.lower(k)))) / F.size("keywords")).otherwise(1.0)
    kept = F.size(F.array_intersect(o, r)) / F.greatest(F.size(o), F.lit(1))
    ratio = F.size(words("rewritten")) / F.greatest(F.size(words("original")), F.lit(1))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(found), 4).alias("keyword_recall"), F.round(F.avg((F.lower(F.trim("original")) != F.lower(F.trim("rewritten"))).cast("int")), 4).alias("rewrite_rate"), F.round(F.avg((kept >= 0.25).cast("int")), 4).alias("intent_rate"), F.round(F.max(ratio), 4).alias("length_ratio"))


def gate(rows: DataFrame) -> DataFrame:
    """E-11: (domain, metric, value, threshold, at_most) -> domain, passed, failing metrics."""
    ok = F.when(F.col("at_most"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return rows.groupBy("domain").agg(F.bool_and(ok).alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col("metric")))), ",").alias("failing"))


def selector_metrics(selected: DataFrame, must: DataFrame) -> DataFrame:
    """E-14: selected (qid, id, selected), must (qid, id, wanted) -> recall of wanted, share of unwanted left out."""
    j = must.join(selected, ["qid", "id"], "left").withColumn("got", F.coalesce("selected", F.lit(False)))
    share = lambda c, of: F.coalesce(F.round(F.try_divide(F.count_if(c), F.count_if(of)), 4), F.lit(1.0))
    return j.groupBy("qid").agg(share(F.col("wanted") & F.col("got"), F.col("wanted")).alias("must_recall"), share(~F.col("wanted") & ~F.col("got"), ~F.col("wanted")).alias("exclusion"))


def quality_drop(rows: DataFrame, answer: str = "answer", expected: str = "expected") -> DataFrame:
    """E-12: accuracy, and F1 of the distinct words of answers, per row id."""
    a, e = (F.array_distinct(T.raw_tokens(F.col(c))) for c in (answer, expected))
    common = F.size(F.array_intersect(a, e))
    total = F.size(a) + F.size(e)
    return rows.select("id", (F.lower(F.trim(answer)) == F.lower(F.trim(expected))).alias("exact"), F.round(F.when(total > 0, 2 * common / total).otherwise(0.0), 4).alias("f1"))


def golden_set(cases: DataFrame, least_cases: int = 200, least_domains: int = 8, least_projects: int = 8, least_unique: float = 0.95, most_docs: int = 3) -> DataFrame:
    """E-7: (domain, project, query, n_docs) -> shape of a golden set, and whether it passes."""
    g = cases.agg(F.count("*").alias("cases"), F.countDistinct("domain").alias("domains"), F.countDistinct("project").alias("projects"), F.countDistinct(F.sha2(F.lower(T.compact(F.col("query"))).cast("binary"), 256)).alias("u"), F.round(F.coalesce(F.avg("n_docs"), F.lit(0.0)), 4).alias("mean_docs"), F.coalesce(F.max("n_docs"), F.lit(0)).alias("max_docs"))
    rate = F.coalesce(F.try_divide("u", "cases"), F.lit(0.0))
    ok = (F.col("cases") >= least_cases) & (F.col("domains") >= least_domains) & (F.col("projects") >= least_projects) & (rate >= least_unique) & (F.col("max_docs") <= most_docs)
    return g.select("cases", "domains", "projects", F.round(rate, 4).alias("unique_rate"), "mean_docs", "max_docs", ok.alias("passed"))


def poisoning(rows: DataFrame, least_quarantine: float = 1.0, least_clean: float = 0.95, most_leaks: int = 0) -> DataFrame:
    """E-8: (poisoned, accepted, leaked) -> rates of quarantine, leaks and clean acceptance, and whether the gate passes."""
    p, a = F.col("poisoned"), F.col("accepted")
    share = lambda c, of, none: F.coalesce(F.try_divide(F.count_if(c), F.count_if(of)), F.lit(none))
    g = rows.agg(share(p & ~a, p, 1.0).alias("q"), share(p & a, p, 0.0).alias("l"), share(~p & a, ~p, 1.0).alias("c"), share(~p & ~a, ~p, 0.0).alias("f"), F.count_if(p & F.col("leaked")).alias("leak_hits"))
    ok = (F.col("q") >= least_quarantine) & (F.col("l") <= 0) & (F.col("c") >= least_clean) & (F.col("f") <= 1 - least_clean) & (F.col("leak_hits") <= most_leaks)
    return g.select(F.round("q", 4).alias("quarantine_rate"), F.round("l", 4).alias("leak_rate"), F.round("c", 4).alias("clean_rate"), F.round("f", 4).alias("false_positive_rate"), "leak_hits", ok.alias("passed"))


def noise_gate(rows: DataFrame, least_reduction: float = 0.25, least_anchor: float = 0.9, most_drop: float = 0.05, least_redundancy: float = 0.6) -> DataFrame:
    """E-9: (id, base_tokens, new_tokens, base_anchor, new_anchor, redundancy) -> reduction, drop, and whether each passes."""
    cut = F.when(F.col("base_tokens") > 0, (F.col("base_tokens") - F.col("new_tokens")) / F.col("base_tokens")).otherwise(0.0)
    drop = F.col("base_anchor") - F.col("new_anchor")
    ok = (cut >= least_reduction) & (F.col("new_anchor") >= least_anchor) & (drop <= most_drop) & (F.col("redundancy") >= least_redundancy)
    return rows.select("id", F.round(cut, 4).alias("reduction"), F.round(drop, 4).alias("anchor_drop"), ok.alias("passed"))


#: Headings that each section of an answer may have.
SECTIONS = {"change": "cambio|change", "reason": "motivo|reason|why", "concepts": "conceptos?|concepts?", "practice": "pr[aá]ctica|practice"}


def format_coverage(rows: DataFrame) -> DataFrame:
    """E-5, heading part: (id, baseline, candidate) -> share of the four sections with a heading in each, and the lift."""
    held = lambda c: sum((F.rlike(F.lower(c), F.lit(f"(?m)^\\s*(?:#+\\s*)?(?:{p})\\s*:")).cast("int") for p in SECTIONS.values()), F.lit(0)) / len(SECTIONS)
    b, c = held(F.col("baseline")), held(F.col("candidate"))
    return rows.select("id", F.round(b, 4).alias("baseline"), F.round(c, 4).alias("candidate"), F.round(c - b, 4).alias("lift"))


def readiness(samples: DataFrame, least_samples: int = 50, most_duplicates: float = 0.1) -> DataFrame:
    """E-6: (id, intent, risk, input, output) -> samples, duplicate and secret rates, labels met, and whether they are ready."""
    secret = F.rlike("output", F.lit("(?i)(?:password|secret|token|api_?key)\\s*[:=]"))
    g = samples.agg(F.count("*").alias("samples"), F.countDistinct(F.sha2(F.lower(T.compact(F.col("input"))).cast("binary"), 256)).alias("u"), F.count_if(secret).alias("s"), F.countDistinct("intent").alias("intents"), F.countDistinct("risk").alias("risks"), F.count_if(F.trim("output") == "").alias("blank"))
    dup = F.coalesce(1 - F.try_divide("u", "samples"), F.lit(0.0))
    ok = (F.col("samples") >= least_samples) & (dup <= most_duplicates) & (F.col("s") == 0) & (F.col("blank") == 0)
    return g.select("samples", F.round(dup, 4).alias("duplicate_rate"), F.round(F.coalesce(F.try_divide("s", "samples"), F.lit(0.0)), 4).alias("secret_rate"), "intents", "risks", ok.alias("ready"))


def recall_metrics(cases: DataFrame) -> DataFrame:
    """E-17: (status, expected_status, recovered, expected) -> status accuracy, mean share recovered, share of exact cases."""
    share = F.coalesce(F.try_divide("recovered", "expected"), F.lit(1.0))
    return cases.agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == F.col("expected_status")).cast("int")), 4).alias("status_accuracy"), F.round(F.avg(F.least(F.lit(1.0), share)), 4).alias("mean_recovered"), F.round(F.avg((F.col("recovered") == F.col("expected")).cast("int")), 4).alias("exact_rate"))


def tuned(scores: DataFrame) -> DataFrame:
    """E-16: (profile, case, passed, score) -> profiles, best pass rate first (ties by mean score, then name)."""
    from pyspark.sql import Window as W

    g = scores.groupBy("profile").agg(F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"), F.round(F.avg("score"), 4).alias("mean_score"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("pass_rate"), F.desc("mean_score"), "profile")))  # a row per profile


def north_star(report: DataFrame, least_savings: float = 40.0, most_blocked: float = 0.05, most_ms: float = 1500.0) -> DataFrame:
    """E-13: (id, savings, blocked_rate, mean_duration) -> failing checks, comma-joined, and whether all pass."""
    bad = F.array_join(F.array_compact(F.array(F.when(F.col("savings") < least_savings, "savings"), F.when(F.col("blocked_rate") > most_blocked, "blocked-rate"), F.when(F.col("mean_duration") > most_ms, "duration"))), ",")
    return report.select("id", bad.alias("failing"), (bad == "").alias("passed"))
