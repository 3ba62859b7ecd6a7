"""URL filters by link-graph propagation, with DataFrame functions only.

Rules decide the urls that they fit. Hosts with allowed urls are seeds of trust, which personalised
PageRank spreads along links; hosts with blocked urls are seeds of distrust, which spreads against the
direction of links. Hosts are then judged by the share of distrust in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables

#: Fixed values: (verdict, host, path) of the rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING = 0.85
ITERATIONS = 8
#: Total change of two steps below which scores have converged.
TOLERANCE = 1e-6
#: Hosts with a larger share of distrust are blocked.
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); the first listed one of equal length. ``rules`` is a stated list."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):  # the last and so outermost test wins
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted before they are shuffled."""
    found = F.regexp_extract_all(F.col("html"), F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]+)"), 1)
    out = pages.filter(F.contains(F.col("html"), F.lit("//"))).select("host", F.explode(found).alias("to"))
    to = F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    out = out.select(F.col("host").alias("src"), host_of(to).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("n"))


#: Hosts (about 60 bytes each) that are broadcast at most, by their count; beyond that, joins are shuffled and split where they are skewed.
BROADCAST_HOSTS = 500_000


def _small(hosts: DataFrame, most: int) -> DataFrame:
    """``hosts``, a written table, to be broadcast if it has few enough rows."""
    return F.broadcast(hosts) if hosts.count() <= most else hosts


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = None, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``seeds`` (host, seed), ``edges`` (src, dst, n) -> (host, score) by personalised PageRank.

    Seeds are normalised to one in all. Hosts without links forward keep their mass. Every second
    step is cut by a written table, so that a lost executor costs two steps at most. With a ``tolerance``, steps go on
    beyond ``iterations`` until two of them reach no new host and change less than that in all. Without seeds there are no scores.
    """
    spark = seeds.sparkSession
    total = seeds.agg(F.sum("seed")).first()[0] or 0
    if total <= 0:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    start = seeds.filter("seed > 0").select("host", (F.col("seed") / F.lit(total)).alias("seed"))
    out_n = _small(tables.table(edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("all"))), broadcast_hosts)
    share = tables.table(edges.join(out_n, edges.src == out_n.host).select("src", "dst", (F.col("n") / F.col("all")).alias("w")))
    score, old, last = start.withColumnRenamed("seed", "score"), None, None
    k, reached, settled = 0, 0, tolerance is None
    while k < iterations or not settled:
        moved = share.join(score, score.host == share.src).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("w")).alias("score"))
        stay = score.join(out_n, "host", "left_anti").select("host", (damping * F.col("score")).alias("score"))
        back = start.select("host", ((1 - damping) * F.col("seed")).alias("score"))
        score = moved.union(stay).union(back).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 2 or k == iterations - 1:
            score, path = tables.written(score)
            if tolerance is not None:
                was = last.select("host", F.col("score").alias("was")) if last is not None else start.select("host", F.col("seed").alias("was"))
                diff = F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))
                change, n = score.join(was, "host", "full_outer").agg(F.coalesce(F.sum(diff), F.lit(0.0)), F.count("score")).first()
                settled, reached, last = n == reached and change < tolerance, n, score
            if old:
                tables.drop(spark, old)
            old = path
            score = _small(score, broadcast_hosts)
        k += 1
    return score


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, iterations: int = ITERATIONS, tolerance: float | None = None, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` (page_id, url, html, and others that are not read) -> page_id, host, path, rule, verdict, distrust.

    One row per row of ``pages``. Null urls and urls without ``://`` have an empty host and path, no
    rule, and are allowed, as are hosts that neither trust nor distrust reaches. Of rules of equal length the first listed one
    wins. Null or empty html has no links; html of any length is searched whole. Repeated rows count as often as they come; an empty table gives no rows.
    """
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict")
    seeds = tables.table(p.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")))
    edges = tables.table(links(pages.select("html", host_of(F.col("url")).alias("host"))))
    steps = iterations if edges.limit(1).count() else 0  # without links a seed keeps what it has
    spread = lambda seed, e: propagate(seeds.select("host", F.col(seed).alias("seed")), e, iterations=steps, tolerance=tolerance if steps else None, broadcast_hosts=broadcast_hosts)
    trust, against = spread("good", edges), spread("bad", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    both = trust.select("host", F.col("score").alias("t"), F.lit(0.0).alias("d")).union(against.select("host", F.lit(0.0).alias("t"), F.col("score").alias("d")))
    hosts = both.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).select("host", (F.col("d") / (F.col("t") + F.col("d"))).alias("distrust"))
    out = p.join(_small(tables.table(hosts), broadcast_hosts), "host", "left")
    host_verdict = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", host_verdict).alias("verdict"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


#: Hosts of the linked pages that the query below makes of ``pages``.
LINKED_HOSTS = 60


def linked(pages: DataFrame) -> DataFrame:
    """Pages with links, made of the rows of ``pages``: each gets one of ``LINKED_HOSTS`` hosts, some of them with a rule, and links to two others."""
    i, n = F.col("page_id"), F.lit(LINKED_HOSTS)
    host = lambda k: F.concat(F.lit("h"), F.pmod(k, n), F.when(F.pmod(k, n) % 7 == 0, ".org").when(F.pmod(k, n) % 5 == 0, ".com").otherwise(".net"))
    path = F.when(i % 2 == 0, "/de/x").otherwise("/en/x")
    link = lambda k: F.concat(F.lit("<a href='http://"), host(k), F.lit("/y'>z</a>"))
    return pages.select("page_id", F.concat(F.lit("http://"), host(i), path).alias("url"), F.concat(link(i * 3 + 1), F.lit(" "), link(i + 11)).alias("html"))


def linked_oracle(iterations: int = ITERATIONS) -> str:
    """DuckDB: the verdicts of ``judge(linked(pages))``, each step of both walks as a CTE."""
    host = lambda k: f"'h' || (({k}) % {LINKED_HOSTS}) || CASE WHEN (({k}) % {LINKED_HOSTS}) % 7 = 0 THEN '.org' WHEN (({k}) % {LINKED_HOSTS}) % 5 = 0 THEN '.com' ELSE '.net' END"
    steps = []
    for name, seed, e in (("t", "good", "SELECT src, dst, n FROM e"), ("d", "bad", "SELECT dst AS src, src AS dst, n FROM e")):
        steps.append(f"{name}e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM ({e}))")
        steps.append(f"{name}0 AS (SELECT host, {seed} / (SELECT sum({seed}) FROM s) AS score FROM s WHERE {seed} > 0)")
        for k in range(iterations):
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT dst AS host, {DAMPING} * score * w AS score FROM {name}{k} JOIN {name}e ON host = src"
                f" UNION ALL SELECT host, {DAMPING} * score FROM {name}{k} WHERE host NOT IN (SELECT src FROM {name}e) UNION ALL SELECT host, {1 - DAMPING!r} * score FROM {name}0) GROUP BY host)"
            )
    return f"""
WITH p AS (SELECT page_id, {host("page_id")} AS host, CASE WHEN page_id % 2 = 0 THEN '/de/x' ELSE '/en/x' END AS path, page_id AS i FROM pages),
r AS (SELECT *, CASE WHEN host LIKE '%.com' AND path = '/de/x' THEN 'com/de/' WHEN host LIKE '%.org' THEN 'org/' END AS rule FROM p),
s AS MATERIALIZED (SELECT host, count(*) FILTER (rule = 'org/') AS good, count(*) FILTER (rule = 'com/de/') AS bad FROM r GROUP BY host),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {host("i * 3 + 1")} AS dst FROM p UNION ALL SELECT host, {host("i + 11")} FROM p) WHERE src <> dst GROUP BY ALL),
{", ".join(steps)},
h AS (SELECT coalesce(t.host, d.host) AS host, coalesce(d.score, 0) / (coalesce(t.score, 0) + coalesce(d.score, 0)) AS distrust FROM t{iterations} t FULL JOIN d{iterations} d ON t.host = d.host)
SELECT page_id, r.host, path, rule, CASE WHEN rule = 'org/' THEN 'allow' WHEN rule = 'com/de/' THEN 'block' WHEN coalesce(distrust, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict, round(coalesce(distrust, 0), 6) AS distrust FROM r LEFT JOIN h USING (host)"""


def oracle() -> str:
    """DuckDB: rules, and the verdict of hosts by their own seeds (the tables' pages have no links between hosts)."""
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(v, h, p)}'" for v, h, p in by_length) + " END"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
x AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM x),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS v FROM p),
s AS (SELECT host, count(*) FILTER (v = 'allow') / sum(count(*) FILTER (v = 'allow')) OVER () AS t, count(*) FILTER (v = 'block') / sum(count(*) FILTER (v = 'block')) OVER () AS d FROM r WHERE host <> '' GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN d / nullif(t + d, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN s USING (host)"""
