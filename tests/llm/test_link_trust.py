import re

import duckdb

from gleanery.llm import link_trust as L


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    return host, re.match(r"[^?#]*", rest[len(raw) :])[0]


def plain_rule(host, path):
    best = max((r for r in L.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


URLS = [None, "", "no-scheme", "://", "http://EXAMPLE.org/es/x?y", "http://a.example.org/en/12#t", "http://badexample.org/es/", "x://org", "http://org/", "https://É.Com/fr/", "https://com/de/?u=http://x.org/", "a?b://c.com/fr/x", "http://x.com\n/de/", "ftp://h.net/en", "http://h.net:80/en/"]


def plain_rank(seeds, edges, steps):
    total = sum(seeds.values())
    start = {h: s / total for h, s in seeds.items() if s}
    out = {}
    for (s, _), n in edges.items():
        out[s] = out.get(s, 0) + n
    score = dict(start)
    for _ in range(steps):
        new = {h: 0.15 * s for h, s in start.items()}
        for h, s in score.items():
            if h in out:
                for (a, b), n in edges.items():
                    if a == h:
                        new[b] = new.get(b, 0) + 0.85 * s * n / out[h]
            else:
                new[h] = new.get(h, 0) + 0.85 * s
        score = new
    return score


def test_urls(spark):
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in L.judge(df).collect()}
    assert len(rows) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")
    assert L.judge(df.limit(0)).collect() == []


def test_graph(spark):
    page = lambda i, host, *to: (i, f"http://{host}/x", " ".join(f'<a class=q href="{t}">' for t in to))
    rows = [
        page(1, "good.org", "http://good.org/a", "//near.net/z", "https://near.net/q", "/rel"),
        page(2, "near.net", "http://far.net/"),
        page(3, "spam.net", "http://bad.com/1", "http://good.org"),
        page(4, "far.net"),
        (5, "http://bad.com/de/", "<A HREF='HTTP://Far.net/'>"),
        (6, "http://bad.com/de/2", None),
        page(7, "alone.net"),
        page(8, "feeder.net", "http://spam.net/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.src, r.dst): r.n for r in L.links(df.select("html", L.host_of(df.url).alias("host"))).collect()}
    assert edges == {("good.org", "near.net"): 2, ("near.net", "far.net"): 1, ("spam.net", "bad.com"): 1, ("spam.net", "good.org"): 1, ("bad.com", "far.net"): 1, ("feeder.net", "spam.net"): 1}
    trust = plain_rank({"good.org": 1}, edges, L.ITERATIONS)
    against = plain_rank({"bad.com": 2}, {(b, a): n for (a, b), n in edges.items()}, L.ITERATIONS)
    out = {r.page_id: r for r in L.judge(df).collect()}
    for i, url, _ in rows:
        h = plain_url(url)[0]
        t, d = trust.get(h, 0), against.get(h, 0)
        assert abs(out[i].distrust - (d / (t + d) if t + d else 0)) < 1e-9
    assert [out[i].verdict for i in range(1, 9)] == ["allow", "allow", "block", "allow", "block", "block", "allow", "block"]


def test_oracle_and_plan(spark, sf):
    df = L.judge(spark.read.parquet(f"{sf}/pages.parquet"))
    assert not re.search("Python|Pandas|Arrow|MapIn", df._jdf.queryExecution().toString())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    key = lambda r: r[0]
    assert sorted(map(tuple, df.drop("distrust").collect()), key=key) == sorted(con.execute(L.oracle()).fetchall(), key=key)


def test_deep_chains_are_followed_to_their_end(spark):
    rows = [(0, "http://bad.com/de/", "")] + [(i, f"http://h{i}.net/", f'<a href="http://{f"h{i - 1}.net" if i > 1 else "bad.com"}/de/">') for i in range(1, 13)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.verdict for r in L.judge(df, tolerance=0.2).collect()}
    assert out == {i: "block" for i in range(13)}


def test_propagation_equals_its_steps_in_sql(spark, sf):
    from gleanery.llm import queries as Q

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = Q.QUERIES["link_propagation"](spark, sf)
    rel = con.execute(L.linked_oracle())
    names = [c[0] for c in rel.description]
    assert {r[0]: r[1:] for r in map(tuple, got.select(*names).collect())} == {r[0]: r[1:] for r in rel.fetchall()}
    assert {r.verdict for r in got.filter("rule IS NULL").collect()} == {"allow", "block"}


def test_the_first_of_equal_rules_wins(spark):
    rules = [("block", "a.org", "/x"), ("allow", "org", "/x/yz"), ("allow", "a.org", "/x")]
    df = spark.createDataFrame([(1, "http://a.org/x/yz"), (2, "http://b.a.org/x/yz1")], "page_id long, url string").selectExpr("*", "CAST(NULL AS STRING) AS html")
    got = {r.page_id: (r.rule, r.verdict) for r in L.judge(df, rules).collect()}
    assert len("a.org/x") < len("org/x/yz") and got == {1: ("org/x/yz", "allow"), 2: ("org/x/yz", "allow")}
    equal = [("block", "a.org", "/x"), ("allow", "a.org", "/y"), ("allow", "a.org", "/x")]
    assert {r.verdict for r in L.judge(df, equal).collect()} == {"block"}


def test_hosts_beyond_the_broadcast_bound(spark, sf):
    pages = L.linked(spark.read.parquet(f"{sf}/pages.parquet"))
    one, two = (sorted(map(tuple, L.judge(pages, broadcast_hosts=n).drop("rule").collect())) for n in (500_000, 0))
    assert [r[:4] for r in one] == [r[:4] for r in two]
