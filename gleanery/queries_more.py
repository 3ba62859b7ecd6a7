"""Further registered queries: gates, findings, axioms, reports, parsing. Inputs are derived from the driver's tables, alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import axioms, code, evals, findings, guards, hygiene, memory, observe, parsing, retrieval, selection, upkeep
from gleanery.queries import AS_OF, CHUNKS, COMPACT, EVENTS, MEMORIES, _EVAL, _bm25_ctes, _list, _re, _requests, asked, chunks, events, memories, pick, query, t, tok, turns

# ---- scalars ------------------------------------------------------------------------------------

_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_PATHS = ["src/auth/Login.test.ts", "src/auth/login.ts", "test/run-tests.js", "docs/api/index.md", "README.md", "lib/net/http_client.spec.js", "package.json", "src/auth/index.ts"]
_PATH = f"([{_list(_PATHS)}])[doc_id % {len(_PATHS)} + 1]"
_STEM = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\.[a-z0-9]+$', ''), '(\\.test|\\.spec)$', ''), '/index$', '')"
_FOLDER = "CASE WHEN contains({0}, '/') THEN regexp_replace(lower({0}), '/[^/]*$', '') ELSE '' END"
_TERMS = f"list_filter(regexp_split_to_array(lower({{0}}), '[/. _-]+'), lambda w: w <> '' AND w NOT IN ({_list(T.SELECTOR_STOPWORDS)}))"
_VERSION = "(doc_id % 3) || '.' || (doc_id % 11) || '.' || (doc_id % 5)"


def _path(i="doc_id"):
    return pick(F.col(i), _PATHS)


@query("f3_f16_scalars", f"""WITH x AS (SELECT *, {_PATH} AS path, {_VERSION} AS v, ([ '>=1.5.2', '>1.0.0', '<=2.3.1', 'latest'])[doc_id % 4 + 1] AS req, ([ 'a/b.ts', '../x', 'a/../../b', '/etc/x', './a/./b', 'C:/x' ])[doc_id % 6 + 1] AS rel, TIMESTAMP '2024-01-01' + to_hours((doc_id % 900)::INT) AS moment,
 'step ' || (doc_id % 70) || ([ ' minutes', 'ms', ' horas', ' units', ' d' ])[doc_id % 5 + 1] || ' wait' AS said FROM documents),
n AS (SELECT *, greatest(0, floor((epoch(TIMESTAMP '2024-02-01') - epoch(moment)) / 86400)::BIGINT) AS days FROM x),
w AS (SELECT *, list_transform(string_split(v, '.'), lambda z: z::INT) AS vi, ([[1,5,2],[1,0,0],[2,3,1],NULL])[doc_id % 4 + 1] AS ri FROM n)
SELECT doc_id AS id, strftime(moment, '%Y%m%d%H%M%S') || '000-' || substr({_SLUG.format("text")}, 1, 20) AS tid, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[()`,.:;!?¿¡"''*_-]', ' ', 'g')), '\\s+', ' ', 'g'))) AS plain,
days, CASE WHEN days <= 1 THEN '' ELSE 'Note: This memory is ' || days || CASE WHEN days = 1 THEN ' day' ELSE ' days' END || ' old. It is a point-in-time observation. Verify against current state before acting on it.' END AS note,
{_STEM.format("path")} AS stem, {_FOLDER.format("path")} AS folder, array_to_string({_TERMS.format("path")}, ' ') AS terms,
CASE WHEN ri IS NULL THEN true WHEN req[1:2] = '>=' THEN vi >= ri WHEN req[1:1] = '>' THEN vi > ri ELSE vi <= ri END AS fits, doc_id % 6 IN (0, 4) AS inside,
CASE WHEN doc_id % 5 = 3 THEN NULL ELSE (doc_id % 70)::INT END AS n_value, ([ 'm', 'ms', 'h', '', 'd' ])[doc_id % 5 + 1] AS n_unit FROM w""")  # fmt: skip
def f3(spark, d):
    i = F.col("doc_id")
    x = t(spark, d, "documents").withColumn("path", _path()).withColumn("v", F.concat_ws(".", i % 3, i % 11, i % 5)).withColumn("req", pick(i, [">=1.5.2", ">1.0.0", "<=2.3.1", "latest"])).withColumn("rel", pick(i, ["a/b.ts", "../x", "a/../../b", "/etc/x", "./a/./b", "C:/x"]))
    x = x.withColumn("at", F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01"))) + (i % 900) * 3600)).withColumn("said", F.concat(F.lit("step "), i % 70, pick(i, [" minutes", "ms", " horas", " units", " d"]), F.lit(" wait")))
    x = x.withColumn("days", T.age_days(F.col("at"), F.to_timestamp(F.lit("2024-02-01")))).withColumn("num", T.numeric_signal(F.col("said")))
    return x.select(
        i.alias("id"), T.timestamp_id(F.col("at"), F.col("text")).alias("tid"), F.md5(T.plain_statement(F.col("text")).cast("binary")).alias("plain"), "days", T.freshness_note(F.col("days")).alias("note"), T.stem(F.col("path")).alias("stem"), T.folder(F.col("path")).alias("folder"),
        F.array_join(T.path_terms(F.col("path")), " ").alias("terms"), code.satisfies(F.col("v"), F.col("req")).alias("fits"), T.inside(F.col("rel")).alias("inside"), F.col("num.value").alias("n_value"), F.col("num.unit").alias("n_unit"),
    )


@query("f9_truncate", "WITH l AS (SELECT doc_id AS id, list_slice(string_split(text, chr(10)), 1, 4) AS l FROM documents), e AS (SELECT id, unnest(l) AS s, unnest(range(0, len(l))) AS i FROM l), c AS (SELECT *, sum(strlen(s) + 1) OVER (PARTITION BY id ORDER BY i) AS n FROM e) SELECT id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (n <= 601), '') AS kept FROM c GROUP BY id")
def f9(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.truncated(F.col("text"), 4, 600).alias("kept"))


@query("t5_relevance", f"SELECT doc_id AS id, md5(array_to_string({tok('relevance', 'text')}, ' ')) AS h FROM documents")
def t5(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.array_join(T.relevance_tokens(F.col("text")), " ").cast("binary")).alias("h"))


# ---- code gates ---------------------------------------------------------------------------------

_LAYERS, _TO = ["api", "core", "ui", "test"], ["core/db", "ui/view", "../lib/x", "./near"]
_FILES = f"""SELECT 'src/' || ([{_list(_LAYERS)}])[doc_id % 4 + 1] || '/m' || doc_id || '.js' AS path, 'import {{ a }} from ''../' || ([{_list(_TO)}])[doc_id % 3 + 1] || '''' || chr(10) || 'const r = require(''' || (CASE WHEN doc_id % 5 = 0 THEN 'request' ELSE 'fs' END) || ''')' || chr(10) || (CASE WHEN doc_id % 7 = 0 THEN 'x = new Buffer(1)' ELSE 'y = 1' END) AS content FROM documents"""
_RULES = [{"id": "no-request", "pattern": "request"}, {"id": "api-not-ui", "from": "src/api/**", "to": "src/ui/*"}, {"id": "ui-not-core", "from": "src/ui/*", "to": "src/core/**"}]


def _files(spark, d):
    i = F.col("doc_id")
    line = F.concat(F.lit("import { a } from '../"), pick(i % 3, _TO), F.lit("'\nconst r = require('"), F.when(i % 5 == 0, "request").otherwise("fs"), F.lit("')\n"), F.when(i % 7 == 0, "x = new Buffer(1)").otherwise("y = 1"))
    return t(spark, d, "documents").select(F.concat(F.lit("src/"), pick(i, _LAYERS), F.lit("/m"), i, F.lit(".js")).alias("path"), line.alias("content"))


@query("g17_architecture", f"""WITH f AS ({_FILES}), l AS (SELECT path, 1 AS line, ([ 'core/db', 'ui/view', 'lib/x' ])[regexp_extract(path, 'm(\\d+)', 1)::INT % 3 + 1] AS k FROM f),
i AS (SELECT path, line, '../' || CASE WHEN k = 'lib/x' THEN '../lib/x' ELSE k END AS import, CASE WHEN k = 'lib/x' THEN 'lib/x' ELSE 'src/' || k END AS target FROM l UNION ALL SELECT path, 2, regexp_extract(content, 'require\\(''([^'']+)', 1), regexp_extract(content, 'require\\(''([^'']+)', 1) FROM f)
SELECT path, line, import, 'no-request' AS rule FROM i WHERE contains(import, 'request') UNION ALL SELECT path, line, import, 'api-not-ui' FROM i WHERE path LIKE 'src/api/%' AND regexp_matches(target, '^src/ui/[^/]*$') UNION ALL SELECT path, line, import, 'ui-not-core' FROM i WHERE regexp_matches(path, '^src/ui/[^/]*$') AND target LIKE 'src/core/%'""")  # fmt: skip
def g17(spark, d):
    return code.architecture_violations(_files(spark, d), _RULES)


@query("g18_deprecations", f"WITH f AS ({_FILES}), l AS (SELECT path, unnest(string_split(content, chr(10))) AS s, unnest([1, 2, 3]) AS line FROM f) SELECT path, line, 'require(''request'')' AS pattern, 'error' AS severity FROM l WHERE contains(s, 'require(''request'')') UNION ALL SELECT path, line, 'new Buffer(', 'error' FROM l WHERE contains(s, 'new Buffer(')")
def g18(spark, d):
    return code.deprecations(_files(spark, d))


_STATUS = ["pass", "skipped", "pass", "degraded", "fail", "skipped", "skipped"]


@query("g19_code_gate", f"WITH s AS (SELECT user_id AS run, ([{_list(_STATUS)}])[event_id % 7 + 1] AS status FROM events WHERE user_id % 3 > 0 OR event_id % 7 IN (1, 5, 6)), g AS (SELECT run, bool_or(status = 'fail') AS f, bool_and(status = 'skipped') AS s, bool_or(status = 'degraded') AS d FROM s GROUP BY run) SELECT run, CASE WHEN f THEN 'fail' WHEN s THEN 'skipped' WHEN d THEN 'degraded' ELSE 'pass' END AS status, NOT f AND (s OR NOT d) AS passed FROM g")
def g19(spark, d):
    e = t(spark, d, "events").filter("user_id % 3 > 0 OR event_id % 7 IN (1, 5, 6)")  # every third run has tools that were skipped alone
    return code.gate_status(e.select(F.col("user_id").alias("run"), F.col("event_type").alias("tool"), pick(F.col("event_id"), _STATUS).alias("status")))


# ---- guards -------------------------------------------------------------------------------------


@query("g2_scope", "WITH x AS (SELECT doc_id AS id, lower(text) AS q FROM documents), h AS (SELECT id, contains(q, 'password') OR contains(q, 'herbal') AS bt, contains(q, 'the')::INT + contains(q, 'und')::INT + contains(q, 'los')::INT AS n, contains(q, 'license') AS bp, contains(q, 'house') AS ap FROM x) SELECT id, CASE WHEN bt OR n < 1 OR bp THEN 'block' WHEN NOT ap THEN 'warn' ELSE 'allow' END AS verdict, CASE WHEN bt OR n < 1 THEN 'domain-scope' WHEN bp OR NOT ap THEN 'jurisdiction' ELSE '' END AS rule FROM h")
def g2(spark, d):
    return guards.scope_guard(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query")), ["the", "und", "los"], ["password", "herbal"], 1, ["house"], ["license"], True)


_CN, _CD = _re(guards.CLAIM_NUMBER), _re(guards.CLAIM_DATE)


@query("g6_grounding", f"WITH x AS (SELECT doc_id AS id, lower(doc_id || ' ' || source || ' ' || n_chars) AS s, list_concat(list_filter(regexp_extract_all(text, '{_CN}'), lambda z: length(z) > 1), regexp_extract_all(text, '{_CD}')) AS c, length(text) AS n FROM documents), y AS (SELECT id, n, len(c)::BIGINT AS n_claims, len(list_filter(c, lambda z: NOT contains(s, lower(z))))::BIGINT AS ungrounded FROM x) SELECT id, n_claims, ungrounded, ungrounded > 3 AS warned, CASE WHEN n < 10 THEN 'too-short' WHEN n > 5000 THEN 'too-long' END AS length FROM y")
def g6_grounding(spark, d):
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws(" ", "doc_id", "source", "n_chars").alias("sources"))
    return guards.grounding(x).join(x.select("id", guards.length_check(F.col("text"), 10, 5000).alias("length")), "id")


@query("g8_enforce", "WITH x AS (SELECT doc_id AS id, lower(text) AS q FROM documents), y AS (SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(q, 'sk-(?:live|test)-[a-z0-9]|\\b(?:api[_-]?key|authorization|bearer)\\b') THEN 'secret-signal-detected' END, CASE WHEN contains(q, 'license') THEN 'blocked-term:License' END, CASE WHEN contains(q, 'metric') OR contains(q, 'observability') OR contains(q, 'trace') OR contains(q, 'dashboard') OR contains(q, 'alert') OR contains(q, 'logs') THEN 'domain-scope-outside:observability' END], lambda z: z IS NOT NULL), ',') AS reasons FROM x) SELECT id, CASE WHEN reasons = '' THEN 'allow' ELSE 'block' END AS action, reasons FROM y")
def g8(spark, d):
    return guards.enforce(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), True, ["License", " "], ["security"])


@query("g4_fixed_windows", """WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS k, epoch(ts)::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS n FROM events),
w AS (SELECT id, k, n, s, s AS start, 1 AS c FROM e WHERE n = 1 UNION ALL SELECT e.id, e.k, e.n, e.s, CASE WHEN e.s - w.start >= 86400 THEN e.s ELSE w.start END, CASE WHEN e.s - w.start >= 86400 THEN 1 ELSE w.c + 1 END FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1)
SELECT id, c <= 2 AS allowed FROM w""")  # fmt: skip
def g4(spark, d):
    return guards.fixed_window_limits(t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), T.nearest_second(F.col("ts")).alias("second")), 2, 86_400)


@query("a20_audit", "WITH l AS (SELECT event_type = 'error' AS b, event_id % 3 = 0 AS m, event_type AS r FROM events) SELECT 'total' AS name, count(*) AS n FROM l UNION ALL SELECT 'blocked', count(*) FILTER (b) FROM l UNION ALL SELECT 'modified', count(*) FILTER (NOT b AND m) FROM l UNION ALL SELECT 'passed', count(*) FILTER (NOT b AND NOT m) FROM l UNION ALL SELECT 'rule:' || r, count(*) FROM l GROUP BY r")
def a20(spark, d):
    return guards.audit_stats(t(spark, d, "events").select((F.col("event_type") == "error").alias("blocked"), (F.col("event_id") % 3 == 0).alias("modified"), F.array("event_type").alias("rules")))


# ---- findings -----------------------------------------------------------------------------------

_SEV, _STAT = ["critical", "High", "medium", "low", "informational", ""], ["FAIL", "pass", "manual", "PASSED", ""]
_FINDING = f"""SELECT doc_id AS id, ([{_list(_SEV)}])[doc_id % 6 + 1] AS sev, ([{_list(_STAT)}])[doc_id % 5 + 1] AS st, doc_id % 120 AS num, doc_id % 4 AS shape, source, substr(text, 1, 60) AS head FROM documents"""
_HAY = "lower(" + COMPACT.format("text") + ")"
_RISK_HITS = ", ".join("(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + f") AS r{k}" for k, (_, _, words) in enumerate(findings.RISKS))


@query("g9_findings", f"""WITH f AS ({_FINDING}), s AS (SELECT *, lower(sev) AS ls, lower(st) AS lst FROM f), n AS (SELECT id, CASE WHEN shape < 3 THEN 'Check ' || id ELSE 'untitled' END AS title, CASE WHEN shape = 0 THEN 'iam-' || id ELSE '' END AS "check", CASE WHEN lst IN ('pass', 'passed') THEN 'pass' WHEN lst = 'fail' THEN 'fail' ELSE 'unknown' END AS status,
CASE WHEN ls = 'critical' THEN 1.0 WHEN ls = 'high' THEN 0.92 WHEN ls = 'medium' THEN 0.78 WHEN ls = 'low' THEN 0.62 WHEN ls = 'informational' THEN 0.45 WHEN num >= 80 THEN 0.9 WHEN num >= 50 THEN 0.76 WHEN num > 0 THEN 0.58 ELSE 0.5 END::DOUBLE AS severity FROM s) SELECT * FROM n WHERE status <> 'pass'""")  # fmt: skip
def g9(spark, d):
    i = F.col("doc_id")
    x = t(spark, d, "documents").select(i.alias("id"), i.alias("ord"), pick(i, _SEV).alias("sev"), pick(i, _STAT).alias("st"), (i % 120).alias("num"), F.concat(F.lit("Check "), i).alias("title"), F.concat(F.lit("IAM_"), i).alias("check"))
    value = lambda c: F.struct(F.col(c).alias("value"))
    one = F.to_json(F.struct(F.struct(F.col("title").alias("CheckTitle"), F.col("check").alias("CheckID"), value("sev").alias("Severity")).alias("metadata"), value("st").alias("status"), F.col("num").alias("severity_id")))
    two = F.to_json(F.struct(F.col("title").alias("Title"), F.struct(F.col("sev").alias("Label"), F.col("num").alias("Normalized")).alias("Severity"), F.struct(F.col("st").alias("Status")).alias("Compliance")))
    three = F.to_json(F.struct("title", F.col("sev").alias("severity"), F.col("st").alias("status"), F.col("num").alias("severity_id")))
    four = F.to_json(F.struct(F.col("sev").alias("severity_label"), F.col("st").alias("status"), F.col("num").alias("severity_id")))
    k = F.col("id") % 4
    return findings.normalised(x.select("id", "ord", F.when(k == 0, one).when(k == 1, two).when(k == 2, three).otherwise(four).alias("json")))


@query("g12_risk_ranks", f"""WITH x AS (SELECT doc_id AS id, {_HAY} AS low FROM documents), h AS (SELECT id, {_RISK_HITS} FROM x),
u AS ({" UNION ALL ".join(f"SELECT id, {k} AS place, '{n}' AS risk, r{k} AS hits, {findings.WEIGHT[s]}::DOUBLE AS w FROM h WHERE r{k} > 0" for k, (n, s, _) in enumerate(findings.RISKS))})
SELECT id, risk, hits, round(hits * w, 4) AS score, row_number() OVER (PARTITION BY id ORDER BY round(hits * w, 4) DESC, hits DESC, w DESC, place) AS rank FROM u""")  # fmt: skip
def g12(spark, d):
    return findings.risk_ranks(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_RISK_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{n}'" for n, _, words in findings.RISKS) + f" ELSE '{findings.OTHER_RISK}' END"
_CRIT = _list([n for n, s, _ in findings.RISKS if s == "critical"])
_UNITS = f"""WITH x AS (SELECT doc_id AS id, source, {_HAY} AS low, CASE WHEN doc_id % 5 > 0 THEN doc_id % 4 / 4 END AS p, CASE WHEN doc_id % 7 > 0 THEN doc_id % 10 / 10 END AS c, ([1.0, 0.92, 0.78, 0.62])[doc_id % 4 + 1] AS s FROM documents),
u AS (SELECT id, source, {_RISK_CASE} AS risk, round(least(1, 0.48 + coalesce(p * 0.28, 0.12) + coalesce(c * 0.2, 0.1) + s * 0.18)::DOUBLE, 6) AS confidence, s FROM x)"""


def _units(spark, d):
    i = F.col("doc_id")
    x = t(spark, d, "documents").select(i.alias("id"), "source", F.col("text").alias("content"), F.when(i % 5 > 0, i % 4 / 4).alias("priority"), F.when(i % 7 > 0, i % 10 / 10).alias("certainty"), F.element_at(F.array(*map(F.lit, (1.0, 0.92, 0.78, 0.62))), (i % 4 + 1).cast("int")).alias("severity"))
    return x, findings.learning_units(x)


@query("g10_units", f"{_UNITS} SELECT id, risk, confidence, risk IN ({_CRIT}) OR s >= 1 AS critical FROM u")
def g10(spark, d):
    return _units(spark, d)[1]


@query("g15_learning_loop", f"{_UNITS} SELECT risk, count(*) AS units, count(*) FILTER (confidence >= 0.72) AS accepted, round(avg(confidence), 4) AS mean_confidence FROM u GROUP BY risk")
def g15(spark, d):
    return findings.accepted(_units(spark, d)[1])


@query("a15_security_summary", f"{_UNITS} SELECT source AS project, array_to_string(list_sort(list_distinct(list(risk))), ',') AS risks, round(avg(confidence), 4) AS mean_confidence FROM u GROUP BY source")
def a15(spark, d):
    x, u = _units(spark, d)
    return findings.security_summary(u.join(x.select("id", F.col("source").alias("project")), "id"))


@query("a21_ci_metrics", "SELECT count(*) AS included, max(doc_id % 4 / 4) AS max_priority, max(doc_id % 4 / 4) >= 0.84 AS passed FROM documents")
def a21(spark, d):
    return findings.pipeline_metrics(t(spark, d, "documents").select((F.col("doc_id") % 4 / 4).alias("priority")), 3)


# ---- axioms, agents, rollbacks ------------------------------------------------------------------

_AXIOM = "SELECT doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN 'obsidian' ELSE 'api' END AS source, CASE WHEN doc_id % 3 = 0 THEN 'topic-' || doc_id % 20 ELSE '' END AS topic, substr(text, 1, 30) AS statement, doc_id % 9 AS priority, lang || ',' || source AS domains FROM documents"
_PLAIN = "lower(trim(regexp_replace(regexp_replace(strip_accents({0}), '[()`,.:;!?¿¡\"''*_-]', ' ', 'g'), '\\s+', ' ', 'g')))"


@query("h16_axioms", f"WITH a AS ({_AXIOM}), k AS (SELECT *, CASE WHEN topic <> '' THEN topic ELSE {_PLAIN.format('statement')} END AS key FROM a), g AS (SELECT key, array_to_string(list_sort(list_distinct(flatten(list(string_split(domains, ','))))), ',') AS domains FROM k GROUP BY key) SELECT key, statement, source, priority, domains FROM (SELECT * EXCLUDE domains FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY source <> 'obsidian', priority, ord) = 1) JOIN g USING (key)")
def h16(spark, d):
    i = F.col("doc_id")
    x = t(spark, d, "documents").select(i.alias("ord"), F.when(i % 5 == 0, "obsidian").otherwise("api").alias("source"), F.when(i % 3 == 0, F.concat(F.lit("topic-"), i % 20)).otherwise("").alias("topic"), F.substring("text", 1, 30).alias("statement"), (i % 9).alias("priority"), F.array("lang", "source").alias("domains"))
    return axioms.merged(x)


@query("h15_save_axioms", "WITH x AS (SELECT doc_id, substr(text, 1, 40) AS title, text AS body, substr(sha256(substr(text, 1, 40) || chr(31) || text), 1, 12) AS id FROM documents) SELECT DISTINCT id FROM x WHERE doc_id % 2 = 1 AND id NOT IN (SELECT id FROM x WHERE doc_id % 2 = 0)")
def h15(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"))
    return axioms.saved(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 2 = 1")).select("id")


_AX = ["*", "en", "de", ""]


@query("r25_axiom_query", f"""WITH x AS (SELECT doc_id AS id, ([{_list(_AX)}])[doc_id % 4 + 1] AS l, ([ 'src/', '*', 'docs/' ])[doc_id % 3 + 1] AS p, ([ 'react', '*' ])[doc_id % 2 + 1] AS f, lower(text) AS body FROM documents WHERE doc_id % 4 = 0 OR DATE '2024-01-01' + (doc_id % 200)::INT > DATE '{AS_OF}'),
s AS (SELECT id, round((CASE WHEN l IN ('', '*') THEN 0.5 WHEN l = 'en' THEN 1 ELSE 0 END + CASE WHEN p = '*' THEN 0.5 WHEN p = 'src/' THEN 1 ELSE 0 END + CASE WHEN f = '*' THEN 0.5 WHEN f = 'react' THEN 1 ELSE 0 END + (contains(body, 'house')::INT + contains(body, 'river')::INT) / 2) / 4, 6) AS score FROM x)
SELECT id, score FROM s WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 5""")  # fmt: skip
def r25(spark, d):
    i = F.col("doc_id")
    expires = F.when(i % 4 != 0, F.date_add(F.to_date(F.lit("2024-01-01")), (i % 200).cast("int")).cast("timestamp"))
    x = t(spark, d, "documents").select(i.alias("id"), i.alias("ord"), F.lit("rule").alias("type"), pick(i, _AX).alias("language"), pick(i, ["src/", "*", "docs/"]).alias("path"), pick(i, ["react", "*"]).alias("framework"), F.lit("").alias("title"), F.col("text").alias("body"), expires.alias("expires"))
    return axioms.query(x, {"language": "en", "path": "src/auth", "framework": "react", "terms": ["House", "river"], "types": ["rule"]}, AS_OF)


_AGENTS = [(1, "a1", "en", "react"), (2, "a2", "de", "react"), (3, "a3", "en", "vue"), (4, "a4", "es", None)]


@query("r27_agent_routing", f"WITH a AS (SELECT * FROM (VALUES {', '.join(str(a).replace('None', 'NULL') for a in _AGENTS)}) v(ord, agent, l, f)), r AS (SELECT doc_id AS id, lang AS language, ([ 'react', 'vue', 'none' ])[doc_id % 3 + 1] AS framework FROM documents), s AS (SELECT id, agent, ord, CASE WHEN language = l THEN 2 ELSE 0 END + CASE WHEN framework = f THEN 3 ELSE 0 END AS score FROM r, a) SELECT id, agent, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1")
def r27(spark, d):
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), pick(F.col("doc_id"), ["react", "vue", "none"]).alias("framework"))
    return axioms.routed(x, spark.createDataFrame(_AGENTS, "ord int, agent string, language string, framework string"))


@query("w9_rollback", "WITH v AS (SELECT user_id AS key, event_id AS version, least(1, greatest(0, value / 60)) AS score FROM events), n AS (SELECT key, max(version) AS newest FROM v GROUP BY key), e AS (SELECT key, version, score FROM v JOIN n USING (key) WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY key ORDER BY version < newest DESC, score DESC, version DESC) = 1) SELECT key, version, score, CASE WHEN version IS NULL THEN 'no-candidate' ELSE 'rollback-ready' END AS status FROM n LEFT JOIN e USING (key)")
def w9(spark, d):
    return axioms.rollback_plan(t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), (F.col("value") / 60).alias("score")))


_SKILLS = ["river house", "green hill town", "license terms", "the"]


@query("h21_skill_conflicts", f"""WITH n AS (SELECT item_id AS id, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 3), ' ') AS name FROM benchmark), c AS (SELECT item_id AS cid, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 2 + (item_id % 3)::INT), ' ') AS name FROM benchmark WHERE item_id % 4 = 0),
x AS (SELECT id, cid, {_SLUG.format("n.name")} AS s1, {_SLUG.format("c.name")} AS s2, list_distinct({tok("rag", "n.name")}) AS w1, list_distinct({tok("rag", "c.name")}) AS w2 FROM n, c),
y AS (SELECT id, cid, CASE WHEN s1 = '' OR s2 = '' THEN 0 WHEN s1 = s2 THEN 1 WHEN (contains(s1, s2) OR contains(s2, s1)) AND least(length(s1), length(s2)) >= 8 THEN 0.9 ELSE round(coalesce(len(list_intersect(w1, w2)) / nullif(len(list_distinct(list_concat(w1, w2))), 0), 0), 4) END::DOUBLE AS score FROM x) SELECT * FROM y WHERE score >= 0.72""")  # fmt: skip
def h21(spark, d):
    b = t(spark, d, "benchmark")
    words = lambda n: F.array_join(F.slice(F.split("text", "\\s+"), F.lit(1), n), " ")
    return axioms.ranked_similar(b.select(F.col("item_id").alias("id"), words(F.lit(3)).alias("name")), b.filter("item_id % 4 = 0").select(F.col("item_id").alias("cid"), words((F.col("item_id") % 3 + 2).cast("int")).alias("name")))


# ---- hygiene, memory ----------------------------------------------------------------------------


@query("h1_near_duplicates")
def h1_near(spark, d):
    return hygiene.near_duplicates(chunks(spark, d))


@query("h9_doctor", f"{_EVAL} SELECT id, quarantine, health FROM r ORDER BY quarantine DESC, health, id LIMIT 20")
def h9(spark, d):
    return hygiene.doctor(hygiene.evaluate(memories(spark, d), AS_OF))


@query("h10_prune", f"{_EVAL} SELECT id, CASE WHEN quarantine THEN 'quarantined' ELSE 'kept' END AS place FROM r")
def h10(spark, d):
    m = memories(spark, d)
    kept, bad = hygiene.pruned(m, hygiene.evaluate(m, AS_OF))
    return kept.select("id", F.lit("kept").alias("place")).union(bad.select("id", F.lit("quarantined")))


@query("h8_h20_write_gate", f"""{_EVAL.replace("count(*) OVER (PARTITION BY fp)", "1").replace("count(*) OVER (PARTITION BY topic)", "1")} SELECT id, CASE WHEN quarantine THEN 'quarantine' ELSE 'accept' END AS action, reasons FROM r""")
def h8(spark, d):
    return hygiene.write_gate(memories(spark, d), AS_OF)


@query("h13_recent", f"SELECT id, project FROM ({MEMORIES}) WHERE id % 6 <> 2 QUALIFY row_number() OVER (PARTITION BY project ORDER BY ord) <= 5")
def h13(spark, d):
    m = memories(spark, d)
    return hygiene.recent(hygiene.deleted(m, m.filter("id % 6 = 2"))).select("id", "project")


@query("h11_superseded", f"SELECT id, topic FROM ({MEMORIES}) WHERE type IN ('learning', 'bugfix') QUALIFY count(*) OVER (PARTITION BY topic) >= 2")
def h11_ids(spark, d):
    return hygiene.superseded(memories(spark, d))


@query("r20_gates", f"SELECT id FROM (SELECT *, lang AS language FROM ({MEMORIES}) JOIN documents ON id = doc_id) WHERE project = (SELECT min(source) FROM documents) AND type IN ('decision', 'bugfix') AND (language = 'en' OR language IS NULL)")
def r20(spark, d):
    m = memories(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language")), "id")
    first = t(spark, d, "documents").agg(F.min("source")).first()[0]
    return memory.gate(m, first, ["decision", "bugfix"], language="en").select("id")


@query("r26_search_all", f"""WITH m AS ({MEMORIES}), tk AS (SELECT id, project, {tok("search", "title || ' ' || content")} AS t FROM m WHERE project IS NOT NULL), n AS (SELECT project, count(*) AS n FROM tk GROUP BY project),
p AS (SELECT id, project, dl, term, count(*) AS tf FROM (SELECT id, project, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL), d AS (SELECT project, term, count(*) AS df FROM p GROUP BY ALL), qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT item_id AS qid, unnest({tok("search", "text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, project, id, round(sum(qn * tf / dl * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM p JOIN d USING (project, term) JOIN qt USING (term) JOIN n USING (project) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, project ORDER BY score DESC, id) AS r FROM s WHERE score > 0 QUALIFY r <= 10) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY project, r) AS rank FROM r QUALIFY rank <= 10""")  # fmt: skip
def r26(spark, d):
    return memory.search_all(memories(spark, d), asked(spark, d))


@query("r28_pipeline_recall", f"WITH {_bm25_ctes(10).replace('FROM documents)', 'FROM documents WHERE source = (SELECT min(source) FROM documents))', 1)} SELECT qid, id, score, rank FROM b WHERE rank <= 5")
def r28(spark, d):
    first = t(spark, d, "documents").agg(F.min("source")).first()[0]
    return retrieval.bm25(chunks(spark, d).filter(F.col("source") == first), asked(spark, d), 5)


# ---- selection ----------------------------------------------------------------------------------

_CHANGED = ["src/auth/login.ts", "lib/net/http_client.js"]


@query("s8_origins", "WITH x AS (SELECT doc_id AS id, ([ 'code', 'chat', 'memory' ])[doc_id % 3 + 1] AS kind, ([ 'src/a', 'engram://x', 'CHAT://y', 'memory://z' ])[doc_id % 4 + 1] AS s FROM documents) SELECT id, CASE WHEN kind = 'chat' OR s = 'CHAT://y' THEN 'chat' WHEN s IN ('engram://x', 'memory://z') THEN 'memory' ELSE 'workspace' END AS origin FROM x")
def s8(spark, d):
    i = F.col("doc_id")
    return t(spark, d, "documents").select(i.alias("id"), selection.origin(pick(i, ["code", "chat", "memory"]), pick(i, ["src/a", "engram://x", "CHAT://y", "memory://z"])).alias("origin"))


def _over_files(one: str) -> str:
    return f"list_max([{', '.join(one.replace('$C', repr(c)) for c in _CHANGED)}])"


_SHARE = f"CASE WHEN len(list_distinct({_TERMS.format('$C')})) > 0 THEN len(list_intersect(list_distinct({_TERMS.format('$C')}), {_TERMS.format('s')})) / len(list_distinct({_TERMS.format('$C')})) ELSE 0 END"
_AFF = _over_files(f"CASE WHEN s = lower($C) THEN 1.0 WHEN {_STEM.format('s')} = {_STEM.format('$C')} THEN 0.93 WHEN ({_FOLDER.format('s')}) <> '' AND ({_FOLDER.format('s')}) = ({_FOLDER.format('$C')}) THEN greatest(0.76, 0.82 * {_SHARE}) ELSE 0.82 * {_SHARE} END")
_ANC = _over_files(f"CASE WHEN s = lower($C) THEN 1.0 WHEN {_STEM.format('s')} = {_STEM.format('$C')} THEN 0.86 ELSE 0 END")
_TST = f"CASE WHEN regexp_matches(s, '(\\.test\\.|\\.spec\\.|^test/)') THEN " + _over_files(f"CASE WHEN ends_with({_STEM.format('s')}, string_split({_STEM.format('$C')}, '/')[-1]) THEN 1.0 ELSE greatest(CASE WHEN contains({_STEM.format('s')}, {_STEM.format('$C')}) THEN 0.95 ELSE 0 END, CASE WHEN contains(s, regexp_replace(lower($C), '^src/', '')) THEN 0.88 ELSE 0 END, 0.9 * {_SHARE}) END") + " ELSE 0 END"


@query("s3_s4_file_terms", f"""WITH x AS (SELECT doc_id AS id, lower({_PATH}) AS s, ([ 'code', 'test', 'spec', 'memory', 'doc', 'chat', 'log' ])[doc_id % 7 + 1] AS kind, lower(text) AS low FROM documents), y AS (SELECT *, least(1, {_AFF}) AS a, {_ANC} AS n, least(1, {_TST}) AS r FROM x),
z AS (SELECT *, least(1, CASE kind WHEN 'code' THEN 0.3 + a * 0.7 WHEN 'test' THEN 0.36 + a * 0.42 + r * 0.28 WHEN 'spec' THEN 0.12 + a * 0.5 WHEN 'memory' THEN 0.08 + a * 0.38 WHEN 'doc' THEN 0.05 + a * 0.28 ELSE a * 0.2 END) AS fit,
 CASE WHEN a >= 0.9 THEN 0 WHEN s = 'readme.md' THEN 0.92 WHEN s = 'agents.md' THEN 0.56 WHEN s = 'package.json' THEN 0.26 WHEN s LIKE 'docs/%' THEN 0.24 ELSE 0 END AS sp,
 CASE WHEN kind = 'test' AND (contains(s, 'run-tests') OR contains(s, 'test/index') OR contains(s, 'test/setup') OR contains(low, 'whole repository') OR contains(low, 'portable checks') OR contains(low, 'across the repository')) AND r < 0.45 THEN 0.85 ELSE 0 END AS rn,
 CASE WHEN kind = 'memory' AND (contains(low, 'session close summary') OR contains(low, 'closed at') OR contains(low, ' learned ') OR contains(low, ' next ')) THEN 0.34 ELSE 0 END AS nr, CASE kind WHEN 'code' THEN 0.16 WHEN 'test' THEN 0.09 ELSE 0.12 END AS w FROM y)
SELECT id, round(a::DOUBLE, 6) AS affinity, round(n::DOUBLE, 6) AS anchor, round(r::DOUBLE, 6) AS test, round(fit::DOUBLE, 6) AS fit, round(sp::DOUBLE, 6) AS source_penalty, round(rn::DOUBLE, 6) AS runner, round(nr::DOUBLE, 6) AS narrative, round((0.12 * a + 0.14 * fit + 0.05 * r + 1.05 * w * n - 0.2 * sp - 0.18 * nr - 0.34 * rn)::DOUBLE, 6) AS total FROM z""")  # fmt: skip
def s3(spark, d):
    i = F.col("doc_id")
    x = t(spark, d, "documents").select(i.alias("id"), _path().alias("source"), pick(i, ["code", "test", "spec", "memory", "doc", "chat", "log"]).alias("kind"), F.col("text").alias("content"))
    return selection.file_terms(x, _CHANGED)


@query("s15_reasons")
def s15(spark, d):
    return observe.by_reason(selection.select_context(_requests(spark, d), asked(spark, d)))


@query("s17_shadow")
def s17(spark, d):
    chosen = selection.select_context(_requests(spark, d), asked(spark, d))
    return selection.shadow(chosen, chosen.select("qid", "score"))


@query("s9_coverage")
def s9(spark, d):
    r = _requests(spark, d)
    return selection.covered(selection.select_context(r, asked(spark, d)).join(r.select("qid", "id", "kind"), ["qid", "id"]), ["test", "spec"])


# ---- observation --------------------------------------------------------------------------------


@query("a3_report", f"WITH e AS (SELECT *, id % 4 = 0 AS rc FROM ({EVENTS})) SELECT count(*) AS runs, count(*) FILTER (failed) AS degraded, count(*) FILTER (command = 'click') AS blocked, sum(id % 3)::BIGINT AS prevented, round(count(*) FILTER (failed) / count(*), 3) AS degraded_rate, round(count(*) FILTER (command = 'click') / count(*), 3) AS blocked_rate, round(sum(duration) / count(*), 3) AS mean_duration, count(*) FILTER (rc) AS recalls, round(count(*) FILTER (rc AND id % 8 = 0) / count(*) FILTER (rc), 3) AS hit_rate, round(sum(id % 7) / count(*), 3) AS mean_selected, round(sum(id % 20) / count(*), 3) AS mean_suppressed FROM e")
def a3(spark, d):
    i = F.col("id")
    return observe.report(events(spark, d).select("duration", F.col("failed").alias("degraded"), (F.col("command") == "click").alias("blocked"), (i % 3).alias("prevented"), (i % 4 == 0).alias("recalled"), (i % 8 == 0).alias("hit"), (i % 7).alias("selected"), (i % 20).alias("suppressed")))


@query("a5_agent_traces", "WITH e AS (SELECT 'agent-' || user_id % 9 AS agent, event_type AS phase, value, event_type = 'error' AS f FROM events) SELECT 'agent' AS of, agent AS name, count(*) AS runs, round(sum(value), 3) AS total, count(*) FILTER (f) AS failures FROM e GROUP BY agent UNION ALL SELECT 'phase', phase, count(*), round(sum(value), 3), count(*) FILTER (f) FROM e GROUP BY phase")
def a5(spark, d):
    return observe.agent_traces(t(spark, d, "events").select(F.concat(F.lit("agent-"), F.col("user_id") % 9).alias("agent"), F.col("event_type").alias("phase"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed")))


@query("a17_improvement", "WITH g AS (SELECT event_type AS skill, count(*) AS n, avg(value) AS b, avg(event_id % 50) AS a FROM events GROUP BY event_type) SELECT skill, n, round(b, 4) AS before, round(a, 4) AS after, round(coalesce((b - a) / nullif(b, 0), 0) * 100, 1) AS improvement FROM g")
def a17(spark, d):
    return observe.improvement(t(spark, d, "events").select(F.col("event_type").alias("skill"), F.col("value").alias("before"), (F.col("event_id") % 50).alias("after")))


@query("a19_main_language", f"WITH f AS (SELECT source AS key, CASE lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' END AS language FROM documents), c AS (SELECT key, language, count(*) AS n FROM f WHERE language IS NOT NULL GROUP BY ALL) SELECT key, language, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, language) = 1")
def a19(spark, d):
    return observe.main_language(t(spark, d, "documents").select(F.col("source").alias("key"), _path().alias("path")), {"ts": "typescript", "js": "javascript", "md": "markdown"})


@query("w5_drift_summary", f"""WITH y AS (SELECT ts::DATE AS at_day, command AS kind, count(*) AS total FROM ({EVENTS}) GROUP BY ALL), b AS (SELECT *, coalesce(avg(total) OVER (PARTITION BY kind ORDER BY at_day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) AS base FROM y),
r AS (SELECT *, base > 0 AND total >= 2 * base AND total - base >= 3 AS spike, round(CASE WHEN base > 0 THEN abs(total - base) / base ELSE 0 END, 4) AS ratio FROM b), l AS (SELECT *, CASE WHEN ratio >= 0.45 THEN 'critical' WHEN ratio >= 0.2 OR spike THEN 'warning' ELSE 'stable' END AS level FROM r)
SELECT kind, count(*) AS samples, round(avg(total), 3) AS mean_total, round(avg(ratio), 4) AS mean_ratio, count(*) FILTER (level = 'stable') AS stable, count(*) FILTER (level = 'warning') AS warning, count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (spike) AS spikes, arg_max(level, at_day) AS last_level FROM l GROUP BY kind""")  # fmt: skip
def w5(spark, d):
    daily = events(spark, d).groupBy(F.to_date("ts").alias("at"), F.col("command").alias("kind")).agg(F.count("*").alias("total"))
    return observe.drift_summary(observe.drift(daily))


@query("c7_expired_sessions", "SELECT user_id AS conv, max(ts) AS last, epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) > 6 * 3600 AS expired FROM events GROUP BY user_id")
def c7(spark, d):
    return observe.expired_sessions(t(spark, d, "events").select(F.col("user_id").alias("conv"), F.col("ts").alias("at")), "2024-01-31")


@query("i15_session_history", "SELECT conv_id AS conv, turn, CASE WHEN length(text) > 400 THEN 'blob:' || substr(sha256(text), 1, 16) ELSE text END AS text, length(text) > 400 AS spilled FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def i15(spark, d):
    return observe.session_history(turns(spark, d).select("conv", "turn", "text"))


# ---- parsing ------------------------------------------------------------------------------------

_WORD = "(?:^|[^a-z0-9_])(?:{0})(?:$|[^a-z0-9_])"
_TAG = lambda tags: "CASE " + " ".join(f"WHEN regexp_matches(x, '{_WORD.format(w)}') THEN '{k}'" for k, w in tags.items()) + " ELSE 'general' END"


@query("p6_rule_tags", f"WITH c AS (SELECT id, kind, lower(source || chr(10) || content) AS x FROM ({CHUNKS})), g AS (SELECT id, kind, {_TAG(parsing.TAG_TOPICS)} AS topic, {_TAG(parsing.TAG_DOMAINS)} AS \"domain\" FROM c) SELECT id, topic, \"domain\", CASE WHEN kind IN ('code', 'test', 'spec', 'log', 'chat') THEN kind ELSE 'doc' END AS type, round(least(0.95, 0.45 + CASE WHEN topic <> 'general' THEN 0.2 ELSE 0 END + CASE WHEN \"domain\" <> 'general' THEN 0.2 ELSE 0 END + CASE WHEN kind IN ('code', 'test', 'spec') THEN 0.1 ELSE 0 END)::DOUBLE, 2) AS confidence FROM g")
def p6(spark, d):
    return parsing.rule_tags(chunks(spark, d))


@query("p1_p3_sections")
def p1(spark, d):
    i = F.col("doc_id")
    body = F.concat(F.lit("intro\n# Title "), i, F.lit("\n"), F.col("text"), F.lit("\n```\n# not a heading\n```\n## Part\nend"))
    return parsing.sections(t(spark, d, "documents").select(i.alias("id"), body.alias("content")))


@query("p4_smart_chunks")
def p4_smart(spark, d):
    return parsing.smart_chunks(chunks(spark, d))


@query("p2_front_matter", "SELECT doc_id AS id, source, lang, doc_id::VARCHAR AS n FROM documents")
def p2(spark, d):
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), parsing.front_matter(F.concat(F.lit("---\nsource: "), "source", F.lit("\nlang:  "), "lang", F.lit("\nbad line\nn: "), "doc_id", F.lit("\n---\nx: y\n"), "text")).alias("m"))
    return x.select("id", F.col("m.source").alias("source"), F.col("m.lang").alias("lang"), F.col("m.n").alias("n"))


# ---- evaluation gates ---------------------------------------------------------------------------


@query("e7_golden_set", "WITH g AS (SELECT count(*) AS cases, count(DISTINCT source) AS domains, count(DISTINCT lang) AS projects, count(DISTINCT lower(trim(regexp_replace(substr(text, 1, 80), '\\s+', ' ', 'g')))) AS u, round(avg(doc_id % 4), 4) AS mean_docs, max(doc_id % 4) AS max_docs FROM documents) SELECT cases, domains, projects, round(u / cases, 4) AS unique_rate, mean_docs, max_docs, cases >= 200 AND domains >= 3 AND projects >= 3 AND u / cases >= 0.8 AND max_docs <= 3 AS passed FROM g")
def e7(spark, d):
    x = t(spark, d, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("project"), F.substring("text", 1, 80).alias("query"), (F.col("doc_id") % 4).alias("n_docs"))
    return evals.golden_set(x, least_domains=3, least_projects=3, least_unique=0.8)


@query("e8_poisoning", "WITH x AS (SELECT toxic = 1 AS p, quality = 1 AS a, doc_id % 9 = 0 AS l FROM labels), g AS (SELECT coalesce(count(*) FILTER (p AND NOT a) / nullif(count(*) FILTER (p), 0), 1) AS q, coalesce(count(*) FILTER (p AND a) / nullif(count(*) FILTER (p), 0), 0) AS l, coalesce(count(*) FILTER (NOT p AND a) / nullif(count(*) FILTER (NOT p), 0), 1) AS c, coalesce(count(*) FILTER (NOT p AND NOT a) / nullif(count(*) FILTER (NOT p), 0), 0) AS f, count(*) FILTER (p AND l) AS leak_hits FROM x) SELECT round(q, 4) AS quarantine_rate, round(l, 4) AS leak_rate, round(c, 4) AS clean_rate, round(f, 4) AS false_positive_rate, leak_hits, q >= 1 AND l <= 0 AND c >= 0.95 AND f <= 0.05 AND leak_hits <= 0 AS passed FROM g")
def e8(spark, d):
    return evals.poisoning(t(spark, d, "labels").select((F.col("toxic") == 1).alias("poisoned"), (F.col("quality") == 1).alias("accepted"), (F.col("doc_id") % 9 == 0).alias("leaked")))


@query("e9_noise_gate", "WITH x AS (SELECT conv_id AS id, sum(length(text)) AS b, sum(CASE WHEN turn >= 2 THEN length(text) ELSE 0 END) AS n, 1.0 AS ba, (conv_id % 5) / 4 AS na, (conv_id % 3) / 2 AS r FROM conversations GROUP BY conv_id) SELECT id, round(CASE WHEN b > 0 THEN (b - n) / b ELSE 0 END, 4) AS reduction, round(ba - na, 4) AS anchor_drop, (CASE WHEN b > 0 THEN (b - n) / b ELSE 0 END) >= 0.25 AND na >= 0.9 AND ba - na <= 0.05 AND r >= 0.6 AS passed FROM x")
def e9(spark, d):
    g = turns(spark, d).groupBy(F.col("conv").alias("id")).agg(F.sum(F.length("text")).alias("base_tokens"), F.sum(F.when(F.col("turn") >= 2, F.length("text")).otherwise(0)).alias("new_tokens"))
    return evals.noise_gate(g.select("*", F.lit(1.0).alias("base_anchor"), (F.col("id") % 5 / 4).alias("new_anchor"), (F.col("id") % 3 / 2).alias("redundancy")))


_ANS = "'Change: ' || substr(text, 1, 20) || chr(10) || CASE WHEN {0} % 2 = 0 THEN '## Reason : x' ELSE 'none' END || chr(10) || CASE WHEN {0} % 3 = 0 THEN 'Conceptos: y' ELSE '' END || chr(10) || CASE WHEN {0} % 5 = 0 THEN 'pr' || 'áctica: z' ELSE '' END"


@query("e5_format", "WITH x AS (SELECT doc_id AS id, doc_id AS a, doc_id + 1 AS b FROM documents) SELECT id, round((1 + (a % 2 = 0)::INT + (a % 3 = 0)::INT + (a % 5 = 0)::INT) / 4, 4) AS baseline, round((1 + (b % 2 = 0)::INT + (b % 3 = 0)::INT + (b % 5 = 0)::INT) / 4, 4) AS candidate, round((1 + (b % 2 = 0)::INT + (b % 3 = 0)::INT + (b % 5 = 0)::INT) / 4 - (1 + (a % 2 = 0)::INT + (a % 3 = 0)::INT + (a % 5 = 0)::INT) / 4, 4) AS lift FROM x")
def e5(spark, d):
    i = F.col("doc_id")
    answer = lambda k: F.concat(F.lit("Change: "), F.substring(F.regexp_replace("text", "[\n:]", " "), 1, 20), F.when(k % 2 == 0, "\n## Reason : x").otherwise("\nnone"), F.when(k % 3 == 0, "\nConceptos: y").otherwise("\n"), F.when(k % 5 == 0, "\npráctica: z").otherwise("\n"))
    return evals.format_coverage(t(spark, d, "documents").select(i.alias("id"), answer(i).alias("baseline"), answer(i + 1).alias("candidate")))


@query("e6_readiness", "WITH g AS (SELECT count(*) AS samples, count(DISTINCT lower(trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')))) AS u, count(*) FILTER (regexp_matches(text, '(?i)(?:password|secret|token|api_?key)\\s*[:=]')) AS s, count(DISTINCT lang) AS intents, count(DISTINCT source) AS risks, count(*) FILTER (trim(text, ' ') = '') AS blank FROM documents) SELECT samples, round(1 - u / samples, 4) AS duplicate_rate, round(s / samples, 4) AS secret_rate, intents, risks, samples >= 50 AND 1 - u / samples <= 0.1 AND s = 0 AND blank = 0 AS ready FROM g")
def e6(spark, d):
    return evals.readiness(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("intent"), F.col("source").alias("risk"), F.substring("text", 1, 60).alias("input"), F.col("text").alias("output")))


@query("e17_recall", "WITH x AS (SELECT event_type = 'view' AS ok, event_id % 4 AS got, event_id % 5 AS want FROM events) SELECT count(*) AS n, round(avg(ok::INT), 4) AS status_accuracy, round(avg(least(1, coalesce(got / nullif(want, 0), 1))), 4) AS mean_recovered, round(avg((got = want)::INT), 4) AS exact_rate FROM x")
def e17(spark, d):
    return evals.recall_metrics(t(spark, d, "events").select(F.col("event_type").alias("status"), F.lit("view").alias("expected_status"), (F.col("event_id") % 4).alias("recovered"), (F.col("event_id") % 5).alias("expected")))


@query("e16_tuning", "WITH g AS (SELECT event_type AS profile, round(avg((value > 20)::INT), 4) AS pass_rate, round(avg(value), 4) AS mean_score FROM events GROUP BY event_type) SELECT *, row_number() OVER (ORDER BY pass_rate DESC, mean_score DESC, profile) AS rank FROM g")
def e16(spark, d):
    return evals.tuned(t(spark, d, "events").select(F.col("event_type").alias("profile"), F.col("event_id").alias("case"), (F.col("value") > 20).alias("passed"), F.col("value").alias("score")))


@query("e13_north_star", "WITH g AS (SELECT user_id AS id, avg(event_id % 90) AS s, avg((event_type = 'error')::INT) AS b, avg(value) AS m FROM events GROUP BY user_id), f AS (SELECT id, array_to_string(list_filter([CASE WHEN s < 40 THEN 'savings' END, CASE WHEN b > 0.05 THEN 'blocked-rate' END, CASE WHEN m > 30 THEN 'duration' END], lambda x: x IS NOT NULL), ',') AS failing FROM g) SELECT id, failing, failing = '' AS passed FROM f")
def e13(spark, d):
    g = t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg(F.col("event_id") % 90).alias("savings"), F.avg((F.col("event_type") == "error").cast("int")).alias("blocked_rate"), F.avg("value").alias("mean_duration"))
    return evals.north_star(g, most_ms=30.0)




# ---- upkeep -------------------------------------------------------------------------------------

_BY = "CASE event_id % 4 WHEN 1 THEN 'rate-limit' WHEN 2 THEN 'keyword-block' END"


@query("g16_compliance", f"""WITH e AS (SELECT event_id AS id, event_id % 3 AS n, {_BY} AS b, CASE WHEN event_type = 'error' THEN [3] WHEN event_type = 'click' THEN [0, 1] WHEN event_type = 'view' THEN [2] ELSE [] END AS a FROM events),
v AS (SELECT id, list_concat(CASE WHEN n = 0 AND b IS NULL THEN ['1input-guard-bypass'] WHEN b = 'rate-limit' THEN ['0rate-limit-triggered'] WHEN b IS NOT NULL THEN ['1input-blocked-' || b] ELSE [] END, list_transform(a, lambda k: ([ '0pii-redacted', '1output-warn-length-check', '2output-blocked-length-check', '3secret-leak-detected' ])[k + 1])) AS v FROM e),
r AS (SELECT id, v, list_max(list_transform(v, lambda x: x[1]::INT)) AS m FROM v) SELECT id, array_to_string(list_transform(v, lambda x: x[2:]), ',') AS violations, coalesce(([ 'low', 'medium', 'high', 'critical' ])[m + 1], 'none') AS risk, coalesce(m, 0) = 0 AS compliant FROM r""")  # fmt: skip
def g16(spark, d):
    kind = lambda a, b: F.struct(F.lit(a).alias("type"), F.lit(b).alias("rule"))
    e, i = F.col("event_type"), F.col("event_id")
    actions = F.when(e == "error", F.array(kind("block", "secret-leak"))).when(e == "click", F.array(kind("redact", "pii-redaction"), kind("warn", "length-check"))).when(e == "view", F.array(kind("block", "length-check")))
    return upkeep.compliance(t(spark, d, "events").select(i.alias("id"), (i % 3).alias("n_rules"), F.when(i % 4 == 1, "rate-limit").when(i % 4 == 2, "keyword-block").alias("blocked_by"), actions.alias("actions")))


@query("m1_teaching", "WITH x AS (SELECT doc_id AS id, [CASE WHEN doc_id % 2 > 0 THEN 'change' END, CASE WHEN doc_id % 3 > 0 THEN 'reason' END, CASE WHEN doc_id % 5 > 0 THEN 'concepts' END, CASE WHEN doc_id % 7 > 0 THEN 'practice' END] AS m FROM documents), y AS (SELECT id, list_filter(m, lambda z: z IS NOT NULL) AS m FROM x) SELECT id, len(m) = 0 AS valid, array_to_string(m, ',') AS missing, (4 - len(m)) / 4 AS score FROM y")
def m1(spark, d):
    i = F.col("doc_id")
    said = F.concat_ws("\n", F.when(i % 2 == 0, "## Change x"), F.when(i % 3 == 0, "so **REASON** is"), F.when(i % 5 == 0, "3) Concepts"), F.when(i % 7 == 0, "practice : do"), F.lit("the end"))
    return t(spark, d, "documents").select(i.alias("id"), upkeep.teaching(said).alias("r")).select("id", "r.valid", "r.missing", "r.score")


@query("r24_failures", "SELECT event_id AS id, ([ 'timeout', 'binary-missing', 'malformed-output', 'unknown' ])[event_id % 4 + 1] AS kind FROM events")
def r24(spark, d):
    said = pick(F.col("event_id"), ["Request timed out, parse skipped", "spawn ENOENT timeout", "Unexpected token <", "boom"])
    return t(spark, d, "events").select(F.col("event_id").alias("id"), upkeep.failure_kind(said).alias("kind"))


@query("m6_highlights", f"SELECT doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN array_to_string(list_slice(['first bullet ' || doc_id, 'second bullet here', 'third bullet here'], 1, 1 + (doc_id % 3)::INT), '|') ELSE substr({COMPACT.format('text')}, 1, 220) END AS h FROM documents")
def m6(spark, d):
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, F.regexp_replace("text", "(?m)^\\s*[-*]", "")).otherwise(F.concat(F.lit("intro\n- first   bullet "), i, F.lit("\n* short\n  - second bullet here\n"), F.when(i % 3 == 2, "- third bullet here\n").otherwise("")))
    return t(spark, d, "documents").select(i.alias("id"), F.array_join(upkeep.highlights(body), "|").alias("h"))


@query("m10_fingerprints", "WITH e AS (SELECT user_id % 40 AS run, string_agg(event_type || ':' || (event_id % 2) || ':' || substr('message of ' || event_type, 1, 60), '|' ORDER BY event_type || ':' || (event_id % 2) || ':' || substr('message of ' || event_type, 1, 60)) AS f FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT run, md5(f) AS fingerprint, count(*) OVER (PARTITION BY f) AS runs FROM e")
def m10(spark, d):
    e = t(spark, d, "events").filter("event_type = 'error'")
    return upkeep.error_fingerprints(e.select((F.col("user_id") % 40).alias("run"), F.col("event_type").alias("tool"), (F.col("event_id") % 2).cast("string").alias("code"), F.concat(F.lit("message of "), "event_type").alias("message")))


@query("m11_lint_errors", "SELECT doc_id AS id, 'src/a' || doc_id || '.ts' AS path, (doc_id % 90)::INT AS line, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, 'TS' || doc_id AS code, 'no ' || lang AS message FROM documents UNION ALL SELECT doc_id, 'b.ts', 3, 'error', 'TS1', 'two' FROM documents")
def m11(spark, d):
    i = F.col("doc_id")
    log = F.concat(F.lit("start\nsrc/a"), i, F.lit(".ts("), i % 90, F.lit(",7): "), F.when(i % 2 == 0, "error").otherwise("warning"), F.lit(" TS"), i, F.lit(": no "), "lang", F.lit("\nnoise (1,2)\nb.ts(3,1): error TS1: two\n"))
    return upkeep.lint_errors(t(spark, d, "documents").select(i.alias("id"), log.alias("text")))


@query("m9_coverage_gate", "WITH x AS (SELECT doc_id AS id, list_slice(['test', 'spec', 'code'], 1, (doc_id % 4)::INT) AS r, list_slice(['code', 'test', 'doc'], 1, (doc_id % 3)::INT) AS c FROM documents), y AS (SELECT id, len(r) AS n, list_filter(r, lambda z: NOT list_contains(c, z)) AS m FROM x), z AS (SELECT *, CASE WHEN n > 0 THEN round((n - len(m)) / n, 3) ELSE 0 END AS ratio FROM y) SELECT id, ratio, array_to_string(m, ',') AS missing, n >= 1 AND ratio >= 0.5 AS passed FROM z")
def m9(spark, d):
    i = F.col("doc_id")
    some = lambda names, n: F.slice(F.array(*map(F.lit, names)), F.lit(1), n.cast("int"))
    return upkeep.coverage_gate(t(spark, d, "documents").select(i.alias("id"), some(["test", "spec", "code"], i % 4).alias("required"), some(["code", "test", "doc"], i % 3).alias("covered")), 0.5)


@query("m14_first_success", "SELECT user_id AS run, count(DISTINCT event_type) AS tried, arg_min(event_type, event_id) FILTER (value > 60) AS answered FROM events GROUP BY user_id")
def m14(spark, d):
    return upkeep.first_success(t(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.col("event_type").alias("provider"), (F.col("value") > 60).alias("ok")))


@query("m17_m20_rules", "SELECT event_id AS id, least(10000.0, 500 * 2.0 ** (event_id % 8))::DOUBLE AS delay, CASE WHEN event_type IN ('error', 'click') THEN 'deny' WHEN event_type = 'view' THEN 'allow' ELSE 'defer' END AS decision FROM events")
def m17(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("id"), upkeep.retry_delay(F.col("event_id") % 8).alias("delay"), upkeep.permission(F.col("event_type"), ["view", "error"], ["error", "click"], "defer").alias("decision"))


@query("m18_layers", "WITH g AS (SELECT event_type AS layer, count(*) AS spans, sum(value) AS s FROM events GROUP BY event_type) SELECT layer, spans, round(s, 3) AS total, round(s / sum(s) OVER (), 4) AS share FROM g")
def m18(spark, d):
    return upkeep.layers(t(spark, d, "events").select(F.col("user_id").alias("trace"), F.col("event_type").alias("layer"), F.col("value").alias("ms")))


@query("m2_axiom_block", f"WITH m AS (SELECT * FROM ({MEMORIES}) WHERE type IN ('pattern', 'decision') QUALIFY row_number() OVER (PARTITION BY project ORDER BY ord) <= 20) SELECT project, string_agg(type || ': ' || title, chr(10) ORDER BY CASE type WHEN 'pattern' THEN 1 ELSE 2 END, ord) AS text FROM m GROUP BY project")
def m2(spark, d):
    return upkeep.axiom_block(memories(spark, d), ["pattern", "decision"])


@query("m8_tasks", "SELECT event_id AS id, ([ 'running', 'completed', 'failed' ])[event_id % 3 + 1] AS status, substr(repeat(props, 5), 1, 20) AS error FROM events WHERE event_id % 3 = 0 OR epoch(TIMESTAMP '2024-01-20') - epoch(ts) <= 3600")
def m8(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("id"), pick(F.col("event_id"), ["running", "completed", "failed"]).alias("status"), F.col("ts").alias("ended"), F.repeat("props", 5).alias("error"))
    return upkeep.cleaned_tasks(e, "2024-01-20", 1, 20)


@query("p18_structural_match", "WITH x AS (SELECT doc_id AS id, list_slice(['Login', 'http'], 1, (doc_id % 3)::INT) AS e, list_slice(['auth/login', 'fs'], 1, (doc_id % 3)::INT) AS dp, list_slice(['login', 'Walk', 'RUN'], 1, (doc_id % 4)::INT) AS s FROM documents), y AS (SELECT id, list_filter([CASE WHEN len(e) > 0 THEN list_contains(e, 'Login')::INT / 2 END, CASE WHEN len(e) > 0 THEN list_contains(e, 'Login')::INT / len(e) END, CASE WHEN len(dp) > 0 THEN list_contains(dp, 'auth/login')::INT / 1 END, CASE WHEN len(s) > 0 THEN (list_contains(s, 'login')::INT + list_contains(s, 'RUN')::INT) / len(s) END], lambda z: z IS NOT NULL) AS p FROM x) SELECT id, round(CASE WHEN len(p) > 0 THEN list_sum(p) / len(p) ELSE 0 END, 6) AS score FROM y")
def p18(spark, d):
    i = F.col("doc_id")
    some = lambda names, n: F.slice(F.array(*map(F.lit, names)), F.lit(1), n.cast("int"))
    s = upkeep.structural_match(some(["Login", "http"], i % 3), some(["auth/login", "fs"], i % 3), some(["login", "Walk", "RUN"], i % 4), ["login", "other"], ["src/auth/login.ts"], ["Login", "run"])
    return t(spark, d, "documents").select(i.alias("id"), F.round(s, 6).alias("score"))


@query("i20_search_output", "SELECT doc_id AS id, 1 AS n, 'm' || doc_id AS name, 'decision' AS type, 'Title of ' || lang AS title, 'line one line two' AS body, source AS project FROM documents UNION ALL SELECT doc_id, 2, 'x', 'bugfix', 'b', 'only', 'global' FROM documents WHERE doc_id % 2 = 0")
def i20(spark, d):
    i = F.col("doc_id")
    out = F.concat(F.lit("Found\n[1] #m"), i, F.lit(" (decision) - Title of "), "lang", F.lit("\n  line one\n line two\n project: "), "source", F.lit(" | scope: project\n"), F.when(i % 2 == 0, "[2] #x (bugfix) - b\nonly\n").otherwise(""))
    return upkeep.search_output(t(spark, d, "documents").select(i.alias("id"), out.alias("text")))
