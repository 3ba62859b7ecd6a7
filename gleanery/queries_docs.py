"""Registered queries of the document structure, and of what is synchronised, streamed and planned. Inputs are derived from the driver's tables, alike on both sides."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gleanery import stored
from gleanery.operators import structure as S
from gleanery.operators import findings, recall, skills, symbols, sync, units
from gleanery.queries import AS_OF, _list, memories, pick, query, t

# ---- structure ----------------------------------------------------------------------------------


def markdown(text):
    """Markdown made of a text's lines: tables of lines with bars, code of lines with equal signs, else headings, items, indented lines and paragraphs by length."""
    n = F.length

    def line(x):
        level = F.repeat(F.lit("#"), n(x) % 3 + 1)
        return (
            F.when(F.contains(x, F.lit(" | ")), F.concat(F.lit("| "), x, F.lit(" |"))).when(F.contains(x, F.lit("=")), F.concat(F.lit("```txt\n"), x, F.lit("\n```")))
            .when(n(x) <= 40, F.concat(level, F.lit(" "), x)).when(n(x) <= 160, F.concat(F.when(n(x) % 2 == 0, "- ").otherwise("1. "), x)).when(n(x) <= 240, F.concat(F.lit("  "), x)).otherwise(F.concat(x, F.lit("\n")))
        )

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


_MD_LINE = "CASE WHEN contains(x, ' | ') THEN '| ' || x || ' |' WHEN contains(x, '=') THEN '```txt' || chr(10) || x || chr(10) || '```' WHEN length(x) <= 40 THEN repeat('#', length(x) % 3 + 1) || ' ' || x WHEN length(x) <= 160 THEN CASE WHEN length(x) % 2 = 0 THEN '- ' ELSE '1. ' END || x WHEN length(x) <= 240 THEN '  ' || x ELSE x || chr(10) END"
MARKDOWN = f"SELECT doc_id AS id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_MD_LINE}), chr(10)) AS content FROM documents"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_IS = lambda p: f"regexp_matches(line, '{p}')"
_LINES = f"""d AS ({MARKDOWN}), l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(0, len(string_split(content, chr(10)))))::INT AS n FROM d),
f AS (SELECT *, {_IS(S.FENCE)} AS fence, sum({_IS(S.FENCE)}::INT) OVER w AS fences FROM l WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)),
k AS (SELECT id, n, line, fences, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN {_IS(S.HEADING)} THEN 'heading' WHEN {_IS(S.TABLE)} THEN 'table' WHEN {_IS(S.UNORDERED)} OR {_IS(S.ORDERED)} THEN 'item' WHEN {_STRIP.format("line")} = '' THEN 'blank' WHEN {_IS("^\\s{2,}")} THEN 'more' ELSE 'text' END AS kind FROM f),
x AS (SELECT *, (sum((kind = 'heading')::INT) OVER w)::BIGINT AS section, sum((kind NOT IN ('item', 'blank', 'more'))::INT) OVER w AS part, sum((kind <> 'table')::INT) OVER w AS tb, sum((kind = 'item')::INT) OVER w AS ib FROM k WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING))"""
_SECTIONS = f"""{_LINES}, s0 AS (SELECT id, section, coalesce(max({_STRIP.format(f"regexp_extract(line, '{S.HEADING}', 2)")}) FILTER (kind = 'heading'), '') AS heading, coalesce(max(length(regexp_extract(line, '{S.HEADING}', 1))) FILTER (kind = 'heading'), 0) AS level, min(n) AS start_line, max(n) AS end_line,
{_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (kind <> 'heading'), '')")} AS content FROM x GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section) AS n FROM s0 WHERE content <> '' OR heading <> ''),
s2 AS (SELECT *, (SELECT max(p.section) FROM s1 p WHERE p.id = s1.id AND p.section < s1.section AND p.level > 0 AND p.level < s1.level) AS parent, regexp_replace(regexp_replace(lower({_STRIP.format("heading")}), '[^\\p{{L}}\\p{{N}}\\s-]+', '', 'g'), '\\s+', '-', 'g') AS raw FROM s1)"""


def _markdown(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", markdown(F.col("text")).alias("content"))


@query("p1_sections", f"WITH {_SECTIONS} SELECT id, n, section, parent, 'section-' || CASE WHEN raw <> '' THEN raw ELSE n::VARCHAR END AS section_id, CASE WHEN heading <> '' THEN heading ELSE 'document' END AS title, greatest(level, 1) AS level, start_line, end_line, md5(content) AS content_md5 FROM s2")
def p1(spark, d):
    return S.sections(_markdown(spark, d)).withColumn("content_md5", F.md5(F.col("content").cast("binary"))).drop("content")


_BODY = "md5(concat_ws(chr(31), block, language, content, array_to_string(headers, '|'), n_rows, array_to_string(items, chr(30)), ordered)) AS body_md5"
_TEXT = f"{_STRIP.format(f"CASE WHEN {_IS(S.UNORDERED)} THEN regexp_extract(line, '{S.UNORDERED}', 1) ELSE regexp_extract(line, '{S.ORDERED}', 1) END")}"


@query("p1_blocks", f"""WITH {_LINES},
c AS (SELECT id, min(section) AS section, 'code' AS block, min(n) AS start_line, max(n) AS end_line, regexp_extract(arg_min(line, n), '{S.FENCE}', 2) AS language, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (kind = 'code'), '') AS content, NULL::VARCHAR[] AS headers, NULL::BIGINT AS n_rows, NULL::VARCHAR[] AS items, NULL::BOOLEAN AS ordered FROM x WHERE kind IN ('fence', 'code') GROUP BY id, ceil(fences / 2)),
tc AS (SELECT *, list_transform(string_split(regexp_extract(line, '{S.TABLE}', 1), '|'), lambda y: {_STRIP.format("y")}) AS cells FROM x WHERE kind = 'table'), tr AS (SELECT *, len(list_filter(cells, lambda y: NOT regexp_matches(y, '{S.CELL_RULE}'))) = 0 AS rule FROM tc),
tt AS (SELECT id, min(section), 'table', min(n), max(n), NULL, NULL, CASE WHEN arg_min(rule, n) THEN [] ELSE arg_min(cells, n) END, count(*) FILTER (NOT rule) - arg_min((NOT rule)::INT, n), NULL, NULL FROM tr GROUP BY id, tb),
i AS (SELECT id, part, ib, min(section) AS section, min(n) AS start_line, max(n) AS end_line, string_agg(CASE kind WHEN 'item' THEN {_TEXT} WHEN 'more' THEN {_STRIP.format("line")} END, ' ' ORDER BY n) AS item, arg_min({_IS(S.ORDERED)}, n) AS ordered FROM x WHERE kind IN ('item', 'more', 'blank') GROUP BY id, part, ib HAVING bool_or(kind = 'item')),
ll AS (SELECT id, min(section), 'list', min(start_line), max(end_line), NULL, NULL, NULL, NULL, list(item ORDER BY start_line), arg_min(ordered, start_line) FROM i GROUP BY id, part)
SELECT id, section, block, start_line, end_line, {_BODY} FROM (SELECT * FROM c UNION ALL SELECT * FROM tt UNION ALL SELECT * FROM ll)""")  # fmt: skip
def p1_blocks(spark, d):
    body = F.concat_ws("\x1f", "block", "language", "content", F.array_join("headers", "|"), F.col("n_rows").cast("string"), F.array_join("items", "\x1e"), F.col("ordered").cast("string"))
    return S.blocks(_markdown(spark, d)).select("id", "section", "block", "start_line", "end_line", F.md5(body.cast("binary")).alias("body_md5"))





@query("p2_pairs", "SELECT doc_id AS id, unnest(['source', 'lang']) AS key, unnest([CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE source END, lang]) AS value FROM documents")
def p2_pairs(spark, d):
    again = F.when(F.col("doc_id") % 2 == 0, F.lit("source: again\n")).otherwise("")
    return S.metadata(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("source: "), "source", F.lit("\nlang:  "), "lang", F.lit("\n"), again, F.lit("\n"), "text").alias("content")))


@query("p5_section_chunks")
def p5_sections(spark, d):
    return S.section_chunks(_markdown(spark, d), 700)


# ---- synchronisation ----------------------------------------------------------------------------


@query("h18_sync")
def h18(spark, d):
    """Two runs of a store over the documents as files: the second one finds some gone, some changed and some new. The manifest after it, with the version of each chunk."""
    x = t(spark, d, "documents").select((F.col("doc_id") % 7).alias("k"), (F.col("doc_id") % 11).alias("c"), F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), markdown(F.col("text")).alias("content"))
    target = stored.folder(spark)
    sync.run(spark, x.filter("k <> 0").select("source", "content"), target)
    edited = F.when(F.col("c") == 0, F.concat("content", F.lit("\n# One more\nPart"))).otherwise(F.col("content"))
    sync.run(spark, x.filter("k <> 1").select("source", edited.alias("content")), target)
    store = sync.Store(spark, target)
    versions = store.versions().groupBy("chunk_id").agg(F.max("version").alias("version"))
    return store.manifest().join(versions, "chunk_id").select("source", "chunk_id", "checksum", "version")


# ---- code ---------------------------------------------------------------------------------------

#: Six lines of code for each line of a text, which stands in a comment: {0} the line, {1} its number, {2} its length modulo 5.
_CODE = ["/* {0} */", "export class C{1} extends B{2} implements I{1}<A, B>, J {{", "  // {{ \" `", "  private async m{1}(a) {{ return \"}}\" + a; }}", "}}", "const v{1} = `}}`, w{1} = [1,"]
_CODE_END = " 2]"


def code(text):
    """Code made of a text's lines."""
    clean = lambda x: F.replace(x, F.lit("*/"), F.lit(" "))

    def lines(x, k):
        parts = "\n".join(_CODE) + _CODE_END
        out = []
        for piece in re.split(r"(\{[012]\})", parts):
            out.append({"{0}": clean(x), "{1}": k.cast("string"), "{2}": (F.length(x) % 5).cast("string")}.get(piece, F.lit(piece.replace("{{", "{").replace("}}", "}"))))
        return F.concat(*out)

    return F.array_join(F.transform(F.split(text, "\n"), lines), "\n")


_L = "SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents"


def _files(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("a.ts").alias("source"), code(F.col("text")).alias("content"))


@query("p19_declarations", f"""WITH l AS ({_L}) SELECT id, unnest(['C' || k, 'm' || k, 'v' || k, 'w' || k]) AS name, unnest(['class', 'method', 'variable', 'variable']) AS kind, unnest([true, false, false, false]) AS exported, unnest(['module', 'private', 'module', 'module']) AS visibility, unnest([NULL, 'C' || k, NULL, NULL]) AS parent,
unnest([6 * k + 2, 6 * k + 4, 6 * k + 6, 6 * k + 6]) AS start_line, unnest([6 * k + 5, 6 * k + 4, 6 * k + 6, 6 * k + 6]) AS end_line, unnest(['B' || length(x) % 5, NULL, NULL, NULL]) AS extends, unnest(['I' || k || ',J', NULL, NULL, NULL]) AS implements FROM l""")
def p19(spark, d):
    x = symbols.declarations(_files(spark, d))
    return x.select("id", "name", "kind", "exported", "visibility", "parent", "start_line", "end_line", F.array_join("extends", ",").alias("extends"), F.array_join("implements", ",").alias("implements"))


@query("p19_chunk_symbols", f"""WITH l AS ({_L}), d AS (SELECT id, unnest([6 * k + 2, 6 * k + 4, 6 * k + 6, 6 * k + 6]) AS a, unnest([6 * k + 5, 6 * k + 4, 6 * k + 6, 6 * k + 6]) AS b, unnest([4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3]) AS o, unnest(['C' || k, 'm' || k, 'v' || k, 'w' || k]) AS name FROM l),
c AS (SELECT DISTINCT id, 10 * (k * 6 // 10) + 1 AS x FROM l), j AS (SELECT id || ':' || x AS chunk_id, name, row_number() OVER (PARTITION BY id, x ORDER BY o) AS n FROM c JOIN d USING (id) WHERE a <= x + 9 AND b >= x) SELECT chunk_id, n, name FROM j WHERE n <= 8""")
def p19_chunks(spark, d):
    """Of chunks of ten lines, those in which a text's line begins."""
    f = _files(spark, d)
    starts = F.array_distinct(F.transform(F.split("content", "\n"), lambda _, k: F.floor(F.floor(k / 6) * 6 / 10) * 10 + 1))
    c = f.select("id", F.explode(starts).alias("start_line")).select("id", F.concat_ws(":", "id", "start_line").alias("chunk_id"), "start_line", (F.col("start_line") + 9).alias("end_line"))
    return symbols.of_chunks(symbols.declarations(f), c)


# ---- recall -------------------------------------------------------------------------------------


def _recall_requests(spark, d):
    """A request per conversation: its first turn is the task, its second the objective, its third the focus; the files are named by roles and first words."""
    c = t(spark, d, "conversations")
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    g = c.groupBy(F.col("conv_id").alias("id")).agg(at(0).alias("task"), at(1).alias("objective"), at(2).alias("focus"), F.max("turn").alias("n"))
    word = F.regexp_extract("task", "([A-Za-z]+)", 1)
    files = F.when(F.col("n") % 2 == 0, F.array(F.concat(F.lit("src/"), word, F.lit("/auth-validate.ts")), F.lit("docs/organize.md")))
    return g.select("id", "task", "objective", "focus", files.alias("files"), F.when(F.col("id") % 10 == 3, F.substring("task", 1, 30)).alias("explicit"))


@query("r21_recall_plans")
def r21(spark, d):
    return recall.plans(_recall_requests(spark, d))


def _recalled(spark, d):
    m = memories(spark, d)
    return m, stored.table(recall.recall(_recall_requests(spark, d), m))


@query("r22_staged_recall")
def r22(spark, d):
    return _recalled(spark, d)[1]


@query("r22_relevant")
def r22_relevant(spark, d):
    m, found = _recalled(spark, d)
    return recall.relevant(_recall_requests(spark, d), found, m, AS_OF, shown=m.filter("id % 5 = 0").select("id"), tools=["that"])


# ---- skills -------------------------------------------------------------------------------------

#: A draft per user, made in the middle of January for a task that the user's events are about; some files lack a section.
_DRAFTS = "SELECT DISTINCT user_id AS u, 'skill-' || user_id AS name, (['/Doctor check user ', 'run the job ', 'git push --force ', 'tidy '])[user_id % 4 + 1] || user_id AS task, TIMESTAMP '2024-01-10' + to_days((user_id % 9)::INT) AS created, CASE WHEN user_id % 5 = 0 THEN NULL ELSE '## Trigger x ## Suggested workflow ## Validation checklist' || CASE WHEN user_id % 3 = 0 THEN '' ELSE ' ## Promotion checklist' END END AS markdown FROM events"
_GAIN = "CASE WHEN {0}0 > 0 THEN round(({0}0 - {0}1) / {0}0, 3) END AS {0}"
_HELD = lambda k: f"CASE WHEN coalesce({k} < {skills.LEAST[k]}, true) THEN '{k}-improvement-below-threshold' END"
_SIDE = lambda c, k: f"count(*) FILTER ({c}) AS n{k}, round(avg(duration) FILTER ({c}), 3) AS duration{k}, round(avg(failed) FILTER ({c}), 3) AS error{k}, round(avg(used) FILTER ({c}), 3) AS token{k}"


@query("m3_promotion", f"""WITH s AS ({_DRAFTS}), e AS (SELECT user_id AS u, ts AS seen, value AS duration, (event_type = 'error')::INT::DOUBLE AS failed, CASE WHEN event_id % 3 > 0 THEN value * 10 END AS used FROM events),
g AS (SELECT name, {_SIDE('seen <= created', 0)}, {_SIDE('seen >= created', 1)} FROM s LEFT JOIN e USING (u) GROUP BY name),
x AS (SELECT s.*, n1 AS runs, {_GAIN.format('duration')}, {_GAIN.format('error')}, {_GAIN.format('token')} FROM s JOIN g USING (name)),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN u % 4 = 2 THEN '{"dangerous-pattern:" + skills.DANGEROUS[8]}' END, CASE WHEN u % 4 = 3 THEN 'unknown-command-low-signal' END, CASE WHEN markdown IS NULL THEN 'missing-skill-file' WHEN NOT contains(markdown, 'Promotion') THEN 'missing-section:promotion-checklist' END,
CASE WHEN runs < 3 THEN 'insufficient-runs:' || runs || '/3' END, {_HELD('duration')}, {_HELD('error')}, {_HELD('token')}], lambda z: z IS NOT NULL), ',') AS reasons FROM x)
SELECT name, runs, duration, error, token, CASE WHEN reasons = '' THEN 'promoted-experimental' ELSE 'hold' END AS decision, reasons FROM r""")  # fmt: skip
def m3(spark, d):
    e = t(spark, d, "events")
    u = F.col("user_id")
    line = F.concat(F.element_at(F.array(*map(F.lit, ["/Doctor check user ", "run the job ", "git push --force ", "tidy "])), (u % 4 + 1).cast("int")), u.cast("string"))
    text = F.concat(F.lit("## Trigger x ## Suggested workflow ## Validation checklist"), F.when(u % 3 == 0, "").otherwise(" ## Promotion checklist"))
    drafts = e.select("user_id").distinct().select(F.concat(F.lit("skill-"), u.cast("string")).alias("name"), line.alias("task"), F.date_add(F.to_date(F.lit("2024-01-10")), (u % 9).cast("int")).cast("timestamp").alias("created"), F.when(u % 5 != 0, text).alias("markdown"))
    told = e.select(line.alias("task"), F.col("ts").alias("at"), F.col("value").alias("duration"), (F.col("event_type") == "error").cast("int").alias("exit_code"), F.when(F.col("event_id") % 3 > 0, F.col("value") * 10).alias("used_tokens"))
    return skills.promoted(drafts, told)


# ---- learning units -----------------------------------------------------------------------------


@query("g11_better_units")
def g11(spark, d):
    """Units of the documents, equal by source, language and risk; confidence and severity follow from the texts' length."""
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "source", "lang", findings.risk_of(F.col("text")).alias("risk"), (F.col("n_chars") % 83 / 83).alias("confidence"), (F.col("n_chars") % 5 / 4).alias("severity"))
    return units.better(x, "source", "lang", "risk")


_RISK_HITS = "[" + ", ".join(f"{{'k': {k}, 'risk': '{name}', 'w': {findings.WEIGHT[sev]}, 'hits': {' + '.join(f'contains(low, {chr(39)}{w}{chr(39)})::INT' for w in words)}}}" for k, (name, sev, words) in enumerate(findings.RISKS)) + "]"
_EDGED = " OR ".join(f"regexp_matches(low, '{p}')" for p in units.EVIDENCE)


@query("g13_teaching", f"""WITH x AS (SELECT doc_id AS id, (['auto', 'on', 'off'])[doc_id % 3 + 1] AS mode, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low, doc_id % 4 = 0 AS sure FROM documents),
h AS (SELECT id, mode, sure, {_EDGED} AS evidence, list_sort(list_transform(list_filter({_RISK_HITS}, lambda z: z.hits > 0), lambda z: {{'a': -z.hits * z.w, 'b': -z.hits, 'c': -z.w, 'd': z.k, 'risk': z.risk}}))[1] AS top FROM x),
e AS (SELECT id, mode, sure, evidence, top IS NOT NULL AS found, coalesce(top.risk, '{findings.OTHER_RISK}') AS risk, coalesce(-top.b, 0) AS hits, mode <> 'off' AND (top IS NOT NULL OR mode <> 'auto') AS enabled FROM h),
c AS (SELECT *, enabled AND risk IN ({_list(units.CRITICAL)}) AS critical FROM e), b AS (SELECT *, critical AND (evidence OR (sure AND (mode = 'on' OR hits >= 2))) AS blocked FROM c)
SELECT id, enabled, CASE WHEN enabled THEN risk END AS risk, critical, blocked, CASE WHEN blocked THEN 'critical-security-risk:' || risk WHEN enabled AND found THEN 'security-advisory:' || risk ELSE '' END AS reason FROM b""")  # fmt: skip
def g13(spark, d):
    x = t(spark, d, "documents")
    sure = x.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.lit("").alias("risk"), F.lit(True).alias("critical"), F.lit(0.9).alias("confidence"))
    return units.teaching(x.select(F.col("doc_id").alias("id"), pick(F.col("doc_id"), ["auto", "on", "off"]).alias("mode"), "text"), sure)
