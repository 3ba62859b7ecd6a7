"""Entities, symbols and chunks of texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import batches
from gleanery.functions.text import ascii_edges, slug

#: Patterns of entities that dialects of regular expressions read alike.
ENTITIES = {
    "date": "\\b\\d{4}-\\d{2}-\\d{2}\\b",
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}",
    "url": "https?://[^\\s<>\"']+",
    "ip": "\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b",
    "number": "\\b\\d{13,19}\\b",
}


def entities(docs: DataFrame) -> DataFrame:
    """P-7, P-8: (id, content) -> id, type, value; each once per document."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(ascii_edges(pattern)), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("type"), F.lower(v).alias("value")))

    found = [of(k, p) for k, p in ENTITIES.items()]
    return docs.select("id", F.explode(F.array_distinct(F.concat(*found))).alias("e")).select("id", "e.type", "e.value")


def symbols(source: Column) -> Column:
    """P-17: names of imports, functions and classes in code, each list sorted and distinct."""
    names = lambda p: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(p), F.lit(1)))), ",")
    return F.struct(names("from\\s+[\"']([^\"']+)[\"']").alias("imports"), names("function\\s+([A-Za-z_$][A-Za-z0-9_$]*)").alias("functions"), names("class\\s+([A-Za-z_$][A-Za-z0-9_$]*)").alias("classes"))


def paragraphs(docs: DataFrame, size: int = 1600) -> DataFrame:
    """P-5: lines packed greedily into chunks of at most ``size`` characters; a longer line is cut. (id, n, chunk)."""

    def step(acc: Column, line: Column) -> Column:
        last = acc["last"]
        fits = F.length(last) + 1 + F.length(line) <= size
        return F.struct(F.when(fits | (last == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"), F.when(last == "", line).when(fits, F.concat(last, F.lit("\n"), line)).otherwise(line).alias("last"))

    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda i: F.substr(x, i * size + 1, F.lit(size)))
    lines = F.flatten(F.transform(F.filter(F.split("content", "\n"), lambda x: x != ""), pieces))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"))
    packed = F.aggregate(lines, start, step, lambda a: F.when(a["last"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["last"]))))
    return docs.select("id", F.posexplode(packed).alias("n", "chunk"))


def windows_of(docs: DataFrame, size: int, step: int) -> DataFrame:
    """P-4, fixed-width subset: (id, n, chunk) of ``size`` characters every ``step``."""
    n = F.greatest(F.ceil((F.length("content") - size) / F.lit(step)), F.lit(0)).cast("int")
    return docs.filter(F.length("content") > 0).select("id", "content", F.explode(F.sequence(F.lit(0), n)).alias("n")).select("id", "n", F.substr("content", F.col("n") * step + 1, F.lit(size)).alias("chunk"))


def flags(content: Column) -> Column:
    """P-16."""
    return F.struct(F.rlike(content, F.lit("```|=>|function |class |def ")).alias("has_code"), F.rlike(content, F.lit("(?i)art[ií]culo\\s+\\d+|section\\s+\\d+|§")).alias("has_legal"), F.size(F.filter(F.split(content, "\\s+"), lambda w: w != "")).cast("long").alias("words"))


#: Rule tags of P-6, the first that fits wins.
TAG_DOMAINS = {"security": "auth|token|jwt|secret|encryption|security", "memory": "memory|recall|engram|session|knowledge", "observability": "metric|trace|observability|dashboard|monitor", "api": "api|endpoint|route|http|request|response", "testing": "test|assert|fixture|spec|mock"}
TAG_TOPICS = {"auth-validation": "auth|validation|session", "context-selection": "context|chunk|selector|ranking|noise", "teaching": "teach|mentor|learning|packet", "sync": "sync|notion|integration|webhook", "release-quality": "ci|benchmark|release|versioning|contract"}


def tagged(chunks: DataFrame) -> DataFrame:
    """P-6: ``chunks`` (source, content, ...) with ``topic`` and ``domain``. Words are looked for as such before their edges are."""
    c = chunks.select("*", F.lower(F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("content", F.lit("")))).alias("_text"))

    def first(tags: dict[str, str]) -> Column:
        out = F.lit("general")
        for tag, words in reversed(tags.items()):
            hint = F.lit(False)
            for w in words.split("|"):
                hint = hint | F.contains("_text", F.lit(w))
            out = F.when(hint & F.rlike("_text", F.lit(f"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])")), tag).otherwise(out)
        return out

    return c.select(*chunks.columns, first(TAG_TOPICS).alias("topic"), first(TAG_DOMAINS).alias("domain"))


def rule_tags(chunks: DataFrame) -> DataFrame:
    """P-6: (id, source, kind, content) -> id, topic, domain, type, confidence."""
    c = tagged(chunks.select("id", "kind", "source", "content"))
    score = F.lit(0.45) + F.when(F.col("topic") != "general", 0.2).otherwise(0.0) + F.when(F.col("domain") != "general", 0.2).otherwise(0.0) + F.when(F.col("kind").isin("code", "test", "spec"), 0.1).otherwise(0.0)
    kind = F.when(F.col("kind").isin("code", "test", "spec", "log", "chat"), F.col("kind")).otherwise("doc")
    return c.select("id", "topic", "domain", kind.alias("type"), F.round(F.least(F.lit(0.95), score), 2).alias("confidence"))


def sections(docs: DataFrame) -> DataFrame:
    """P-1, P-3: (id, content) in Markdown -> id, n, level, heading, slug, content, lines: a section per heading outside of code fences, and one for what
    comes before the first. A fold over the lines of one document, within a row."""
    line = lambda x: F.regexp_extract(x, "^(#{1,6})\\s+(.+?)\\s*#*\\s*$", 2)
    empty = F.array().cast("array<struct<level:int,heading:string,content:array<string>>>")
    none = F.struct(F.lit(0).alias("level"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("content"))
    start = F.struct(empty.alias("done"), none.alias("now"), F.lit(False).alias("fence"))

    def step(acc: Column, x: Column) -> Column:
        fence = F.rlike(x, F.lit("^\\s*(?:```|~~~)"))
        is_heading = ~acc["fence"] & ~fence & (line(x) != "")
        fresh = F.struct(F.length(F.regexp_extract(x, "^(#{1,6})\\s", 1)).alias("level"), line(x).alias("heading"), F.array().cast("array<string>").alias("content"))
        grown = F.struct(acc["now"]["level"].alias("level"), acc["now"]["heading"].alias("heading"), F.concat(acc["now"]["content"], F.array(x)).alias("content"))
        return F.struct(F.when(is_heading, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(is_heading, fresh).otherwise(grown).alias("now"), (acc["fence"] != fence).alias("fence"))

    every = F.aggregate(F.split(F.coalesce("content", F.lit("")), "\r?\n"), start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    full = F.filter(every, lambda s: (s["heading"] != "") | (F.trim(F.array_join(s["content"], "\n")) != ""))
    out = docs.select("id", F.posexplode(full).alias("n", "s"))
    return out.select("id", "n", "s.level", "s.heading", slug(F.col("s.heading")).alias("slug"), F.array_join("s.content", "\n").alias("content"), F.size("s.content").alias("lines"))


def front_matter(text: Column) -> Column:
    """P-2: keys and values between ``---`` lines at the beginning, as a map; empty without."""
    block = F.regexp_extract(text, "^---\\r?\\n((?s:.*?))\\r?\\n---", 1)
    pairs = F.filter(F.split(block, "\r?\n"), lambda x: F.rlike(x, F.lit("^[A-Za-z_][A-Za-z0-9_-]*\\s*:")))
    key = lambda x: F.trim(F.regexp_extract(x, "^([^:]+):", 1))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]+:", ""))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(key(x), value(x))))


def smart_chunks(docs: DataFrame, size: int = 3000, least: int = 200, overlap: int = 100) -> DataFrame:
    """P-4: (id, content) -> id, n, strategy, chunk. By sections if there are several with a heading, else by paragraphs if there is a blank
    line, else by sentences; pieces are packed up to ``size`` characters, short ones join the chunk before, long ones are cut at the next finer level, and
    each chunk begins with the end of the one before.

    A small state machine per document, on Arrow batches.
    """

    def pack(parts: list[str], glue: str, finer) -> list[str]:
        out, held = [], ""

        def close() -> None:
            nonlocal held
            if len(held) >= least or (held and not out):
                out.append(held)
            elif held:
                out[-1] += glue + held
            held = ""

        for p in parts:
            if len(held) + len(p) + len(glue) <= size:
                held = held + glue + p if held else p
                continue
            close()
            if len(p) > size:
                out.extend(finer(p))
            else:
                held = p
        close()
        return out

    def by_sentence(text: str) -> list[str]:
        parts = [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ])", text)]
        return pack(parts, " ", lambda s: [s[i : i + size] for i in range(0, len(s), size)])

    def by_paragraph(text: str) -> list[str]:
        return pack(re.split(r"\n{2,}", text), "\n\n", by_sentence)

    def by_section(text: str) -> list[str] | None:
        parts, fence, headed = [[]], False, False
        for x in text.split("\n"):
            mark = re.match(r"\s*(?:```|~~~)", x)
            if not fence and not mark and re.match(r"#{1,6}\s+\S", x):
                headed = True
                parts.append([])
            fence ^= bool(mark)
            parts[-1].append(x)
        texts = [t for t in ("\n".join(p).strip("\n") for p in parts) if t.strip()]
        return pack(texts, "\n\n", by_paragraph) if headed and len(texts) > 1 else None

    def run(parts):
        for pdf in parts:
            rows = []
            for i, text in zip(pdf["id"], pdf["content"], strict=True):
                if not text:
                    continue
                got, how = by_section(text), "section"
                if got is None:
                    got, how = (by_paragraph(text), "paragraph") if "\n\n" in text else (by_sentence(text), "semantic")
                rows += [(i, n, how, (got[n - 1][-overlap:] if n and overlap else "") + c) for n, c in enumerate(got)]
            yield pd.DataFrame(rows, columns=["id", "n", "strategy", "chunk"])

    return batches.small(docs.select("id", "content")).mapInPandas(run, "id long, n int, strategy string, chunk string")
