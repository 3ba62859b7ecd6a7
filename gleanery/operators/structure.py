"""Structure of Markdown texts: front matter, sections, typed blocks, and chunks by section.

Texts become rows of lines. The state of a line parser (inside a fence, which section, which block) is a running count over a
text's lines, so that all of it is window functions over one shuffle by id, and linear in the length of a text. ``id`` is a key of the texts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What lines are taken for.
FENCE = "^(`{3,}|~{3,})(\\w*)"
HEADING = "^(#{1,6})\\s+(.+)"
TABLE = "^\\|(.+)\\|$"
UNORDERED = "^\\s*[-*+]\\s+(.+)"
ORDERED = "^\\s*\\d+[.)]\\s+(.+)"
PAIR = "^([A-Za-z_][\\w.-]*)\\s*:\\s*(.+)$"
MARKER = "^---\\s*$"
CELL_RULE = "^[-:]+$"


#: What ``\\s`` stands for.
SPACE = " \t\n\x0b\f\r"


def stripped(x: Column) -> Column:
    return F.trim(x, F.lit(SPACE))


def _split(docs: DataFrame) -> DataFrame:
    """(id, lines, first, last, start): the front matter is in lines [first, last), the text begins at ``start``."""
    d = docs.select("id", F.split(F.coalesce("content", F.lit("")), "\r?\n").alias("lines"))
    head = F.get("lines", F.lit(0))
    is_pair = lambda x: F.rlike(stripped(x), F.lit(PAIR))
    # all lines are looked at only in texts that begin with front matter
    close = F.when(F.rlike(head, F.lit(MARKER)), F.array_position(F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.rlike(x, F.lit(MARKER))), True))
    other = F.when(is_pair(head), F.array_position(F.transform("lines", is_pair), False)).otherwise(1)
    d = d.select("id", "lines", F.rlike(head, F.lit(MARKER)).alias("fenced"), close.cast("int").alias("close"), F.when(other == 0, F.size("lines")).otherwise(other.cast("int") - 1).alias("pairs"))
    blank = F.coalesce(stripped(F.get("lines", F.col("pairs"))) == "", F.lit(False))
    start = F.when(F.col("fenced"), F.when(F.col("close") > 0, F.col("close") + 1).otherwise(0)).when(F.col("pairs") == 0, 0).otherwise(F.col("pairs") + blank.cast("int"))
    return d.select("id", "lines", F.col("fenced").cast("int").alias("first"), F.when(F.col("fenced"), F.greatest("close", F.lit(1))).otherwise(F.col("pairs")).alias("last"), start.alias("start"))


def metadata(docs: DataFrame) -> DataFrame:
    """P-2: (id, content) -> id, key, value: pairs between ``---`` lines, or the lines of pairs that a text begins with. Of a key's values the last counts."""
    d = _split(docs).filter("last > first").select("id", F.posexplode(F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first"))).alias("n", "line"))
    line = stripped(F.col("line"))
    d = d.select("id", "n", F.regexp_extract(line, PAIR, 1).alias("key"), stripped(F.regexp_extract(line, PAIR, 2)).alias("value")).filter("key <> ''")
    return d.groupBy("id", "key").agg(F.max_by("value", "n").alias("value"))


def lines(docs: DataFrame) -> DataFrame:
    """(id, content) -> id, n, line, kind (fence, code, heading, table, item, more, blank or text), and running numbers: of the ``section``,
    of the ``part`` (what ends a list begins one), of fences, table breaks and items. ``more`` is an indented line, which goes on with a list's item."""
    x = _split(docs).select("id", "start", F.posexplode("lines").alias("n", "line")).filter("n >= start")
    w = W.partitionBy("id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    count = lambda c: F.sum(c.cast("int")).over(w)
    is_ = lambda p: F.rlike("line", F.lit(p))
    begins = lambda *with_: F.substring("line", 1, len(with_[0])).isin(*with_)
    x = x.withColumn("fence", begins("```", "~~~")).withColumn("fences", count(F.col("fence")))
    # a pattern is tried only on lines whose first sign fits it
    sign = F.substring(F.ltrim("line", F.lit(SPACE)), 1, 1)
    kind = (
        F.when(F.col("fence"), "fence").when(F.col("fences") % 2 == 1, "code").when(begins("#") & is_(HEADING), "heading").when(begins("|") & is_(TABLE), "table")
        .when((sign.isin("-", "*", "+") & is_(UNORDERED)) | (sign.between("0", "9") & is_(ORDERED)), "item")
        .when(sign == "", "blank").when(F.rlike(F.substring("line", 1, 2), F.lit("^\\s{2}")), "more").otherwise("text")
    )
    x = x.select("id", "n", "line", "fences", kind.alias("kind"))
    k = F.col("kind")
    return x.select("*", count(k == "heading").alias("section"), count(~k.isin("item", "blank", "more")).alias("part"), count(k != "table").alias("rows_before"), count(k == "item").alias("items_before"))


def _joined(values: Column, glue: str) -> Column:
    """Values of (n, value) structs in order of n."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", values.alias("v")))), lambda s: s["v"]), glue)


def _sections(x: DataFrame) -> DataFrame:
    head = F.col("kind") == "heading"
    g = x.groupBy("id", "section").agg(
        F.max(F.when(head, stripped(F.regexp_extract("line", HEADING, 2)))).alias("heading"), F.coalesce(F.max(F.when(head, F.length(F.regexp_extract("line", HEADING, 1)))), F.lit(0)).alias("level"),
        F.min("n").alias("start_line"), F.max("n").alias("end_line"), stripped(_joined(F.when(~head, F.col("line")), "\n")).alias("content"),
    )
    g = g.withColumn("heading", F.coalesce("heading", F.lit(""))).filter("content <> '' OR heading <> ''")
    w = W.partitionBy("id").orderBy("section")
    # the parent is the nearest section before of a lower level; six levels, so six running values
    last = [F.last(F.when(F.col("level") == k, F.col("section")), True).over(w.rowsBetween(W.unboundedPreceding, -1)) for k in range(1, 6)]
    parent = F.greatest(F.lit(-1), *[F.when(F.col("level") > k, last[k - 1]) for k in range(1, 6)])
    return g.withColumn("parent", F.nullif(parent, F.lit(-1))).withColumn("n", F.row_number().over(w))


def sections(docs: DataFrame) -> DataFrame:
    """P-1, P-3: (id, content) -> id, n (from 1), section, parent, section_id, title, level, start_line, end_line, content: a section per heading
    outside of fences, and one for what comes before the first. ``parent`` is the ``section`` that it lies in, null at the top."""
    s = _sections(lines(docs))
    raw = F.regexp_replace(F.regexp_replace(F.lower(stripped(F.col("heading"))), "[^\\p{L}\\p{N}\\s-]+", ""), "\\s+", "-")
    name = F.concat(F.lit("section-"), F.when(raw != "", raw).otherwise(F.col("n").cast("string")))
    title = F.when(F.col("heading") != "", F.col("heading")).otherwise("document")
    return s.select("id", "n", "section", "parent", name.alias("section_id"), title.alias("title"), F.greatest("level", F.lit(1)).alias("level"), "start_line", "end_line", "content")


def blocks(docs: DataFrame) -> DataFrame:
    """P-1: (id, content) -> id, section, block (code, table or list), start_line, end_line, language, content of code, headers and n_rows of a table, items
    and ordered of a list; null where a block has none. A fence that is never closed reaches to the end, a list over blank lines up to what ends it."""
    x = lines(docs)
    none = {"language": "string", "content": "string", "headers": "array<string>", "n_rows": "long", "items": "array<string>", "ordered": "boolean"}

    def shaped(df: DataFrame, block: str, **own: Column) -> DataFrame:
        more = [own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in none.items()]
        return df.select("id", "section", F.lit(block).alias("block"), "start_line", "end_line", *more)

    span = [F.min("section").alias("section"), F.min("n").alias("start_line"), F.max("n").alias("end_line")]
    fenced = x.filter("kind IN ('fence', 'code')").withColumn("k", F.ceil(F.col("fences") / 2))
    code = fenced.groupBy("id", "k").agg(*span, F.min_by("line", "n").alias("open"), _joined(F.when(F.col("kind") == "code", F.col("line")), "\n").alias("body"))
    cells = F.transform(F.split(F.regexp_extract("line", TABLE, 1), "\\|"), stripped)
    t = x.filter("kind = 'table'").withColumn("cells", cells).withColumn("rule", F.forall("cells", lambda c: F.rlike(c, F.lit(CELL_RULE))))
    t = t.groupBy("id", "rows_before").agg(*span, F.min_by(F.when(F.col("rule"), F.array().cast("array<string>")).otherwise(F.col("cells")), "n").alias("headers"), (F.count_if(~F.col("rule")) - F.min_by((~F.col("rule")).cast("int"), "n")).alias("n_rows"))
    text = F.when(F.rlike("line", F.lit(UNORDERED)), F.regexp_extract("line", UNORDERED, 1)).otherwise(F.regexp_extract("line", ORDERED, 1))
    own = F.when(F.col("kind") == "item", stripped(text)).when(F.col("kind") == "more", stripped(F.col("line")))
    numbered = F.min_by(F.rlike("line", F.lit(ORDERED)), "n")
    item = x.filter("kind IN ('item', 'more', 'blank')").groupBy("id", "part", "items_before").agg(*span, F.max(F.col("kind") == "item").alias("real"), _joined(own, " ").alias("item"), numbered.alias("ordered"))
    item = item.filter("real").withColumn("n", F.col("start_line"))
    lists = item.groupBy("id", "part").agg(F.min("section").alias("section"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda s: s["item"]).alias("items"), F.min_by("ordered", "n").alias("ordered"))
    code = shaped(code, "code", language=F.regexp_extract("open", FENCE, 2), content=F.col("body"))
    return code.unionByName(shaped(t, "table", headers=F.col("headers"), n_rows=F.col("n_rows"))).unionByName(shaped(lists, "list", items=F.col("items"), ordered=F.col("ordered")))


def packed(units: list[str], glue: str, size: int, finer) -> list[str]:
    """Units packed greedily up to ``size`` characters; one that is longer is cut by ``finer``, whose last piece goes on being packed."""
    out, held, length = [], [], 0
    for u in units:
        if held and length + len(glue) + len(u) <= size:
            held.append(u)
            length += len(glue) + len(u)
            continue
        if held:
            out.append(glue.join(held))
        if len(u) > size:
            *done, u = finer(u)
            out += done
        held, length = ([u] if u else []), len(u)
    return out + [glue.join(held)] if held else out


def pieces(text: str, size: int) -> list[str]:
    """A section's text: whole if it fits, else by paragraphs, those by sentences, and those in cuts of ``size``."""
    cuts = lambda s: [*(s[i : i + size] for i in range(0, len(s), size)), ""]  # noqa: E731  a cut sentence isn't packed further
    by_sentence = lambda p: packed(re.split(r"(?<=[.!?])\s+", p), " ", size, cuts) or [p[:size]]
    if len(text) <= size:
        return [text]
    return packed([p for p in (q.strip() for q in re.split(r"\n\s*\n", text)) if p], "\n\n", size, by_sentence)


def section_chunks(docs: DataFrame, size: int = 1600) -> DataFrame:
    """P-5: (id, source, content) -> id, chunk_id, n (from 0 in the text), title, level, start_line, end_line, content. The id of a chunk is that of its
    section and its place in it, so that an edit of one section leaves the others' ids. ``size`` is 300 at least; no source counts as ``inline``."""
    size = max(300, int(size))

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda x: pieces(x, size))

    # the source goes along with the id, so that chunks need no join
    source = F.when(F.trim("source") != "", F.col("source")).otherwise("inline")
    s = sections(docs.select(F.struct(F.col("id"), source.alias("source")).alias("id"), "content"))
    s = s.select("id", F.col("n").alias("s"), "section_id", "title", "level", "start_line", "end_line", F.posexplode(cut("content")).alias("i", "content"))
    s = s.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("s", "i")) - 1)
    name = F.concat("id.source", F.lit("#"), "section_id", F.lit("-"), (F.col("i") + 1).cast("string"))
    return s.select("id.id", name.alias("chunk_id"), "n", "title", "level", "start_line", "end_line", "content")
