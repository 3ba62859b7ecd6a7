"""P-19: symbols of JavaScript and TypeScript files: declarations with their lines, and the edges between names.

A file is scanned once, in the task that reads it: strings, templates and comments are one token each, so that nothing within them counts, and what leaves
the scan is a row per statement, and per member of a class, with the tokens of its own level in one line. Nothing is shuffled for that, and bodies of functions
go nowhere. What a statement is, and what it names, are column expressions over these lines.

Limits, as there is no compiler: a literal regular expression is read as single characters, so that quotes and brackets in one are not seen as its own;
a template within a template ends the outer one; destructured variables have no declaration.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery import batches, stored

#: Rows of statements after which they leave the worker, once their file ends.
MOST_ROWS = 5000

LANGUAGES = {"typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"]}
#: How many imports, exports, public names, hints and declarations a file's summary holds, and declarations of a chunk's.
CAPS = {"imports": 12, "exports": 12, "public_surface": 12, "dependency_hints": 16, "declarations": 24}
CHUNK_DECLARATIONS = 8
TOKEN = (
    "/\\*[\\s\\S]*?(?:\\*/|$)|//[^\\n]*|`[^`\\\\]*(?:\\\\[\\s\\S][^`\\\\]*)*`?|\"[^\"\\\\\\n]*(?:\\\\[\\s\\S][^\"\\\\\\n]*)*\"?|'[^'\\\\\\n]*(?:\\\\[\\s\\S][^'\\\\\\n]*)*'?"
    "|#?[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|=>|\\n\\s*|[^\\s]"
)
NAME = "^[#A-Za-z_$\"'`]"
ENDS = "^[#A-Za-z0-9_$\"'`)\\]}]"
#: Words that go on with what stands before them, and words after which a line's end ends nothing.
CONTINUES = ["else", "catch", "finally", "while", "from", "as", "of", "in", "instanceof", "extends", "implements", "satisfies"]
OPEN_ENDED = [
    "export", "default", "async", "class", "extends", "implements", "const", "let", "var", "import", "from", "function", "type", "interface", "enum", "abstract", "declare", "override",
    "public", "private", "protected", "static", "readonly", "new", "of", "in", "as", "get", "set", "typeof", "instanceof",
]


def language(source: Column) -> Column:
    ext = F.lower(F.regexp_extract(source, "\\.([A-Za-z]+)$", 1))
    return F.when(ext.isin(LANGUAGES["typescript"]), "typescript").when(ext.isin(LANGUAGES["javascript"]), "javascript")


_TOKEN, _NAME_LIKE, _ENDS, _FRESH = (re.compile(p, re.A) for p in (TOKEN, NAME, ENDS, "^[#A-Za-z_$\"'`@*\\[]"))
Token = tuple[str, int, int, int, int]  # text, place, first and last line, level: brackets around it (of a bracket: around both of the pair)


def _tokens(text: str) -> Iterator[Token]:
    line, depth = 1, 0
    for n, m in enumerate(_TOKEN.finditer(text)):
        t = m[0]
        end = line + t.count("\n")
        if not t.startswith(("\n", "//", "/*")):
            depth -= t in "})]"
            yield t, n, line, end, depth
            depth += t in "{(["
        line = end


def _begins(last: Token | None, t: Token) -> bool:
    """Whether a token begins a new statement or member after the one before it of the same level."""
    if last is None or last[0] == ";":
        return True
    fresh_line = t[2] > last[3] and _FRESH.match(t[0]) and _ENDS.match(last[0]) and last[0] not in OPEN_ENDED
    after_block = last[0] == "}" and (_NAME_LIKE.match(t[0]) or t[0] == "@")
    return bool((fresh_line or after_block) and t[0] not in CONTINUES)


def _pieces(tokens: Iterable[Token], level: int) -> Iterator[list[Token]]:
    """Tokens in pieces, each of which begins with one of ``level``."""
    last, now = None, []
    for t in tokens:
        if t[4] == level:
            if _begins(last, t) and now:
                yield now
                now = []
            last = t
        now.append(t)
    if now:
        yield now


def _line(tokens: Iterable[Token]) -> str:
    return " ".join(t[0] for t in tokens)


def _variables(own: list[Token]) -> list[dict]:
    """Names after the keyword or a comma of the statement's own level, each with the lines up to the next one."""
    ahead = [*own[1:], None]
    starts = [k for k in range(1, len(own)) if own[k - 1][0] in ("const", "let", "var", ",") and re.match("[A-Za-z_$]", own[k][0]) and (ahead[k] is None or ahead[k][0] in ("=", ":", ",", ";", "!", "of", "in"))]
    out = []
    for k, to in pairwise([*starts, len(own) + 1]):
        mine = [t for t in own[k : to - 1] if t[0] != ";"]
        out.append({"name": own[k][0], "n": own[k][1], "start_line": own[k][2], "end_line": max(t[3] for t in mine)})
    return out


VARIABLES = "array<struct<name:string,n:long,start_line:long,end_line:long>>"


def statements(files: DataFrame) -> DataFrame:
    """(id, content) -> id, n (place of its first token), sign (its tokens of its own level), full (all tokens, of imports and re-exports), owner (the sign of its class, of a
    member), start_line, end_line, variables."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, text in zip(pdf["id"], pdf["content"], strict=True):
                if len(rows) >= MOST_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
                for s in _pieces(_tokens(re.sub("\r\n?", "\n", text or "")), 0):
                    own = [t for t in s if t[4] == 0]
                    sign = _line(own)
                    words = sign.split(" ", 6)
                    whole = words[0] == "import" or words[0] == "export" and any(w in "{*" for w in words[1:3])
                    names = _variables(own) if {"const", "let", "var"} & set(words[:5]) else []
                    rows.append((i, s[0][1], sign, _line(s) if whole else None, None, s[0][2], s[-1][3], names))
                    if "class" in words[:5]:
                        for m in _pieces((t for t in s if t[4] >= 1), 1):
                            rows.append((i, m[0][1], _line(t for t in m if t[4] == 1), None, sign, m[0][2], m[-1][3], []))
            yield pd.DataFrame(rows, columns=columns)

    columns = ["id", "n", "sign", "full", "owner", "start_line", "end_line", "variables"]
    kind = files.schema["id"].dataType.simpleString()
    return batches.small(files.select("id", "content")).mapInPandas(run, f"id {kind}, n long, sign string, full string, owner string, start_line long, end_line long, variables {VARIABLES}")


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, "^[\"'`]|[\"'`]$", "")


_EXPORT = "^(export )?(?:default )?(?:declare )?"
_WORD = "([A-Za-z_$][A-Za-z0-9_$]*)"
#: How statements of a kind begin; the last group is the name.
KINDS = {
    "function": _EXPORT + "(?:async )?function (?:\\* )?" + _WORD, "class": _EXPORT + "(?:abstract )?class (?!extends |implements )" + _WORD, "interface": _EXPORT + "interface " + _WORD,
    "type": _EXPORT + "type " + _WORD + " (?:<|=)", "enum": _EXPORT + "(?:const )?enum " + _WORD,
}
VARIABLE = _EXPORT + "(?:const|let|var) (?!enum )"
METHOD = "^(?:@ [A-Za-z0-9_$. ]+(?:\\( \\) )?)*((?:(?:public|private|protected|static|async|abstract|override|readonly|declare|\\*) )*)(#?[A-Za-z_$][A-Za-z0-9_$]*|\"[^\"]*\"|'[^']*') (?:[?!] )?(?:< .*> )?\\( \\)(?: .*)?$"


def _first(kinds: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(kinds.items()):
        out = F.when(F.rlike("sign", F.lit(p)), k).otherwise(out)
    return out


def _name(kind: str, sign: str = "sign") -> Column:
    return F.regexp_extract(sign, KINDS[kind], 2)


def _bare(types: Column) -> Column:
    """Without what stands in angle brackets, four deep."""
    for _ in range(4):
        types = F.regexp_replace(types, "<[^<>]*> ?", "")
    return types


def _names(types: Column) -> Column:
    return F.filter(F.transform(F.split(types, ","), lambda x: F.regexp_replace(F.trim(x), " ?\\. ?", ".")), lambda x: x != "")


def declarations(files: DataFrame) -> DataFrame:
    """(id, content) -> id, ord, name, kind, exported, visibility, parent, start_line, end_line, is_async, extends, implements: functions, classes and their
    methods (constructors and accessors are none), interfaces, types, enums and variables of the outermost level. ``ord`` orders them within a file."""
    s = statements(files).withColumn("kind", _first(KINDS)).withColumn("whole", F.col("owner").isNull())
    outer = F.rlike("sign", F.lit("^export "))
    types = {"ord": "long", "name": "string", "kind": "string", "exported": "boolean", "visibility": "string", "parent": "string", "start_line": "long", "end_line": "long", "is_async": "boolean", "extends": "array<string>", "implements": "array<string>"}
    row = lambda **own: F.struct(*[own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in types.items()])
    lines = {"ord": F.col("n"), "start_line": F.col("start_line"), "end_line": F.col("end_line")}
    name = F.coalesce(*[F.when(F.col("kind") == k, _name(k)) for k in KINDS])
    is_class = F.col("kind") == "class"
    head = _bare(F.regexp_extract("sign", "^(.*?)(?:\\{ \\}|$)", 1))
    clause = lambda a, b: F.when(is_class, _names(F.regexp_extract(head, a, b)))
    is_async = F.when(F.col("kind") == "function", F.rlike("sign", F.lit("^(?:export )?(?:default )?async ")))
    top = row(name=name, kind=F.col("kind"), exported=outer, visibility=F.lit("module"), is_async=is_async, extends=clause(" extends (.*?)(?: implements .*)?$", 1), implements=clause(" implements (.*)$", 1), **lines)
    variable = lambda v: row(name=v["name"], kind=F.lit("variable"), exported=outer, visibility=F.lit("module"), ord=v["n"], start_line=v["start_line"], end_line=v["end_line"])
    sign = F.regexp_replace("sign", " ;$", "")
    method, mods = F.regexp_extract(sign, METHOD, 2), F.split(F.regexp_extract(sign, METHOD, 1), " ")
    seen = F.when(F.array_contains(mods, "private"), "private").when(F.array_contains(mods, "protected"), "protected").when(F.array_contains(mods, "public"), "public").otherwise("module")
    member = row(name=method, kind=F.lit("method"), exported=seen.isin("public", "module"), visibility=seen, parent=_name("class", "owner"), is_async=F.array_contains(mods, "async"), **lines)
    is_method = F.rlike("owner", F.lit(KINDS["class"])) & F.rlike(sign, F.lit(METHOD)) & (method != "constructor")
    # one scan: a row has what it declares as a list
    of_whole = F.when(F.col("kind").isNotNull(), F.array(top)).when(F.rlike("sign", F.lit(VARIABLE)), F.transform("variables", variable))
    found = F.when(F.col("whole"), of_whole).when(is_method, F.array(member))
    return s.select("id", F.explode(found).alias("d")).select("id", "d.*")


_FROM = "(?:from )?([\"'][^\"']*[\"'])"


def imports(files: DataFrame) -> DataFrame:
    """(id, content) -> id, ord, source, bindings, locals, type_only: import statements; ``locals`` are the names that they bind."""
    x = statements(files).filter(F.col("owner").isNull() & F.rlike("sign", F.lit("^import (?!\\(|\\.)"))).select("id", "full", F.col("n").alias("ord"))
    part = lambda p: F.regexp_extract("full", p, 1)
    one, space = part("^import (?:type )?" + _WORD + " (?:,|from )"), part("\\* as " + _WORD)
    listed = F.filter(F.transform(F.split(part("\\{ (.*?) ?\\}"), " ?, ?"), lambda b: F.regexp_replace(F.trim(b), "^type ", "")), lambda b: b != "")
    some = lambda c, v: F.when(c != "", F.array(v)).otherwise(F.array().cast("array<string>"))
    return x.select(
        "id", "ord", _unquoted(part(_FROM + "(?: with .*| assert .*)?(?: ;)?$")).alias("source"), F.concat(some(one, one), some(space, F.concat(F.lit("* as "), space)), listed).alias("bindings"),
        F.concat(some(one, one), some(space, space), F.transform(listed, lambda b: F.regexp_replace(b, "^.* as ", ""))).alias("locals"), F.rlike("full", F.lit("^import type (?!from |,)")).alias("type_only"),
    )


def re_exports(files: DataFrame) -> DataFrame:
    """(id, content) -> id, ord, names, source: ``export { a, b as c } from "x"`` and ``export * from "x"``; no source is null."""
    x = statements(files).filter(F.col("owner").isNull() & F.rlike("sign", F.lit("^export (?:type )?(?:\\{|\\*)"))).select("id", "full", F.col("n").alias("ord"))
    listed = F.filter(F.transform(F.split(F.regexp_extract("full", "\\{ (.*?) ?\\}", 1), " ?, ?"), lambda b: F.regexp_replace(F.trim(b), "^(?:.* as |type )", "")), lambda b: b != "")
    return x.select("id", "ord", listed.alias("names"), F.nullif(_unquoted(F.regexp_extract("full", "from ([\"'][^\"']*[\"'])", 1)), F.lit("")).alias("source"))


def edges(files: DataFrame) -> DataFrame:
    """(id, content) -> id, ord, source, target, kind: what a file or one of its names leans on: imports, re-exports, extends, implements, and member (of a class)."""
    d = declarations(files)
    up = lambda c: d.select("id", "ord", F.col("name").alias("source"), F.explode(c).alias("target"), F.lit(c).alias("kind"))
    own = d.filter("parent IS NOT NULL").select("id", "ord", F.col("name").alias("source"), F.col("parent").alias("target"), F.lit("member"))
    whole = lambda x, kind: x.filter("source IS NOT NULL").select("id", "ord", F.lit(None).cast("string"), "source", F.lit(kind))
    return up("extends").union(up("implements")).union(own).union(whole(imports(files), "imports")).union(whole(re_exports(files), "re-exports"))


def summary(files: DataFrame) -> DataFrame:
    """(id, source, content) -> id, language, imports, exports, public_surface, dependency_hints (in the order of the file, each once, as many as CAPS says), n_declarations.
    Files of other languages have none."""
    files = files.withColumn("language", language(F.col("source"))).filter("language IS NOT NULL")
    d, i, r = declarations(files), imports(files), re_exports(files)
    first = d.select("id", "ord", "name", "exported", "parent", "kind", F.row_number().over(W.partitionBy("id").orderBy("ord")).alias("_n")).filter(F.col("_n") <= CAPS["declarations"])

    def listed(name: str, *parts: DataFrame) -> DataFrame:
        """parts: (id, ord, k, value)"""
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        once = every.filter("value <> ''").groupBy("id", "value").agg(F.min(F.struct("ord", "k")).alias("at"))
        once = once.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("at"))).filter(F.col("_n") <= CAPS[name])
        return once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias(name))

    at = lambda x, k, v: x.select("id", "ord", F.lit(k).alias("k"), v.alias("value"))
    spread = lambda x, k, c: x.select("id", "ord", F.posexplode(c).alias("p", "value")).select("id", "ord", (F.col("p") + k).alias("k"), "value")
    seen = first.filter("exported")
    surface = [at(seen, 0, F.col("name")), at(seen.filter("kind = 'method'"), 1, F.concat_ws(".", "parent", "name")), spread(r, 0, "names")]
    d24 = d.join(first.select("id", "ord"), ["id", "ord"], "left_semi")
    hints = [spread(i, 0, "locals"), at(i, 1000, F.col("source")), at(r, 0, F.coalesce("source", F.lit(""))), at(first, 0, F.coalesce("parent", F.lit(""))), spread(d24, 1, "extends"), spread(d24, 1000, "implements")]
    out = files.select("id", "language").join(first.groupBy("id").agg(F.count("*").alias("n_declarations")), "id", "left")
    for part in (listed("imports", at(i, 0, F.col("source"))), listed("exports", at(seen, 0, F.col("name")), spread(r, 0, "names")), listed("public_surface", *surface), listed("dependency_hints", *hints)):
        out = out.join(part, "id", "left")
    return out.select("id", "language", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("imports", "exports", "public_surface", "dependency_hints")], F.coalesce("n_declarations", F.lit(0)).alias("n_declarations"))


def of_chunks(found: DataFrame, chunks: DataFrame, block: int = 64) -> DataFrame:
    """Declarations (id, ord, name, start_line, end_line) of chunks (id, chunk_id, start_line, end_line) whose lines they share: chunk_id, n, name, the first
    ``CHUNK_DECLARATIONS`` of each. Lines are listed in blocks, which makes an equi-join of the range join; a chunk without lines (start 0) takes all of its file.
    Both sides are written once, as both joins read them: files are scanned once."""
    blocks = lambda a, b: F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block))
    d = stored.table(found.select("id", "ord", "name", F.col("start_line").alias("a"), F.col("end_line").alias("b")))
    chunks = stored.table(chunks.select("id", "chunk_id", "start_line", "end_line"))
    ranged = chunks.filter("start_line > 0 AND end_line >= start_line").select("id", "chunk_id", F.col("start_line").alias("x"), F.col("end_line").alias("y"))
    j = d.withColumn("block", F.explode(blocks("a", "b"))).join(ranged.withColumn("block", F.explode(blocks("x", "y"))), ["id", "block"])
    j = j.filter("a <= y AND b >= x").filter(F.col("block") == F.greatest(F.floor(F.col("a") / block), F.floor(F.col("x") / block))).select("chunk_id", "ord", "name")
    whole = chunks.filter("NOT (start_line > 0 AND end_line >= start_line)").select("id", "chunk_id").join(d, "id").select("chunk_id", "ord", "name")
    n = F.row_number().over(W.partitionBy("chunk_id").orderBy("ord"))
    return j.union(whole).select("chunk_id", n.alias("n"), "name").filter(F.col("n") <= CHUNK_DECLARATIONS)
