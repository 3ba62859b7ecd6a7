"""Gates over source files: imports against rules, deprecated lines, versions, and the status of several tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deprecated code (what a line holds, severity).
DEPRECATED = [
    ("require('request')", "error"),
    ('require("request")', "error"),
    ("new Buffer(", "error"),
    ("process.binding(", "warning"),
]
IMPORT = "import\\s+(?:[^'\"]*\\s+from\\s+)?['\"]([^'\"]+)['\"]"
REQUIRE = "require\\s*\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)"


def glob_pattern(glob: str) -> str:
    """F-14: a glob as a pattern for whole paths, without regard to case: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else f"\\{c}" if c in ".+^${}()|[]\\" else c
        i += 1
    return f"(?i)^{out}$"


def resolved(path: Column, source: Column, depth: int = 8) -> Column:
    """An import path that starts with a dot, relative to the folder of its file; other paths stay. ``depth`` steps up at most are folded."""
    folder = F.regexp_replace(source, "(^|/)[^/]*$", "")
    p = F.concat(folder, F.lit("/"), path)
    p = F.regexp_replace(F.regexp_replace(p, "/(\\./)+", "/"), "^/", "")
    for _ in range(depth):
        p = F.regexp_replace(p, "(^|/)(?!\\.\\./)[^/]+/\\.\\./", "$1")
    return F.when(F.startswith(path, F.lit(".")), p).otherwise(path)


def imports(files: DataFrame) -> DataFrame:
    """(path, content) -> path, line, import: the first import or require of each line."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    one, two = F.regexp_extract("s", IMPORT, 1), F.regexp_extract("s", REQUIRE, 1)
    return lines.select("path", (F.col("line") + 1).alias("line"), F.when(one != "", one).otherwise(two).alias("import")).filter("import <> ''")


def architecture_violations(files: DataFrame, rules: list[dict]) -> DataFrame:
    """G-17, J-8: imports against stated rules: a forbidden ``pattern``, or files ``from`` that import paths ``to``. One row per line and rule that it breaks."""
    i = imports(files).withColumn("target", resolved(F.col("import"), F.col("path")))

    def breaks(r: dict) -> Column:
        out = F.lit(False)
        if r.get("pattern"):
            out = out | F.rlike("import", F.lit(glob_pattern(r["pattern"]))) | F.contains(F.col("import"), F.lit(r["pattern"]))
        if r.get("from") and r.get("to"):
            to = F.lit(glob_pattern(r["to"]))
            out = out | (F.rlike("path", F.lit(glob_pattern(r["from"]))) & (F.rlike("target", to) | F.rlike("import", to)))
        return out

    broken = F.array_compact(F.array(*[F.when(breaks(r), r["id"]) for r in rules])) if rules else F.array().cast("array<string>")
    return i.select("path", "line", "import", F.explode(broken).alias("rule"))


def deprecations(files: DataFrame, patterns: list[tuple[str, str]] = DEPRECATED) -> DataFrame:
    """G-18: lines that hold a deprecated piece of code."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("s"), F.lit(p)), F.struct(F.lit(p).alias("pattern"), F.lit(sev).alias("severity"))) for p, sev in patterns]))
    return lines.select("path", (F.col("line") + 1).alias("line"), F.explode(found).alias("d")).select("path", "line", "d.pattern", "d.severity")


def satisfies(installed: Column, required: Column) -> Column:
    """F-13: whether a version fits ``>=1.2.3``, ``>1.2.3`` or ``<=1.2.3``. What can't be read is taken to fit."""
    number = lambda text, k: F.coalesce(F.regexp_extract(text, "^[><=!]*\\s*(\\d+)\\.(\\d+)\\.(\\d+)", k).try_cast("int"), F.lit(0))
    op = F.regexp_extract(required, "^([><=!]+)\\s*\\d+\\.\\d+\\.\\d+$", 1)
    have, want = (F.array(*[number(x, k) for k in (1, 2, 3)]) for x in (installed, required))
    more, less, same = have > want, have < want, have == want
    return F.when(op == "", True).when(op == ">=", more | same).when(op == ">", more).when(op == "<=", less | same).otherwise(False)


def gate_status(tools: DataFrame) -> DataFrame:
    """G-19: (run, tool, status) -> run, status, passed: fail, else skipped if all are, else degraded, else pass."""
    g = tools.groupBy("run").agg(F.max((F.col("status") == "fail").cast("int")).alias("f"), F.min((F.col("status") == "skipped").cast("int")).alias("s"), F.max((F.col("status") == "degraded").cast("int")).alias("d"))
    status = F.when(F.col("f") == 1, "fail").when(F.col("s") == 1, "skipped").when(F.col("d") == 1, "degraded").otherwise("pass")
    return g.select("run", status.alias("status"), status.isin("pass", "skipped").alias("passed"))
