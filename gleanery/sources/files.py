"""Readers and writers of chunks, memories and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "id string, source string, kind string, content string, certainty double, recency double, teachingValue double, priority double"
KINDS = ["code", "test", "spec", "memory", "doc", "chat", "log"]
IGNORED = ["node_modules", ".git", "dist", "build", "coverage"]
TEXT_FILES = "js|ts|jsx|tsx|mjs|cjs|json|md|mdx|txt|py|go|rs|java|yml|yaml|toml|sql|sh|html|css"


#: Signals of a chunk by its kind (certainty, recency, teachingValue, priority); the last line holds for all other kinds.
SIGNALS = {
    "code": [0.92, 0.75, 0.72, 0.86],
    "test": [0.93, 0.74, 0.8, 0.84],
    "spec": [0.88, 0.7, 0.82, 0.78],
    "log": [0.35, 0.6, 0.1, 0.15],
    "chat": [0.45, 0.5, 0.25, 0.2],
    "doc": [0.7, 0.65, 0.6, 0.55],
}


def default_signals(kind: Column) -> list[Column]:
    """P-20: the four signals of a chunk of which no more is known than its kind."""
    out = []
    for k, name in enumerate(("certainty", "recency", "teachingValue", "priority")):
        value = F.lit(SIGNALS["doc"][k])
        for of, values in SIGNALS.items():
            value = F.when(kind == of, values[k]).otherwise(value)
        out.append(value.alias(name))
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """I-10: chunks of JSON files, checked against the contract; other fields are dropped."""
    return valid_chunks(spark.read.schema(CHUNK).option("multiLine", True).json(path))


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Rows with all strings, a known kind and signals between 0 and 1."""
    ok = F.lit(True)
    for c in ("id", "source", "kind", "content"):
        ok = ok & F.col(c).isNotNull()
    for c in ("certainty", "recency", "teachingValue", "priority"):
        ok = ok & (F.col(c).isNull() | F.col(c).between(0, 1))
    return chunks.filter(ok & F.col("kind").isin(KINDS))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """I-11: malformed lines are skipped."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad IS NULL").drop("_bad")


def is_sensitive(path: Column) -> Column:
    """Names of files that hold secrets."""
    return F.rlike(F.lower(path), F.lit("(^|/)\\.env(\\.|$)|\\.pem$|\\.key$|id_rsa|credentials"))


def is_candidate(path: Column) -> Column:
    """I-2: text files outside ignored folders that don't look sensitive."""
    parts = F.split(path, "/")
    return F.rlike(F.lower(path), F.lit(f"\\.({TEXT_FILES})$")) & ~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))) & ~is_sensitive(path) & ~F.rlike(path, F.lit("\\.min\\.(js|css)$"))


def scan_workspace(spark: SparkSession, root: str, most: int = 200, chars: int = 32_000) -> DataFrame:
    """I-1, I-3: the newest ``most`` candidate files (the limit is the feature), their text up to ``chars``, and kind."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(is_candidate(F.col("path")))
    f = f.orderBy(F.desc("modificationTime"), "path").limit(most)
    return f.select(F.col("path").alias("source"), "modificationTime", file_kind(F.col("path")).alias("kind"), F.substring(F.col("content").cast("string"), 1, chars).alias("content"))


def file_kind(path: Column) -> Column:
    """P-20: kind of a chunk by its path."""
    p = F.lower(path)
    test = F.rlike(p, F.lit("(^|/)(tests?|__tests__)/|\\.(test|spec)\\.[a-z]+$"))
    return F.when(test, "test").when(F.rlike(p, F.lit("(^|/)(specs?|openapi)[/.]")), "spec").when(F.rlike(p, F.lit("\\.log$|(^|/)logs/")), "log").when(F.rlike(p, F.lit("\\.(md|mdx|txt|rst)$")), "doc").otherwise("code")


def head(text: Column, lines: int = 30) -> Column:
    """I-5: the first lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
