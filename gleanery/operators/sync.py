"""H-18: synchronising files into a store of chunks, run by run.

A store is a folder of tables (``files``, ``manifest``, ``chunks``, ``versions``, ``duplicates``). A run appends its rows to each under
``seq=N``, in as many rows as files have changed, and counts only from the moment that its line in ``commits`` is there, which is
written last. A run that died before is not seen by any reader, and the next one writes over it under the same number. Readers take the newest
row of a key among the runs that are committed. ``compact`` puts what is current into one run, from which readers start.
A store has one writer at a time.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import stored
from gleanery.functions import text as T
from gleanery.operators import guards, parsing, structure
from gleanery.operators.observe import latest
from gleanery.sources import files as paths

#: Files that are taken in, by extension or name, and the similarity of near duplicates.
EXTENSIONS = ["js", "mjs", "cjs", "ts", "tsx", "go", "py", "json", "log", "md", "txt", "toml", "yaml", "yml"]
NAMES = ["README.md", "AGENTS.md", "agents.md", "package.json"]
NEAR = 0.82

TABLES = {
    "files": "source string, hash string, size long, change string, gone boolean, owner long",
    "manifest": "source string, chunk_id string, checksum string",
    "chunks": "id string, source string, kind string, content string, certainty double, recency double, teachingValue double, priority double, topic string, domain string, checksum string, gone boolean",
    "versions": "chunk_id string, source string, version long, checksum string, kind string",
    "duplicates": "chunk_id string, source string, duplicate_of string, reason string",
}
#: What a run counts, in the order of its report.
COUNTS = ["discovered", "created", "changed", "deleted", "unchanged", "files_changed", "files_skipped", "chunks_processed", "chunks_persisted", "chunks_created", "chunks_updated", "chunks_unchanged", "chunks_tombstoned", "duplicates_detected", "redactions_applied"]


def supported(source: Column) -> Column:
    name = F.element_at(F.split(source, "/"), -1)
    return name.isin(NAMES) | F.rlike(name, F.lit(f"[^.].*\\.({'|'.join(EXTENSIONS)})$"))


def kind_of(source: Column) -> Column:
    """Kind of a file's chunks by its path."""
    ext = F.rlike(source, F.lit("\\.(js|mjs|cjs|ts|tsx|go|py)$"))
    spec = F.startswith(source, F.lit("docs/")) | source.isin(NAMES)
    test = F.startswith(source, F.lit("test/")) | F.contains(source, F.lit(".test.")) | F.contains(source, F.lit(".spec."))
    return F.when(F.contains(source, F.lit("/logs/")) | F.endswith(source, F.lit(".log")), "log").when(F.contains(source, F.lit("/chat/")), "chat").when(test, "test").when(spec, "spec").when(ext, "code").otherwise("doc")


@dataclass
class Report:
    """``seq`` is null if nothing had changed, so that nothing was written."""

    status: str
    seq: int | None
    summary: dict[str, int]
    errors: list[str] = field(default_factory=list)


class Store:
    """A store at ``target``, a folder that all of the cluster sees."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target

    def commits(self) -> list[dict]:
        """The committed runs that count, oldest first: all, or those from the last compaction on."""
        try:
            rows = self.spark.read.schema("line string").text(f"{self.target}/commits").collect()  # a line per run
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        runs = sorted((json.loads(r.line) for r in rows), key=lambda r: r["seq"])
        base = max((k for k, r in enumerate(runs) if r["base"]), default=0)
        return runs[base:]

    def read(self, table: str, runs: list[dict]) -> DataFrame:
        """All rows of ``runs``, with ``seq``."""
        if not runs:
            return self.spark.createDataFrame([], f"{TABLES[table]}, seq long")
        parts = [f"{self.target}/{table}/seq={r['seq']}" for r in runs]
        return self.spark.read.schema(f"{TABLES[table]}, seq long").option("basePath", f"{self.target}/{table}").parquet(*parts)

    def write(self, table: str, seq: int, rows: DataFrame) -> DataFrame:
        columns = [c.split(" ")[0] for c in TABLES[table].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.target}/{table}/seq={seq}")
        return self.read(table, [{"seq": seq}])

    def commit(self, seq: int, summary: dict[str, int], base: bool = False) -> None:
        line = json.dumps({"seq": seq, "base": base, **summary})
        self.spark.createDataFrame([(line,)], "line string").coalesce(1).write.mode("overwrite").text(f"{self.target}/commits/seq={seq}")

    def files(self, runs: list[dict] | None = None) -> DataFrame:
        """(source, hash, size, owner): files that are there; owner: the run that wrote a file's manifest."""
        rows = latest(self.read("files", self.commits() if runs is None else runs), "source", "seq")
        return rows.filter("NOT gone").select("source", "hash", "size", "owner")

    def manifest(self, runs: list[dict] | None = None) -> DataFrame:
        """(source, chunk_id, checksum) of files that are there."""
        runs = self.commits() if runs is None else runs
        owners = self.files(runs).select("source", F.col("owner").alias("seq"))
        return self.read("manifest", runs).join(owners, ["source", "seq"]).select("source", "chunk_id", "checksum")

    def chunks(self, runs: list[dict] | None = None) -> DataFrame:
        return latest(self.read("chunks", self.commits() if runs is None else runs), "id", "seq").filter("NOT gone").drop("gone", "seq")

    def versions(self, runs: list[dict] | None = None) -> DataFrame:
        """The whole history (chunk_id, source, version, checksum, kind)."""
        return self.read("versions", self.commits() if runs is None else runs).drop("seq")


def _doubled(chunks: list[tuple]) -> list[tuple]:
    """The duplicates among a file's chunks (source, id, kind, checksum, tokens), in order: copies of a kept chunk, and chunks of one kind with a Jaccard similarity of NEAR or more to one.

    Only chunks that share one of their rarest words are compared: so many of these that two similar ones must share one.
    """
    if len(chunks) < 2:
        return []
    sets = [set(c[4].tolist()) for c in chunks]
    often = Counter(w for s in sets for w in s)
    copies: dict[str, str] = {}
    index: dict[tuple[str, int], list[int]] = {}
    out = []
    for k, ((source, i, kind, checksum, _), s) in enumerate(zip(chunks, sets, strict=True)):
        of, reason = copies.get(checksum), "exact"
        prefix = sorted(s, key=lambda w: (often[w], w))[: len(s) - math.ceil(NEAR * len(s)) + 1]
        if of is None:
            near = sorted({j for w in prefix for j in index.get((kind, w), ())})
            first = next((j for j in near if len(s & sets[j]) / len(s | sets[j]) >= NEAR), None)
            of, reason = (chunks[first][1], "near") if first is not None else (None, "")
        if of is not None:
            out.append((i, source, of, reason))
            continue
        copies[checksum] = i
        for w in prefix:
            index.setdefault((kind, w), []).append(k)
    return out


def _file_by_file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_doubled`` of each file; its chunks follow one another, over ends of batches as well."""
    columns = ["chunk_id", "source", "duplicate_of", "reason"]
    held: list[tuple] = []
    for pdf in batches:
        out = []
        for c in zip(*[pdf[k] for k in ("source", "id", "kind", "checksum", "tokens")], strict=True):
            if held and held[0][0] != c[0]:
                out += _doubled(held)
                held = []
            held.append(c)
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(_doubled(held), columns=columns)


def doubled(chunks: DataFrame) -> DataFrame:
    """H-1 of each file on its own: chunks (id, n, source, kind, checksum, content) -> chunk_id, source, duplicate_of, reason. A file has been one row, so that
    its chunks are no more than a task can hold; they come as hashes of their words. Files are many and small, and so go through a task in batches and not each on its own."""
    words = F.transform(F.array_distinct(T.sync_tokens(F.col("content"))), lambda w: F.xxhash64(w))
    c = chunks.select("id", "n", "source", "kind", "checksum", words.alias("tokens")).repartition("source").sortWithinPartitions("source", "n")
    return c.mapInPandas(_file_by_file, TABLES["duplicates"])


def run(spark: SparkSession, files: DataFrame, target: str, size: int = 1800) -> Report:
    """One run over ``files`` (source, content; a source once): what has changed is redacted, chunked, freed of duplicates within its file, versioned and
    stored, and chunks that a file no longer has are marked as gone.

    A file without content (null) could not be read: it is an error, and what is stored of it stays. Files of other kinds, and ones whose name says that they
    hold secrets, are noted as seen and keep what is stored. A chunk that comes back after it was gone is stored again, as a new version only if its
    text is another. The same files again change nothing and write nothing.
    """
    store = Store(spark, target)
    runs = store.commits()
    seq = runs[-1]["seq"] + 1 if runs else 1
    before = store.files(runs)
    now = files.select("source", "content", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))
    was = before.select(F.col("source").alias("was"), F.col("hash").alias("old"), F.col("owner").alias("old_owner"))
    j = now.join(was, now.source == was.was, "full_outer")
    change = F.when(F.col("source").isNull(), "deleted").when(F.col("content").isNull(), "failed").when(F.col("was").isNull(), "created").when(F.col("hash") == F.col("old"), "unchanged").otherwise("changed")
    source = F.coalesce("source", "was")
    taken = F.when(~supported(source), "unsupported").when(paths.is_sensitive(source), "sensitive").otherwise("taken")
    # one reading of the files, from which all that follows is made
    j = j.select(source.alias("source"), "hash", "size", change.alias("change"), "old_owner", taken.alias("how"), "content")
    clean = F.when(F.col("change").isin("created", "changed") & (F.col("how") == "taken"), guards.redact_secrets(F.col("content")))
    work, work_path = stored.written(j.withColumn("clean", clean).drop("content"))
    seen = {(r.change, r.how): (r["count"], r.marks or 0) for r in work.groupBy("change", "how").agg(F.count("*").alias("count"), F.sum(F.regexp_count("clean", F.lit("\\[REDACTED"))).alias("marks")).collect()}
    count = lambda *kinds, how=None: sum(n for (c, h), (n, _) in seen.items() if c in kinds and (how is None or h in how))
    s = dict.fromkeys(COUNTS, 0) | {k: count(k) for k in ("created", "changed", "deleted", "unchanged")}
    s["discovered"] = count("created", "changed", "unchanged", "failed")
    s["files_changed"] = s["created"] + s["changed"] + s["deleted"]
    s["files_skipped"] = s["unchanged"] + count("created", "changed", how=("unsupported", "sensitive"))
    s["redactions_applied"] = sum(m for _, m in seen.values())
    errors = [f"sync-read-failed:{r.source}" for r in work.filter("change = 'failed'").select("source").orderBy("source").limit(100).collect()]  # a report's limit
    if not s["files_changed"]:
        stored.drop(spark, work_path)
        return Report("error" if errors else "ok", None, s, errors)

    fresh = work.filter("change IN ('created', 'changed') AND how = 'taken'")
    own = F.when(F.col("change") == "deleted", F.lit(None)).when(F.col("how") == "taken", F.lit(seq)).otherwise(F.col("old_owner"))
    touched = work.filter("change IN ('created', 'changed', 'deleted')")
    store.write("files", seq, touched.select("source", "hash", "size", "change", (F.col("change") == "deleted").alias("gone"), own.cast("long").alias("owner")))

    c = structure.section_chunks(fresh.select(F.col("source").alias("id"), "source", F.col("clean").alias("content")), size)
    c = c.select(F.concat("id", F.lit("::"), F.col("n").cast("string")).alias("id"), "n", F.col("id").alias("source"), structure.stripped(F.col("content")).alias("content")).filter("content <> ''")
    cand, cand_path = stored.written(c.withColumn("checksum", F.sha2(F.col("content").cast("binary"), 256)).withColumn("kind", kind_of(F.col("source"))))
    doubles = store.write("duplicates", seq, doubled(cand))
    unique = cand.join(doubles.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    kept = store.write("manifest", seq, unique.select("source", F.col("id").alias("chunk_id"), "checksum"))

    last = store.versions(runs).groupBy(F.col("chunk_id").alias("id")).agg(F.max_by(F.struct("version", "checksum"), "version").alias("last"))
    there = store.chunks(runs).select("id", F.lit(True).alias("there"))
    j = unique.join(last, "id", "left").join(there, "id", "left")
    same = F.coalesce(F.col("last.checksum") == F.col("checksum"), F.lit(False))
    new = store.write("versions", seq, j.filter(~same).select(F.col("id").alias("chunk_id"), "source", (F.coalesce("last.version", F.lit(0)) + 1).alias("version"), "checksum", "kind"))
    put = parsing.tagged(j.filter(~same | F.col("there").isNull()).select("id", "source", "kind", "content", "checksum"))
    put = put.select("*", *paths.default_signals(F.col("kind")), F.lit(False).alias("gone"))
    old = store.read("manifest", runs).join(touched.filter("change = 'deleted' OR how = 'taken'").select("source", F.col("old_owner").alias("seq")), ["source", "seq"]).select(F.col("chunk_id").alias("id"), "source")
    gone = old.join(kept.select(F.col("chunk_id").alias("id")), "id", "left_anti").join(there, "id", "left_semi").withColumn("gone", F.lit(True))
    stale = store.write("chunks", seq, put.unionByName(gone, allowMissingColumns=True))

    by = {r.gone: r["count"] for r in stale.groupBy("gone").count().collect()}
    first = new.agg(F.count_if(F.col("version") == 1).alias("created"), F.count_if(F.col("version") > 1).alias("updated")).first()
    s["chunks_processed"], s["duplicates_detected"] = cand.count(), doubles.count()
    s["chunks_created"], s["chunks_updated"] = first.created, first.updated
    s["chunks_unchanged"] = s["chunks_processed"] - s["duplicates_detected"] - first.created - first.updated
    s["chunks_persisted"], s["chunks_tombstoned"] = by.get(False, 0), by.get(True, 0)
    store.commit(seq, s)
    stored.drop(spark, work_path, cand_path)
    return Report("partial" if errors else "ok", seq, s, errors)


def compact(spark: SparkSession, target: str) -> int | None:
    """What is current, and the history of versions, as one run, from which readers start; earlier runs may be deleted once no reader has them open."""
    store = Store(spark, target)
    runs = store.commits()
    if len(runs) < 2:
        return None
    seq = runs[-1]["seq"] + 1
    store.write("files", seq, store.files(runs).select("source", "hash", "size", F.lit("kept").alias("change"), F.lit(False).alias("gone"), F.when(F.col("owner").isNotNull(), F.lit(seq)).cast("long").alias("owner")))
    store.write("manifest", seq, store.manifest(runs))
    store.write("chunks", seq, store.chunks(runs).withColumn("gone", F.lit(False)))
    store.write("versions", seq, store.versions(runs))
    store.write("duplicates", seq, store.read("duplicates", runs))
    store.commit(seq, {}, base=True)
    return seq
