"""Merkle manifest of a dataset: a tree per source over its documents, and a tree over the sources.

A parent stores its preimage, the concatenated digests of its children (64 characters each). A leaf joins the preimages of all its
ancestors. For its proof it excises its own slot from each of them, which leaves the siblings; to fold, it splices its digest into the slot,
hashes, and goes on with the next preimage.

Nothing depends on the size of a source: leaves are numbered in two levels (by range partitions, then within each),
a parent has at most ``FAN`` children, and a preimage meets its ancestors before it meets its children, so that what is shuffled per document
is about a sixteenth of its path. All is in DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.llm import tables

FAN = 16
#: Characters of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<preimage:string,slot:int>>"


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row; ``text`` takes the place of its text."""
    return sha(F.concat(*[encoded(text if c == "text" and text is not None else F.col(c)) for c in FIELDS]))


def tampered() -> Column:
    """Digest of the row with its text's A-Z lower-cased, where 5 divides the crc32 of its doc_id; else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf_digest(F.translate("text", _UPPER, _LOWER)))


def ranked(df: DataFrame, by: list[str]) -> tuple[DataFrame, str]:
    """``df`` with ``rank`` (long, from 0) in the order of ``by``, written. Ranges of rows are sorted on their own, and each begins where those before end."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    out, path = tables.written(ordered)
    part = F.shiftright("at", 33).alias("part")
    sizes = out.groupBy(part).agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row per partition
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", (before - F.col("first")).alias("shift")))
    return out.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift"), path


def _above(idx: str = "idx") -> Column:
    return F.expr(f"{idx} div {FAN}")


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Preimages (tree, idx, n, preimage) level by level, and the roots (tree, hash), of nodes (tree, idx, n, hash); n: nodes of the tree at that level."""
    levels, current = [], nodes
    roots = nodes.filter("n = 1").select("tree", "hash")
    while most > 1:
        most = -(-most // FAN)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")
        up = current.filter("n > 1").groupBy("tree", _above().alias("above")).agg(F.max("n").alias("n"), joined.alias("preimage"))
        levels.append(tables.table(up.select("tree", F.col("above").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "preimage")))
        current = levels[-1].select("tree", "idx", "n", sha(F.col("preimage")).alias("hash"))
        roots = roots.union(current.filter("n = 1").select("tree", "hash"))
    return levels, roots


def _paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` (tree, idx, n, ...) with ``path``, the preimages above each, lowest first, each with the slot in it, and the other columns of ``tops``.

    ``tops`` (tree, path, ...) has what lies above the root of a tree. Going down, each preimage gets its own path from its parent.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]

    def below(rows: DataFrame, parents: DataFrame | None) -> DataFrame:
        at_top = rows.filter("n = 1").join(tops, "tree")
        if parents is None:
            return at_top
        p = parents.select("tree", F.col("idx").alias("above"), F.col("preimage").alias("over"), F.col("path").alias("rest"), *more)
        inner = rows.filter("n > 1").withColumn("above", _above()).join(p, ["tree", "above"])
        step = F.struct(F.col("over").alias("preimage"), (F.col("idx") % FAN).cast("int").alias("slot"))
        return at_top.unionByName(inner.withColumn("path", F.concat(F.array(step), F.col("rest"))).drop("above", "over", "rest"))

    parents = None
    for rows in reversed(levels):
        parents = below(rows, parents)
    return below(nodes, parents)


def _around(step: Column) -> tuple[Column, Column]:
    """What stands before and after the own slot of a preimage."""
    at = step["slot"] * DIGEST
    return F.substr(step["preimage"], F.lit(1), at), F.substr(step["preimage"], at + DIGEST + 1)


def siblings(path: Column) -> Column:
    """All sibling digests from the lowest level up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(*_around(s))), "")


def fold(path: Column, leaf: Column) -> Column:
    """The root that follows from ``leaf``: its digest is spliced into each preimage in turn, and the result is hashed."""

    def step(acc: Column, s: Column) -> Column:
        before, after = _around(s)
        return sha(F.concat(before, acc, after))

    return F.aggregate(path, leaf, step)


@dataclass
class Manifest:
    """``leaves``: doc_id, source, leaf, changed, tree (number of the source), idx (in its source), n, path, subroot. ``preimages``: level, tree, idx,
    preimage of the trees of sources, ``top_preimages`` of the tree over them. ``root`` is null without documents."""

    leaves: DataFrame
    preimages: DataFrame
    top_preimages: DataFrame
    root: str | None


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; others are not read). ``changed``: another digest per row, or null, that is carried along.

    Nulls in any column count as the value ``-``; null sources are one tree, the first. Null doc_ids come first within a source. Rows with one
    doc_id and source are ordered by digest, and repeated rows are leaves each. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    hashed, path = tables.written(docs.select("doc_id", "source", leaf_digest().alias("leaf"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"), F.monotonically_increasing_id().alias("row")))
    rows, _ = ranked(hashed, ["source", "doc_id", "leaf", "row"])
    tables.drop(spark, path)
    sources, _ = ranked(rows.groupBy(F.col("source").alias("of")).agg(F.min("rank").alias("first"), F.count("*").alias("n")), ["first"])
    sources = tables.bounded(sources.withColumnRenamed("rank", "tree"))
    leaves = rows.drop("row").join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("idx", F.col("rank") - F.col("first")).drop("of", "first", "rank")
    size = sources.agg(F.max("n").alias("most"), F.count("*").alias("trees")).first()
    levels, subroots = _levels(leaves.select("tree", "idx", "n", F.col("leaf").alias("hash")), size.most or 0)
    subroots = tables.table(subroots.withColumnRenamed("hash", "subroot"))
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(size.trees).cast("long").alias("n"), F.col("subroot").alias("hash"))
    top_levels, root = _levels(tops, size.trees)
    end = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(PATH).alias("path"))
    above = tables.table(_paths(tops, top_levels, end).select(F.col("idx").alias("tree"), "path", F.col("hash").alias("subroot")))
    found = root.first()

    def listed(parts: list[DataFrame]) -> DataFrame:
        out = spark.createDataFrame([], "level int, tree long, idx long, preimage string")
        for k, p in enumerate(parts):
            out = out.union(p.select(F.lit(k), "tree", "idx", "preimage"))
        return out

    return Manifest(_paths(leaves, levels, above), listed(levels), listed(top_levels), found.hash if found else None)


def verify(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``docs`` -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, and the root that its (changed) leaf folds to."""
    m = build(docs, changed)
    path = F.col("path")
    out = m.leaves.select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), sha(siblings(path)).alias("proof_sha256"), fold(path, F.coalesce("changed", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 7) -> str:
    """The same in DuckDB, for trees of at most 16^levels leaves."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"
    of_id = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295)"
    sql = f"""WITH t AS (SELECT {crc} AS tab), d AS (SELECT *, row_number() OVER () AS rid, {digest("text")} AS leaf, CASE WHEN {of_id} % 5 = 0 THEN {digest(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents, t),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT d.rid, d.doc_id, d.leaf, d.other, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY s.tree) AS n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
a0 AS (SELECT tree, idx, n, leaf AS h FROM l)"""

    def up(a: str) -> str:
        out = ""
        for k in range(levels):
            out += f""",
{a}p{k} AS MATERIALIZED (SELECT tree, idx // {FAN} AS p, string_agg(h, '' ORDER BY idx) AS pre FROM {a}{k} WHERE n > 1 GROUP BY ALL),
{a}{k + 1} AS MATERIALIZED (SELECT tree, p AS idx, (n + {FAN - 1}) // {FAN} AS n, sha256(pre) AS h FROM {a}p{k} JOIN (SELECT DISTINCT tree, n FROM {a}{k}) USING (tree) UNION ALL SELECT tree, idx, n, h FROM {a}{k} WHERE n = 1)"""
        return out

    def climb(src: str, a: str, tree: str, idx: str, name: str) -> str:
        out = ""
        for k in range(levels):
            at = f"(x.{idx} // {FAN**k}) % {FAN} * {DIGEST}"
            before, after = f"substr(pre, 1, {at})", f"substr(pre, {at} + {DIGEST + 1})"
            out += f""",
{name}{k} AS (SELECT x.* REPLACE (CASE WHEN pre IS NULL THEN sib ELSE sib || {before} || {after} END AS sib, CASE WHEN pre IS NULL THEN f ELSE sha256({before} || f || {after}) END AS f) FROM {src if k == 0 else f"{name}{k - 1}"} x LEFT JOIN {a}p{k} y ON y.tree = x.{tree} AND y.p = x.{idx} // {FAN ** (k + 1)})"""
        return out

    sql += up("a") + f", b0 AS (SELECT 0 AS tree, tree AS idx, (SELECT count(*) FROM s) AS n, h FROM a{levels})" + up("b")
    sql += ", x AS (SELECT l.*, 0 AS top, '' AS sib, coalesce(other, leaf) AS f FROM l)" + climb("x", "a", "tree", "idx", "u") + climb(f"u{levels - 1}", "b", "top", "tree", "v")
    return sql + f""" SELECT doc_id, leaf, a{levels}.h AS subroot, r.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM v{levels - 1} v JOIN a{levels} ON v.tree = a{levels}.tree, b{levels} r"""
