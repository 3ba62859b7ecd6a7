"""Token counts by a separator scan of flat, unindexed token files.

A file is nothing but little-endian ids, documents end with an end-of-document id, and there is no
index. It is cut into blocks anywhere. Each block is searched for separators by one vectorised
comparison; a prefix scan over the blocks' summaries (ids, and the last separator so far) then stitches
documents that cross blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm import tables
from gleanery.llm.memory import released, small_batches
from gleanery.llm.tokens import RANKS, VOCABULARY, encoder, forget

END = 50256
BLOCK_BYTES = 1 << 18
BLOCKS = "file_id string, block long, ids binary"


#: Bytes that are read in one go by a task; a multiple of any block size.
RANGE_BYTES = 1 << 26
#: Blocks whose summaries are scanned together; the sums of such stretches are scanned in turn.
STRETCH = 1024


def _blocks(name: str, first: int, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for k, data in enumerate(parts, first):
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([data], pa.binary())], names=["file_id", "block", "ids"])


def _opened(name: str):
    """The file by Arrow's file systems: local, HDFS, S3 and GCS."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
    return where.open_input_file(path)


def read_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Token files of any size under ``path`` as blocks. Spark lists them; tasks read ranges of them, so that a large file is read by many tasks.

    Ranges are read through Arrow's file systems. For a store that only Spark can open, see ``read_whole_files``.
    """
    blocks = max(1, range_bytes // block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(name) as f:
                    places = range(k * blocks * block_bytes, min(size, (k + 1) * blocks * block_bytes), block_bytes)
                    yield from _blocks(name, k * blocks, (f.read_at(min(block_bytes, size - at), at) for at in places))

    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (blocks * block_bytes)))).alias("k"))
    return ranges.repartition("path", "k").mapInArrow(released(run), BLOCKS)


def read_whole_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As ``read_files``, for stores that only Spark can open: a file is one binary row first, so that Spark lets it have 2 GB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = x.as_buffer()
                yield from _blocks(name, 0, (data[at : at + block_bytes].to_pybytes() for at in range(0, data.size, block_bytes)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(released(run), BLOCKS)


def _scan(width: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, size = [], []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer(), width)
                ends.append(np.flatnonzero(ids == separator))
                size.append(len(ids))
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))], names=["file_id", "block", "size", "ends"])

    return run


def _scan_named(width: str, separator: int):
    """Scan the blocks; rows that name documents (block -1) pass through."""
    scan = _scan(width, separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.filter(pc.less(batch.column(1), 0))
            blocks = batch.filter(pc.greater_equal(batch.column(1), 0))
            n = names.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([names.column(0), names.column(1), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), names.column(3), names.column(4)], names=["file_id", "block", "size", "ends", "doc_id", "doc_index"])
            for got in scan(iter([blocks])):
                m = got.num_rows
                yield pa.RecordBatch.from_arrays([*got.columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=["file_id", "block", "size", "ends", "doc_id", "doc_index"])

    return released(run)


def boundaries(blocks: DataFrame, width: str = "<u2", separator: int = END) -> DataFrame:
    """``blocks`` (file_id, block, ids) -> file_id, doc_index, start, n_tokens, closed: one row per document.

    ``n_tokens`` leaves the separator out; two separators in a row enclose a document of none. Ids after
    a file's last separator are a document that isn't closed. Empty files have no documents; a null
    file_id is a file of its own; an empty table gives no rows. Blocks must hold whole ids; a null block
    content is empty. Repeated (file_id, block) rows aren't allowed, as a file has one such block.
    """
    found = blocks.select("file_id", "block", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(_scan(width, separator), "file_id string, block long, size long, ends array<long>")
    return _stitched(tables.table(found))


def _stitched(found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The prefix scan over summaries (file_id, block, size, ends), in two levels.

    Of each block, only its size, its number of separators and its last one are scanned: first within stretches of
    blocks, then, from the sums of these, over the stretches of a file. The separators themselves are joined to the
    results by block. So a file of a terabyte is thousands of rows to the one task that scans its stretches.
    """
    s = found.select("file_id", "block", "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("end"), F.floor(F.col("block") / stretch).alias("stretch"))
    within = W.partitionBy("file_id", "stretch").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("base", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("number", F.coalesce(F.sum("n").over(within), F.lit(0)))
    s = s.withColumn("last", F.when(F.col("n") > 0, F.col("base") + F.col("end") + 1)).withColumn("after", F.max("last").over(within))
    g = s.groupBy("file_id", "stretch").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max("last").alias("last"), F.max("block").alias("block"))
    before = W.partitionBy("file_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("gbase", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("gnumber", F.coalesce(F.sum("n").over(before), F.lit(0)))
    g = g.withColumn("gafter", F.coalesce(F.max(F.col("gbase") + F.col("last")).over(before), F.lit(0))).withColumn("final", F.max("block").over(W.partitionBy("file_id")))
    g = g.select(F.col("file_id").alias("gfile"), F.col("stretch").alias("gstretch"), "gbase", "gnumber", "gafter", "final")
    s = s.join(g, s.file_id.eqNullSafe(g.gfile) & (s.stretch == g.gstretch))
    base = F.col("gbase") + F.col("base")
    s = s.select("file_id", "block", "size", "n", base.alias("base"), F.coalesce(F.col("gbase") + F.col("after"), "gafter").alias("after"), (F.col("gnumber") + F.col("number")).alias("number"), (F.col("gbase") + F.col("last")).alias("last"), (F.col("block") == F.col("final")).alias("is_last"))
    e = found.filter(F.size("ends") > 0).select(F.col("file_id").alias("efile"), F.col("block").alias("eblock"), "ends")
    closed = e.join(s.select("file_id", "block", "base", "after", "number"), e.efile.eqNullSafe(F.col("file_id")) & (e.eblock == F.col("block")))
    closed = closed.select("file_id", "base", "after", "number", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") > 0, F.col("base") + F.get("ends", F.col("k") - 1) + 1).otherwise(F.col("after"))
    closed = closed.select("file_id", (F.col("number") + F.col("k")).alias("doc_index"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tail_start, tail_end = F.coalesce("last", "after"), F.col("base") + F.col("size")
    tail = s.filter("is_last").filter(tail_end > tail_start).select("file_id", (F.col("number") + F.col("n")).alias("doc_index"), tail_start.alias("start"), (tail_end - tail_start).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(tail)


def _write(vocabulary: str, ranks: str, separator: int, block_bytes: int):
    """Texts of a partition as one flat file; blocks are passed on when they are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, ranks, plain=True)
        end = np.array([separator], e.width).tobytes()
        name, block, held, number = None, 0, b"", 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                name = name or part.column(0)[0].as_py()
                n = part.num_rows
                yield _rows([(name, -1, None)] * n, part.column(1), range(number, number + n))
                number += n
                held += b"".join(e.encode(t.as_py()) + end for t in part.column(2))
                full = len(held) // block_bytes * block_bytes
                yield _rows([(name, block + k, held[i : i + block_bytes]) for k, i in enumerate(range(0, full, block_bytes))])
                block, held = block + full // block_bytes, held[full:]
        if held:
            yield _rows([(name, block, held)])

    return released(run, forget)


def _rows(blocks: list, doc_ids=None, numbers=()) -> pa.RecordBatch:
    n = len(blocks)
    return pa.RecordBatch.from_arrays(
        [pa.array([b[0] for b in blocks], pa.string()), pa.array([b[1] for b in blocks], pa.int64()), pa.array([b[2] for b in blocks], pa.binary()), pa.nulls(n, pa.int64()) if doc_ids is None else doc_ids, pa.array(list(numbers) or [None] * n, pa.int64())],
        names=["file_id", "block", "ids", "doc_id", "doc_index"],
    )


def counts(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, separator: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, file_id, doc_index, start, n_tokens: every row's token count, found by the scan.

    Each input partition is encoded as a flat file of ids, which is scanned without the documents'
    borders; only afterwards are the documents found named by their place in the file. Null and empty
    texts have no tokens; repeated rows are documents of their own; an empty table gives no rows.
    """
    named = small_batches(docs).select(F.concat(F.lit("part-"), F.spark_partition_id()).alias("file_id"), "doc_id", "text")
    both = named.mapInArrow(_write(vocabulary, ranks, separator, block_bytes), f"{BLOCKS}, doc_id long, doc_index long")
    width = encoder(vocabulary, ranks, plain=True).width.str
    both = both.mapInArrow(_scan_named(width, separator), "file_id string, block long, size long, ends array<long>, doc_id long, doc_index long")
    both = tables.table(both)
    found = _stitched(both.filter("block >= 0").select("file_id", "block", "size", "ends"))
    names = both.filter("block < 0").select("file_id", "doc_index", "doc_id")
    return names.join(found, ["file_id", "doc_index"]).select("doc_id", "file_id", "doc_index", "start", "n_tokens")
