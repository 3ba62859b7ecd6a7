"""Vector code compression: product codes of integer vectors, learned on weighted distinct parts.

1. Components become integers, and each vector is cut into equal consecutive parts.
2. Equal parts of a position are one row with a weight (partial sums before the shuffle, so that a part that
   a third of all vectors share stays small).
3. Lloyd's rounds run over these distinct rows only. A task returns weighted sums per codebook entry, Spark adds
   them up, and the driver holds no more than the codebooks.
4. Codes and squared errors of distinct parts are joined back to the vectors. Parts that at least one in
   ``HOT`` vectors has are few by their definition, and so are broadcast; all others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables

#: A part is joined by a broadcast if at least one in so many vectors has it: at most HOT parts per position.
HOT = 2000
#: Components may have so many bits, so that sums of squares stay exact in 64.
BITS = 27
#: Rows whose distances to all entries are held at once.
ROWS = 8192


def _finite(v: str) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.col(v).isNotNull() & F.forall(v, lambda x: F.coalesce(good(x.cast("double")), F.lit(False)))


def _integers(v: str, scale: int) -> Column:
    whole = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda i: F.when(F.abs(i) < 2**BITS, i.cast("int")).otherwise(F.raise_error(F.concat(F.lit("component too large for exact distances: "), i.cast("string"))).cast("int"))
    return F.transform(F.transform(v, whole), fits)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; ties go to the lower index. Integers, and exact.

    Matrix products in doubles are exact as long as all sums stay below 2^53; beyond, integers are multiplied.
    """
    at, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if book.shape[1] * (2 * most) ** 2 < 2**53 else np.int64
    b = book.astype(kind)
    bb = (b * b).sum(axis=1)
    for i in range(0, len(x), ROWS):
        y = x[i : i + ROWS].astype(kind)
        d = (y * y).sum(axis=1)[:, None] - 2 * (y @ b.T) + bb
        k = d.argmin(axis=1)
        at[i : i + ROWS], dist[i : i + ROWS] = k, d[np.arange(len(y)), k].astype(np.int64)
    return at, dist


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    part = batch.column("part")
    x = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column("pos").to_numpy(), x.reshape(len(part), -1)


def _sums(books: np.ndarray):
    """Per position and entry of a task: its weight, then its weighted sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, e, w = books.shape
        total = np.zeros((n, e, w + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, x = _parts(batch)
            weight = batch.column("weight").to_numpy()
            for k in range(n):
                mine = pos == k
                at, _ = nearest(x[mine], books[k])
                np.add.at(total[k], at, np.column_stack([weight[mine], x[mine] * weight[mine][:, None]]))
        for k, i in np.argwhere(total[:, :, 0] > 0).tolist():
            cols = [pa.array(np.full(w + 1, z, np.int32)) for z in (k, i)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(w + 1, dtype=np.int32)), pa.array(total[k, i])], names=["pos", "entry", "at", "total"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, x = _parts(batch)
            code, err = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            for k in range(len(books)):
                mine = pos == k
                code[mine], err[mine] = nearest(x[mine], books[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(err)], names=[*batch.schema.names, "code", "err"])

    return run


def codebooks(distinct: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` of weighted Lloyd over distinct (pos, part, weight). Entries that no part takes stay as they are."""
    books = start.copy()
    for _ in range(rounds):
        sums = distinct.select("pos", "part", "weight").mapInArrow(_sums(books), "pos int, entry int, at int, total long")
        got = sums.groupBy("pos", "entry", "at").agg(F.sum("total").alias("total")).toArrow()  # codebooks at most
        pos, entry, at, total = (got.column(c).to_numpy() for c in ("pos", "entry", "at", "total"))
        new = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        new[pos, entry, at] = total
        used = new[:, :, 0] > 0
        books[used] = new[used][:, 1:] // new[used][:, :1]
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' integers by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``vectors`` (vec_id, embedding, label, and others that are not read) -> vec_id, code, error long, label, label_error long, codebooks_sha256.

    Rows whose vector is null, or holds nulls or numbers that are not finite, are dropped. The codebooks have the dimension of the
    first kept vector (by vec_id, nulls last, then by components); vectors of another dimension, and all if
    it isn't a positive multiple of ``parts``, have no code and are dropped too. Repeated rows are coded each; rows
    with one vec_id and different vectors too, and a null vec_id is kept. Ties between entries go to the lower
    index, ties between equal vec_ids at the start to the lesser vector. Fewer than ``entries`` vectors make as many entries;
    an empty table gives no rows. Components of 2^27 and more (after scaling) stop the run with an error, as distances would not be exact.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    good = vectors.filter(_finite("embedding")).select("vec_id", "label", _integers("embedding", scale).alias("v"))
    kept, kept_path = tables.written(good.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).select(F.size("v").alias("n")).first()
    dim = first.n if first is not None and first.n % parts == 0 else 0
    kept = kept.filter(F.size("v") == dim) if dim else kept.limit(0)
    width = max(dim // parts, 1)
    start = np.array([r.v for r in kept.orderBy(*order).limit(entries).select("v").collect()], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)

    cut = F.array(*[F.slice("v", 1 + k * width, width) for k in range(parts)])
    each = kept.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct, distinct_path = tables.written(each.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    books = codebooks(distinct, start, rounds) if start.size else start
    coded, coded_path = tables.written(distinct.mapInArrow(_codes(books), "pos int, part array<int>, weight long, code int, err long"))
    total = kept.count()
    hot = F.broadcast(coded.filter(F.col("weight") * HOT >= total).drop("weight"))
    rare = coded.filter(F.col("weight") * HOT < total).drop("weight")
    both = each.join(hot, ["pos", "part"]).unionByName(each.join(hot, ["pos", "part"], "left_anti").join(rare, ["pos", "part"]))
    hexed = lambda k: F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == k, F.col("code"))))), 2, "0")
    whole = both.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.concat(*map(hexed, range(parts))).alias("code"), F.sum("err").alias("error"))
    done = tables.table(whole.drop("row"))
    tables.drop(spark, kept_path, distinct_path, coded_path)
    by_label = tables.bounded(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = done.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same in DuckDB, round by round, over all pairs of parts and entries; for small tables."""
    good = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = f"""k AS (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS rid, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings WHERE {good})),
p AS (SELECT rid, pos, v[pos * len(v) // {parts} + 1 : (pos + 1) * len(v) // {parts}] AS part FROM k, range({parts}) r(pos)),
b0 AS (SELECT pos, rid AS e, part FROM p WHERE rid < {entries})"""
    dist = "list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(rounds + 1):
        steps += f""",
a{i} AS MATERIALIZED (SELECT rid, pos, any_value(ppart) AS part, min({{'d': d, 'e': e}}) AS m FROM (SELECT p.rid, p.pos, p.part AS ppart, b.e, {dist} AS d FROM p JOIN b{i} b USING (pos)) GROUP BY rid, pos)"""
        if i < rounds:
            steps += f""",
s{i} AS (SELECT pos, e, list(c ORDER BY j) AS part FROM (SELECT pos, m.e AS e, j, floor(sum(part[j])::DOUBLE / count(*))::BIGINT AS c FROM a{i}, range(1, (SELECT max(len(part)) + 1 FROM p)) r(j) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.pos, b.e, coalesce(s.part, b.part) AS part FROM b{i} b LEFT JOIN s{i} s USING (pos, e))"""
    return f"""WITH {steps},
g AS (SELECT rid, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY pos) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN g USING (rid)"""
