"""Joins beyond equality of one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import stored
from gleanery.batches import small
from gleanery.functions import text as T


#: What rounding to six digits and floating-point arithmetic may add to a similarity; filters allow for it.
SLACK = 1e-6


#: Words whose frequencies are broadcast at most.
MOST_WORDS = 1_000_000


def word_counts(sets: DataFrame) -> DataFrame:
    """(w, df): hashes of the words that more than one of the lists ``t`` holds, and of how many; at most ``MOST_WORDS``, to be broadcast.

    Of more words, those found most often: only the order of a set's words depends on it, which may be any, and is best with frequent words last.
    """
    w = sets.select(F.explode(F.transform("t", lambda w: F.xxhash64(w))).alias("w"))
    counts = stored.table(w.groupBy("w").agg(F.count("*").alias("df")).filter("df > 1"))
    n, least = 0, 63
    for r in sorted(counts.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).count().collect(), key=lambda r: -r.power):
        n += r["count"]
        if n > MOST_WORDS:
            break
        least = r.power
    return F.broadcast(counts.filter(F.floor(F.log2("df")) >= least))


def candidates(sets: DataFrame, least: float, extra: list[str], often: DataFrame | None = None) -> DataFrame:
    """Pairs of distinct sets (k, t, and ``extra``: a row a key, dealt by it) that may have Jaccard similarity of ``least``: ka < kb.

    They share a word of their rare prefix (of the rarest words, so many that two similar sets must share one) and have fitting lengths, and their 256-bit parities (of hashed
    words) differ in no more bits than their words may. The join tests this row by row, so that a pair which only shares a word is neither kept nor shuffled. Words go as hashes: two words with
    one hash can only add a pair, and so can two values of ``extra``, which are part of the hash that pairs meet by. ``often`` (w, df): how often
    words are found that occur more than once; where that is broadcast, the words of a set never leave its task.
    """
    low = least - SLACK
    e = sets.select("k", *extra, F.size("t").alias("n"), F.explode(F.transform("t", lambda w: F.xxhash64(w))).alias("w"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w").bitwiseAND(63).cast("int"))
    parity = [F.bit_xor(F.when(F.col("w").bitwiseAND(192) == 64 * j, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{j}") for j in range(4)]
    if often is None:
        often = word_counts(sets)
    e = e.join(often, "w", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    order = e.groupBy("k", "n", *extra).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"), *parity)
    prefix = order.select("k", "n", "s0", "s1", "s2", "s3", *extra, F.explode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(low)).cast("int") + 1)).alias("x"))
    a, b = (prefix.select(*[F.col(c).alias(c + s) for c in ("k", "n", "s0", "s1", "s2", "s3")], F.xxhash64("x.w", *extra).alias("w")) for s in "ab")
    differ = sum((F.bit_count(F.col(f"s{j}a").bitwiseXOR(F.col(f"s{j}b"))) for j in range(4)), F.lit(0))
    fits = (F.col("ka") < F.col("kb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(low)) & (differ <= (F.col("na") + F.col("nb")) * F.lit((1 - low) / (1 + low)))
    return a.join(b, "w").filter(fits).select("ka", "kb").distinct()


#: Bits of the parities that pairs are tried by before their words meet; a multiple of 64.
PARITY_BITS = 2048


def _parities(sets: DataFrame) -> DataFrame:
    """(k, n, s): the number of words of each set, and the parities of its hashed words as numbers of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            bit = batch.column(1).flatten().to_numpy() & (PARITY_BITS - 1)
            odd = np.bincount(np.repeat(np.arange(len(n)), n) * PARITY_BITS + bit, minlength=len(n) * PARITY_BITS) & 1
            s = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (PARITY_BITS // 64)), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), s], names=["k", "n", "s"])

    return small(sets.select("k", F.transform("t", lambda w: F.xxhash64(w)).alias("w"))).mapInArrow(run, "k long, n long, s array<long>")


def _likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``pairs`` (ka, kb) whose parities differ in no more bits than their words may. Those of long sets are told apart only by many bits, and only a pair that is left takes words along."""
    p, low = stored.table(_parities(sets)), least - SLACK
    a, b = (p.select(*[F.col(c).alias(c + x) for c in ("k", "n", "s")]) for x in "ab")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    j = pairs.join(a, "ka").join(b, "kb")
    return stored.table(j.filter(differ <= (F.col("na") + F.col("nb")) * F.lit((1 - low) / (1 + low))).select("ka", "kb"))


def _similar_sets(rows: DataFrame, least: float, extra: list[str], tokens) -> tuple[DataFrame, DataFrame]:
    """(k, id) of ``rows`` with words, k: their set; and pairs of different sets (ka, kb, similarity) with Jaccard similarity of ``least`` or more."""
    t = rows.select("id", *extra, F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("t")).filter(F.size("t") > 0)
    t = stored.table(t.withColumn("k", F.xxhash64("t", *extra)))  # read several times
    sets_of = lambda rows: rows.groupBy("k").agg(F.first("t").alias("t"), *[F.first(c).alias(c) for c in extra])
    pairs = stored.table(candidates(sets_of(t), least, extra, word_counts(t)))
    # of all sets, only those in a pair meet
    sets = stored.table(sets_of(t.join(stored.bounded(pairs.select(F.col("ka").alias("k")).union(pairs.select("kb")).distinct()), "k", "left_semi")))
    pairs = _likely(pairs, sets, least)
    side = lambda s: sets.select(F.col("k").alias("k" + s), F.col("t").alias("t" + s), *[F.col(c).alias(c + s) for c in extra])
    full = pairs.join(side("a"), "ka").join(side("b"), "kb")
    for c in extra:
        full = full.filter(F.col(c + "a") == F.col(c + "b"))
    return t.select("k", "id"), full.select("ka", "kb", F.round(T.jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity")).filter(F.col("similarity") >= least)


def similar_pairs(rows: DataFrame, least: float = 0.72, within: str | None = None, tokens=T.rag_tokens) -> DataFrame:
    """J-7, H-21, H-22: pairs (a, b, similarity) of rows (id, text) with Jaccard similarity of ``least`` or more; of rows of one value of ``within``, if it is named.

    Equal word sets are one node until the end: only they are paired in full, as each such pair is a result.
    """
    t, full = _similar_sets(rows, least, [within] if within else [], tokens)
    x, y = t.select(F.col("k").alias("ka"), F.col("id").alias("x")), t.select(F.col("k").alias("kb"), F.col("id").alias("y"))
    other = full.join(x, "ka").join(y, "kb").select("x", "y", "similarity")
    same = x.join(y, x.ka == y.kb).filter("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return other.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def similar_firsts(rows: DataFrame, least: float, within: str, tokens=T.rag_tokens) -> tuple[DataFrame, DataFrame]:
    """Sets of words with their first rows only: (id, first) of each row with words, first: the least id with its words; and pairs (a, b) of similar firsts, a < b."""
    t, full = _similar_sets(rows, least, [within], tokens)
    firsts = stored.table(t.groupBy("k").agg(F.min("id").alias("first")))
    x, y = firsts.select(F.col("k").alias("ka"), F.col("first").alias("x")), firsts.select(F.col("k").alias("kb"), F.col("first").alias("y"))
    pairs = full.join(x, "ka").join(y, "kb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return t.join(firsts, "k").select("id", "first"), pairs


def overlapping(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    """J-9: intervals (id, key, start, end) of both sides that overlap within a key.

    Each interval is listed in the buckets that it touches, which makes an equi-join of the range join; a pair is
    reported in the first bucket that both touch only.
    """
    put = lambda d, s: d.select(F.col("id").alias(f"id{s}"), "key", F.col("start").alias(f"s{s}"), F.col("end").alias(f"e{s}"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("bucket"))
    j = put(left, "1").join(put(right, "2"), ["key", "bucket"]).filter("s1 <= e2 AND s2 <= e1")
    return j.filter(F.col("bucket") == F.greatest(F.floor(F.col("s1") / bucket), F.floor(F.col("s2") / bucket))).select("id1", "id2")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str) -> DataFrame:
    """X-1: each left row (key, ts, id) with the latest right row (key, ts, value) not after it, by one sorted pass per key."""
    from pyspark.sql import Window as W

    both = left.select(key, ts, F.lit(1).alias("side"), "id", F.lit(None).cast(right.schema["value"].dataType).alias("value"))
    both = both.union(right.select(key, ts, F.lit(0), F.lit(None).cast("long"), "value"))
    w = W.partitionBy(key).orderBy(ts, "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", True).over(w)).filter("side = 1").select("id", "value")
