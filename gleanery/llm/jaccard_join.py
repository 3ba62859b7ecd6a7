"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when the Jaccard similarity of their shingle sets is at least
``threshold`` = num / den. The join is exact:

1. Each text becomes the set of its distinct shingle hashes. Equal sets share a 64-bit key,
   so that a group of copies is one node from here on. Shingles that several sets of a task have are
   counted over the whole corpus, and the most frequent ones (a fixed number) are known to all tasks.
2. Each set is ordered rarest first by these counts (ties by hash: one global order). The probe
   prefix, n - ceil(t n) + 1 long, is posted by shingle; its first n - ceil(2t/(1+t) n) + 1 entries
   form the index prefix, which is enough for the shorter side of a pair.
3. Postings are streamed in the order of shingle and position. Each group proposes pairs of its first
   member (the least position) with all others, and is done with it; members that turn out to be linked
   then count as one component and need no pair among themselves.
4. Groups that still hold several components propose pairs in further rounds. What is left after ``ROUNDS`` rounds is
   enumerated across components inside the join, which only lets pairs through that pass all filters. So no
   link between components is lost, and linked members are never expanded into all their pairs.
5. A pair passes the length, positional and suffix filters (the difference of counts in classes of
   the whole set bounds the overlap: first in 16 classes, then in as many as an eighth of the set), and is verified once on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables
from gleanery.llm.components import components
from gleanery.llm.memory import Seen, released, small_batches
from gleanery.llm.wordhash import U, forget_powers, mix, shingle_sets, text_slices

CLASSES = 16
#: Shingles whose frequency is known to all tasks, 16 bytes each.
FREQUENT = 1 << 18
#: Shingles of a task that are counted together.
STRETCH = 1 << 21
#: Rounds with central members before the rest is enumerated.
ROUNDS = 3
#: Pairs of one member that are verified in one task.
PAIRS_A_TASK = 512


def _keys(h: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, key and check hash of each row's set; both hashes are sums and so free of order."""
    n = np.bincount(owner, minlength=rows)
    key, check = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = (np.cumsum(n) - n)[full]
        with np.errstate(over="ignore"):
            key[full] = mix(np.add.reduceat(mix(h ^ U(0xA5A5A5A55A5A5A5A)), at) + n[full].astype(np.uint64))
            check[full] = mix(np.add.reduceat(mix(h * U(0xD6E8FEB86659FD93) + U(1)), at))
    return n, key, check


INFO = "doc_id long, n int, key long, check long, c1 long, c2 long, sketch array<short>, total long"


def _sketches(h: np.ndarray, owner: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Counts of each set's shingles by their last bits, in about an eighth as many classes as it has shingles (a power of two; at least CLASSES)."""
    classes = np.where(n > 0, np.maximum(CLASSES, 1 << np.ceil(np.log2(np.maximum(n / 8, 1))).astype(np.int64)), 0)
    ends = np.concatenate([[0], np.cumsum(classes)])
    counts = np.bincount(ends[owner] + (h & (classes[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.minimum(counts, 32_767).astype(np.int16)))


def _describe(width: int):
    """A row per document; and a row (key, total) per shingle that several sets of a stretch of input have."""
    names = ["doc_id", "n", "key", "check", "c1", "c2", "sketch", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = Seen(), np.empty(STRETCH, np.uint64), 0

        def common() -> pa.RecordBatch:
            h = held[:size]
            h.sort()
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(h)))
            at, count = at[count > 1], count[count > 1]
            m = len(at)
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(h[at].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int16())), pa.array(count.astype(np.int64))], names=names)

        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                rows = last - first
                h, owner = shingle_sets(data, offsets, width)
                n, key, check = _keys(h, owner, rows)
                fresh = h[seen.fresh(key, n > 0)[owner]]
                for at in range(0, len(fresh), STRETCH):
                    part = fresh[at : at + STRETCH]
                    if size + len(part) > STRETCH:
                        yield common()
                        size = 0
                    held[size : size + len(part)] = part
                    size += len(part)
                classes = np.bincount(owner * CLASSES + (h & U(CLASSES - 1)).astype(np.int64), minlength=rows * CLASSES)
                packed = np.minimum(classes, 255).astype(np.uint8).view("<i8").reshape(rows, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64), mask=n == 0), pa.array(check.view(np.int64)), pa.array(packed[:, 0]), pa.array(packed[:, 1]), _sketches(h, owner, n), pa.nulls(rows, pa.int64())], names=names)
        yield common()

    return released(run, forget_powers)


def frequent(totals: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles by the sums of ``totals`` (key, total), and their sums, ordered by hash.

    At most ``most`` of them: sums are first counted by powers of two, and the least power is taken from
    which on they are few enough. They set the order of shingles only, so that no result depends on this bound.
    """
    sums = tables.table(totals.groupBy("key").agg(F.sum("total").alias("total")))
    scale = F.floor(F.log2("total")).cast("int")
    left, least = most, None
    for row in sorted(sums.groupBy(scale.alias("p")).count().collect(), reverse=True):
        if row["count"] > left:
            break
        left, least = left - row["count"], row.p
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = sums.filter(scale >= least).toArrow()
    h, n = got.column("key").to_numpy().view(np.uint64), got.column("total").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _counts(h: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, totals = table
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, totals[at], 0)


def _post(width: int, num: int, den: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(0)):
                rows = last - first
                h, owner = shingle_sets(data, offsets, width)
                n, key, _ = _keys(h, owner, rows)
                fresh = seen.fresh(key, n > 0)
                order = np.lexsort((h, _counts(h, table.value), owner))
                h, owner = h[order], owner[order]
                pos = np.arange(len(h)) - (np.cumsum(n) - n)[owner]
                probe = n + 1 - -(-n * num // den)
                take = fresh[owner] & (pos < probe[owner])
                o = owner[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[take].view(np.int64)), pa.array(key[o].view(np.int64)), pa.array(n[o].astype(np.int32)), pa.array(pos[take].astype(np.int32))],
                    names=["token", "key", "n", "pos"],
                )

    return released(run, forget_powers)


def _possible(n1, p1, n2, p2, num: int, den: int):
    """Length, index-prefix and positional filters of pairs with a common shingle at p1 and p2.

    Works on numpy arrays and on columns alike; the shorter side is found first.
    """
    big = (n1 >= n2) * n1 + (n1 < n2) * n2
    small = n1 + n2 - big
    at_small = (n1 >= n2) * p2 + (n1 < n2) * p1
    at_big = p1 + p2 - at_small
    need = -(-num * (n1 + n2) // (num + den))
    index = small + 1 - -(-2 * num * small // (num + den))
    left = np.minimum(small - at_small, big - at_big)
    return (den * small >= num * big) & (at_small < index) & (left >= need)


GROUPS = "kind int, token long, key long, n int, pos int, comp long"


def _group(num: int, den: int):
    """Stream postings ordered by token: pairs of each token's first member with members of other components
    (kind 1; token and key are the pair), and the members but the first of tokens that still hold several components (kind 0).

    All that is carried from batch to batch is the last token's first posting and its last one. A token that
    spans batches isn't judged as a whole: its members are handed on, and go in a later round.
    """
    names = ["kind", "token", "key", "n", "pos", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_row = last_row = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            token, key, n, pos, comp = cols
            m = len(token)
            same = np.zeros(m, bool)
            same[1:] = token[1:] == token[:-1]
            # repeats of a posting (copies posted by several tasks) neither count nor leave the group
            repeat = np.zeros(m, bool)
            repeat[1:] = same[1:] & (key[1:] == key[:-1])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(m)))
            head = [c[lead] for c in cols]
            is_head = lead == np.arange(m)
            if last_row is not None and token[0] == last_row[0]:
                here = lead == 0
                head = [np.where(here, x, c) for x, c in zip(lead_row, head, strict=True)]
                repeat[0] = key[0] == last_row[1]
                is_head[0] = False
            _, fk, fn, fp, fc = head
            ok = (comp != fc) & ~repeat & _possible(fn, fp, n, pos, num, den)
            if ok.any():
                pairs = np.unique(np.stack([np.minimum(fk[ok], key[ok]), np.maximum(fk[ok], key[ok])]), axis=1)
                z = np.zeros(pairs.shape[1], np.int64)
                yield _rows(names, z + 1, pairs[0], pairs[1], z, z, z)
            # what is left of a token without its first member matters only with two components or more
            keep = ~is_head & ~repeat
            starts = np.flatnonzero(~same)
            low = np.minimum.reduceat(np.where(keep, comp, np.iinfo(np.int64).max), starts)
            high = np.maximum.reduceat(np.where(keep, comp, np.iinfo(np.int64).min), starts)
            mixed = low < high
            mixed[[0, -1]] = True
            keep &= np.repeat(mixed, np.diff(np.append(starts, m)))
            if keep.any():
                yield _rows(names, np.zeros(int(keep.sum()), np.int64), *(c[keep] for c in cols))
            lead_row, last_row = [int(c[-1]) for c in head], (int(token[-1]), int(key[-1]))

    return released(run)


def _rows(names: list[str], kind, token, key, n, pos, comp) -> pa.RecordBatch:
    i32, i64 = (lambda x: pa.array(x.astype(np.int32))), pa.array
    return pa.RecordBatch.from_arrays([i32(kind), i64(token), i64(key), i32(n), i32(pos), i64(comp)], names=names)


def _grouped(postings: DataFrame, num: int, den: int) -> DataFrame:
    p = postings.repartition("token").sortWithinPartitions("token", "pos", "key")
    return p.mapInArrow(_group(num, den), GROUPS)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(0)):
                h, owner = shingle_sets(data, offsets, width)
                n, key, _ = _keys(h, owner, last - first)
                fresh = seen.fresh(key, n > 0)
                ends = np.concatenate([[0], np.cumsum(n[fresh])])
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[fresh[owner]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[fresh].view(np.int64)), sets], names=["key", "hashes"])

    return released(run, forget_powers)


def _suffix_ok(a: str, b: str, num: int, den: int):
    """Suffix filter: the counts of shingles by class (16 of them, a byte each, capped at 255, which can
    only lower their differences) bound how far the sets differ; columns n, c1 and c2 with both endings."""
    byte = lambda c, k: F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(F.lit(255))
    diff = sum((F.abs(byte(f"{c}{a}", k) - byte(f"{c}{b}", k)) for c in ("c1", "c2") for k in range(8)), F.lit(0))
    n = F.col(f"n{a}") + F.col(f"n{b}")
    return diff <= n - 2 * F.ceil(F.lit(num) * n / F.lit(num + den))


def _sketch_ok(num: int, den: int):
    """Suffix filter once more, by the sketches x and y of both sets: the finer one is folded to the coarser one's classes first."""
    fold = lambda a, m: F.transform(F.sequence(F.lit(0), m - 1), lambda i: (F.get(a, i) + F.get(a, i + m)).cast("short"))
    x = F.when(F.size("x") > F.size("y"), fold(F.col("x"), F.size("y"))).otherwise(F.col("x"))
    y = F.when(F.size("y") > F.size("x"), fold(F.col("y"), F.size("x"))).otherwise(F.col("y"))
    diff = F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda acc, d: acc + d)
    n = F.col("na") + F.col("nb")
    return diff <= n - 2 * F.ceil(F.lit(num) * n / F.lit(num + den))


def link_components(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, frequent_shingles: int = FREQUENT, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` (doc_id, text, and others that are not read) -> doc_id, n_shingles long, component_id long.

    One row per row of ``docs``. Null, empty and blank texts have an empty set, link with nothing and
    are their own component; repeated rows have equal sets and share a component; with a null doc_id the
    component is that of the least known doc_id of its members (null if all are null). Rows with the same
    doc_id and different texts are judged each by its own text. An empty table gives no rows.
    Two different sets with the same 64-bit key would be mixed up; a second hash finds that and the run
    stops with an error.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select("doc_id", "text")
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = tables.written(df)
        paths.append(path)
        return out

    def dropped(but: int) -> None:
        """Tables that no later plan reads, all after the first ``but`` ones."""
        tables.drop(spark, *paths[but:])
        del paths[but:]

    said = keep(docs.mapInArrow(_describe(width), INFO))
    table = spark.sparkContext.broadcast(frequent(said.filter("total is not null").select("key", "total"), frequent_shingles))
    info = said.filter("total is null").select("doc_id", "n", "key", "check", "c1", "c2")
    sets = keep(info.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.min("check").alias("k0"), F.max("check").alias("k1")))
    if sets.filter("k0 <> k1").limit(1).count():
        raise RuntimeError("two different shingle sets have one key")
    small = sets.select("key", "rep", "n", "c1", "c2")
    known = docs.filter("doc_id is not null")
    unnamed = docs.filter("doc_id is null").select("text")

    def checked(pairs: DataFrame, done: DataFrame | None) -> tuple[DataFrame, str]:
        """Suffix filter by class counts; then the sets of what is left, and only of that, are compared. (a, b, linked), written."""
        side = lambda e: small.select(*[F.col(c).alias(e if c == "key" else f"{c}{e}") for c in small.columns])
        p = pairs if done is None else pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        p = p.join(side("a"), "a").join(side("b"), "b")
        before = len(paths)
        p = keep(p.filter(_suffix_ok("a", "b", num, den)).select("a", "b", F.col("repa").alias("ra"), F.col("repb").alias("rb"), "na", "nb"))
        found = p.count()
        if found:
            wanted = p.select(F.col("a").alias("key")).union(p.select("b")).distinct()
            wanted = F.broadcast(wanted) if found <= broadcast_rows else wanted
            sketches = said.filter("total is null").select("key", "sketch").join(wanted, "key", "left_semi").dropDuplicates(["key"])
            q = p.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b")
            p = keep(q.filter(_sketch_ok(num, den)).select("a", "b", "ra", "rb"))
            found = p.count()
        if not found:
            out = tables.written(p.select("a", "b", F.lit(False).alias("linked")))
            dropped(before)
            return out
        reps = p.select(F.col("ra").alias("rep")).union(p.select("rb")).filter("rep is not null").distinct()
        reps = F.broadcast(reps) if found <= broadcast_rows else reps
        texts = known.join(reps, known.doc_id == reps.rep, "left_semi").select("text").union(unnamed)
        full = texts.mapInArrow(_sets(width), "key long, hashes array<long>").dropDuplicates(["key"])
        sides = lambda d, e, *more: d.select(F.col("key").alias(e), *more, F.col("hashes").alias(f"h{e}"))
        # a member with very many pairs is dealt to several tasks, a copy of its set to each
        ends = p.select(F.col("a").alias("key")).union(p.select("b")).groupBy("key").count().filter(F.col("count") > PAIRS_A_TASK)
        hubs, path = tables.written(ends.select("key", F.ceil(F.col("count") / PAIRS_A_TASK).cast("int").alias("parts")))
        n_hubs = hubs.count()
        hubs = F.broadcast(hubs) if n_hubs <= broadcast_rows else hubs
        plain, hot = p.select("a", "b"), None
        if n_hubs:
            parts = lambda d, c: d.join(hubs.withColumnRenamed("key", c), c, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            both = parts(parts(plain, "a").withColumnRenamed("parts", "parts_a"), "b").withColumnRenamed("parts", "parts_b")
            plain = both.filter("parts_a = 1 AND parts_b = 1").select("a", "b")
            hot = both.filter("parts_a > 1 OR parts_b > 1")
            some_keys = hot.select(F.col("a").alias("key")).union(hot.select("b")).distinct()
            split = parts(full.join(some_keys, "key", "left_semi"), "key").select("key", "hashes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            for e, other in ("ab", "ba"):
                hot = hot.withColumn("part", F.pmod(F.xxhash64(other), f"parts_{e}").cast("int"))
                hot = hot.join(sides(split, e, "part"), [e, "part"]).drop("part")
        pair = plain.join(sides(full, "a"), "a").join(sides(full, "b"), "b").select("a", "b", "ha", "hb")
        pair = pair if hot is None else pair.union(hot.select("a", "b", "ha", "hb"))
        common = F.size(F.array_intersect("ha", "hb"))
        out = tables.written(pair.select("a", "b", (den * common >= num * (F.size("ha") + F.size("hb") - common)).alias("linked")))
        tables.drop(spark, path)
        dropped(before)
        return out

    def joined(done: DataFrame) -> tuple[DataFrame, str]:
        return tables.written(components(done.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))))

    def some(df: DataFrame) -> bool:
        return df.limit(1).count() > 0

    base = len(paths)
    postings = docs.select("text").mapInArrow(_post(width, num, den, table), "token long, key long, n int, pos int").withColumn("comp", F.col("key"))
    done = comp = comp_path = None
    links: list[str] = []
    for k in range(ROUNDS):
        groups = keep(_grouped(postings, num, den))
        before = paths[base:-1]
        new, path = checked(groups.filter("kind = 1").select(F.col("token").alias("a"), F.col("key").alias("b")).distinct(), done)
        links.append(path)
        tables.drop(spark, *before)
        paths[base:] = paths[-1:]
        done = new if done is None else done.union(new)
        if k == 0 or some(new.filter("linked")):
            old = comp_path
            comp, comp_path = joined(done)
            if old:
                tables.drop(spark, old)
        members = groups.filter("kind = 0").select("token", "key", "n", "pos")
        if not some(members):
            members = None
            break
        side = F.broadcast(comp) if comp.count() <= broadcast_rows else comp
        members = members.join(side, members.key == side.node, "left").select("token", "key", "n", "pos", F.coalesce("root", "key").alias("comp"))
        postings = members
    if members is not None:
        # every pair across components that is left, each with a row outside its token's largest component
        members = keep(members)
        size = members.groupBy("token", "comp").count()
        main = size.groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
        m = members.join(main, "token").join(small.select("key", "c1", "c2"), "key")
        cols = ("key", "n", "pos", "comp", "c1", "c2")
        x = m.filter("comp <> main").select("token", *[F.col(c).alias(f"{c}1") for c in cols])
        y = m.select("token", "main", *[F.col(c).alias(f"{c}2") for c in cols])
        big, small_n = F.greatest("n1", "n2"), F.least("n1", "n2")
        lead = F.when(F.col("n1") >= F.col("n2"), F.col("pos2")).otherwise(F.col("pos1"))
        rest = F.col("pos1") + F.col("pos2") - lead
        cond = (F.col("comp1") != F.col("comp2")) & ((F.col("comp2") == F.col("main")) | (F.col("key1") < F.col("key2")))
        cond &= (den * small_n >= num * big) & (lead < small_n + 1 - F.ceil(2 * num * small_n / F.lit(num + den)))
        cond &= F.least(small_n - lead, big - rest) >= F.ceil(num * (F.col("n1") + F.col("n2")) / F.lit(num + den))
        cond &= _suffix_ok("1", "2", num, den)
        pairs = x.join(y, "token").filter(cond).select(F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b")).distinct()
        new, path = checked(pairs, done)
        links.append(path)
        if some(new.filter("linked")):
            old = comp_path
            comp, comp_path = joined(done.union(new))
            tables.drop(spark, old)
    tables.drop(spark, *links)
    dropped(base)

    home = sets.join(comp, sets.key == comp.node, "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = home.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_key = home.join(least, "root").select("key", "component_id")
    out = info.join(of_key, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out
