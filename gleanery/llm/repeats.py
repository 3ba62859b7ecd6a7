"""Substring dedup: words in windows that also start elsewhere are removed, found by fixed-block anchors.

A window has ``window`` = 2b - 1 words, so that it holds exactly one whole block of its text's non-overlapping blocks of b words.

1. **Index and probe.** Every text's blocks are the index; every rolling window of b words, at all positions, probes it. Both meet in buckets
   by hash. A probe needs no more than a fingerprint: per task and bucket, sorted ones are sent as packed differences, two to three bytes each.
   A block that occurs at no second place ends here; a block that is wrongly found to (fingerprints are short) only costs work.
2. **Extend.** Each found block is extended to both sides, as far as the repeat goes: the windows over it are compared by 64-bit hashes of all their
   words. Equal windows meet as one group by hash, and never as pairs, so that thousands of copies cost their number and not its
   square. What repeats within a task is settled there, and one of each group speaks for all. A window that starts at a second place
   is repeated, and runs of such windows are the maximal exact repeats.
3. The covered words of each text are left out.

Texts are known by two 64-bit hashes, so that rows need no unique id, and equal texts share their result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables
from gleanery.llm.memory import released, small_batches
from gleanery.llm.wordhash import BASE, BASE_INVERSE, BYTE_VALUE, SPACE, U, forget_powers, mix, powers, text_slices, word_bounds

WINDOW = 35
#: Windows that a task holds before it sends them off.
HELD = 1 << 21
#: Texts of more bytes are hashed in pieces.
PIECE = 1 << 20
#: Buckets per partition of the input; at least and at most so many.
SHARE, LEAST, MOST = 16, 512, 1 << 20
#: Bytes of found blocks or repeats that are broadcast; more are joined by a shuffle.
BROADCAST = 32 << 20


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """``data`` cut before white space, in pieces of at least ``PIECE`` bytes but the last."""
    first = 0
    while len(data) - first > PIECE:
        end, step = first + PIECE, PIECE // 16
        while end < len(data) and not (gap := SPACE[data[end : end + step]]).any():
            end += step
        end = min(end + int(gap.argmax()), len(data)) if end < len(data) else len(data)
        yield data[first:end]
        first = end
    yield data[first:]


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_bounds(data, offsets)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64)), rows


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, as it stands, and the number of words of each row."""
    if len(data) <= 2 * PIECE or len(offsets) > 2:
        h, rows = _hashes(data, offsets)
        return h, np.bincount(rows, minlength=len(offsets) - 1)
    h = np.concatenate([_hashes(p, np.array([0, len(p)]))[0] for p in pieces(data)])
    return h, np.array([len(h)])


def windows(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words within a row, in order, and their number per row."""
    n = np.maximum(counts - width + 1, 0)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(BASE, len(h)), out=sums[1:])
        at = np.repeat(np.cumsum(counts) - counts, n) + positions(n)
        return mix((sums[at + width] - sums[at]) * powers(BASE_INVERSE, len(h))[at] + U(width)), n


def positions(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def packed(x: np.ndarray) -> bytes:
    """Integers as differences, the bytes of equal weight together; sorted ones leave their high bytes empty, which the shuffle's compression takes away."""
    step = x.copy()
    step[1:] -= x[:-1]
    return step.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unpacked(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    step = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(np.dtype(kind).newbyteorder("<")).ravel().astype(kind)
    return np.cumsum(step, dtype=kind)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted buckets."""
    if len(bucket):
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        yield from zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True)


# ---- index and probe ------------------------------------------------------------------------------

PROBES = "bucket int, once binary, twice binary, blocks binary, k1 binary, k2 binary, pos binary"


def _post(width: int, bits: int):
    """Per stretch of a task and bucket: fingerprints (the 32 bits after the bucket's) of windows met once, of windows met more often, and of blocks with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            h, k1, k2, n = (np.concatenate(x) for x in zip(*held, strict=True))
            prefix = h >> U(32 - bits)
            order = np.argsort(prefix, kind="stable")
            s = prefix[order]
            new = np.append(True, s[1:] != s[:-1])
            unique = s[new]
            often = np.diff(np.append(np.flatnonzero(new), len(s))) > 1
            # a block that repeats within the stretch is posted once for each text, as all others
            pos = positions(n)
            is_block = pos % width == 0
            text = np.repeat(np.arange(len(n)), n)
            b = np.flatnonzero(is_block)
            b = b[np.lexsort((pos[b], k2[text[b]], k1[text[b]], prefix[b]))]
            fresh = np.append(True, (prefix[b][1:] != prefix[b][:-1]) | (k1[text[b]][1:] != k1[text[b]][:-1]) | (pos[b][1:] != pos[b][:-1]))[: len(b)]
            b = b[fresh]
            at = {k: (i, j) for k, i, j in _cuts((prefix[b] >> U(32)).astype(np.int64))}
            low = lambda x: (x & U(0xFFFFFFFF)).astype(np.uint32)
            rows = []
            for k, i, j in _cuts((unique >> U(32)).astype(np.int64)):
                u, o = low(unique[i:j]), often[i:j]
                first, end = at.get(k, (0, 0))
                mine = b[first:end]
                rows.append((k, packed(u[~o]), packed(u[o]), packed(low(prefix[mine])), k1[text[mine]].tobytes(), k2[text[mine]].tobytes(), pos[mine].tobytes()))
            for i in range(0, len(rows), 256):
                part = list(zip(*rows[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(p, pa.binary()) for p in part[1:])], names=["bucket", "once", "twice", "blocks", "k1", "k2", "pos"])

        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                h, n = windows(*words(data, offsets), width)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                k1, k2 = (batch.column(i).slice(first, last - first).to_numpy()[some] for i in (0, 1))
                held.append((h, k1, k2, n[some]))
                size += len(h)
                if size >= HELD:
                    yield from sent()
                    held, size = [], 0
        if held:
            yield from sent()

    return released(run, forget_powers)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks whose fingerprint is at a second place, of rows ordered by bucket."""

    def judged(rows: list[dict]) -> pa.RecordBatch:
        once = np.concatenate([unpacked(r["once"], np.uint32) for r in rows])
        once.sort()
        twice = np.concatenate([unpacked(r["twice"], np.uint32) for r in rows])
        again = np.unique(np.concatenate([twice, once[1:][once[1:] == once[:-1]]]))
        block = np.concatenate([unpacked(r["blocks"], np.uint32) for r in rows])
        hit = np.isin(block, again)
        cols = [np.concatenate([np.frombuffer(r[c], np.int64) for r in rows])[hit] for c in ("k1", "k2", "pos")]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32))], names=["k1", "k2", "pos"])

    yield from _by(batches, "bucket", judged)


def _by(batches: Iterator[pa.RecordBatch], key: str, judged) -> Iterator[pa.RecordBatch]:
    """``judged`` over the rows of each value of ``key``, which come together."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r[key] != now:
                yield judged(rows)
                rows = []
            now = r[key]
            rows.append(r)
    if rows:
        yield judged(rows)


# ---- extend ---------------------------------------------------------------------------------------

#: bucket -1 has a stretch's texts: keys, numbers of windows, and as bits the windows that are settled already.
CANDIDATES = "stretch long, bucket int, once binary, place binary, twice binary, settled binary, k1 binary, k2 binary, n binary"


def _candidates(width: int, block: int, bits: int):
    names = ["stretch", "bucket", "once", "place", "twice", "settled", "k1", "k2", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = stretch = 0

        def sent() -> Iterator[pa.RecordBatch]:
            h, candidate, k1, k2, n = (np.concatenate(x) for x in zip(*held, strict=True))
            settled = np.zeros(len(h), bool)
            place = np.flatnonzero(candidate)
            order = place[np.argsort(h[place], kind="stable")]
            s = h[order]
            new = np.append(True, s[1:] != s[:-1])[: len(s)]
            count = np.diff(np.append(np.flatnonzero(new), len(s)))
            settled[order[np.repeat(count > 1, count)]] = True
            unique, where, often = s[new], order[new], count > 1
            none = (b"", b"", b"")
            rows = [(task + stretch, -1, *none, np.packbits(settled).tobytes(), k1.tobytes(), k2.tobytes(), n.tobytes())]
            for k, i, j in _cuts((unique >> U(64 - bits)).astype(np.int64)):
                u, o, w = unique[i:j], often[i:j], where[i:j]
                rows.append((task + stretch, k, packed(u[~o]), packed(w[~o].astype(np.uint32)), packed(u[o]), b"", *none))
            for i in range(0, len(rows), 256):
                part = list(zip(*rows[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), *(pa.array(p, pa.binary()) for p in part[2:])], names=names)

        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                h, n = windows(*words(data, offsets), width)
                k1, k2 = (batch.column(i).slice(first, last - first).to_numpy() for i in (0, 1))
                found = batch.column(3).slice(first, last - first)
                of = np.repeat(np.arange(last - first), n)
                # the only whole block of a window, by its number in the text
                number = -(-positions(n) // block)
                blocks = n + width
                start = np.cumsum(blocks) - blocks
                hit = np.zeros(int(blocks.sum()), bool)
                hit[start[np.repeat(np.arange(last - first), found.value_lengths().to_numpy())] + found.flatten().to_numpy() // block] = True
                held.append((h, hit[start[of] + number], k1, k2, n))
                size += len(h)
                if size >= HELD:
                    yield from sent()
                    held, size, stretch = [], 0, stretch + 1
        if held:
            yield from sent()

    return released(run, forget_powers)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch, the places of windows that other stretches have too."""

    def judged(rows: list[dict]) -> pa.RecordBatch:
        once = [unpacked(r["once"], np.uint64) for r in rows]
        every = np.concatenate(once)
        every.sort()
        twice = np.concatenate([unpacked(r["twice"], np.uint64) for r in rows])
        again = np.unique(np.concatenate([twice, every[1:][every[1:] == every[:-1]]]))
        out = [(r["stretch"], packed(np.sort(unpacked(r["place"], np.uint32)[np.isin(h, again)]))) for r, h in zip(rows, once, strict=True)]
        out = [x for x in out if x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["stretch", "place"])

    yield from _by(batches, "bucket", judged)


REPEATS = "k1 long, k2 long, starts array<int>, ends array<int>"


def _runs(width: int):
    """Maximal repeats of each text, as words [start, end) of runs of repeated windows; rows of a stretch come together, its texts first."""

    def judged(rows: list[dict]) -> pa.RecordBatch:
        head = rows[0]
        n = np.frombuffer(head["n"], np.int64)
        flags = np.unpackbits(np.frombuffer(head["settled"], np.uint8), count=int(n.sum())).astype(bool)
        for r in rows[1:]:
            flags[unpacked(r["place"], np.uint32)] = True
        at = np.flatnonzero(flags)
        pos, text = positions(n)[at], np.repeat(np.arange(len(n)), n)[at]
        # a run goes on while the next window begins no later than the words covered so far end
        new = np.append(True, (text[1:] != text[:-1]) | (pos[1:] > pos[:-1] + width))[: len(at)]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)[: int(new.sum())]
        start, end, of = pos[new], pos[last] + width, text[new]
        per = np.bincount(of, minlength=len(n))
        some = per > 0
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per[some])).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (start, end)]
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(head["k1"], np.int64)[some]), pa.array(np.frombuffer(head["k2"], np.int64)[some]), *lists], names=["k1", "k2", "starts", "ends"])

    return lambda batches: _by(batches, "stretch", judged)


# ---- the whole ------------------------------------------------------------------------------------


def _keys(window: int) -> tuple[Column, Column]:
    """Two hashes of a text. A text that is too short to hold a window has no second one, and its first is spread by chance of its row, as it is joined with nothing."""
    long = F.octet_length("text") >= 2 * window - 1
    return F.when(long, F.xxhash64("text")).otherwise(F.xxhash64(F.monotonically_increasing_id())), F.when(long, F.xxhash64(F.lit(1), "text"))


def _joined(texts: DataFrame, found: DataFrame, lists: list[str], how: str) -> DataFrame:
    """``found`` (k1, k2 and lists of ints) at the texts; broadcast if its bytes are counted to be few. Spark splits a hot text's rows."""
    size = found.agg(F.sum(sum((4 * F.size(c) for c in lists), F.lit(64)))).first()[0] or 0
    return texts.join(F.broadcast(found) if size <= BROADCAST else found, ["k1", "k2"], how)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal repeats (k1, k2, starts, ends) of the distinct texts of ``docs``, in words; k1 and k2 are the text's hashes, see ``_keys``. Written."""
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd: twice a block less one word")
    block = (window + 1) // 2
    spark = docs.sparkSession
    k1, k2 = _keys(window)
    texts = small_batches(docs).select(k1.alias("k1"), k2.alias("k2"), "text").filter("k2 is not null")
    many = docs.select("text").rdd.getNumPartitions()
    bits = max(LEAST, min(MOST, SHARE * many)).bit_length() - 1
    probes = texts.mapInArrow(_post(block, bits), PROBES)
    places = probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_found), "k1 long, k2 long, pos int")
    found, found_path = tables.written(places.groupBy("k1", "k2").agg(F.collect_set("pos").alias("found")))
    cand, cand_path = tables.written(_joined(texts, found, ["found"], "inner").select("k1", "k2", "text", "found").mapInArrow(_candidates(window, block, bits), CANDIDATES))
    sent = cand.filter("bucket >= 0").select("stretch", "bucket", "once", "place", "twice")
    answers = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_answers), "stretch long, place binary")
    listed = cand.filter("bucket < 0").select("stretch", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("place"), "settled", "k1", "k2", "n")
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("settled", "binary"), ("k1", "binary"), ("k2", "binary"), ("n", "binary"))]
    both = listed.union(answers.select("stretch", F.lit(1), "place", *empty))
    runs = both.repartition("stretch").sortWithinPartitions("stretch", "kind").mapInArrow(released(_runs(window)), REPEATS)
    out = tables.table(runs.groupBy("k1", "k2").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends")))
    tables.drop(spark, found_path, cand_path)
    return out


CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends = (batch.column(i) for i in (1, 2, 3))
            rows = []
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer() if texts[i].is_valid else b""
                keep = _spans(starts[i].values.to_numpy(), ends[i].values.to_numpy()) if starts[i].is_valid else None
                rows.append(_kept(np.frombuffer(raw, np.uint8), keep, with_text))
            n, gone, sha, kept = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            out = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return released(run)


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word up to the last covered one stays."""
    edge = np.zeros(int(ends[-1]) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1]) == 0


def _kept(data: np.ndarray, keep: np.ndarray | None, with_text: bool) -> tuple[int, int, str, str | None]:
    sha, n, gone, parts = hashlib.sha256(), 0, 0, []
    for piece in pieces(data):
        w = piece.tobytes().split()
        mine = keep[n : n + len(w)] if keep is not None else None
        n += len(w)
        if mine is not None and len(mine):
            out = [*compress(w, mine.tolist()), *w[len(mine) :]]
        else:
            out = w
        gone += len(w) - len(out)
        if out:
            text = b" ".join(out)
            sha.update(b" " + text if parts else text)
            parts.append(text if with_text else b"")
    return n, gone, sha.hexdigest(), b" ".join(parts).decode() if with_text else None


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, and others that are not read) -> doc_id, n_words, n_removed, kept_sha256, and the ``kept`` text unless ``with_text`` is false.

    One row per row of ``docs``. Words are runs of characters other than ASCII white space. Null, empty and blank
    texts have no words, and so nothing is removed; the kept text is empty. Texts of fewer than ``window`` words keep all their words. Repeated rows
    and equal texts lose all words from ``window`` on, whatever their doc_ids; null doc_ids are rows as any other. All places of a repeat go, none
    is preferred, so that there are no ties. An empty table gives no rows.
    """
    found = repeats(docs, window)
    k1, k2 = _keys(window)
    texts = small_batches(docs).select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    rows = _joined(texts, found, ["starts", "ends"], "left").select("doc_id", "text", "starts", "ends")
    out = rows.mapInArrow(_cut(with_text), CUT.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"))
    return out if with_text else out.drop("kept")


def oracle(window: int = WINDOW) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT rid, i, md5(array_to_string(w[i : i + {window - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {window - 2})) u(i)),
g AS (SELECT h FROM e GROUP BY h HAVING count(*) > 1), s AS (SELECT rid, i FROM e SEMI JOIN g USING (h)),
x AS (SELECT rid, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) u(j)),
c AS (SELECT x.*, max(s.i) OVER (PARTITION BY x.rid ORDER BY x.j) AS last FROM x LEFT JOIN s ON s.rid = x.rid AND s.i = x.j),
k AS (SELECT rid, count(*) AS n_words, count(*) FILTER (j - last < {window}) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (last IS NULL OR j - last >= {window}) AS kept FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""
