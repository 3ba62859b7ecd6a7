"""Language identification of mixed texts: script ranges, per-word scores and Viterbi over words.

The script of a word narrows its candidate languages to those that use this script in the
training texts. Its score for each is the sum of smoothed log-probabilities of its letter trigrams.
Viterbi with a penalty for each change of language then labels spans of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.memory import released, small_batches

BUCKETS = 1 << 16
#: Labelled documents per language that the model is fitted on at most, drawn by hash of doc_id.
TRAIN_DOCS = 1500
TRAIN_TASKS = 8
PENALTY = 8.0
SMOOTHING = 0.3
#: A language uses a script if at least this share of its training words does.
SCRIPT_SHARE = 0.01
OFF = -1e4
UNKNOWN = "und"
#: Words (times languages) that are decoded at once; a longer text is decoded on its own.
SLICE_CHARS = 1 << 19

#: First code points of ranges, and the script from there on.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages)
    allowed: np.ndarray  # (scripts, languages)


@dataclass
class Words:
    """The words (runs of letters) of some documents: trigram buckets with their word, and per word script, length, row, place."""

    bucket: np.ndarray
    first: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    row: np.ndarray
    start: np.ndarray


def words_of(texts: list[str]) -> Words:
    lows = [t.lower() if t.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) if len(t.lower()) != len(t) else t.lower() for t in texts]
    lengths = np.array([len(t) for t in lows], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    code = np.frombuffer(" ".join(lows).encode("utf-32-le", "surrogatepass") + b" \0\0\0", "<u4").astype(np.int64)
    if not len(code):
        code = np.zeros(1, np.int64)
    is_letter = letter_table()[np.minimum(code, 0x10FFFF)]
    before = np.concatenate([[False], is_letter[:-1]])
    start = np.flatnonzero(is_letter & ~before)
    end = np.flatnonzero(~is_letter & before)
    if len(end) < len(start):
        end = np.append(end, len(code))
    prev = np.where(before, np.concatenate([[0], code[:-1]]), 0)
    after = np.concatenate([is_letter[1:], [False]])
    nxt = np.where(after, np.concatenate([code[1:], [0]]), 0)
    at = np.flatnonzero(is_letter)
    h = (prev[at] * 0x9E3779B1 + code[at] * 0x85EBCA6B + nxt[at] * 0xC2B2AE35) & 0xFFFFFFFF
    bucket = ((h ^ (h >> 15)) * 0x2C1B3C6D >> 13) & (BUCKETS - 1)
    letters = end - start
    first = np.cumsum(letters) - letters
    script = _SCRIPT[np.searchsorted(_STARTS, code[start], side="right") - 1]
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(bucket, first, script, letters, row, start - offsets[row])


def word_scores(model: Model, w: Words) -> np.ndarray:
    if not len(w.first):
        return np.zeros((0, len(model.languages)))
    s = np.add.reduceat(model.scores[w.bucket], w.first, axis=0)
    allowed = model.allowed[w.script]
    return np.where(allowed | ~allowed.any(axis=1, keepdims=True), s, OFF)


def viterbi(scores: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word, for all documents of a slice at once, word by word.

    Ties go to staying, then to the first language.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    docs, begin, count = np.unique(row, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    stay = np.zeros((n, k), bool)
    jump = np.zeros(n, np.int64)
    best = scores[begin].copy()
    live_at = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), side="right")
    final = np.empty(len(docs), np.int64)
    done = len(docs)
    for t in range(1, int(count[0])):
        m = live_at[t]
        if m < done:
            final[m:done] = best[m:done].argmax(axis=1)
            done = m
        at = begin[:m] + t
        top = best[:m].argmax(axis=1)
        leave = best[np.arange(m), top] - penalty
        keeps = best[:m] >= leave[:, None]
        stay[at], jump[at] = keeps, top
        best[:m] = np.where(keeps, best[:m], leave[:, None]) + scores[at]
    final[:done] = best[:done].argmax(axis=1)
    out = np.empty(n, np.int64)
    now = final.copy()
    last = begin + count - 1
    out[last] = now
    for t in range(int(count[0]) - 1, 0, -1):
        m = live_at[t]
        at = begin[:m] + t
        now[:m] = np.where(stay[at, now[:m]], now[:m], jump[at])
        out[at - 1] = now[:m]
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > SLICE_CHARS:
            yield first, [x or "" for x in texts[first:i]]
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, [x or "" for x in texts[first:]]


def label(model: Model, texts: list[str], penalty: float = PENALTY) -> tuple[Words, np.ndarray]:
    w = words_of(texts)
    return w, viterbi(word_scores(model, w), w.row, penalty)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in _slices(batch.column(1).to_pylist()):
            w = words_of(texts)
            owner = np.repeat(w.row, w.letters)
            for lang in set(langs[first : first + len(texts)]):
                mine = np.array([x == lang for x in langs[first : first + len(texts)]])
                grams[lang] = grams.get(lang, 0) + np.bincount(w.bucket[mine[owner]], minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(w.script[mine[w.row]], minlength=len(SCRIPT_NAMES))
    lang, bucket, count = [], [], []
    for x in grams:
        both = np.concatenate([grams[x], scripts[x]])
        at = np.flatnonzero(both)
        lang += [x] * len(at)
        bucket.append(at)
        count.append(both[at])
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(cat(bucket), pa.int64()), pa.array(cat(count), pa.int64())], names=["lang", "bucket", "n"])


def in_part(parts: int = 3, left: int = 1):
    """Held-out rows; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == left, F.lit(False))


def drawn(known: DataFrame, most: int, parts: int = 64) -> DataFrame:
    """The first ``most`` rows of each language by hash of doc_id, in two steps: within parts of a language, then of what these leave."""
    h = F.xxhash64("doc_id")
    for keys in (["lang", F.pmod(h, F.lit(parts))], ["lang"]):
        first = W.partitionBy(*keys).orderBy(h, "doc_id")
        known = known.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).drop("rank")
    return known


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Trigram and script counts of at most ``train_docs`` documents of each language, not held out.

    The counts (at most BUCKETS per language) are summed by Spark and collected; texts are not. Only the drawn
    documents are dealt anew, to ``TRAIN_TASKS`` tasks, so that few tasks make up counts; the scan is as wide as the table.
    """
    known = docs.select("doc_id", "lang").filter("lang is not null and doc_id is not null").filter(~in_part())
    some = drawn(known.distinct(), train_docs)
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(some), ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = texts.repartition(TRAIN_TASKS, F.xxhash64("text")).mapInArrow(released(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = rows.toPandas()
    languages = sorted(counts.lang.unique())
    table = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    table[[languages.index(x) for x in counts.lang], counts.bucket.to_numpy(np.int64)] = counts.n
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    p = (grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS) if languages else grams
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray(np.log(p).T), (allowed & (scripts > 0)).T if languages else allowed.T)


def _predict(shared, penalty: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = None
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            names = names or [*batch.schema.names, "lang_pred", "score", *["spans"] * spans]
            for first, texts in _slices(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                w, lang = label(model, texts, penalty) if model.languages else (words_of([""]), np.zeros(0, np.int64))
                n = len(texts)
                share = np.bincount(w.row * max(len(model.languages), 1) + lang, w.letters, minlength=n * max(len(model.languages), 1)).reshape(n, -1)
                total = share.sum(axis=1)
                pred = [model.languages[i] if t else UNKNOWN for i, t in zip(share.argmax(axis=1), total, strict=True)]
                part = batch.slice(first, n)
                cols = [*part.columns, pa.array(pred), pa.array(np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0))]
                if spans:
                    cols.append(pa.array(_spans(model, w, lang, n), kind))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _spans(model: Model, w: Words, lang: np.ndarray, n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(lang):
        new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (w.row[1:] != w.row[:-1])]))
        for a, b in zip(new, np.append(new[1:], len(lang)) - 1, strict=True):
            out[w.row[a]].append({"start": int(w.start[a]), "end": int(w.start[b] + w.letters[b]), "lang": model.languages[lang[a]]})
    return out


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, lang) -> doc_id, lang_pred, score and, if asked for, spans (start, end, lang) of code points.

    ``lang_pred`` has the most letters among the spans and ``score`` is its share of them; texts without
    letters, null texts and all texts if nothing can be learned get ``und`` and 0. Repeated rows are
    labelled alike; an empty table gives no rows. Only ``text`` enters a prediction. Other columns of ``docs``, whatever their
    names, are not read. Very long texts are decoded whole, on their own.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(small_batches(docs), train_docs))
    more = ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(_keep_id(_predict(model, penalty, spans)), _letters.clear), f"doc_id {kind}, lang_pred string, score double{more}")


def _keep_id(f):
    def run(batches):
        for batch in f(batches):
            yield pa.RecordBatch.from_arrays([c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"], names=[x for x in batch.schema.names if x != "text"])

    return run


def joined(spans) -> Column:
    """Spans as start:end:lang, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], s["lang"])), ",")
