"""Byte-level convolutional quality classifier in numpy.

Filters over ``WIDTH`` bytes are learned as tables (filter response of each byte at each place).
They slide over the whole document; responses are max-pooled in overlapping chunks (two neighbouring
blocks each, so that a chunk starts every block), and the mean and the maximum over all chunks
enter one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.memory import released, small_batches
from gleanery.llm.wordhash import text_slices

WIDTH, STRIDE, FILTERS, BLOCK = 6, 2, 16, 256
#: Labelled documents that the classifier is fitted on at most, drawn by hash of doc_id.
TRAIN_DOCS = 4000
EPOCHS = 14
THRESHOLD = 0.3
SLICE = 1 << 18


@dataclass
class Model:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents at block borders, followed by zero bytes; first block of each, and each block's valid windows."""
    length = np.diff(offsets)
    blocks = np.maximum(1, -(-(length + WIDTH - 1) // BLOCK))  # the last window sees no other document
    first = np.cumsum(blocks) - blocks
    out = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
    move = np.repeat(first * BLOCK - offsets[:-1], length)
    out[np.arange(len(data)) + move] = data
    owner = np.repeat(np.arange(len(length)), blocks)
    left = length[owner] - (np.arange(len(owner)) - first[owner]) * BLOCK
    valid = np.clip(-(-left // STRIDE), 0, BLOCK // STRIDE)
    return out, first, valid


def _responses(model: Model, x: np.ndarray) -> np.ndarray:
    n = (len(x) - WIDTH) // STRIDE
    z = np.take(model.tables[0], x[: STRIDE * n : STRIDE], axis=0)
    for k in range(1, WIDTH):
        z += np.take(model.tables[k], x[k : k + STRIDE * n : STRIDE], axis=0)
    return z.reshape(-1, BLOCK // STRIDE, model.tables.shape[2])


def _masked(z: np.ndarray, valid: np.ndarray) -> np.ndarray:
    short = np.flatnonzero(valid < z.shape[1])
    z[short] = np.where(np.arange(z.shape[1])[None, :, None] < valid[short][:, None, None], z[short], -1e9)
    return z


def _chunks(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum of each block and the next one of its document."""
    after = np.empty_like(pooled)
    after[:-1] = pooled[1:]
    after[np.append(first[1:], len(pooled)) - 1] = 0
    return np.maximum(pooled, after)


def _features(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    chunks = _chunks(pooled, first)
    count = np.diff(np.append(first, len(pooled)))[:, None]
    return np.concatenate([np.add.reduceat(chunks, first) / count, np.maximum.reduceat(chunks, first)], axis=1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each document of a slice. Bytes of a document are never skipped or cut."""
    x, first, valid = _padded(data, offsets)
    pooled = np.empty((len(valid), model.tables.shape[2]), np.float32)
    step = SLICE // BLOCK
    for at in range(0, len(valid), step):  # a very long document takes several steps
        z = _responses(model, x[at * BLOCK : min(len(valid), at + step) * BLOCK + WIDTH])
        pooled[at : at + step] = np.maximum(_masked(z, valid[at : at + step]).max(axis=1) + model.bias, 0)
    return _sigmoid(_features(pooled, first).astype(np.float64) @ model.weights + model.offset)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, filters: int = FILTERS, seed: int = 7, rate: float = 0.02) -> Model:
    """Adam on the log-loss; gradients flow through the largest responses only.

    With no rows, or one label only, the score is that label's smoothed share everywhere.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(rng.normal(0, 0.25, (WIDTH, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), np.zeros(2 * filters), float(np.log(share / (1 - share))))
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    model.weights = rng.normal(0, 0.1, 2 * filters)
    params = [model.tables, model.bias, model.weights]
    first_moment = [np.zeros(p.shape) for p in params] + [0.0]
    second = [np.zeros(p.shape) for p in params] + [0.0]
    step, batch = 0, 32
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            x, first, valid = _padded(data, offsets)
            z = _masked(_responses(model, x), valid)
            where = z.argmax(axis=1)
            raw = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0, :] + model.bias
            pooled = np.maximum(raw, 0)
            f = _features(pooled, first).astype(np.float64)
            p = _sigmoid(f @ model.weights + model.offset)
            err = (p - labels[rows]) / len(rows)
            g_weights = f.T @ err + 1e-4 * model.weights
            g_offset = err.sum()
            # back through the document's mean and maximum, the chunks' maxima and the blocks' maxima
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(pooled))))
            chunks = _chunks(pooled, first)
            count = np.bincount(owner)[owner][:, None]
            mean_w, max_w = model.weights[:filters], model.weights[filters:]
            g_chunk = err[owner][:, None] * mean_w / count
            top = chunks == np.maximum.reduceat(chunks, first)[owner]
            ties = np.add.reduceat(top, first)[owner]
            g_chunk = g_chunk + top * (err[owner][:, None] * max_w) / ties
            own = pooled >= chunks
            g_block = g_chunk * own
            g_block[1:] += (g_chunk * ~own)[:-1]
            g_block *= raw > 0
            g_bias = g_block.sum(axis=0)
            g_tables = np.empty(model.tables.shape)
            place = np.arange(len(pooled))[:, None] * BLOCK + where * STRIDE
            for k in range(WIDTH):
                index = x[place + k].astype(np.int64) * filters + np.arange(filters)
                g_tables[k] = np.bincount(index.ravel(), g_block.ravel(), minlength=256 * filters).reshape(256, filters)
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for i, g in enumerate([g_tables, g_bias, g_weights, g_offset]):
                first_moment[i] = 0.9 * first_moment[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * np.square(g)
                change = now * (first_moment[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                if i < 3:
                    params[i] -= change.astype(params[i].dtype)
                else:
                    model.offset -= float(change)
    return model


def is_held_out(column="doc_id", parts: int = 5, left: int = 0):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == left, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on ``labels`` (doc_id, quality) outside the held-out fifth.

    Labels other than 0 and 1 and documents with contradicting labels are left out; of several
    rows of a labelled doc_id the least text is taken. At most ``train_docs`` documents are collected.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(~is_held_out()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1")
    drawn = known.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    return fit([(r.text or "").encode() for r in rows], np.array([r.y for r in rows], np.float64))


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            names = names or [*batch.schema.names, "score", "predicted"]
            for first, last, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text"))):
                s = scores(model.value, data, offsets)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    return released(run)


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with two more columns: score double (0 to 1) and predicted int (1 from ``threshold`` on).

    Only ``text`` enters a score; null and empty texts get the score of a document without windows.
    Repeated rows get equal scores, an empty table gives no rows. Columns named score or
    predicted in ``docs`` are replaced.
    """
    docs = small_batches(docs).drop("score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(model, threshold), f"{fields}, score double, predicted int")
