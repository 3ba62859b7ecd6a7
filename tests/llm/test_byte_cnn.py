import random
import zlib

import numpy as np

from gleanery.llm import byte_cnn as C


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def plain_score(model, text):
    """The network stated window by window."""
    filters = model.tables.shape[2]
    blocks = []
    for at in range(0, max(len(text) + C.WIDTH - 1, 1), C.BLOCK):
        best = np.full(filters, -np.inf)
        for w in range(at, min(at + C.BLOCK, len(text)), C.STRIDE):
            part = (text[w : w + C.WIDTH] + bytes(C.WIDTH))[: C.WIDTH]
            best = np.maximum(best, sum(model.tables[k][part[k]] for k in range(C.WIDTH)))
        blocks.append(np.maximum(best + model.bias, 0) if np.isfinite(best).all() else np.zeros(filters))
    chunks = [np.maximum(b, blocks[i + 1]) if i + 1 < len(blocks) else b for i, b in enumerate(blocks)]
    f = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(f @ model.weights + model.offset)))


def test_equals_plain_network():
    rng = random.Random(3)
    model = C.fit([], np.zeros(0))
    model.weights = np.linspace(-0.3, 0.4, 2 * C.FILTERS)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 1000, 3000, 0)]
    got = C.scores(model, *joined(texts))
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)


def test_gradient_learns():
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the", "house", "is", "on", "a", "hill"]) for _ in range(80)).encode() for _ in range(120)]
    bad = [t[:200] + b" ### $$$ &&& " + t[200:] for t in good[:60]]
    texts, y = good[60:] + bad, np.array([1.0] * 60 + [0.0] * 60)
    model = C.fit(texts, y, epochs=60)
    s = C.scores(model, *joined(good[:60]))
    t = C.scores(model, *joined([x[:300] + b" &&& ### " + x[300:] for x in good[:60]]))
    assert ((s > 0.5).mean() + (t < 0.5).mean()) / 2 > 0.95


def test_held_out_accuracy_and_edges(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (None, "a", "x"), (None, "a", "x"), (-3, "word " * 100_000, "x")], "doc_id long, text string, score string")
    both = docs.selectExpr("doc_id", "text", "lang AS score").union(odd)
    out = C.classify(both, labels)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "score", "predicted"] and len(rows) == docs.count() + 5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    y = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.93
    assert C.classify(both.limit(0), labels).collect() == []
    constant = C.classify(both, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in constant] == [0.5]
