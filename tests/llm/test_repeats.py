import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleanery.llm import repeats as R
from tests.llm.brute import WORD

SCHEMA = "doc_id long, text string, k1 string, pos int, starts string"


def plain(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n):
    """Passages about as long as a window, some shared by many, within texts of few different words."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "é", "a.b"]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(4, 40))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(1, 40)] + [rng.choice(vocab) for _ in range(rng.randrange(9))]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w) if w else rng.choice([None, "", " "])))
    return rows + rows[:5] + [(None, rows[7][1])]


@pytest.mark.parametrize(("seed", "window", "held", "most"), [(1, 35, 1 << 21, 32 << 20), (2, 7, 40, 0), (3, 11, 500, 32 << 20), (4, 3, 25, 0)])
def test_plain(spark, monkeypatch, seed, window, held, most):
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "BROADCAST", most)
    rows = corpus(seed, 70)
    df = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], SCHEMA).repartition(5)
    assert got(R.dedup(df, window)) == plain(rows, window)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 1 << 10)
    long = " ".join(f"x{i % 7919}" for i in range(20_000))
    giant = "y" * 5000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (5, long), (6, giant + " " + giant), (None, None), (7, long + " tail"), (8, " ".join(["same"] * 36)), (9, " ".join(["other"] * 35)), (10, "z " * 1500)]
    df = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], SCHEMA)
    assert got(R.dedup(df)) == plain(rows, 35)
    assert R.dedup(df.limit(0)).collect() == []
    assert R.dedup(df, with_text=False).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    with pytest.raises(ValueError, match="odd"):
        R.dedup(df, 34)


def test_documents(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert got(R.dedup(spark.read.parquet(f"{sf}/documents.parquet"))) == plain(rows, 35)


def test_packing_of_integers():
    for kind in (np.uint32, np.uint64):
        x = np.sort(np.random.default_rng(1).integers(0, np.iinfo(kind).max, 999, dtype=kind))
        assert (R.unpacked(R.packed(x), kind) == x).all() and len(R.unpacked(R.packed(x[:0]), kind)) == 0
    y = np.array([5, 1, 4_000_000_000, 0], np.uint32)
    assert (R.unpacked(R.packed(y), np.uint32) == y).all()
