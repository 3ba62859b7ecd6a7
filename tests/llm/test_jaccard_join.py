import random

import pyarrow.parquet as pq
import pytest

from gleanery.llm import jaccard_join as J
from tests.llm.brute import jaccard_components

SCHEMA = "doc_id long, text string, token string, key long"


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(words, rng, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) if rng.random() < share else w for w in words]


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 90]))] for _ in range(12)]
    common = [rng.choice(vocab) for _ in range(25)]
    rows = []
    for d in range(n):
        words = edited(rng.choice(bases), rng, rng.choice([0, 0, 0.01, 0.03, 0.06]))
        if rng.random() < 0.3:
            words = words + common
        rows.append((d, " ".join(words) if rng.random() < 0.8 else "\n\t".join(words).upper()))
    return rows


@pytest.mark.parametrize(("seed", "rounds"), [(1, 4), (2, 1)])
def test_brute_force(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(J, "ROUNDS", rounds)
    rows = corpus(seed, 160)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert got(J.link_components(df)) == jaccard_components(rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS_A_TASK", 3)
    rows = corpus(9, 60)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(J.link_components(df, broadcast_rows=0)) == jaccard_components(rows)


def test_edge_rows(spark):
    long = " ".join(f"x{i % 7919}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (None, "a b"), (7, "a b c d e"), (7, "a b c d e"), (8, long), (9, long + " y"), (None, None), (10, "é à"), (11, "É à"), (12, "a b c d e f")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(J.link_components(df)) == jaccard_components(rows)
    assert got(J.link_components(df.limit(0))) == []


def test_documents(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert got(J.link_components(spark.read.parquet(f"{sf}/documents.parquet"))) == jaccard_components(rows)
