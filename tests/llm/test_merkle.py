import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleanery.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, tree string, leaf string, n int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h("".join(map(enc, (r[0], r[3], r[2], r[4], text))))


def climb(nodes):
    """Root, and for each node the runs above it with its place in each."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, k in enumerate(at):
            paths[i].append((runs[k // 16], k % 16))
        at = [k // 16 for k in at]
        nodes = [h("".join(r)) for r in runs]
    return nodes[0] if nodes else None, paths


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((mine, *climb([leaf(r, r[1]) for r in mine])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, sub, paths), top in zip(trees, tops, strict=True):
        for r, p in zip(mine, paths, strict=True):
            own = leaf(r, r[1])
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            f = leaf(r, lower(r[1])) if hit else own
            proof = ""
            for run, k in p + top:
                proof += "".join(run[:k] + run[k + 1 :])
                f = h("".join([*run[:k], f, *run[k + 1 :]]))
            out.append((r[0], own, sub, root, h(proof), f, f == root))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "plain", "Mixed CASE é", "ÀB c", "x" * rng.randrange(9)])
    return [(rng.choice([i, i, i, None]), text(), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3])) for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (16, ["a"]), (17, ["a", None]), (300, ["hot"] * 30 + ["é", "z", "", None, "one"]), (600, [f"s{i}" for i in range(40)])])
def test_plain(spark, n, sources):
    rows = rows_of(n, n, sources)
    df = spark.createDataFrame([(*r, 1, "t", "l", 2) for r in rows], SCHEMA).repartition(7)
    assert got(M.verify(df, M.tampered())) == plain(rows)


def test_odd_rows(spark):
    """Repeated rows are leaves each; very long texts; an empty table."""
    big = "Long TEXT " * 200_000
    rows = [(5, big, "en", "s", 1), (5, big, "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None), (7, "A", "en", "s", 1), (7, "B", "en", "s", 1)]
    df = spark.createDataFrame([(*r, 1, "t", "l", 2) for r in rows], SCHEMA)
    assert got(M.verify(df, M.tampered())) == plain(rows)
    assert M.verify(df.limit(0), M.tampered()).collect() == [] and M.build(df.limit(0)).root is None


def test_manifest_rebuilds_its_root(spark):
    """The stored preimages alone give the roots, and an untouched table folds to the root everywhere."""
    rows = rows_of(3, 200, ["a", "b", "c"])
    df = spark.createDataFrame([(*r, 1, "t", "l", 2) for r in rows], SCHEMA)
    m = M.build(df)
    top = {(r.level, r.idx): r.preimage for r in m.top_preimages.collect()}
    assert h(top[max(top)]) == m.root
    kept = {(r.level, r.tree, r.idx): r.preimage for r in m.preimages.collect()}
    for (level, tree, idx), pre in kept.items():
        if level:
            children = [h(kept[level - 1, tree, k]) for k in range(16 * idx, 16 * idx + 16) if (level - 1, tree, k) in kept]
            assert pre == "".join(children)
    assert M.verify(df).agg(F.min("verified")).first()[0] is True
    changed = M.verify(df, F.when(F.col("text") == "plain", F.sha2(F.lit("x"), 256)))
    assert {r.verified for r in changed.join(df.filter("text = 'plain'").select("doc_id").filter("doc_id is not null"), "doc_id").collect()} == {False}
