import hashlib
import random

import numpy as np
import pytest

from gleanery.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, pos int, part string, code string"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, vector, label) -> rows of the result, with Python's integers only."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    if not dim or dim % parts:
        return []
    kept = [r for r in kept if len(r[1]) == dim]
    w = dim // parts
    cut = [[r[1][k * w : (k + 1) * w] for k in range(parts)] for r in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            of = [near(books[k], c[k])[1] for c in cut]
            for i in set(of):
                mine = [c[k] for c, o in zip(cut, of, strict=True) if o == i]
                books[k][i] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = []
    for r, c in zip(kept, cut, strict=True):
        got = [near(books[k], c[k]) for k in range(parts)]
        done.append((r[0], "".join(f"{i:02x}" for _, i in got), sum(d for d, _ in got), r[2]))
    total = {}
    for r in done:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in done), key=str)


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "c") for r in rows], SCHEMA)


@pytest.mark.parametrize(("entries", "hot"), [(5, 2000), (16, 3), (256, 1)])
def test_plain(spark, monkeypatch, entries, hot):
    """A third of the vectors are equal, parts repeat, and some rows are not to be kept."""
    monkeypatch.setattr(V, "HOT", hot)
    rng = random.Random(entries)
    pool = [[rng.uniform(-0.6, 0.6) for _ in range(2)] for _ in range(9)]
    rows = []
    for i in range(90):
        v = [0.25, -0.25] * 4 if i % 3 == 0 else [x for _ in range(4) for x in (rng.choice(pool) if rng.random() < 0.6 else [rng.uniform(-1, 1), rng.uniform(-1, 1)])]
        rows.append((i, v, rng.choice([1, 2, None])))
    rows += [(200, None, 1), (201, [0.1, None] * 4, 1), (202, [float("nan")] * 8, None), (203, [float("inf")] * 8, 1), (204, [-float("inf")] + [0.0] * 7, 1)]
    rng.shuffle(rows)
    df = table(spark, rows).repartition(5)
    assert got(V.compress(df, entries=entries)) == plain(rows, entries=entries)


def test_odd_rows(spark):
    """Repeated rows and vec_ids, null ids, other dimensions, empty vectors, an empty table."""
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (1, [-0.001] * 8, None), (None, [0.5] * 8, 2), (None, [0.2] * 8, None), (5, [0.1] * 4, 1), (6, [], 1), (7, [0.1] * 9, 1)]
    assert got(V.compress(table(spark, rows))) == plain(rows)
    assert V.compress(table(spark, []).limit(0)).collect() == []
    assert V.compress(table(spark, [(1, [0.5] * 6, 1)])).collect() == []
    with pytest.raises(Exception, match="too large"):
        V.compress(table(spark, [(1, [3e30] * 8, 1)])).collect()


def test_nearest_is_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    book = rng.integers(-(2**26), 2**26, (7, 16))
    x = np.concatenate([book[[3, 3]], rng.integers(-(2**26), 2**26, (40, 16))])
    at, dist = V.nearest(x, np.concatenate([book, book]))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)), i) for i, e in enumerate(book)) for r in x]
    assert [(int(d), int(i)) for d, i in zip(dist, at, strict=True)] == want
