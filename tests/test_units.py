"""The fold of equal units against a plain loop, and the decision about a lesson by hand."""

import random

import pytest

from gleanery.operators import units as U


def plain(rows):
    held = {}
    for i, _, c, s, p in sorted(rows, key=lambda r: (r[1], r[0])):
        k = " ".join((p or "").split()).lower()
        c, s = c or 0.0, s or 0.0
        if k not in held or c > held[k][1] or s > held[k][2]:
            held[k] = (i, c, s)
    return sorted((k, v[0]) for k, v in held.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold(spark, seed):
    """Confidence and severity disagree; one key has nearly all rows, and is cut into many segments."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4000), rng.choice([None, *(k / 20 for k in range(20))]), rng.choice([None, 0.2, 0.5, 0.8, 1.0]), rng.choice(["Hot  key"] * 20 + ["b", "B ", None, "c"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ord long, confidence double, severity double, p string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sorted(tuple(r) for r in U.better(df, "p").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows)
    assert U.better(df.limit(0), "p").collect() == []


def test_segments_compose():
    """Any cut of a sequence gives what the whole gives, and the fold is no maximum: its order matters."""
    rng = random.Random(5)
    for _ in range(300):
        xs = [(i, rng.randrange(5), rng.randrange(5)) for i in range(rng.randrange(1, 25))]
        held = xs[0]
        for x in xs[1:]:
            held = x if x[1] > held[1] or x[2] > held[2] else held
        cut = sorted(rng.sample(range(len(xs) + 1), min(2, len(xs))))
        state = None
        for a, b in zip([0, *cut], [*cut, len(xs)], strict=True):
            s = U.Segment()
            for x in xs[a:b]:
                s.add(*x)
            for r in s.rows():
                if state is None or r["confidence"] > state[1] or r["severity"] > state[2]:
                    state = (r["id"], r["kept_confidence"], r["kept_severity"])
                    break
        assert state == held


def test_teaching(spark):
    rows = [
        (1, "off", "password api_key"), (2, "auto", "nothing here"), (3, "on", "nothing here"), (4, "auto", "the password token"), (5, "auto", "set the api-key now"), (6, "auto", "use of md5"),
        (7, "on", "a token"), (8, "auto", "a token"), (9, "auto", "a token and a password"), (10, None, None), (11, "on", "a token"),
    ]
    req = spark.createDataFrame(rows, "id long, mode string, text string")
    rec = spark.createDataFrame([(7, "secrets-exposure", True, 0.8), (8, "", True, 0.9), (9, None, True, 0.78), (11, "xss", True, 0.99), (4, "", True, 0.7), (4, "", False, 1.0)], "id long, risk string, critical boolean, confidence double")
    got = {r.id: (r.enabled, r.risk, r.critical, r.blocked, r.reason) for r in U.teaching(req, rec).collect()}
    off = (False, None, False, False, "")
    secret = lambda blocked: (True, "secrets-exposure", True, blocked, ("critical-security-risk:" if blocked else "security-advisory:") + "secrets-exposure")
    assert got == {
        1: off, 2: off, 3: (True, "security-misconfiguration", False, False, ""), 4: secret(False), 5: secret(True), 6: (True, "weak-crypto", False, False, "security-advisory:weak-crypto"),
        7: secret(True), 8: secret(False), 9: secret(True), 10: off, 11: secret(False),
    }
    assert not any(r.blocked for r in U.teaching(req, rec, "warn").collect())
    assert {r.id for r in U.teaching(req).collect() if r.blocked} == {5}
