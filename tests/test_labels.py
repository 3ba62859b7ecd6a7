"""Versions of label sets: the same samples write nothing, a crash leaves the old version, versions never change."""

import os

import pytest

from gleanery.sources import labels as L

ROWS = [("a", " in ", "out", "Fix Bug!", "HIGH"), (None, "x", "y", None, ""), ("c", "x", "z", "ask", "low")]
SCHEMA = "id string, input string, output string, intent string, risk string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_versions(spark, tmp_path):
    target = str(tmp_path)
    first = L.write(spark, frame(spark, ROWS), target, "set", "fixture")
    assert first["version"] == "1.0.0" and first["sampleCount"] == 3
    got = sorted((tuple(r) for r in L.read(spark, target, "set").collect()))
    assert got[0] == ("a", "in", "out", "fix-bug", "high") and got[1] == ("c", "x", "z", "ask", "low") and got[2][0].startswith("sample-") and got[2][3:] == ("unknown", "unknown")
    before = sorted(os.listdir(f"{target}/set/versions"))
    assert L.write(spark, frame(spark, ROWS[::-1]).repartition(3), target, "set", "elsewhere") == first and sorted(os.listdir(f"{target}/set/versions")) == before
    second = L.write(spark, frame(spark, ROWS + [("d", "1", "2", "i", "r")]), target, "set")
    assert second["version"] == "1.0.1" and L.read(spark, target, "set").count() == 4 and L.read(spark, target, "set", "1.0.0").count() == 3
    # the samples of an older version once more are a new version; a repeated row counts
    assert L.write(spark, frame(spark, ROWS), target, "set")["version"] == "1.0.2"
    assert L.write(spark, frame(spark, ROWS + ROWS[:1]), target, "set")["version"] == "1.0.3"
    assert L.write(spark, frame(spark, ROWS[:1]), target, "set", version="2.0.9")["version"] == "2.0.9"
    assert L.write(spark, frame(spark, ROWS[:2]), target, "set")["version"] == "2.0.10"
    assert [m["version"] for m in L.manifests(spark, target, "set")][-2:] == ["2.0.9", "2.0.10"]
    with pytest.raises(ValueError, match="other samples"):
        L.write(spark, frame(spark, ROWS[:2]), target, "set", version="1.0.0")
    assert L.write(spark, frame(spark, ROWS), target, "set", version="1.0.0") == first
    for bad in ({"version": "1.0"},):
        with pytest.raises(ValueError, match="not a version"):
            L.write(spark, frame(spark, ROWS), target, "set", **bad)
    with pytest.raises(ValueError, match="no samples"):
        L.write(spark, frame(spark, ROWS).limit(0), target, "set")
    with pytest.raises(Exception, match="samples need an output"):
        L.write(spark, frame(spark, [("a", "x", " ", "i", "r")]), target, "set")


def test_crash(spark, tmp_path, monkeypatch):
    """A version whose manifest was never written isn't there, and the next attempt has its number."""
    target = str(tmp_path)
    L.write(spark, frame(spark, ROWS), target, "set")
    publish = L._publish
    monkeypatch.setattr(L, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        L.write(spark, frame(spark, ROWS[:2]), target, "set")
    monkeypatch.setattr(L, "_publish", publish)
    assert os.path.isdir(f"{target}/set/versions/1.0.1") and L.read(spark, target, "set").count() == 3
    assert L.write(spark, frame(spark, ROWS[:1]), target, "set")["version"] == "1.0.1" and L.read(spark, target, "set").count() == 1
    with pytest.raises(ValueError, match="no version"):
        L.read(spark, target, "set", "9.0.0")
