"""Migrations of memory files: old and new ones read alike afterwards, a second run changes nothing, one that died is done over."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleanery.sources import migrations as M

NOW = "2024-05-01T00:00:00.000Z"
GOOD = {"id": "g", "createdAt": "2024-01-01T00:00:00.000Z", "updatedAt": "2024-01-02T00:00:00.000Z", "createdAtMs": 1704067200000, "updatedAtMs": 1704153600000, "x": {"é": [1]}}


def put(path, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.txt", "w") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")


def read(spark, root):
    out = {}
    for r in M.lines(spark, root).collect():
        out.setdefault(r.project, []).append(r.value)
    return {k: sorted(v) for k, v in out.items()}


def files(root):
    return sorted((d, n, os.path.getmtime(f"{d}/{n}")) for d, _, ns in os.walk(root) for n in ns if n.startswith("part"))


def test_split(spark, tmp_path):
    root, legacy = str(tmp_path / "memory"), str(tmp_path / "legacy")
    put(f"{root}/project=a", [{"id": "1", "t": "kept"}])
    put(f"{root}/project=other", [{"id": "9"}])
    before = files(f"{root}/project=other")
    put(legacy, [{"id": "1", "project": "a", "t": "old"}, {"id": "2", "project": "a"}, {"id": "3"}, {"id": "4", "project": " "}, "no json", "", {"id": "2", "project": "b c"}, "[1]"])
    assert M.split_projects(spark, legacy, root) == {"projects": 3, "added": 4}
    got = read(spark, root)
    assert {k: sorted(json.loads(x)["id"] for x in v) for k, v in got.items()} == {"a": ["1", "2"], "b c": ["2"], "_default": ["3", "4"], "other": ["9"]}
    assert json.loads(got["a"][0])["t"] == "kept" and files(f"{root}/project=other") == before
    assert M.split_projects(spark, legacy, root) == {"projects": 0, "added": 0} and read(spark, root) == got


def test_times(spark, tmp_path):
    root = str(tmp_path / "memory")
    put(f"{root}/project=new", [GOOD])
    put(f"{root}/project=old", [GOOD, {"id": "a"}, {"id": "b", "createdAt": "2024-02-01"}, {"id": "c", "createdAt": "never", "updatedAt": "2024-03-01T01:00:00+01:00", "createdAtMs": 5}, "not json", "[]"])
    before = files(f"{root}/project=new")
    assert M.add_times(spark, root, NOW) == {"projects": 1, "lines": 3}
    got = read(spark, root)
    rows = {json.loads(x)["id"]: json.loads(x) for x in got["old"] if x.startswith("{")}
    assert rows["g"] == GOOD and rows["a"] == {"id": "a", "createdAt": NOW, "updatedAt": NOW, "createdAtMs": 1714521600000, "updatedAtMs": 1714521600000}
    assert rows["b"]["createdAt"] == rows["b"]["updatedAt"] == "2024-02-01T00:00:00.000Z" and rows["b"]["createdAtMs"] == 1706745600000
    assert (rows["c"]["createdAt"], rows["c"]["updatedAt"], rows["c"]["createdAtMs"], rows["c"]["updatedAtMs"]) == (NOW, "2024-03-01T00:00:00.000Z", 5, 1709251200000)
    assert {"not json", "[]"} < set(got["old"]) and files(f"{root}/project=new") == before
    assert M.add_times(spark, root, "2025-01-01T00:00:00.000Z") == {"projects": 0, "lines": 0} and read(spark, root) == got


def test_died_and_done_over(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "memory")
    put(f"{root}/project=p", [{"id": "a"}])
    mark = M._mark
    monkeypatch.setattr(M, "_mark", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        M.add_times(spark, root, NOW)
    once = read(spark, root)
    monkeypatch.setattr(M, "_mark", mark)
    assert M.add_times(spark, root, "2025-01-01T00:00:00.000Z") == {"projects": 0, "lines": 0} and read(spark, root) == once
    assert M._read(spark, str(tmp_path / "none"), M.LINES).count() == 0 and M.lines(spark, root).select(F.col("project")).first().project == "p"
