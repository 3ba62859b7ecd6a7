import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import separators as S
from gleanery.llm.tokens import VOCABULARY


def plain(ids, sep):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == sep:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("stretch", [1024, 3])
def test_blocks_cut_anywhere(spark, monkeypatch, stretch):
    monkeypatch.setattr(S._stitched, "__defaults__", (stretch,))
    rng = random.Random(3)
    files = {f"f{k}": [rng.choice([7, 7, 8, 9, 10]) for _ in range(rng.choice([0, 1, 5, 40, 300]))] for k in range(12)}
    files["only"], files["none"] = [7, 7, 7], [8] * 50
    rows = []
    for name, ids in files.items():
        data = np.array(ids, "<u2").tobytes()
        step = 2 * rng.randrange(1, 20)
        rows += [(name, k, bytearray(data[i : i + step]), "x") for k, i in enumerate(range(0, len(data), step))]
    rows.append(("null", 0, None, "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file_id string, block long, ids binary, size string").repartition(5)
    got = sorted((r.file_id, r.doc_index, r.start, r.n_tokens, r.closed) for r in S.boundaries(df, separator=7).collect())
    assert got == sorted((f, *d) for f, ids in files.items() for d in plain(ids, 7))
    assert S.boundaries(df.limit(0), separator=7).collect() == []


def test_files(spark, tmp_path):
    ids = [1, 2, S.END, S.END, 3, S.END, 4]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = sorted((r.doc_index, r.start, r.n_tokens, r.closed) for r in S.boundaries(S.read_files(spark, str(tmp_path), 4)).collect())
    assert got == plain(ids, S.END)


def test_a_file_is_read_in_ranges(spark, tmp_path):
    """Blocks and ranges of a few ids: no task holds the file; both readers agree with a plain scan."""
    rng = random.Random(8)
    files = {f"{k}.bin": [rng.choice([S.END, 5, 6, 7, 8]) for _ in range(n)] for k, n in enumerate((1000, 1, 333))}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    want = sorted((name, *d) for name, ids in files.items() for d in plain(ids, S.END))
    for blocks in (S.read_files(spark, str(tmp_path), 16, 64), S.read_whole_files(spark, str(tmp_path), 16)):
        got = sorted((r.file_id.rsplit("/", 1)[1], r.doc_index, r.start, r.n_tokens, r.closed) for r in S.boundaries(blocks).collect())
        assert got == want
    parts = S.read_files(spark, str(tmp_path), 16, 64).groupBy("file_id").count().collect()
    assert {r["count"] for r in parts} == {125, 1, 42}


def test_counts(spark, sf):
    hf = Tokenizer.from_file(VOCABULARY)
    hf.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a <|endoftext|> b!"), (None, "x y"), (-4, "w " * 60_000), (-5, "q"), (-5, "q")], "doc_id long, text string")
    df = docs.union(odd).selectExpr("doc_id", "text", "text AS ids").repartition(3)
    want = sorted((str(r.doc_id), len(hf.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    out = S.counts(df, block_bytes=1000)
    assert sorted((str(r.doc_id), r.n_tokens) for r in out.collect()) == want
    assert S.counts(df.limit(0)).collect() == []
