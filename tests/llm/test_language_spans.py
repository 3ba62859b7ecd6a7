import random
import zlib

import numpy as np

from gleanery.llm import language_spans as G


def plain_viterbi(scores, penalty):
    n, k = scores.shape
    best, back = scores[0].copy(), []
    for t in range(1, n):
        top = int(best.argmax())
        step = [j if best[j] >= best[top] - penalty else top for j in range(k)]
        back.append(step)
        best = np.array([max(best[j], best[top] - penalty) for j in range(k)]) + scores[t]
    out = [int(best.argmax())]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def test_viterbi():
    rng = np.random.default_rng(1)
    row = np.repeat([0, 2, 3, 7], [5, 1, 40, 12])
    scores = rng.normal(0, 4, (len(row), 3))
    got = G.viterbi(scores, row, 3.0)
    for r in (0, 2, 3, 7):
        assert got[row == r].tolist() == plain_viterbi(scores[row == r], 3.0)
    assert len(G.viterbi(np.zeros((0, 3)), row[:0], 3.0)) == 0


EN, DE, RU = "the house is on the hill and the river runs by it", "das haus steht auf dem berg und der fluss geht daran vorbei", "дом стоит на горе и река течет мимо него"


def test_mixed_scripts_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample(t.split(), 8)), lang, 0.0) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 60)]
    mixed = " ".join([EN, DE, RU])
    odd = [(1001, None, "en", 0.0), (1002, "", None, 0.0), (1003, "12 34!", "de", 0.0), (1004, mixed, None, 0.0), (None, EN, None, 0.0), (1005, EN * 4000, None, 0.0), (1006, "İstanbul ẞ 中文", None, 0.0), (1004, mixed, None, 0.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    out = [r for r in G.identify(df).collect()]
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and by[1003].score == 0
    assert by[None].lang_pred == "en" and by[1005].lang_pred == "en" and by[1005].score == 1
    spans = by[1004].spans
    assert [s.lang for s in spans] == ["en", "de", "ru"]
    assert mixed[spans[2].start : spans[2].end] == RU and mixed[spans[0].start : spans[0].end] == EN
    assert all(r.lang_pred == lang for (i, _, lang, _) in rows for r in [by[i]])
    assert G.identify(df.limit(0)).collect() == []
    nothing = G.identify(df.selectExpr("doc_id", "text", "cast(null as string) AS lang"), spans=False).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = G.identify(docs, spans=False).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    print("held-out accuracy", np.mean(held))
    assert len(out) == len(lang) and np.mean(held) > 0.97


def test_joined_spans_and_the_two_step_draw(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(60)] + [(7, EN, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = G.identify(df).select("doc_id", G.joined("spans").alias("spans")).collect()
    assert {r.spans for r in out if r.doc_id % 2} == {f"0:{len(EN)}:en"}
    known = df.select("doc_id", "lang").distinct()
    for parts in (64, 1):
        got = {r.doc_id for r in G.drawn(known, 9, parts).collect()}
        order = known.selectExpr("doc_id", "lang", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect()
        assert got == {r.doc_id for lang in ("en", "de") for r in [r for r in order if r.lang == lang][:9]}
