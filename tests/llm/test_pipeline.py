from pyspark.sql import functions as F

import corpus_pipeline as C
from gleanery.llm import byte_cnn, templates
from tests.llm.brute import jaccard_components
from tests.llm.test_markov_secrets import base_spans
from tests.llm.test_packing import check_pieces


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, None, "s", None), (90_002, "", "en", "s", 0), (90_003, "", "en", "s", 0)], docs.schema)
    docs = docs.union(extra)
    seen = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        seen[name] = len(rows)
        after = {r.doc_id: r for r in rows if k < 4}
        if k == 0:
            scored = byte_cnn.classify(spark.createDataFrame(list(before.values()), extra.schema), spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {r.doc_id for r in scored.collect() if r.predicted == 1}
        if k == 1:
            assert set(after) == {d for d, _, c in jaccard_components([(d, r.text) for d, r in before.items()]) if d == c}
        if k == 2:
            hits = templates.matches(spark.createDataFrame(list(before.values()), extra.schema), spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert set(after) == set(before) - {r.doc_id for r in hits.collect()}
        if k == 3:
            assert set(after) == set(before)
            for d, r in after.items():
                assert not base_spans(r.text) and (r.n_chars is None if r.text is None else r.n_chars == len(r.text))
                assert base_spans(before[d].text) or "[SECRET]" in (r.text or "") or r.text == before[d].text
        if k == 4:
            check_pieces(rows, {d: r.text for d, r in before.items()})
    assert all(seen.values())


def test_odd_tables(spark, sf):
    """Extra columns with clashing names keep their values, repeated doc_ids and empty tables pass through all stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    names = ["spans", "score", "predicted", "rest", "id", "v", "item_id", "component_id", "ids", "row"]
    odd = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (90_003, "", None, None, 0)], docs.schema))
    odd = odd.select("*", *[F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(n) for n in names])
    for name, stage in C.STAGES[:-1]:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, sf)
            assert out.columns == odd.columns, name
            for r in out.collect():
                assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for n in names), name
    assert C.STAGES[-1][1](spark, odd.limit(0), sf).collect() == []
    assert {r.doc_id for r in C.STAGES[-1][1](spark, odd, sf).collect()} == {r.doc_id for r in odd.select("doc_id").collect()}
