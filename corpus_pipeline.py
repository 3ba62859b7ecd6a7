"""Five stages from raw documents to packed sequences. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import byte_cnn, jaccard_join, markov_secrets, packing, tables, templates


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one (``rest``), so that no name clashes with those that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("rest"))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as texts without windows; repeated rows stay or go together; an empty table gives no
    rows. Columns keep their values, whatever their names.
    """
    scored = byte_cnn.classify(wrapped(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unwrapped(scored.filter("predicted = 1"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component stays; rows with a null doc_id stay too.

    Of repeated rows with one doc_id, all stay or go together.
    """
    found = jaccard_join.link_components(docs)
    gone = tables.bounded(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item's wording, re-parameterised or not, go."""
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows. All documents stay.

    Null texts stay null, repeated rows are masked alike, and other columns keep their values, whatever their names.
    """
    clean = unwrapped(markov_secrets.redacted(markov_secrets.scan(wrapped(docs))), docs.columns)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences.

    A null or empty text is its separator alone; every row is packed, repeats too; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", lexical_packing),
]

#: Models and tokenizers cannot be stated in SQL; tests/llm/test_pipeline.py compares each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.table(docs)
    return docs
