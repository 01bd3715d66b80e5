"""A corpus pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxbook.llm.mixing import mixed_texts
from fluxbook.llm.resampling import resample
from fluxbook.llm.secrets import redact_secrets
from fluxbook.llm.shingle_join import keep_one_each
from fluxbook.llm.staging import staged, without
from fluxbook.llm.templates import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    drawn = staged(resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "pipeline-quality")
    return without(docs, "doc_id", "text", drawn.filter("not kept").select(F.col("doc_id").alias("id"), "text_hash"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, its templates with other values included."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, "doc_id", "text", found.filter("contaminated").select(F.col("doc_id").alias("id"), "text_hash"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: what a source gives beyond its budget is left out, the document at the cut is shortened, a small
    source's documents come again."""
    out = mixed_texts(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
]

#: Models and similarity joins have no SQL here; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
