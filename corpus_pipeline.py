"""Document pipeline: quality rules, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Rows with a null or repeated id are judged by their own text. A document that a stage rejects is gone; the
quality stage also cuts the frequent lines of a host out of the texts it keeps, the secret stage replaces
secrets and drops nothing (both keep n_chars right); the last stage returns the pieces of the packed sequences.

Defined cases: empty tables pass through; extra columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fcverify.llm import decontamination, near_dedup, packing, quality_rules, secret_scan
from fcverify.session import settle, shared_dir
from fcverify.shipping import ship


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key that only equal ids with equal texts share, and its name."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(key, F.concat_ws(":", id_text, F.hex(F.xxhash64(text)), F.hex(F.hash(text)))), key


def _measured(docs: DataFrame) -> DataFrame:
    """With the size of changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the frequent lines of their host."""
    return _measured(quality_rules.judged(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    groups = settle(near_dedup.near_groups(docs))
    left = docs.join(groups.filter("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti")
    repeated = settle(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated, "doc_id", "left_anti").unionByName(once)
    return left.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = _keyed(docs)
    found = decontamination.search(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id=key)
    return rows.join(found.select(key).distinct(), key, "left_anti").drop(key)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return _measured(secret_scan.redact(docs, secret_scan.trained(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _stage(function):
    return lambda spark, docs, sf_dir: function(ship(spark), docs, sf_dir)


STAGES = [(f.__name__.removesuffix("_stage"), _stage(f)) for f in (
    quality_stage, near_dedup_stage, decontamination_stage, secret_stage, packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
