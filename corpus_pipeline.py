"""A training corpus from raw documents, in five stages. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.llm import bpe_tree, decontam, jaccard_join, language_id, line_dedup
from marisma.llm.scratch import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those where no language has three tenths of the words' probability.

    A document that mixes languages stays as long as one of them has that share; null and empty texts go.
    """
    known = language_id.predict_languages(docs)
    return known.where((F.col("lang_pred") != language_id.UND) & (F.col("lang_score") >= 0.3)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 40 code points or more that five documents share, except in the largest doc_id; n_chars follows the text. No document goes, one of shared lines alone becomes empty."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingle sets of similarity 0.8 or more stays, that of the smallest doc_id.

    Rows are told apart by a 64-bit hash of their file and place in it, not by doc_id, which may be null or stand twice. Null comes after all ids;
    of rows with one doc_id that of the smallest hash of the text stays, of equal rows any one. Texts without a word are linked
    with nothing and stay.
    """
    key = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        rows = docs.withColumn("_row", key)
    except AnalysisException:  # not read from Parquet
        rows = keep(docs, "pipeline-rows").withColumn("_row", key)
    classes = jaccard_join.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), size=5, percent=80)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text"), "_row").alias("order")
    named = classes.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", order), "_row")
    stay = keep(named.groupBy("component_id").agg(F.min("order").alias("order")).select("order._row"), "pipeline-stay")
    return rows.join(stay, "_row", "left_semi").select(*docs.columns)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark table or a paraphrase of one."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = bpe_tree.encode_documents(docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", decontam_stage), ("byte-level BPE", encode_stage)]

#: SQL can express neither the first stage nor the last two.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{i}")
    return docs
