"""From raw documents to packed training sequences: four stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.near_copies import keep_one_copy
from tabweave.llm.packing import pack_documents
from tabweave.llm.quality_rules import keep_good
from tabweave.llm.queries import held_out, tokenizer_path
from tabweave.llm.shared import new_folder, table
from tabweave.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a model of the labels finds toxic."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return drop_toxic(docs, fit_toxicity(docs, labels))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base checks or a rule of the table."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of texts that share 0.8 of their five-word shingles."""
    return keep_one_copy(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 ids."""
    return pack_documents(docs, tokenizer_path(), end_id=2, width=4096)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("packing", packing)]

#: No SQL: the first stage is a trained model, the last one cuts by dynamic programming.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
