"""The corpus pipeline: its stages, in order, and a run of all of them over `documents`.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`. Every
stage's rows are written as a table in the shared folder and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleflow.llm import decontaminate, lines, packing, similar, toxicity
from alleleflow.llm.shared import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, or nearly stand, earlier in the table. A document that
    loses all its lines goes; n_chars follows the text."""
    cleaned = lines.remove_similar_lines(docs)
    cleaned = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.col("n_removed") > 0
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of 5-word-shingle Jaccard similarity 0.8 or more join.
    Candidates come from SimHash fingerprints within 4 bits and, for the pairs these miss, from MinHash."""
    return similar.drop_near_duplicates(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", reject_toxic), ("line dedup", dedup_lines), ("near-dedup", dedup_documents),
          ("benchmark decontamination", decontaminate_documents), ("packing", pack_documents)]

#: Tokenization, SimHash and MinHash have no SQL form; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
