"""From raw documents to token files: five stages, each an operator of the corpus subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandloom.llm.common import shared_folder, stored
from bandloom.llm.decontaminate import drop_contaminated
from bandloom.llm.language_id import drop_unidentified
from bandloom.llm.mixing import mixed_documents
from bandloom.llm.near_dedup import drop_near_duplicates
from bandloom.llm.token_files import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go."""
    return drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as many times as the mix takes it, up to three times or not at all."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents are written as bit-packed token ids and read back."""
    return encode_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_files", token_files)]

#: Stages run models and tokenizers, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), shared_folder(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
