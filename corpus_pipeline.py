"""The corpus pipeline: five stages over documents, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stored, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import keep_one
from tessera.llm.packing import pack
from tessera.llm.quality import CUT, quality_scores
from tessera.llm.toxicity import toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    scored = toxicity_scores(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.filter("toxicity_score < 0.5").drop("toxicity_score")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least CUT stay."""
    scored = quality_scores(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.filter(scored["quality_score"] >= CUT).drop("quality_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the least doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out of the texts; documents that are mostly such windows go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: String kernels, sampled paths and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
