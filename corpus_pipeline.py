"""Raw documents to packed training sequences: quality, toxicity, near duplicates, packing.

Each stage works on what the stage before it kept; its result is written as Parquet to the shared
folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm.near_duplicates import one_of_each
from spendlens.llm.packing import packed_documents
from spendlens.llm.quality import fit_quality, good_documents
from spendlens.llm.shared import stored, table
from spendlens.llm.toxicity import fit_toxicity, harmless_documents


#: Chunks whose ids a worker of the packing stage remembers: workers stay for later stages, and so does what they hold.
REMEMBERED = 250_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-training does not reject."""
    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic window."""
    return harmless_documents(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, each with its place in a sequence of at most 1024 ids."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Trained models and tokenizers have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
