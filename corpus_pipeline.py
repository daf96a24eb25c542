"""The corpus pipeline: stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import fresh, new_path, table
from missive.llm.line_dedup import drop_repeated_lines
from missive.llm.mixing import mixed_documents
from missive.llm.packing import pack
from missive.llm.simhash import one_per_group
from missive.llm.toxicity import scored


def columns_of(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    Null and empty texts stay unless the bias alone is toxic; rows of repeated ids are judged by their own
    texts; without labels or documents nothing goes; all columns stay, whatever their names.
    """
    (score,) = fresh(docs, "score")
    return scored(docs, table(spark, sf_dir, "labels"), score).where(F.col(score) < 0.5).select(*columns_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go from all of them; no document goes.

    A null text becomes an empty one, and a text of which all lines go is empty; rows of repeated or null ids are
    documents like others.
    """
    return drop_repeated_lines(docs, counts=tuple(fresh(docs, "n_lines", "n_dropped"))).select(*columns_of(docs))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least id, nulls last.

    Of several rows of an id that with the least hash stays; empty and blank texts are one group.
    """
    return one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it, possibly not at all.

    Null and empty texts have size 0: they stay once if their source has no words at all, else as often as
    whole rounds of the source are taken; a null source is the last one.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null or empty text gives the end id alone."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]

#: A trained classifier is among the stages; tests check invariants of each stage, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
