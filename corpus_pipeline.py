"""The corpus pipeline: quality rules, language identification, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of ``documents``, and any
further ones, whatever their names; the last returns the packed pieces. A stage's result is written before the next reads it; then
what the stage wrote on the way, and its input, are removed, so the mix alone is left for packing.
An empty table gives an empty result in every stage; rows with a null id or source are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.langid import keep_identified
from weirflow.llm.mixing import shuffled_rows
from weirflow.llm.packing import pack
from weirflow.llm.quality import keep_good
from weirflow.llm.queries import tokenizer
from weirflow.llm.similar import keep_similar_one
from weirflow.operators.state import settled

#: Rows that Spark hands a Python worker at once, in the stages that have workers (a setting of the session).
WORKER_ROWS = 2000


def bounded(spark: SparkSession) -> None:
    """Sets WORKER_ROWS, so that what a batch of texts takes on either side of the socket stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WORKER_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes. A null or empty text has no words and fails; a null source is
    a host; repeated rows are judged each."""
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by the filters' evidence. A null text or one without a letter goes; a null language is
    not learned from; without any learned language nothing is told and all go; repeated rows are told alike."""
    bounded(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles shared to 0.8 or more, every link verified. Candidates
    are op4's components of fingerprints and, beyond their four bits, MinHash bands. The row of the least id stays, null ids last, then that of the least text hash; null and empty texts are one group; rows that share
    id and text are one."""
    bounded(spark)
    return keep_similar_one(docs, k=5, least=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, every shard in its shuffled order. A null source is the last; null texts have
    no words; repeated rows are drawn each."""
    return shuffled_rows(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full windows, with their ids. A null or empty text is the closing id alone; repeated rows are
    packed each."""
    bounded(spark)
    return pack(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Fingerprints, learned filters and byte-pair ids have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def after(spark: SparkSession, sf_dir: str, stages: int) -> DataFrame:
    """``documents`` after the first ``stages`` stages, kept; all that was kept before is removed."""
    if not stages:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    return settled(spark, lambda: STAGES[stages - 1][1](spark, after(spark, sf_dir, stages - 1), sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of ``documents``."""
    return STAGES[-1][1](spark, after(spark, sf_dir, len(STAGES) - 1), sf_dir)
