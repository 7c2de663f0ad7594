"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes all that its predecessor kept, written as Parquet and read
again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm import jaccard, lines, mixing, packing, quality
from pageflow.sources.shared import staged
from pageflow.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents that go to Python at once.  Spark's 10,000 are tens of megabytes of text, several times over in both processes.
ARROW_ROWS = 2_000
#: Documents that a reader of Parquet holds at once; its arrays double in size until a batch of texts fits.
READER_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """The session hands out at most ``ARROW_ROWS`` rows and reads ``READER_ROWS`` at a time, or fewer if it is set so."""
    for name, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
        ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS),
    ):
        if not 0 < int(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or leave their language's perplexity band go."""
    small_batches(spark)
    return quality.passed(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than 1 % and at least five of a source's documents share go; every document stays."""
    small_batches(spark)
    cleaned = lines.drop_boilerplate(docs, lines.LineSettings(max_ratio=0.01), host="source")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays.

    Near duplicates take shingles of five words and a similarity of 0.8.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, jaccard.JaccardSettings(words=5, percent=80))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target words; a document may be left out or stand twice."""
    small_batches(spark)
    return mixing.mix(docs)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces in windows of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, packing.PackSettings(public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", source_mix),
    ("packing", window_packing),
]

#: Perplexity, near duplicates and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
