"""A corpus pipeline: language, toxicity, near duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varidoc.llm import language_id, mixing, near_dedup, packing, toxicity
from varidoc.llm.common import content, fresh, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Those without a letter go; a null text is one of them."""
    profiles = language_id.fit(docs.filter(~F.coalesce(language_id.held_out(), F.lit(False))))
    return docs.filter(language_id.language_of(spark, profiles)(F.col("text"))["lang"] != language_id.UNDETERMINED)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic: a probability below 0.7."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxicity_of(spark, model)(F.col("text"))["score"] < 0.7)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, since ids may be null or repeat; and the number's column."""
    row = fresh(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of least id; rows of other groups stay whatever their ids."""
    rows, row = _numbered(docs)
    return rows.join(near_dedup.survivors(rows, row), row, "left_semi").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix plays them: not at all, once or twice. Plays belong to rows; the mix is
    shuffled by id and content, so row numbers decide between equal rows only."""
    rows, row = _numbered(docs)
    plays = mixing.mix(rows, keep=row, tie=content(docs)).filter("plays > 0").select(F.col("kept").alias(row), "plays")
    played, play = rows.join(plays.withColumnRenamed("plays", fresh(rows, "plays")), row), fresh(docs, "play")
    return played.withColumn(play, F.explode(F.sequence(F.lit(1), F.col(fresh(rows, "plays"))))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens; every play of a document is packed once."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", clean), ("near_dedup", distinct), ("mixing", mixture), ("packing", sequences)]

#: Token ids and digests of words are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
