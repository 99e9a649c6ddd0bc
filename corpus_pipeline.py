"""The corpus pipeline: language, lines, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents``.  Odd input: null texts have no language and go with the
first stage; what the operators define for repeated rows and null ids holds here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_engine.llm.langid import keep_identified, learn_languages
from outcome_engine.llm.lines import dedup_lines
from outcome_engine.llm.neardup import without_near_copies
from outcome_engine.llm.queries import packed_pieces
from outcome_engine.llm.tables import read, stored
from outcome_engine.llm.templates import without_leaks


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that are not held out; documents without a language go."""
    return keep_identified(docs, learn_languages(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first one only; n_chars follows the text."""
    kept = dedup_lines(docs, counts=("__lines", "__dropped")).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_pieces(docs)


STAGES = [("language", identify_language), ("lines", drop_repeated_lines), ("near copies", drop_near_copies),
          ("benchmark", drop_benchmark_leaks), ("packing", pack)]
ORACLE_SQL = None  # a trained field, and packing by dynamic programming, are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
