"""Scoring new ventures as files arrive (the batch scorer over a file stream).

Every step of ``Scorer.score`` is row-level or a join with small fitted tables
(stream-static joins), so the same plan runs on ``readStream``; no streaming
state is kept.  Sink: any ``writeStream`` format; the checkpoint location is
required by Spark and must be on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.pipeline import Scorer
from ..sources.readers import CSV_OPTIONS, RAW_COLUMNS


def read_stream(spark: SparkSession, folder: str, columns=RAW_COLUMNS, multi_line: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return spark.readStream.schema(schema).options(**CSV_OPTIONS).option("multiLine", multi_line).csv(folder)


def score_stream(spark: SparkSession, scorer: Scorer, folder: str) -> DataFrame:
    """A streaming DataFrame of predictions for CSV files dropped into ``folder``."""
    return scorer.score(read_stream(spark, folder))
