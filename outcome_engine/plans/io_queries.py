"""Registered queries of sources and sinks: what is written is read back, whole.

The files lie in new folders below the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distinct as D
from ..operators import cohorts as K
from ..session import scratch
from ..sources import sinks
from ..sources.fixture import ventures_raw
from ..sources.readers import CSV_OPTIONS, read_ventures_csv
from . import ml_queries
from .catalog import _clean_table, ventures


def multi_line_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: raw ventures with line breaks, quotes and commas in a field, written as CSV and read in splits."""
    path = scratch(spark, "csv")
    raw = ventures_raw(spark, sf_dir)
    cell = F.concat(F.col("name"), F.lit('\nknown as "'), F.col("k").cast("string"), F.lit('",\n\nof '), F.coalesce("city", F.lit("nowhere")))
    raw = raw.withColumn("name", cell).select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    raw.write.options(header=True, escape=CSV_OPTIONS["escape"], ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_ventures_csv(spark, path, multi_line=True).select("k", "name", "category_list", "funding_total_usd", "status", "founded_at")


def cleaned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01: the cleaned table as Parquet."""
    path = sinks.layout(scratch(spark, "sink"))["data"] + "/cleaned_ventures"
    sinks.write_table(_clean_table(spark, sf_dir), path)
    return spark.read.parquet(path)


def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: the prediction table as headered CSV."""
    path = sinks.layout(scratch(spark, "sink"))["data"] + "/predictions"
    table = ml_queries.queries()["sco_predictions"](spark, sf_dir)
    sinks.write_table(table, path, fmt="csv")
    return spark.read.option("header", True).schema(table.schema).csv(path)


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: all panels from the shared scans, written; the rows of each table."""
    root = scratch(spark, "sink")
    out = None
    for name in sinks.write_dashboard(ventures(spark, sf_dir), root):
        n = spark.read.parquet(f"{sinks.layout(root)['panels']}/{name}").agg(F.lit(name).alias("panel"), F.count(F.lit(1)).alias("n_rows"))
        out = n if out is None else out.unionAll(n)
    return out


def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: distinct categories and countries by year from sketches per (year, country), beside the exact counts."""
    v = ventures(spark, sf_dir).where("founded_at IS NOT NULL").withColumn("year", F.year("founded_at"))
    lists = K.category_lists(v, F.col("year"), F.col("country_code"))
    stored = D.sketches(K.explode_categories(lists, ["year", "country_code"]), ["year", "country_code"], {"categories": "category", "countries": "country_code"})
    guess = D.roll_up(stored, ["year"], ["categories", "countries"])
    items = K.explode_categories(v, ["year", "country_code"])
    exact = items.groupBy("year").agg(F.count_distinct("category").alias("n_categories"), F.count_distinct("country_code").alias("n_countries"))
    near = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.03 + 0.5).cast("int")
    return exact.join(guess.drop("n"), "year").select("year", "n_categories", "n_countries", near("categories", "n_categories").alias("categories_near"),
                                                      near("countries", "n_countries").alias("countries_near"))


def queries() -> dict:
    return {"src_multiline_csv": multi_line_csv, "snk_cleaned_table": cleaned_table, "snk_predictions_csv": predictions_csv, "snk_dashboard": dashboard,
            "agg_distinct_sketches": distinct_sketches}
