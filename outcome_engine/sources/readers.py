"""Sources: parquet tables of a scale-factor folder and raw headered CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Roles
from .csv_records import read_csv_in_splits

RAW_COLUMNS = ("name", "homepage_url", "category_list", "funding_total_usd", "status", "country_code",
               "state_code", "city", "funding_rounds", "founded_at", "first_funding_at", "last_funding_at")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The same for files and streams, so one file parses alike in both.
CSV_OPTIONS = {"header": "true", "escape": '"', "mode": "PERMISSIVE"}


def read_ventures_csv(spark: SparkSession, path: str, roles: Roles | None = None, multi_line: bool = False) -> DataFrame:
    """Headered CSV, every column as text (the cleaner does the typing).

    Without ``inferSchema`` Spark reads all columns as strings named by the
    header, so there is no inference pass over the input.  ``multi_line`` accepts
    line breaks inside quoted fields; large files are read in splits then too.
    ``roles`` renames the input's columns onto the engine's names; columns the
    engine does not use are kept as they are.
    """
    roles = roles or Roles()
    df = read_csv_in_splits(spark, path, CSV_OPTIONS) if multi_line else spark.read.options(**CSV_OPTIONS).csv(path)
    for src, dst in roles.rename_map().items():
        if src in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df
