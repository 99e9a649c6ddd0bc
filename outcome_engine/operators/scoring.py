"""Scoring (SCO-*): probabilities for open ventures, confidence buckets and summaries.

The summaries take any table with ``success_probability`` and
``predicted_success``, so they run the same on a model's output, on a streaming
micro-batch or on a transparent baseline score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from . import cohorts as K

PREDICTION_COLUMNS = ("name", "primary_category", "country_code", "funding_total_usd", "company_age_years",
                      "predicted_success", "success_probability", "confidence_category")


def baseline_score(feat: DataFrame) -> DataFrame:
    """A transparent prior score from the target-encoded rates and funding size (0..1, 4 decimals).

    Used where a deterministic score is wanted (tests, SQL-checked summaries).
    """
    s = (F.lit(0.5) * F.col("category_success_rate") + F.lit(0.3) * F.col("country_success_rate")
         + F.lit(0.2) * F.col("funding_log") / F.lit(10.0))
    p = F.round(X.clip(s, 0.0, 1.0), 4)
    return feat.withColumn("success_probability", p).withColumn(
        "predicted_success", (F.col("success_probability") > 0.5).cast("int"))


def with_confidence(scored: DataFrame) -> DataFrame:
    edges, labels, lowest = C.CONFIDENCE_BUCKETS
    return scored.withColumn("confidence_category", X.bucketize("success_probability", edges, labels, lowest))


def prediction_table(scored: DataFrame) -> DataFrame:
    """The 8-column prediction table of the original output (plus the entity id)."""
    return with_confidence(scored).select("venture_id", *PREDICTION_COLUMNS)


def summary(scored: DataFrame) -> DataFrame:
    """n scored, n predicted to succeed, percent, mean probability."""
    n = F.count(F.lit(1))
    return scored.agg(n.alias("n_scored"), F.sum("predicted_success").cast("long").alias("n_predicted_success"),
                      X.pct(F.sum("predicted_success"), n).alias("pct_predicted_success"),
                      F.round(F.avg("success_probability"), 6).alias("mean_probability"))


def confidence_distribution(scored: DataFrame) -> DataFrame:
    """Counts and percent of all scored rows per confidence bucket (a probability of 0 has no bucket)."""
    c = with_confidence(scored)
    total = F.broadcast(c.agg(F.count(F.lit(1)).alias("_total")))
    counts = K.value_counts(c, "confidence_category")
    return counts.crossJoin(total).select("confidence_category", "n",
                                          X.pct(F.col("n"), F.col("_total")).alias("pct"))


def top_promising(scored: DataFrame, k: int = 20) -> DataFrame:
    """The k highest probabilities (ties by entity id) with the 7 report columns."""
    c = with_confidence(scored).select("venture_id", *[x for x in PREDICTION_COLUMNS if x != "predicted_success"])
    return K.top_k(c, "success_probability", "venture_id", k)


def category_rollup(scored: DataFrame, min_total: int = C.MIN_SCORED_CATEGORY, k: int = 15) -> DataFrame:
    """Per primary category: Total, Predicted_Success, Success_Rate, Avg_Probability (3 decimals);
    categories with at least ``min_total`` rows, top k by mean probability."""
    g = scored.groupBy("primary_category").agg(
        F.count(F.lit(1)).alias("Total"),
        F.sum("predicted_success").cast("long").alias("Predicted_Success"),
        F.round(X.ratio(F.sum("predicted_success"), F.count(F.lit(1))), 3).alias("Success_Rate"),
        F.round(F.avg("success_probability"), 3).alias("Avg_Probability"))
    g = g.where(F.col("Total") >= min_total)
    return K.top_k(g, "Avg_Probability", "primary_category", k)
