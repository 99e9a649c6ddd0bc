"""Classification metrics (MET-*) over a long predictions table.

Input rows: ``model, label (0/1), score (probability of 1), pred (0/1)``, one per
(model, entity).  Every metric is an aggregation; curves and AUC use the
distributed running sums of ``ranks`` (no single-task window over all scores).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import exprs as X
from .ranks import cumulative_before


def score_counts(pred: DataFrame, by: Sequence[str] = ("model",), settings: Settings = DEFAULT) -> DataFrame:
    """Per distinct score: positives, negatives and those strictly below (by, score, pos, neg, pos_before, neg_before),
    plus the group totals P and N."""
    by = list(by)
    counts = pred.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    cum = cumulative_before(counts, by, "score", ["pos", "neg"], settings)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.join(F.broadcast(totals), by) if by else cum.crossJoin(F.broadcast(totals))


def auc_table(pred: DataFrame, by: Sequence[str] = ("model",), settings: Settings = DEFAULT) -> DataFrame:
    """ROC-AUC (ties count one half, i.e. the Mann-Whitney statistic) and average precision per group."""
    by = list(by)
    c = score_counts(pred, by, settings)
    tps = F.col("P") - F.col("pos_before")
    fps = F.col("N") - F.col("neg_before")
    pairs = F.col("pos") * (F.col("neg_before") + F.lit(0.5) * F.col("neg"))
    return c.groupBy(*by).agg(
        F.max("P").alias("n_pos"), F.max("N").alias("n_neg"),
        F.try_divide(F.sum(pairs), F.max("P") * F.max("N")).alias("auc"),
        F.round(F.sum(F.try_divide(F.col("pos").cast("double"), F.col("P").cast("double"))
                      * F.try_divide(tps.cast("double"), (tps + fps).cast("double"))), 9).alias("average_precision"))


def roc_curve(pred: DataFrame, by: Sequence[str] = ("model",), settings: Settings = DEFAULT) -> DataFrame:
    """All ROC points (threshold = each distinct score; a row scores positive when >= threshold)."""
    by = list(by)
    c = score_counts(pred, by, settings)
    tps = F.col("P") - F.col("pos_before")
    fps = F.col("N") - F.col("neg_before")
    return c.select(*by, F.col("score").alias("threshold"), tps.alias("tps"), fps.alias("fps"),
                    X.ratio(fps, F.col("N")).alias("fpr"), X.ratio(tps, F.col("P")).alias("tpr"))


def pr_curve(pred: DataFrame, by: Sequence[str] = ("model",), settings: Settings = DEFAULT) -> DataFrame:
    """Precision and recall at each distinct score threshold."""
    by = list(by)
    c = score_counts(pred, by, settings)
    tps = F.col("P") - F.col("pos_before")
    fps = F.col("N") - F.col("neg_before")
    return c.select(*by, F.col("score").alias("threshold"),
                    X.ratio(tps, tps + fps).alias("precision"), X.ratio(tps, F.col("P")).alias("recall"))


def confusion(pred: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """All four cells (label, pred, n) per group, empty cells as 0."""
    by = list(by)
    cells = pred.groupBy(*by).agg(*[F.count_if((F.col("label") == a) & (F.col("pred") == b)).alias(f"c{a}{b}")
                                    for a in (0, 1) for b in (0, 1)])
    arr = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"c{a}{b}").alias("n"))
                    for a in (0, 1) for b in (0, 1)])
    return cells.select(*by, F.explode(arr).alias("c")).select(*by, "c.*")


def classification_summary(pred: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 per group."""
    by = list(by)
    y, p = F.col("label"), F.col("pred")
    agg = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == p).alias("_ok"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(*by, "n", "tp", "fp", "fn",
                      X.ratio(F.col("_ok"), F.col("n")).alias("accuracy"),
                      F.coalesce(X.ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
                      F.coalesce(X.ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
                      F.coalesce(X.ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def evaluate(pred: DataFrame, by: Sequence[str] = ("model",), settings: Settings = DEFAULT) -> DataFrame:
    """One row per group: n, accuracy, precision, recall, f1, auc, average_precision."""
    by = list(by)
    s = classification_summary(pred, by)
    a = auc_table(pred, by, settings).select(*by, "auc", "average_precision")
    return s.join(a, by) if by else s.crossJoin(a)
