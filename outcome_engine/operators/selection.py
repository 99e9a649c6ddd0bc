"""Feature selection (SEL-*): correlation ranking, variance threshold, forest importance, vote.

The statistics are aggregations over the feature frame; the resulting lists hold
at most 26 feature names, which is the only thing brought to the driver (to
build the feature vector).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Settings
from ..functions import exprs as X
from ..session import cut_lineage
from . import stats as S
from .quantiles import quantile_row


def prepare(feat: DataFrame, features: Sequence[str], keep: Sequence[str] = ("venture_id", "target"),
            settings: Settings = DEFAULT) -> DataFrame:
    """Second clean-up pass: clip every feature to [q01, q99] when q99 > q01, fill nulls
    with the median (0 if none), replace what is not finite by 0."""
    q = quantile_row(feat, {f: f for f in features}, [C.WINSOR_LOW, 0.5, C.WINSOR_HIGH], ["lo", "med", "hi"],
                     settings=settings).first().asDict()  # one bounded row of numbers, applied as literals
    cols = []
    for f in features:
        lo, hi, med = q.get(f"{f}__lo"), q.get(f"{f}__hi"), q.get(f"{f}__med")
        x = F.col(f).cast("double")
        if lo is not None and hi is not None and hi > lo:
            clipped, med_c = X.clip(x, lo, hi), F.lit(min(max(med, lo), hi))
        else:
            clipped, med_c = x, F.lit(med).cast("double")
        cols.append(F.coalesce(X.nan_to_null(clipped), med_c, F.lit(0.0)).alias(f))
    return feat.select(*[k for k in keep if k in feat.columns], *cols)


def correlation_rank(prepared: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """feature, corr, abs_corr, position, rank (abs desc; ties by candidate position); constant features drop out."""
    pos = {f: i for i, f in enumerate(features)}
    out = S.corr_with(prepared, list(features), target, digits=12).where(F.col("corr").isNotNull())
    position = F.lit(0)
    for f, i in pos.items():
        position = F.when(F.col("feature") == f, F.lit(i)).otherwise(position)
    out = out.withColumn("position", position)
    w = Window.orderBy(F.col("abs_corr").desc(), F.col("position"))  # <= 26 rows
    return out.withColumn("rank", F.row_number().over(w))


def variance_table(prepared: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, variance (population), selected (variance > threshold)."""
    row = prepared.agg(*[F.var_pop(f).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("variance")) for f in features])
    out = row.select(F.explode(cells).alias("c")).select("c.*")
    return out.withColumn("selected", (F.col("variance") > C.VARIANCE_THRESHOLD).cast("int"))


def forest_importance(prepared: DataFrame, features: Sequence[str], target: str = "target",
                      settings: Settings = DEFAULT, num_trees: int = 50, depth: int = 30) -> DataFrame:
    """Random-forest importances (50 trees grown to Spark's greatest depth, fixed seed): feature, importance, rank."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol="_features")
    # deep trees are not sent to the tasks anew at every level: rows keep the ids of their nodes
    rf = RandomForestClassifier(featuresCol="_features", labelCol=target, numTrees=num_trees, maxDepth=depth, seed=settings.seed, cacheNodeIds=True)
    model = rf.fit(va.transform(prepared.select(*features, F.col(target).cast("double").alias(target))))
    imp = model.featureImportances.toArray().tolist()
    spark = prepared.sparkSession
    rows = [(f, float(v), i) for i, (f, v) in enumerate(zip(features, imp))]
    out = spark.createDataFrame(rows, "feature string, importance double, position int")
    w = Window.orderBy(F.col("importance").desc(), F.col("position"))
    return out.withColumn("rank", F.row_number().over(w)).drop("position")


def vote(lists: Sequence[Sequence[str]], corr_order: Sequence[str], all_features: Sequence[str]) -> list[str]:
    """Union of the selector lists ranked by votes (ties: first appearance); at most 20;
    fewer than 10 -> extend by correlation order up to 15; nothing -> every feature."""
    flat = [f for lst in lists for f in lst]
    if not flat:
        return list(all_features)
    first = {}
    for i, f in enumerate(flat):
        first.setdefault(f, i)
    votes = {f: flat.count(f) for f in first}
    ranked = sorted(first, key=lambda f: (-votes[f], first[f]))
    if len(ranked) > C.MAX_SELECTED:
        ranked = ranked[:C.MAX_SELECTED]
    elif len(ranked) < C.MIN_SELECTED:
        for f in corr_order:
            if f not in ranked and len(ranked) < C.FILL_SELECTED:
                ranked.append(f)
    return [f for f in ranked if f in all_features]


def select_features(feat: DataFrame, settings: Settings = DEFAULT, with_forest: bool = True,
                    prepared: DataFrame | None = None, candidates: Sequence[str] = C.CANDIDATE_FEATURES) -> dict:
    """Run the three selectors and the vote; returns the selector tables and the final list."""
    cands = [f for f in candidates if f in feat.columns]
    # read by three selectors and a forest fit (one job per tree level): store it
    if prepared is None:
        prepared = cut_lineage(prepare(feat, cands, settings=settings))
    corr = correlation_rank(prepared, cands)
    var = variance_table(prepared, cands)
    # The selector outputs are <= 26-row tables: bringing them to the driver is metadata.
    corr_rows = corr.orderBy("rank").select("feature").collect()
    corr_order = [r.feature for r in corr_rows]
    lists = [corr_order[:C.TOP_CORR_FEATURES],
             [r.feature for r in var.where("selected = 1").select("feature").collect()]]
    rf = None
    if with_forest:
        rf = forest_importance(prepared, cands, settings=settings)
        lists.append([r.feature for r in rf.orderBy("rank").limit(C.TOP_RF_FEATURES).select("feature").collect()])
    final = vote(lists, corr_order, cands)
    return {"prepared": prepared, "correlation": corr, "variance": var, "forest": rf, "selected": final,
            "candidates": cands}
