"""Registered queries of the modelling half: features, selection, split, scaling,
metrics, scoring and the report.

Queries whose result does not depend on a trained model are checked against
SQL; the model-dependent ones (forest importances, model table, model scores)
are checked by row count only.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import DEFAULT, Settings
from ..operators import features as FE
from ..operators import impute as IM
from ..operators import insights as INS
from ..operators import metrics as M
from ..operators import prep as PR
from ..operators import scoring as SC
from ..operators import selection as SEL
from ..session import cut_lineage
from .catalog import ventures

DIGITS = 6


def _round_doubles(df: DataFrame, digits: int = DIGITS, skip: tuple = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if isinstance(t, T.DoubleType) and c not in skip else F.col(c)
                       for c, t in ((f.name, f.dataType) for f in df.schema.fields)])


def training_frame(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT):
    """Cleaned table, fitted feature statistics and the training feature frame (shared per session)."""
    return _training_frame(spark, sf_dir, settings)


@lru_cache(maxsize=8)
def _training_frame(spark: SparkSession, sf_dir: str, settings: Settings):
    v = ventures(spark, sf_dir, settings)
    train = FE.with_target(v)
    model = FE.fit_features(train, settings)
    return v, model, model.transform(train)


# Features of the caller's own: SQL expressions over the feature frame.
EXTRA_FEATURES = {"funding_per_year": "funding_total_usd_filled / (company_age_years + 1)",
                  "web_and_place": "has_homepage * has_location"}


def _features_extra(spark, sf_dir):
    v = ventures(spark, sf_dir)
    train = FE.with_target(v)
    model = FE.fit_features(train, DEFAULT, extra_features=EXTRA_FEATURES)
    return _round_doubles(model.transform(train).select("venture_id", *EXTRA_FEATURES))


def _features_oof(spark, sf_dir):
    """Success rates of category and country without the row's own fold, and without the row."""
    _, _, feat = training_frame(spark, sf_dir)
    rows = PR.stratified_split(feat.select("venture_id", "primary_category", "country_code", "target"))
    out = FE.encoded_rates(FE.encoded_rates(rows, "primary_category", prefix="category_"), "country_code", prefix="country_")
    return _round_doubles(out.select("venture_id", "fold", "category_oof", "category_loo", "country_oof", "country_loo"))


def _features(spark, sf_dir):
    _, _, feat = training_frame(spark, sf_dir)
    cands = [c for c in C.CANDIDATE_FEATURES if c in feat.columns]
    return _round_doubles(feat.select("venture_id", "target", *cands))


def _prepared(spark, sf_dir):
    return _prepared_frame(spark, sf_dir, DEFAULT)


@lru_cache(maxsize=8)
def _prepared_frame(spark, sf_dir, settings):
    """The selection clean-up frame (shared per session; read by three selectors)."""
    _, _, feat = training_frame(spark, sf_dir, settings)
    return cut_lineage(SEL.prepare(feat, list(C.CANDIDATE_FEATURES), settings=settings))


def _sel_correlation(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    out = SEL.correlation_rank(p, list(C.CANDIDATE_FEATURES))
    return out.select("feature", F.round("corr", DIGITS).alias("corr"), F.round("abs_corr", DIGITS).alias("abs_corr"),
                      "position", "rank")


def _sel_variance(spark, sf_dir):
    t = SEL.variance_table(_prepared(spark, sf_dir), list(C.CANDIDATE_FEATURES))
    v = F.col("variance")
    e = F.when(v > 0, F.floor(F.log10(v)).cast("int")).otherwise(F.lit(0))
    scaled = F.when(e >= 0, v / F.pow(F.lit(10.0), e)).otherwise(v * F.pow(F.lit(10.0), -e))
    return t.select("feature", F.round(scaled, DIGITS).alias("variance_mantissa"), e.alias("variance_exponent"),
                    "selected")


def _split(spark, sf_dir):
    _, _, feat = training_frame(spark, sf_dir)
    return PR.stratified_split(feat.select("venture_id", "target"), label="target")


def _scaler(spark, sf_dir):
    """The scaler that the models use: fitted on the feature frame, with its one rule for an empty range."""
    _, _, feat = training_frame(spark, sf_dir)
    s = PR.fit_robust_scaler(feat, list(C.CANDIDATE_FEATURES))
    return _round_doubles(PR.scaler_table(s, list(C.CANDIDATE_FEATURES)))


# Columns of the cleaned table that still have nulls before the features fill them with medians.
IMPUTED = ("funding_total_usd", "funding_rounds", "funding_per_round", "company_age_years", "days_to_first_funding",
           "funding_duration_days", "category_count")


def _knn(spark, sf_dir):
    """All ventures with their nulls filled from the five nearest concluded ones, open ventures too (as in scoring)."""
    v = ventures(spark, sf_dir)
    model = IM.fit_knn(FE.with_target(v), IMPUTED)
    return _round_doubles(model.transform(v.select("venture_id", *IMPUTED)))


def _baseline_predictions(spark, sf_dir):
    _, _, feat = training_frame(spark, sf_dir)
    s = SC.baseline_score(feat)
    return s.select(F.lit("baseline").alias("model"), "venture_id", F.col("target").alias("label"),
                    F.col("success_probability").alias("score"), F.col("predicted_success").alias("pred"))


def _met_auc(spark, sf_dir):
    return M.auc_table(_baseline_predictions(spark, sf_dir))


def _met_roc(spark, sf_dir):
    return M.roc_curve(_baseline_predictions(spark, sf_dir))


def _met_pr(spark, sf_dir):
    return M.pr_curve(_baseline_predictions(spark, sf_dir))


def _met_confusion(spark, sf_dir):
    return M.confusion(_baseline_predictions(spark, sf_dir))


def _met_summary(spark, sf_dir):
    return M.evaluate(_baseline_predictions(spark, sf_dir))


def operating_scored(spark, sf_dir, settings: Settings = DEFAULT) -> DataFrame:
    """Open ventures with features from the training statistics and the baseline score."""
    return SC.baseline_score(_operating_features(spark, sf_dir, settings))


@lru_cache(maxsize=8)
def _operating_features(spark, sf_dir, settings):
    """Stored once: several summaries and the model scoring read a few of its columns each."""
    v, model, _ = training_frame(spark, sf_dir, settings)
    return cut_lineage(model.transform(v.where(F.col("status") == "operating")))


def _sco_summary(spark, sf_dir):
    return SC.summary(operating_scored(spark, sf_dir))


def _sco_confidence(spark, sf_dir):
    return SC.confidence_distribution(operating_scored(spark, sf_dir))


def _sco_top(spark, sf_dir):
    return SC.top_promising(operating_scored(spark, sf_dir))


def _sco_rollup(spark, sf_dir):
    return SC.category_rollup(operating_scored(spark, sf_dir))


def _sco_predictions(spark, sf_dir):
    return SC.prediction_table(operating_scored(spark, sf_dir))


def _ins(fn):
    def run(spark, sf_dir):
        return fn(ventures(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


def _ins_quadrants(spark, sf_dir):
    return INS.quadrants(INS.opportunity(ventures(spark, sf_dir)))


def _ins_high_opportunity(spark, sf_dir):
    return INS.high_opportunity(INS.opportunity(ventures(spark, sf_dir)))


def _ins_report(spark, sf_dir):
    return INS.report(ventures(spark, sf_dir)).withColumn("value", F.round("value", DIGITS))


# ------------------------------------------------------------------ model-dependent (rows-only check)
@lru_cache(maxsize=4)
def selection(spark: SparkSession, sf_dir: str) -> dict:
    """The selectors' tables and the chosen features, once per (session, folder); no model but the selector forest is trained."""
    _, _, feat = training_frame(spark, sf_dir)
    return SEL.select_features(feat, prepared=_prepared(spark, sf_dir))


@lru_cache(maxsize=4)
def trained(spark: SparkSession, sf_dir: str, grid: str = "single"):
    """Select features, scale, split and train the model families once per (session, folder)."""
    from ..operators import models as MD
    v, fmodel, feat = training_frame(spark, sf_dir)
    sel = selection(spark, sf_dir)
    chosen = sel["selected"]
    # models learn from the feature frame itself (the selection clean-up only ranks features)
    scaler = PR.fit_robust_scaler(feat, chosen)
    # the split only adds columns, so no row is joined to another one's label or fold
    scaled = PR.robust_scale(feat, scaler, chosen, keep=["venture_id", "target"])
    data = PR.stratified_split(scaled, label="target").withColumnRenamed("target", "label")
    res = MD.train_models(data, chosen, grid=grid)
    return {"ventures": v, "features": fmodel, "selection": sel, "scaler": scaler, "result": res}


def _sel_forest(spark, sf_dir):
    return selection(spark, sf_dir)["forest"]


def _sel_selected(spark, sf_dir):
    chosen = selection(spark, sf_dir)["selected"]
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(chosen)], "feature string, position int")


def _mdl_results(spark, sf_dir):
    return trained(spark, sf_dir)["result"].metrics


def _mdl_chosen(spark, sf_dir):
    return trained(spark, sf_dir)["result"].chosen


def _mdl_errors(spark, sf_dir):
    return trained(spark, sf_dir)["result"].errors


def _mdl_confusion_totals(spark, sf_dir):
    """Test rows by model and label: fixed by the split, whatever the models say."""
    cells = M.confusion(trained(spark, sf_dir)["result"].predictions)
    return cells.groupBy("model", "label").agg(F.sum("n").alias("n"))


def _mdl_invariants(spark, sf_dir):
    """What must hold of any trained run: 1 where it does.

    The soft vote is its members' mean, the best model has the largest AUC, and
    each AUC of the table equals the area that Spark's own evaluator finds.
    """
    res = trained(spark, sf_dir)["result"]
    pred, table = res.predictions, res.metrics
    mean = pred.where(F.col("model").isin(*res.members)).groupBy("row_id").agg(F.avg("score").alias("mean"))
    vote = pred.where("model = 'Ensemble'").join(mean, "row_id").agg(F.max(F.abs(F.col("score") - F.col("mean"))).alias("d"))
    top = table.agg(F.max_by("Model", F.struct("ROC-AUC", F.col("Model") == res.best_name)).alias("m"))
    # Spark's evaluator sorts the scores of a model; at most eight models
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0)
    areas = [(n, float(evaluator.evaluate(pred.where(F.col("model") == n).select("score", F.col("label").cast("double"))))) for n in res.models]
    auc = spark.createDataFrame(areas, "Model string, a double").join(table, "Model") \
        .agg(F.max(F.abs(F.col("a") - F.col("ROC-AUC"))).alias("d"), F.count(F.lit(1)).alias("n"))
    one = lambda df, name, ok: df.select(F.lit(name).alias("invariant"), ok.cast("int").alias("holds"))
    return one(vote, "ensemble is the mean of its members", F.col("d") < 1e-9) \
        .union(one(top, "best model has the largest AUC", F.col("m") == res.best_name)) \
        .union(one(auc, "AUC equals the evaluator's area", F.col("d") < 1e-9)) \
        .union(one(table.agg(F.count(F.lit(1)).alias("n")), "seven families and the ensemble", F.col("n") == 8))


def _sco_model_rows(spark, sf_dir):
    """Id and shown columns of every scored open venture."""
    return _sco_model_predictions(spark, sf_dir).select("venture_id", "name", "primary_category", "country_code", "funding_total_usd", "company_age_years")


def _mdl_importance(spark, sf_dir):
    from ..operators import models as MD
    t = trained(spark, sf_dir)
    res = t["result"]
    imp = MD.importances(res.models, res.best_name, res.features)
    df = spark.createDataFrame(imp or [("none", 0.0)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(10)


def _sco_model_predictions(spark, sf_dir):
    from ..operators import models as MD
    t = trained(spark, sf_dir)
    res = t["result"]
    op = t["features"].transform(t["ventures"].where(F.col("status") == "operating"))
    shown = ["name", "primary_category", "country_code", "funding_total_usd", "company_age_years"]
    op = op.select("*", *[F.col(c).alias(f"_show_{c}") for c in shown])
    keep = ["venture_id"] + [f"_show_{c}" for c in shown]
    scaled = PR.robust_scale(op, t["scaler"], res.features, keep=keep)
    scored = MD.predict(res.models, res.best_name, scaled)
    scored = scored.select("venture_id", "success_probability", "predicted_success",
                           *[F.col(f"_show_{c}").alias(c) for c in shown])
    return SC.prediction_table(scored)


def _mdl_curve(kind):
    def run(spark, sf_dir):
        res = trained(spark, sf_dir)["result"]
        pred = res.predictions
        if kind == "roc":
            return M.roc_curve(pred)
        if kind == "pr":
            return M.pr_curve(pred)
        return M.confusion(pred)
    run.__name__ = f"_mdl_{kind}"
    return run


def _importance_table(spark, sf_dir, k):
    from ..functions import exprs as X
    from ..operators import models as MD
    res = trained(spark, sf_dir)["result"]
    imp = MD.importances(res.models, res.best_name, res.features)
    df = spark.createDataFrame(imp or [("none", 0.0)], "feature string, importance double")
    top = df.orderBy(F.col("importance").desc(), "feature").limit(k)
    return top.withColumn("factor", X.snake_to_title("feature"))


def _ins_success_factors(spark, sf_dir):
    """INS-01: the best model's 8 most important features."""
    return _importance_table(spark, sf_dir, 8)


def _ins_model_summary(spark, sf_dir):
    """INS-07: best model, its ROC-AUC and its five main factors (prettified names)."""
    res = trained(spark, sf_dir)["result"]
    best = res.metrics.where(F.col("Model") == res.best_name).select("Model", "ROC-AUC")
    pairs = F.collect_list(F.struct(-F.col("importance"), F.col("feature"), F.col("factor")))
    top5 = _importance_table(spark, sf_dir, 5).agg(F.array_join(F.sort_array(pairs)["factor"], ", ").alias("top_factors"))
    return best.crossJoin(top5)


def _ins_run_summary(spark, sf_dir):
    """INS-15: rows analysed, best model, number of scored open ventures."""
    t = trained(spark, sf_dir)
    n = t["ventures"].agg(F.count(F.lit(1)).alias("n_ventures"))
    n_op = t["ventures"].where(F.col("status") == "operating").agg(F.count(F.lit(1)).alias("n_predictions"))
    best = t["result"].metrics.where(F.col("Model") == t["result"].best_name).select(F.col("Model").alias("best_model"))
    return n.crossJoin(best).crossJoin(n_op)


def queries() -> dict:
    return {
        "fea_features": _features,
        "fea_extra": _features_extra,
        "fea_oof": _features_oof,
        "sel_correlation": _sel_correlation,
        "sel_variance": _sel_variance,
        "prp_split": _split,
        "prp_scaler": _scaler,
        "prp_knn": _knn,
        "met_auc": _met_auc,
        "met_roc_curve": _met_roc,
        "met_pr_curve": _met_pr,
        "met_confusion": _met_confusion,
        "met_summary": _met_summary,
        "sco_summary": _sco_summary,
        "sco_confidence": _sco_confidence,
        "sco_top_promising": _sco_top,
        "sco_category_rollup": _sco_rollup,
        "sco_predictions": _sco_predictions,
        "ins_key_stats": _ins(INS.key_stats),
        "ins_risk_factors": _ins(INS.risk_factors),
        "ins_opportunity": _ins(INS.opportunity),
        "ins_quadrants": _ins_quadrants,
        "ins_high_opportunity": _ins_high_opportunity,
        "ins_exit_timing": _ins(INS.exit_timing),
        "ins_geography": _ins(INS.geography),
        "ins_funding": _ins(INS.funding),
        "ins_timing": _ins(INS.timing),
        "ins_tech": _ins(INS.tech),
        "ins_report": _ins_report,
        "sel_forest_importance": _sel_forest,
        "sel_selected": _sel_selected,
        "mdl_results": _mdl_results,
        "mdl_importance": _mdl_importance,
        "mdl_chosen": _mdl_chosen,
        "mdl_errors": _mdl_errors,
        "mdl_confusion_totals": _mdl_confusion_totals,
        "mdl_invariants": _mdl_invariants,
        "sco_model_rows": _sco_model_rows,
        "sco_model_predictions": _sco_model_predictions,
        "mdl_roc_curve": _mdl_curve("roc"),
        "mdl_pr_curve": _mdl_curve("pr"),
        "mdl_confusion": _mdl_curve("confusion"),
        "ins_success_factors": _ins_success_factors,
        "ins_model_summary": _ins_model_summary,
        "ins_run_summary": _ins_run_summary,
    }
