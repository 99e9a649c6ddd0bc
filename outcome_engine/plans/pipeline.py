"""The whole run: read -> clean -> panels -> features -> selection -> models ->
evaluation -> scoring -> report, with every table written to ``output_root``.

Also the batch scorer for a file of new ventures (read as raw text, cleaned with
the training cap, featurised with the training statistics, scored by the best
model).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Roles, Settings
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import impute as IM
from ..operators import insights as INS
from ..operators import models as MD
from ..operators import prep as PR
from ..operators import scoring as SC
from ..operators import selection as SEL
from ..session import cut_lineage
from ..sources import sinks
from ..sources.readers import read_ventures_csv
from .dashboard import Dashboard


@dataclass
class RunResult:
    ventures: DataFrame
    panels: dict
    metrics: DataFrame
    predictions: DataFrame
    report: DataFrame
    best_model: str
    features: list


@dataclass
class Scorer:
    """Everything needed to score new rows: cap, feature statistics, selected features, scaler, models."""

    cap: DataFrame
    feature_model: FE.FeatureModel
    features: list
    scaler: DataFrame
    models: dict
    best: str
    settings: Settings = DEFAULT
    imputer: IM.KnnImputer | None = None  # for features of the caller's own that may be null

    def score(self, raw: DataFrame) -> DataFrame:
        """Raw venture rows (text columns) -> the 8-column prediction table."""
        t = CL.drop_incomplete(CL.typed(raw, self.settings))
        t = CL.cap_funding(t, self.settings, self.cap)  # the training cap, as a literal
        v = CL.repair(CL.derive(t, self.settings), self.settings)
        feat = self.feature_model.transform(v)
        shown = ["name", "primary_category", "country_code", "funding_total_usd", "company_age_years"]
        feat = feat.select("*", *[F.col(c).alias(f"_show_{c}") for c in shown])
        keep = ["venture_id"] + [f"_show_{c}" for c in shown]
        if self.imputer is not None:
            if feat.isStreaming:
                raise ValueError("the neighbour search needs whole batches: score them with foreachBatch")
            feat = self.imputer.transform(feat)
        scaled = PR.robust_scale(feat, self.scaler, self.features, keep=keep)
        scored = MD.predict(self.models, self.best, scaled)
        scored = scored.select("venture_id", "success_probability", "predicted_success",
                               *[F.col(f"_show_{c}").alias(c) for c in shown])
        return SC.prediction_table(scored)

    def save(self, root: str) -> None:
        """Everything that scoring needs, below ``<root>/models``: a later session can ``load`` it."""
        base = sinks.layout(root)["models"]
        sinks.save_models(self.models, root)
        self.feature_model.save(f"{base}/feature_statistics")
        sinks.write_table(self.scaler, f"{base}/scaler", partitions=1)
        sinks.write_table(self.cap, f"{base}/funding_cap", partitions=1)
        if self.imputer is not None:
            self.imputer.save(f"{base}/imputer")
        members = {n: len(m) if isinstance(m, list) else 0 for n, m in self.models.items()}
        settings = {k: v for k, v in asdict(self.settings).items() if k != "roles"}
        meta = {"features": list(self.features), "best": self.best, "models": members, "settings": settings, "roles": asdict(self.settings.roles),
                "imputed": self.imputer is not None}
        spark = self.scaler.sparkSession
        sinks.write_table(spark.createDataFrame([(json.dumps(meta),)], "meta string"), f"{base}/scorer", partitions=1)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Scorer:
        """A scorer that ``save`` wrote."""
        base = sinks.layout(root)["models"]
        meta = json.loads(spark.read.parquet(f"{base}/scorer").first()["meta"])
        kept = meta["settings"] | {"date_formats": tuple(meta["settings"]["date_formats"]), "roles": Roles(**meta["roles"])}
        settings = Settings(**kept)
        load = lambda name, suffix="": PipelineModel.load(f"{base}/{sinks.model_key(name)}{suffix}")
        models = {n: [load(n, f"_member{i}") for i in range(k)] if k else load(n) for n, k in meta["models"].items()}
        return cls(spark.read.parquet(f"{base}/funding_cap"), FE.FeatureModel.load(spark, f"{base}/feature_statistics", settings),
                   meta["features"], spark.read.parquet(f"{base}/scaler"), models, meta["best"], settings,
                   IM.KnnImputer.load(spark, f"{base}/imputer") if meta.get("imputed") else None)


def run(spark: SparkSession, raw: DataFrame, output_root: str | None = None, settings: Settings = DEFAULT,
        grid: str = "single", model_names: list[str] | None = None, models: dict | None = None,
        extra_features: dict[str, str] | None = None, impute: bool = False) -> tuple[RunResult, Scorer]:
    """End-to-end analysis of a raw venture table.

    ``impute`` fills nulls of the chosen features from the nearest concluded ventures,
    in training and in scoring; the built-in features have none after their median fill.
    ``models``: families of the caller's own, as for ``train_models``;
    ``extra_features``: features of the caller's own, as for ``fit_features``.
    """
    kept = CL.drop_incomplete(CL.typed(raw, settings))
    cap = CL.funding_stats(kept, settings)
    v = cut_lineage(CL.clean(raw, settings))                       # 1: cleaned table, stored once
    panels = Dashboard(v, settings).tables()                       # 2: dashboards, from three scans
    train = FE.with_target(v)                                      # 3: features
    fmodel = FE.fit_features(train, settings, extra_features)
    feat = fmodel.transform(train)
    sel = SEL.select_features(feat, settings, candidates=[*C.CANDIDATE_FEATURES, *(extra_features or {})])  # 3b: selection
    chosen = sel["selected"]
    imputer = IM.fit_knn(feat, chosen) if impute else None
    feat = imputer.transform(feat) if imputer else feat
    scaler = PR.fit_robust_scaler(feat, chosen, settings)
    scaled = PR.robust_scale(feat, scaler, chosen, keep=["venture_id", "target"])
    data = PR.stratified_split(scaled, "target", settings=settings).withColumnRenamed("target", "label")
    res = MD.train_models(data, chosen, settings, grid=grid, names=model_names, models=models)  # 4-5: models and evaluation
    scorer = Scorer(cap, fmodel, chosen, scaler, res.models, res.best_name, settings, imputer)
    op = fmodel.transform(v.where(F.col("status") == "operating"))  # 6: open ventures
    op = op.select("*", *[F.col(c).alias(f"_show_{c}") for c in
                          ["name", "primary_category", "country_code", "funding_total_usd", "company_age_years"]])
    keep = ["venture_id"] + [f"_show_{c}" for c in
                             ["name", "primary_category", "country_code", "funding_total_usd", "company_age_years"]]
    op = imputer.transform(op) if imputer else op
    scaled = PR.robust_scale(op, scaler, chosen, keep=keep)
    scored = MD.predict(res.models, res.best_name, scaled)
    scored = scored.select("venture_id", "success_probability", "predicted_success",
                           *[F.col(c).alias(c.replace("_show_", "")) for c in keep[1:]])
    predictions = SC.prediction_table(scored)
    report = INS.report(v, settings)                               # 7: report
    result = RunResult(v, panels, res.metrics, predictions, report, res.best_name, chosen)
    if output_root:
        out = sinks.layout(output_root)
        sinks.write_table(v, f"{out['data']}/cleaned_ventures")
        sinks.write_panels(panels, output_root)
        sinks.write_table(res.metrics, f"{out['data']}/model_results", partitions=1)
        sinks.write_table(predictions, f"{out['data']}/predictions")
        sinks.write_table(report, f"{out['data']}/report", partitions=1)
        sinks.write_table(res.chosen, f"{out['data']}/model_settings", partitions=1)
        sinks.write_table(res.errors, f"{out['data']}/model_errors", partitions=1)
        scorer.save(output_root)
    return result, scorer


def score_file(spark: SparkSession, scorer: Scorer, path: str) -> DataFrame:
    """Batch scoring of a headered CSV of new ventures."""
    return scorer.score(read_ventures_csv(spark, path))
