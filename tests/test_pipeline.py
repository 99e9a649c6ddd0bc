"""End-to-end run on sf0.001: sinks, batch scoring of a CSV file, file-stream scoring."""

import os
import tempfile

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from conftest import SF_SMALL
from outcome_engine.operators import clean as CL
from outcome_engine.operators import prep as PR
from outcome_engine.plans import pipeline as PL
from outcome_engine.session import cut_lineage, drop_stored, stored_tables
from outcome_engine.sources.fixture import ventures_raw
from outcome_engine.sources.readers import read_ventures_csv
from outcome_engine.streaming.score_stream import score_stream


def test_run_write_and_score(spark):
    root = tempfile.mkdtemp(prefix="oe-run-", dir="/tmp")
    raw = ventures_raw(spark, SF_SMALL)
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=3)
    broken = DecisionTreeClassifier(featuresCol="no such column", labelCol="label")
    res, scorer = PL.run(spark, raw, output_root=root, model_names=["Logistic Regression", "Random Forest"],
                         models={"Own tree": (tree, [{tree.maxDepth: 2}, {tree.maxDepth: 3}]), "Broken": (broken, [{}])},
                         extra_features={"web_and_place": "has_homepage * has_location"})
    names = {"Logistic Regression", "Random Forest", "Own tree", "Ensemble"}
    assert res.best_model in names and {r["Model"] for r in res.metrics.collect()} == names
    chosen = {r["model"]: r for r in spark.read.parquet(f"{root}/data/model_settings").collect()}
    assert chosen["Own tree"]["parameters"] in ("maxDepth=2", "maxDepth=3") and chosen["Own tree"]["cv_mean"] is not None
    assert {r["model"] for r in spark.read.parquet(f"{root}/data/model_errors").collect()} == {"Broken"}
    cleaned = spark.read.parquet(f"{root}/data/cleaned_ventures")
    assert cleaned.count() == res.ventures.count() and {"funding_bracket", "success_category"} <= set(cleaned.columns)
    n_open = res.ventures.where(F.col("status") == "operating").count()
    assert res.predictions.count() == n_open
    for sub in ("data/cleaned_ventures", "data/model_results", "data/predictions", "panels/d3_rate_by_bracket",
                "models/logistic_regression", "models/feature_statistics/winsor"):
        assert os.path.isdir(os.path.join(root, sub)), sub
    # batch scoring of a raw CSV file of new ventures (all columns as text)
    csv_dir = os.path.join(root, "incoming")
    raw.drop("k").where(F.col("status") == "operating").select(
        *[F.col(c).cast("string") for c in raw.columns if c != "k"]).write.option("header", True).csv(csv_dir)
    scored = PL.score_file(spark, scorer, csv_dir)
    rows = scored.collect()
    assert len(rows) > 0 and all(0.0 <= r["success_probability"] <= 1.0 for r in rows)
    # a saved scorer, loaded in another session, gives the same predictions
    again = PL.score_file(spark.newSession(), PL.Scorer.load(spark.newSession(), root), csv_dir)
    key = lambda r: (r["venture_id"], r["success_probability"], r["predicted_success"])
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))
    # the same scorer over a file stream (one micro-batch, memory sink)
    stream = score_stream(spark, scorer, csv_dir)
    q = stream.writeStream.format("memory").queryName("oe_scored").option(
        "checkpointLocation", os.path.join(root, "stream-ckpt")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("oe_scored").count() == len(rows)


def test_null_features_are_imputed_in_training_and_scoring(spark, tmp_path):
    """A feature of the caller's own with nulls: filled from the nearest concluded ventures on both sides, and by a loaded scorer."""
    raw = ventures_raw(spark, SF_SMALL)
    res, scorer = PL.run(spark, raw, model_names=["Logistic Regression"], impute=True,
                         extra_features={"round_size": "if(venture_id % 3 = 0, null, funding_log / (funding_rounds + 1))"})
    assert "round_size" in scorer.features and scorer.imputer.columns == tuple(scorer.features)
    rows = {r["name"]: r["success_probability"] for r in res.predictions.collect()}
    assert len(rows) > 20 and all(p is not None and 0 <= p <= 1 for p in rows.values())
    scorer.save(str(tmp_path))
    again = PL.Scorer.load(spark, str(tmp_path)).score(raw.where("status = 'operating'"))
    assert {r["name"]: r["success_probability"] for r in again.collect()}.keys() == rows.keys()


def test_repeated_rows_stay_as_many_as_they_are(spark):
    """Equal rows share a content id; no step joins them with each other."""
    raw = ventures_raw(spark, SF_SMALL).drop("k")
    raw = raw.union(raw.limit(20)).union(raw.limit(20))
    res, scorer = PL.run(spark, raw, model_names=["Logistic Regression", "Random Forest"])
    kept = raw.where("name is not null and status is not null and status <> 'NA'").count()
    assert res.ventures.count() == kept
    assert res.predictions.count() == res.ventures.where("status = 'operating'").count()


def test_split_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(i // 3, i % 2, float(i)) for i in range(60)], "venture_id long, target int, x double")
    out = PR.stratified_split(df, n_folds=5)
    assert out.count() == 60 and out.select("x").distinct().count() == 60
    assert {(r["target"], r["n"]) for r in out.where("is_test = 1").groupBy("target").agg(F.count("*").alias("n")).collect()} == {(0, 6), (1, 6)}


def test_missing_value_texts_and_date_forms(spark, tmp_path):
    (tmp_path / "v.csv").write_text(
        "name,homepage_url,category_list,funding_total_usd,status,country_code,state_code,city,funding_rounds,founded_at,first_funding_at,last_funding_at\n"
        "A,N/A,null,NA,operating,NA,NULL,None,1,2011-02-03T04:05:06,2012-05,03-Apr-2013\n"
        "B,http://b.com,Software,10,NA,USA,CA,X,1,2010-01-01,2011-01-01,nonsense\n"
        "null,http://c.com,Software,10,closed,USA,CA,X,1,2010-01-01,2011-01-01,2012-01-01\n")
    raw = read_ventures_csv(spark, str(tmp_path / "v.csv"))
    rows = CL.drop_incomplete(CL.typed(raw)).collect()
    assert [r["name"] for r in rows] == ["A"]
    a = rows[0]
    assert [a[c] for c in ("homepage_url", "category_list", "funding_total_usd", "country_code", "state_code", "city")] == [None] * 6
    assert [str(a[c]) for c in ("founded_at", "first_funding_at", "last_funding_at")] == ["2011-02-03", "2012-05-01", "2013-04-03"]
    report = CL.cleaning_report(raw).first()
    assert report["unparsed_dates"] == 1 and report["rows_removed"] == 2


def test_stored_tables_are_read_by_column_and_can_be_dropped(spark):
    before = stored_tables()
    stored = cut_lineage(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    plan = stored.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    assert drop_stored(spark, since=before) == 1 and stored_tables() == before
