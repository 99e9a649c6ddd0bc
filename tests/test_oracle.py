"""Registered queries against their DuckDB SQL on the driver's tables (small scale)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare, duck

FAST = ["ventures_clean", "clean_report", "d1_missing_pct", "d2_rate_by_age", "d3_rate_by_bracket",
        "d3_efficiency_box", "d4_geo_summary", "d5_category_success", "d5_category_insights", "d6_rate_by_era",
        "d6_temporal_summary", "d7_corr_matrix", "d7_corr_ranked", "ins_report", "ins_exit_timing"]
ML = ["fea_features", "fea_extra", "sel_correlation", "prp_split", "prp_scaler", "prp_knn", "met_auc", "met_roc_curve", "met_summary", "sco_category_rollup",
      "sco_predictions"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql_or_is_model_bound():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}  # the subpackage tests its own queries
    assert own - set(o) == {"sel_forest_importance", "sel_selected", "mdl_results", "mdl_importance", "mdl_chosen", "mdl_errors",
                            "sco_model_predictions", "mdl_roc_curve", "mdl_pr_curve", "mdl_confusion",
                            "ins_success_factors", "ins_model_summary", "ins_run_summary"}


@pytest.mark.parametrize("name", FAST + ML)
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and df.columns == ["funding_bracket", "bucket_order", "n", "n_success", "success_rate"]


def test_cleaning_is_time_zone_independent(spark, con):
    from pyspark.sql import functions as F

    from outcome_engine.operators.clean import clean
    from outcome_engine.sources.fixture import ventures_raw

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        v = clean(ventures_raw(spark, SF_SMALL))
        dates = ("founded_at", "first_funding_at", "last_funding_at")
        v = v.select(*[F.col(c).cast("string").alias(c) if c in dates else F.col(c) for c in v.columns])
        ok, msg = compare(v, con, E.oracle_sql()["ventures_clean"])
        assert ok, msg
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
