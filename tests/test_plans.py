"""Plans that must hold at any size: what is shuffled on which key, and what is scanned."""

import re

import pytest

from conftest import SF_SMALL
from outcome_engine.operators import insights as INS
from outcome_engine.plans import catalog
from outcome_engine.plans.catalog import ventures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name,key", [("d3_efficiency_box", "status"), ("d3_funding_density", "success_category"),
                                      ("d3_first_funding_hist", "success_category"), ("met_auc", "model"), ("met_roc_curve", "model")])
def test_no_detail_row_is_shuffled_on_a_few_groups(spark, no_auto_broadcast, name, key):
    text = plan(catalog.queries()[name](spark, SF_SMALL))
    assert not re.search(rf"(SortMergeJoin|ShuffledHashJoin) \[{key}#\d+\], ", text)


def test_panels_scan_only_their_columns(spark):
    text = plan(catalog.queries()["d2_rate_by_age"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "Scan ExistingRDD" not in text and "homepage_url" not in schema and len(schema.split(",")) <= 4


def test_report_needs_few_scans(spark):
    v = ventures(spark, SF_SMALL)
    assert len(re.findall(r"FileScan parquet", plan(INS.report(v)))) <= 9  # five of the stored one-row table
    assert len(re.findall(r"FileScan parquet", plan(INS.high_opportunity(INS.opportunity(v))))) <= 3
    assert len(re.findall(r"FileScan parquet", plan(INS.opportunity(v)))) == 1


def test_correlations_multiply_no_rows(spark):
    text = plan(catalog.queries()["d7_corr_matrix"](spark, SF_SMALL))
    for i, line in enumerate(text.splitlines()):
        if "Generate" in line:  # only above an aggregate of one row
            assert "Aggregate" in "\n".join(text.splitlines()[i:i + 4])
