"""The shared-scan dashboard gives the tables of the single panel queries."""

import math

import pytest

from conftest import SF_SMALL
from outcome_engine.config import DEFAULT
from outcome_engine.plans import dashboard as D
from outcome_engine.plans import panels as P
from outcome_engine.plans.catalog import ventures


def norm(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.fixture(scope="module")
def tables(spark):
    return D.Dashboard(ventures(spark, SF_SMALL)).tables()


def test_every_panel_is_there(tables):
    assert sorted(tables) == sorted(P.PANELS) and len(tables) == 41


@pytest.mark.parametrize("name", sorted(P.PANELS))
def test_panel_equals_its_query(spark, tables, name):
    got, want = tables[name], P.PANELS[name](ventures(spark, SF_SMALL))
    types = lambda df: sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    assert types(got) == types(want)
    (cols, a), (_, b) = norm(got), norm(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(close(p, q) for p, q in zip(x, y)), (cols, x, y)


def test_three_scans_make_the_dashboard(spark, monkeypatch):
    """Plans that read the venture table: one for each stored result and none for a panel."""
    v = ventures(spark, SF_SMALL)
    source = v.inputFiles()[0].rpartition("/")[0].rpartition("/")[2]
    plans = []
    plain = D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: (plans.append(df), plain(df))[1])
    made = D.Dashboard(v, DEFAULT).tables()
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") \
        if any(source in f for f in df.inputFiles()) else 0
    read = [sum(source in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()) for df in plans]
    assert sum(scans(df) > 0 for df in plans) == 3, read
    assert not any(source in f for df in made.values() for f in df.inputFiles())
    own = [p for p in plans if any(source in f for f in p.inputFiles())]
    assert all(sum(1 for line in p._jdf.queryExecution().executedPlan().toString().splitlines() if source in line) <= 1 for p in own)


def test_dashboard_of_an_empty_table(spark):
    v = ventures(spark, SF_SMALL).limit(0)
    made = D.Dashboard(v).tables()
    for name in ("d1_overview_stats", "d2_rate_by_age", "d3_funding_summary", "d4_geo_summary", "d5_top_categories", "d6_month_counts", "d7_corr_ranked"):
        (_, a), (_, b) = norm(made[name]), norm(P.PANELS[name](v))
        assert a == b, name
