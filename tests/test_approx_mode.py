"""The percentile_approx mode runs the same panels and stays close to the exact mode."""

import pytest

from conftest import SF_SMALL
from outcome_engine.config import DEFAULT
from outcome_engine.plans import panels as P
from outcome_engine.plans.catalog import ventures

APPROX = DEFAULT.with_(quantile_mode="approx")


@pytest.mark.parametrize("name", ["d3_funding_stats", "d3_funding_summary", "d3_efficiency_box",
                                  "d6_median_funding_year", "d6_temporal_summary"])
def test_approx_panels_match_exact_shape(spark, name):
    v = ventures(spark, SF_SMALL)
    exact = P.PANELS[name](v, DEFAULT).collect()
    approx = P.PANELS[name](v, APPROX).collect()
    assert len(exact) == len(approx)
    assert sorted(exact[0].asDict()) == sorted(approx[0].asDict())
