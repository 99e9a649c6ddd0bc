"""Property tests (hypothesis): exact quantiles equal numpy, histograms partition the data,
clipping stays in bounds, shares sum to one."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outcome_engine.config import DEFAULT
from outcome_engine.functions import exprs as X
from outcome_engine.operators import cohorts as K
from outcome_engine.operators import stats as S
from outcome_engine.operators.quantiles import quantile_table

FLOATS = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(vals=st.lists(FLOATS, min_size=1, max_size=60), p=st.floats(min_value=0, max_value=1), blocks=st.integers(1, 9))
def test_quantile_equals_numpy(spark, vals, p, blocks):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = quantile_table(df, {"x": "x"}, [p], ["q"], settings=DEFAULT.with_(quantile_blocks=blocks)).first()["q"]
    want = float(np.quantile(np.array(vals), p))
    assert abs(got - want) <= 1e-9 * max(1.0, abs(want))


@SLOW
@given(vals=st.lists(FLOATS, min_size=1, max_size=60), bins=st.integers(1, 12))
def test_histogram_partitions_rows(spark, vals, bins):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = sorted(S.histogram(df, "x", bins).collect(), key=lambda r: r["bin"])
    assert len(got) == bins and sum(r["n"] for r in got) == len(vals)
    assert [r["n"] for r in got] == np.histogram(np.array(vals), bins=bins)[0].tolist()


@SLOW
@given(vals=st.lists(st.one_of(st.none(), FLOATS), min_size=1, max_size=40), lo=FLOATS, width=st.floats(0, 1e6))
def test_clip_in_bounds_and_null_safe(spark, vals, lo, width):
    hi = lo + width
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r["c"] for r in df.select(X.clip("x", lo, hi).alias("c")).collect()]
    for v, c in zip(vals, out):
        assert (c is None) == (v is None)
        if c is not None:
            assert lo <= c <= hi


@SLOW
@given(keys=st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=1, max_size=80))
def test_value_count_shares_sum_to_one(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    counts = K.value_counts(df, "k")
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))
    shares = K.shares(counts.crossJoin(total), "n", F.col("t")).agg(F.sum("share")).first()[0]
    assert abs(shares - 1.0) < 1e-12
