"""Histograms, box plots and correlations against numpy."""

import numpy as np
import pytest

from outcome_engine.operators import stats as S


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(5, 2, 997), [0.0, 10.0, 10.0]])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    got = sorted(S.histogram(df, "x", 20).collect(), key=lambda r: r["bin"])
    counts, edges = np.histogram(vals, bins=20)
    assert [r["n"] for r in got] == counts.tolist()
    assert sum(r["n"] for r in got) == len(vals)
    assert got[0]["bin_lo"] == pytest.approx(edges[0]) and got[-1]["bin_hi"] == pytest.approx(edges[-1])


def test_histogram_constant_and_groups(spark):
    df = spark.createDataFrame([("a", 3.0)] * 5 + [("b", 1.0), ("b", 2.0)], "g string, x double")
    got = S.histogram(df, "x", 4, by=["g"], density=True).collect()
    a = sorted([r for r in got if r["g"] == "a"], key=lambda r: r["bin"])
    assert a[0]["bin_lo"] == 2.5 and a[-1]["bin_hi"] == 3.5 and sum(r["n"] for r in a) == 5
    counts, edges = np.histogram([3.0] * 5, bins=4)
    assert [r["n"] for r in a] == counts.tolist()
    dens, _ = np.histogram([1.0, 2.0], bins=4, density=True)
    b = sorted([r for r in got if r["g"] == "b"], key=lambda r: r["bin"])
    assert [r["density"] for r in b] == pytest.approx(dens.tolist())


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("s", v) for v in vals], "g string, x double")
    r = S.box_stats(df, "x", ["g"]).first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert r["q1"] == q1 and r["q3"] == q3 and r["median"] == np.median(vals)
    assert r["whisker_hi"] == 5.0 and r["whisker_lo"] == 1.0 and r["n_outliers"] == 1


def test_corr_matches_numpy_and_constant_is_null(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=200)
    b = 0.5 * a + rng.normal(size=200)
    rows = [(float(x), float(y), 1.0) for x, y in zip(a, b)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in S.corr_long(df, ["a", "b", "c"]).collect()}
    assert got[("b", "a")] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    assert got[("c", "a")] is None and got[("c", "b")] is None
    assert set(got) == {("b", "a"), ("c", "a"), ("c", "b")}


def test_match_modes_token_subset_of_substring(spark):
    from outcome_engine.operators import cohorts as K

    v = spark.createDataFrame([(1, "Software|Enterprise Software"), (2, "Enterprise Software"), (3, "Games"),
                               (4, None)], "venture_id int, category_list string")
    cats = spark.createDataFrame([("Software",), ("Games",)], "category string")
    sub = {(r["venture_id"], r["category"]) for r in K.match_categories(v, cats, "substring").collect()}
    tok = {(r["venture_id"], r["category"]) for r in K.match_categories(v, cats, "token").collect()}
    rgx = {(r["venture_id"], r["category"]) for r in K.match_categories(v, cats, "regex").collect()}
    assert tok <= sub and sub == rgx
    assert sub == {(1, "Software"), (2, "Software"), (3, "Games")} and tok == {(1, "Software"), (3, "Games")}


def test_schema_type_counts(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "a int, b string, c double")
    got = {r["data_type"]: r["n_columns"] for r in S.schema_type_counts(df).collect()}
    assert got == {"int": 1, "string": 1, "double": 1}
