"""Distributed exact quantiles equal numpy's linear interpolation; approx mode is close."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcome_engine.config import DEFAULT
from outcome_engine.operators.quantiles import grouped_quantiles, quantile_row, quantile_table
from outcome_engine.operators.ranks import cumulative_before

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0]
NAMES = [f"p{i}" for i in range(len(PROBS))]


@pytest.mark.parametrize("blocks", [1, 4, 64, 4096])
def test_exact_matches_numpy_with_ties_and_nulls(spark, blocks):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(10, 2, 500), np.full(300, 42.0), rng.integers(0, 5, 200).astype(float)])
    rows = [(float(v),) for v in vals] + [(None,)] * 17
    df = spark.createDataFrame(rows, "x double")
    got = quantile_table(df, {"x": "x"}, PROBS, NAMES, settings=DEFAULT.with_(quantile_blocks=blocks)).first()
    want = np.quantile(vals, PROBS)
    assert got["n"] == len(vals)
    for nm, w in zip(NAMES, want):
        assert got[nm] == pytest.approx(w, rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("blocks,rows", [(2, 1), (4, 10), (64, 30), (64, 400)])
def test_multi_select_over_several_rounds(spark, blocks, rows):
    """Groups of very different sizes, a value that half the rows share, negative zero, infinities, groups without values."""
    rng = np.random.default_rng(11)
    data = [(1, float(v)) for v in rng.normal(0, 1, 700)] + [(1, 0.25)] * 700 + [(2, 5.0)] * 300 + [(3, -0.0), (3, 0.0), (3, 1.0)] \
        + [(None, float(v)) for v in rng.integers(0, 9, 250)] + [(4, None), (5, float("inf")), (5, 2.0), (5, float("nan"))]
    df = spark.createDataFrame(data, "g int, x double")
    settings = DEFAULT.with_(quantile_blocks=blocks, select_rows=rows)
    got = {r["g"]: r for r in quantile_table(df, {"x": "x"}, PROBS, NAMES, by=["g"], settings=settings).collect()}
    plain = {r["g"]: r for r in quantile_table(df, {"x": "x"}, PROBS, NAMES, by=["g"]).collect()}
    assert set(got) == set(plain) == {1, 2, 3, 5}
    for g, r in got.items():
        xs = np.array([v for k, v in data if k == g and v is not None and v == v])
        assert r["n"] == len(xs) and tuple(r) == tuple(plain[g])
        if np.isfinite(xs).all():
            assert [r[n] for n in NAMES] == pytest.approx(list(np.quantile(xs, PROBS)), rel=1e-12)


def test_only_small_segments_are_ranked(spark, monkeypatch):
    """The rows that reach a window over values are bounded by select_rows a wanted rank, whatever the table's size."""
    from outcome_engine.operators import quantiles as Q

    ranked = []
    plain = Q._ranked

    def spy(counts, keys, *more):
        ranked.append((counts.count(), counts.groupBy(*keys).count().agg(F.max("count")).first()[0]))
        return plain(counts, keys, *more)

    monkeypatch.setattr(Q, "_ranked", spy)
    rng = np.random.default_rng(2)
    xs, ys = rng.normal(0, 1, 20_000), rng.normal(0, 1, 20_000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "x double, y double")
    row = Q.quantile_row(df, {"x": "x", "y": "y"}, [0.5, 0.99], ["med", "high"], settings=DEFAULT.with_(select_rows=50))
    assert [row.first()[c] for c in ("x__med", "y__high")] == pytest.approx([np.median(xs), np.quantile(ys, 0.99)])
    assert ranked and max(most or 0 for _, most in ranked) <= 50 and sum(n for n, _ in ranked) <= 50 * 8


def test_grouped_and_row_forms(spark):
    rng = np.random.default_rng(3)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 400), rng.normal(0, 1, 400))]
    df = spark.createDataFrame(data, "g int, x double")
    got = {r["g"]: r for r in grouped_quantiles(df, "x", [0.25, 0.5], ["q1", "med"], by=["g"]).collect()}
    for g in range(4):
        xs = np.array([v for gg, v in data if gg == g])
        assert got[g]["med"] == pytest.approx(np.median(xs), rel=1e-12)
        assert got[g]["q1"] == pytest.approx(np.quantile(xs, 0.25), rel=1e-12)
    row = quantile_row(df, {"x": "x", "g": F.col("g")}, [0.5], ["med"]).first()
    assert row["x__med"] == pytest.approx(np.median([v for _, v in data]))
    assert row["g__med"] == pytest.approx(np.median([g for g, _ in data]))


def test_all_null_measure_gives_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    row = quantile_row(df, {"a": "a", "b": "b"}, [0.5], ["med"]).first()
    assert row["a__med"] is None and row["b__med"] == 1.5


def test_approx_mode_is_close(spark):
    vals = np.arange(10000, dtype=float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = quantile_table(df, {"x": "x"}, [0.5], ["med"], settings=DEFAULT.with_(quantile_mode="approx")).first()
    assert abs(got["med"] - np.median(vals)) <= 10000 / DEFAULT.approx_accuracy + 1


def test_cumulative_before_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v), int(c)) for k, v, c in zip(rng.integers(0, 3, 300), rng.normal(size=300).round(2),
                                                          rng.integers(1, 5, 300))]
    agg = {}
    for k, v, c in rows:
        agg[(k, v)] = agg.get((k, v), 0) + c
    df = spark.createDataFrame([(k, v, c) for (k, v), c in agg.items()], "k int, v double, c int")
    out = cumulative_before(df, ["k"], "v", ["c"], DEFAULT.with_(quantile_blocks=8)).collect()
    for r in out:
        want = sum(c for (k, v), c in agg.items() if k == r["k"] and v < r["v"])
        assert r["c_before"] == want
