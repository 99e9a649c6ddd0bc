"""Stratified hash split, folds, robust scaling, feature vote."""

import numpy as np
import pytest

from outcome_engine.operators import prep as PR
from outcome_engine.operators.selection import vote


def test_split_is_stratified_exact_and_deterministic(spark):
    rows = [(i, int(i % 3 == 0)) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "venture_id long, target int")
    out = PR.stratified_split(df, "target", "venture_id", 0.2, 5).collect()
    for cls in (0, 1):
        part = [r for r in out if r["target"] == cls]
        n_test = sum(r["is_test"] for r in part)
        assert n_test == int(np.floor(len(part) * 0.2 + 0.5))
        folds = [r["fold"] for r in part if r["is_test"] == 0]
        assert set(folds) == set(range(5)) and max(folds.count(f) for f in range(5)) - min(
            folds.count(f) for f in range(5)) <= 1
        assert all(r["fold"] is None for r in part if r["is_test"] == 1)
    again = {r["venture_id"]: r["is_test"] for r in PR.stratified_split(df, "target", "venture_id").collect()}
    assert again == {r["venture_id"]: r["is_test"] for r in out}


def test_robust_scale(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in range(1, 11)], "a double, c double")
    sc = PR.fit_robust_scaler(df, ["a", "c"])
    out = PR.robust_scale(df, sc, ["a", "c"]).collect()
    q1, med, q3 = np.quantile(np.arange(1, 11), [0.25, 0.5, 0.75])
    assert [r["a"] for r in out] == pytest.approx([(v - med) / (q3 - q1) for v in range(1, 11)])
    assert all(r["c"] == 0.0 for r in out)  # constant column: IQR 0 -> scale 1


def test_vote_rules():
    all_f = [f"f{i}" for i in range(30)]
    assert vote([["f1", "f2"], ["f2"], []], all_f, all_f)[:2] == ["f2", "f1"]
    assert len(vote([all_f[:25], all_f[:25]], all_f, all_f)) == 20
    small = vote([["f3"]], ["f0", "f3", "f1", "f2"] + all_f, all_f)
    assert small[0] == "f3" and len(small) == 15
    assert vote([[], []], [], all_f) == all_f
