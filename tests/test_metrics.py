"""AUC / AP / curves / confusion against brute force."""

import numpy as np
import pytest

from outcome_engine.operators import metrics as M


def _pred(spark, labels, scores):
    rows = [("m", i, int(y), float(s), int(s > 0.5)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "model string, venture_id int, label int, score double, pred int")


def _auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, s):
    ap, prev_r = 0.0, 0.0
    P = sum(y)
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300).tolist()
    s = np.round(np.clip(np.array(y) * 0.2 + rng.uniform(0, 0.8, 300), 0, 1), 2).tolist()
    r = M.auc_table(_pred(spark, y, s)).first()
    assert r["auc"] == pytest.approx(_auc_brute(y, s), abs=1e-12)
    assert r["average_precision"] == pytest.approx(_ap_brute(y, s), abs=1e-8)
    r2 = M.auc_table(_pred(spark, y, [1 - v for v in s])).first()
    assert r2["auc"] == pytest.approx(1 - r["auc"], abs=1e-12)


def test_roc_curve_points(spark):
    y, s = [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]
    pts = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_curve(_pred(spark, y, s)).collect())
    assert pts == [(0.1, 1.0, 1.0), (0.35, 0.5, 1.0), (0.4, 0.5, 0.5), (0.8, 0.0, 0.5)]


def test_confusion_and_summary(spark):
    y, s = [0, 0, 1, 1, 1], [0.9, 0.1, 0.6, 0.7, 0.2]
    cells = {(r["label"], r["pred"]): r["n"] for r in M.confusion(_pred(spark, y, s)).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    r = M.classification_summary(_pred(spark, y, s)).first()
    assert r["accuracy"] == pytest.approx(3 / 5) and r["f1"] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))
