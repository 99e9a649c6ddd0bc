"""Nearest-neighbour imputation against all pairs."""

import random

import numpy as np
import pytest

from outcome_engine.operators import impute as IM

NAMES = ["a", "b", "c", "d"]
SCHEMA = "venture_id long, a double, b double, c double, d double, note string"


def brute(donors, receivers, k):
    """The definition, by all pairs in plain Python floats."""
    n = len(NAMES)
    none = lambda v: v is None or v != v
    clean = lambda row: [None if none(v) else float(v) for v in row[1:1 + n]]
    have = [(row[0] if row[0] is not None else (1 << 63) - 1, clean(row)) for row in donors]
    means = [np.mean([x[i] for _, x in have if x[i] is not None]) if any(x[i] is not None for _, x in have) else None for i in range(n)]
    out = []
    for row in receivers:
        x, filled = clean(row), clean(row)
        for i in range(n):
            if x[i] is not None:
                continue
            near = []
            for key, y in have:
                both = [j for j in range(n) if x[j] is not None and y[j] is not None]
                if y[i] is None or not both:
                    continue
                total = 0.0
                for j in both:
                    total += (x[j] - y[j]) * (x[j] - y[j])
                near.append((total * n / len(both), key, y[i]))
            near = sorted(near)[:k]
            filled[i] = sum(v for *_, v in near) / len(near) if near else means[i]
        out.append((row[0], *filled, row[-1]))
    return out


def table(seed, n, low=0):
    """Coarse values, so that distances tie; many masks; a third of the rows alike; other scales by column."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [float(rng.randint(0, 6)), float(rng.randint(0, 3)) * 100, rng.choice([1.5, 2.5, 1e7]), float(rng.randint(0, 50))]
        if rng.random() < 0.33:
            v = [3.0, 100.0, 1.5, 7.0]
        v = [None if rng.random() < 0.25 else x for x in v]
        rows.append((low + i, *v, f"row {i}"))
    return rows


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[-1] or "")
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g[0], g[-1]) == (w[0], w[-1])
        for x, y in zip(g[1:-1], w[1:-1]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-12)), (g, w)


@pytest.mark.parametrize("seed,n,k,layout", [(1, 150, 5, IM.Layout()), (2, 300, 3, IM.Layout(7, 8, 5, 20)), (3, 300, 1, IM.Layout(3, 64, 1, 3))])
def test_imputation_is_that_of_all_pairs(spark, seed, n, k, layout):
    """Also with many small rings, so that visits leave most of them out, and with hot rings that are copied."""
    donors, receivers = table(seed, n), table(seed + 50, 120, low=1000)
    model = IM.fit_knn(spark.createDataFrame(donors, SCHEMA), NAMES, k=k, layout=layout)
    same(model.transform(spark.createDataFrame(receivers, SCHEMA).repartition(4)).collect(), brute(donors, receivers, k))
    if seed == 2:
        same(model.transform(spark.createDataFrame(donors, SCHEMA)).collect(), brute(donors, donors, k))


def test_odd_rows(spark, tmp_path):
    nan = float("nan")
    donors = [(1, 1.0, None, None, None, "x"), (1, 2.0, 5.0, None, None, "y"), (2, nan, 6.0, None, None, None), (None, 2.0, 8.0, None, None, "z"),
              (3, None, None, None, None, None)]
    receivers = [(7, None, None, None, None, "all null"), (8, 1.9, nan, 4.0, None, "nan"), (8, 1.9, nan, 4.0, None, "nan"), (None, None, 6.0, None, None, None),
                 (9, 1.0, 2.0, 3.0, 4.0, "whole"), (10, None, None, 4.0, None, "nothing in common")]
    model = IM.fit_knn(spark.createDataFrame(donors, SCHEMA), NAMES, k=2)
    df = spark.createDataFrame(receivers, SCHEMA)
    want = brute(donors, receivers, 2)
    same(model.transform(df).collect(), want)
    model.save(str(tmp_path / "knn"))
    same(IM.KnnImputer.load(spark, str(tmp_path / "knn")).transform(df).collect(), want)
    assert model.transform(df.limit(0)).collect() == []
    empty = IM.fit_knn(df.limit(0), NAMES)
    same(empty.transform(df).collect(), brute([], receivers, 5))
    clash = df.withColumnRenamed("note", "mask").withColumnRenamed("venture_id", "rid")
    same([tuple(r) for r in model.transform(clash).collect()], want)


def test_no_pair_of_rows_is_made_without_its_ring(spark, monkeypatch):
    """Searched pairs stay far below all pairs, and no join in the plan is a nested loop or a product."""
    pairs = []
    plain = IM.KnnImputer._search

    def spy(self, visits, placed, spaces):
        a, b = visits.groupBy("block").count(), placed.groupBy("block").count().withColumnRenamed("count", "donors")
        pairs.append(a.join(b, "block").selectExpr("sum(count * donors)").first()[0] or 0)
        out = plain(self, visits, placed, spaces)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        return out

    monkeypatch.setattr(IM.KnnImputer, "_search", spy)
    rng = random.Random(8)
    donors = [(i, rng.random(), rng.random(), None, float(i), "") for i in range(4000)]
    receivers = [(i, rng.random(), rng.random(), None, None, "") for i in range(500)]
    model = IM.fit_knn(spark.createDataFrame(donors, SCHEMA), NAMES, layout=IM.Layout(ring_rows=16))
    same(model.transform(spark.createDataFrame(receivers, SCHEMA)).collect(), brute(donors, receivers, 5))
    assert sum(pairs) < 4000 * 500 / 8
