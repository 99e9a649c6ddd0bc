"""Flags for the corrected forms, out-of-fold encoding, sketches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from outcome_engine.config import DEFAULT
from outcome_engine.functions import exprs as X
from outcome_engine.operators import clean as CL
from outcome_engine.operators import distinct as D
from outcome_engine.operators import features as FE
from outcome_engine.plans import panels as P
from outcome_engine.plans.catalog import ventures


def test_whole_word_fixes(spark):
    df = spark.createDataFrame([("air travel|ai|ai-first|italian it|saas|hr.",)], "c string")
    got = df.select(X.clean_category_list("c").alias("a"), X.clean_category_list("c", whole_word=True).alias("b")).first()
    assert got["a"] == "AIr Travel|AI|AI-First|ITalian IT|SaaS|HR." and got["b"] == "Air Travel|AI|AI-First|Italian IT|SaaS|HR."


def test_recompute_brings_derived_columns_up_to_date(spark):
    columns = "k string, name string, homepage_url string, category_list string, funding_total_usd string, status string, country_code string, state_code string, " \
              "city string, funding_rounds string, founded_at string, first_funding_at string, last_funding_at string"
    raw = spark.createDataFrame([("1", "A", None, None, "100", "closed", None, None, None, None, "2010-01-10", "2010-01-01", "2010-02-01")], columns)
    old, new = CL.clean(raw).first(), CL.clean(raw, DEFAULT.with_(recompute=True)).first()
    assert (old["days_to_first_funding"], old["funding_duration_days"], old["funding_per_round"]) == (-9, 31, None)
    assert (new["days_to_first_funding"], new["funding_duration_days"], new["funding_per_round"]) == (0, 22, 100.0)


def test_concentration_over_all_countries(spark):
    v = ventures(spark, SF_SMALL)
    n = [r["n"] for r in v.where("country_code IS NOT NULL").groupBy("country_code").agg(F.count("*").alias("n")).collect()]
    assert P.d4_geo_summary(v, top_n=None).first()["hhi"] == pytest.approx(sum(x * x for x in n) / sum(n) ** 2)
    few = spark.createDataFrame([(str(i), i + 1) for i in range(40)], "country_code string, n long")
    top = sorted((i + 1 for i in range(40)), reverse=True)
    assert P.geo_summary(few, top_n=3).first()["hhi"] == pytest.approx(sum(x * x for x in top[:3]) / sum(top) ** 2)
    assert P.geo_summary(few, top_n=None).first()["hhi"] == pytest.approx(sum(x * x for x in top) / sum(top) ** 2)


def test_encoded_rates_leave_the_own_fold_out(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaabc") if i % 11 else None, rng.randint(0, 1), rng.choice([0, 1, 2, None])) for i in range(120)] + [(500, "lonely", 1, 0), (501, "lonely2", 1, None)]
    df = spark.createDataFrame(rows, "venture_id long, c string, target int, fold int")
    got = {r["venture_id"]: r for r in FE.encoded_rates(df, "c").collect()}
    train = defaultdict(list)
    for i, c, y, f in rows:
        if c is not None and f is not None:
            train[c].append((i, y, f))
    assert len(got) == len(rows)
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.1
    for i, c, _, f in rows:
        assert got[i]["oof"] == pytest.approx(mean([y for _, y, g in train[c] if f is None or g != f])), i
        assert got[i]["loo"] == pytest.approx(mean([y for j, y, _ in train[c] if j != i])), i


def test_sketches_roll_up_within_their_error(spark):
    df = spark.range(60_000).selectExpr("id % 7 AS year", "id % 40 AS place", "id * 7919 % 50021 AS value", "if(id % 3 = 0, null, id) AS other")
    stored = D.sketches(df, ["year", "place"], {"value": "value", "other": "other"})
    exact = df.agg(F.count_distinct("value").alias("value"), F.count_distinct("other").alias("other")).first()
    whole = D.roll_up(stored, [], ["value", "other"]).first()
    assert whole["n"] == 60_000
    for c in ("value", "other"):
        assert abs(whole[c] - exact[c]) <= 0.03 * exact[c]
    by_year = {r["year"]: r for r in D.roll_up(stored, ["year"], ["value"]).collect()}
    for r in df.groupBy("year").agg(F.count_distinct("value").alias("n")).collect():
        assert abs(by_year[r["year"]]["value"] - r["n"]) <= 0.03 * r["n"]


def test_approximate_distinct_panel(spark):
    v = ventures(spark, SF_SMALL)
    exact = {r["year"]: r for r in P.d5_diversity_by_year(v).collect()}
    near = {r["year"]: r for r in P.d5_diversity_by_year(v, DEFAULT.with_(distinct_mode="approx")).collect()}
    assert exact.keys() == near.keys()
    assert all(near[y]["n_ventures"] == r["n_ventures"] and abs(near[y]["n_categories"] - r["n_categories"]) <= 1 for y, r in exact.items())
