"""Scalar expressions: title case, category cleaning, buckets, safe math, domain type."""

import math

from pyspark.sql import functions as F

from outcome_engine import config as C
from outcome_engine.functions import exprs as X


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_title_case_matches_python(spark):
    for s in ["e-commerce", "3d printing", "men's wear", "b2b saas", "ALL CAPS", "mIxEd-caSe_words"]:
        assert _one(spark, X.title_case(F.col("x")), s) == s.title()


def test_clean_category_list(spark):
    cases = {
        None: None, "": None, "|": None, " saas|ai ": "SaaS|AI", "e-commerce|3d  printing": "E-Commerce|3D Printing",
        "italian food": "ITalian Food", "health  care||analytics ": "Health Care|Analytics", "it services": "IT Services",
    }
    for raw, want in cases.items():
        assert _one(spark, X.clean_category_list(F.col("x")), raw) == want, raw


def test_bucketize_edges_right_closed(spark):
    edges, labels, lowest = C.FUNDING_BRACKET_PANEL
    rows = [(0.0, None), (1.0, "<50K"), (50000.0, "<50K"), (50000.01, "50K-500K"), (5e7, "5M-50M"),
            (5e7 + 1, ">50M"), (-1.0, None), (None, None)]
    df = spark.createDataFrame([(v,) for v, _ in rows], "x double")
    got = [r["b"] for r in df.select(X.bucketize("x", edges, labels, lowest).alias("b")).collect()]
    assert got == [w for _, w in rows]
    e2, l2, low2 = C.FUNDING_BRACKET_ALL
    assert _one(spark, X.bucketize("x", e2, l2, low2), 0.0, "x double") == "No/Low Funding"


def test_safe_divide_and_log(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1e12, 1e-3), (6.0, 3.0), (None, 2.0)], "n double, d double")
    got = [r["q"] for r in df.select(X.safe_divide("n", "d", 0.0).alias("q")).collect()]
    assert got == [0.0, 0.0, 1e10, 2.0, None]
    df = spark.createDataFrame([(0.0,), (-5.0,), (1e30,), (100.0,)], "x double")
    got = [r["l"] for r in df.select(X.safe_log10("x").alias("l")).collect()]
    assert got[0] == -10.0 and got[1] == -10.0 and got[2] == 10.0 and math.isclose(got[3], 2.0)


def test_domain_type(spark):
    cases = {None: "No Website", "http://a.com": "Commercial", "HTTP://B.IO": "Tech", "http://c.co": "Company",
             "http://d.org": "Organization", "http://e.net": "Network", "http://f.de": "Other"}
    for url, want in cases.items():
        assert _one(spark, X.domain_type("x"), url) == want


def test_to_number_rejects_junk(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("-",), ("12d",), ("1e3",), ("abc",), (None,)], "x string")
    got = [r["v"] for r in df.select(X.to_number("x").alias("v")).collect()]
    assert got == [12.5, None, None, 1000.0, None, None]
