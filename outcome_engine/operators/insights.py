"""Insights (INS-*): the strategic report as tables.

Every report figure is an aggregation of the cleaned table (or of a bounded
top-k table); ``report`` unions them into one long (section, metric, value)
table.  Model-dependent lines (success factors) come from ``models.importances``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Settings
from ..functions import exprs as X
from ..session import cut_lineage
from . import cohorts as K
from .quantiles import bounded_quantile_row, quantile_row


def _concluded(v: DataFrame) -> DataFrame:
    return v.where(F.col("status").isin(*C.CONCLUDED_STATUSES))


def _won():
    return F.col("status").isin(*C.SUCCESS_STATUSES)


def _conc():
    return F.col("status").isin(*C.CONCLUDED_STATUSES)


def _key_stats() -> list:
    return [F.count(F.lit(1)).alias("n_total"), F.count_if(_conc()).alias("n_concluded"),
            X.pct(F.count_if(_conc() & _won()), F.count_if(_conc())).alias("success_rate"),
            F.count_distinct("country_code").alias("n_countries"), F.count_distinct("primary_category").alias("n_categories")]


def _risk_factors() -> list:
    failed = F.col("status") == "closed"
    share = lambda c: X.pct(F.count_if(failed & c), F.count_if(failed))
    return [F.count_if(failed).alias("n_failed"), share(F.col("has_funding") == 0).alias("pct_no_funding"),
            share(F.col("has_location") == 0).alias("pct_no_location"), share(F.col("category_count") == 1).alias("pct_single_category"),
            share(F.col("has_homepage") == 0).alias("pct_no_website"),
            F.round(F.avg(F.when(failed, F.col("company_age_years"))), 4).alias("mean_age_at_failure")]


def _funding() -> list:
    f, conc, won = F.col("funding_total_usd"), _conc(), _won()
    rate = lambda c: X.pct(F.count_if(conc & c & won), F.count_if(conc & c))
    with_rate, without_rate = rate(F.col("has_funding") == 1), rate(F.col("has_funding") == 0)
    return [F.round(F.avg(F.when(conc & won, f)), 2).alias("mean_funding_success"),
            F.round(F.avg(F.when(F.col("status") == "closed", f)), 2).alias("mean_funding_failed"),
            with_rate.alias("rate_with_funding"), without_rate.alias("rate_without_funding"),
            F.round(with_rate - without_rate, 6).alias("funded_lift_pp")]


def _timing() -> list:
    won, age = _conc() & _won(), F.col("company_age_years")
    return [X.pct(F.count_if(won & (age < 2)), F.count_if(won)).alias("pct_early_exit"),
            X.pct(F.count_if(won & (age > 10)), F.count_if(won)).alias("pct_late_exit")]


def _tech() -> list:
    conc, t = _conc(), F.col("is_tech_startup") == 1
    tech_rate = X.pct(F.count_if(conc & t & _won()), F.count_if(conc & t))
    return [F.count_if(conc & t).alias("n_tech_concluded"), tech_rate.alias("tech_success_rate"),
            F.round(tech_rate - X.pct(F.count_if(conc & _won()), F.count_if(conc)), 6).alias("tech_vs_overall_pp")]


def key_stats(v: DataFrame) -> DataFrame:
    return v.agg(*_key_stats())


def risk_factors(v: DataFrame) -> DataFrame:
    """Shares of failed ventures without funding / location / second category / website; mean age at failure."""
    return v.agg(*_risk_factors())


def opportunity(v: DataFrame) -> DataFrame:
    """Top 20 primary categories by size with more than 30 concluded: success rate vs competition.  One pass."""
    sizes = v.where(F.col("primary_category").isNotNull()).groupBy("primary_category").agg(F.count(F.lit(1)).alias("competition"), F.count_if(_conc()).alias("n_concluded"),
                                              F.count_if(_conc() & _won()).alias("n_success"))
    out = K.top_k(sizes, "competition", "primary_category", 20).where(F.col("n_concluded") > C.MIN_OPPORTUNITY_CONCLUDED)
    return out.select("primary_category", "rank", "competition", "n_concluded",
                      X.pct(F.col("n_success"), F.col("n_concluded")).alias("success_rate"))


def quadrants(opp: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Median competition and median success rate of the opportunity table (one row; <= 20 rows in)."""
    q = bounded_quantile_row(opp, {"c": "competition", "r": "success_rate"}, [0.5], ["med"])
    return q.select(F.col("c__med").alias("median_competition"), F.col("r__med").alias("median_success_rate"))


def high_opportunity(opp: DataFrame, settings: Settings = DEFAULT, k: int = 5) -> DataFrame:
    """Categories above the median rate and below the median competition, best k by rate."""
    opp = cut_lineage(opp)  # at most 20 rows, read for the medians and for the choice
    j = opp.crossJoin(F.broadcast(quadrants(opp, settings)))
    sel = j.where((F.col("success_rate") > F.col("median_success_rate"))
                  & (F.col("competition") < F.col("median_competition")))
    return K.top_k(sel.select("primary_category", "success_rate", "competition"), "success_rate",
                   "primary_category", k)


def exit_timing(v: DataFrame) -> DataFrame:
    age = F.col("company_age_years")
    rows = _concluded(v).where(age.isNotNull() & (age > 0) & (age < 20))
    return K.rate_by_bucket(rows, age, C.AGE_GROUPS_EXIT, "age_group", success=_won())


def geography(v: DataFrame, k: int = 5, gate: str = "after") -> DataFrame:
    """Best k countries by success rate; the size gate (> 50 concluded) applies after the
    top k as in the original report (``gate='before'`` filters first)."""
    rates = K.rate_by(_concluded(v).where(F.col("country_code").isNotNull()), ["country_code"], success=_won())
    if gate == "before":
        rates = rates.where(F.col("n") > C.MIN_REPORT_COUNTRY)
    top = K.top_k(rates, "success_rate", "country_code", k)
    return top.where(F.col("n") > C.MIN_REPORT_COUNTRY) if gate == "after" else top


def funding(v: DataFrame) -> DataFrame:
    return v.agg(*_funding())


def timing(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    won = _concluded(v).where(_won())
    age = F.col("company_age_years")
    med = quantile_row(won, {"a": age}, [0.5], ["med"], settings=settings)
    return med.select(F.col("a__med").alias("median_age_at_success")).crossJoin(v.agg(*_timing()))


def tech(v: DataFrame) -> DataFrame:
    return v.agg(*_tech())


def _lines(df: DataFrame, section: str, metrics: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"),
                             F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.explode(arr).alias("l")).select("l.*")


def report(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The numeric report as one long table (section, metric, value)."""
    # all plain aggregates come from one pass over the table
    won = _concluded(v).where(_won())
    median = quantile_row(won, {"a": F.col("company_age_years")}, [0.5], ["med"], settings=settings)
    one = cut_lineage(v.agg(*_key_stats(), *_risk_factors(), *_funding(), *_timing(), *_tech())
                      .crossJoin(median.select(F.col("a__med").alias("median_age_at_success"))))
    parts = [
        _lines(one, "key_statistics", ["n_total", "n_concluded", "success_rate", "n_countries", "n_categories"]),
        _lines(one, "risk_factors", ["pct_no_funding", "pct_no_location", "pct_single_category", "pct_no_website",
                                     "mean_age_at_failure"]),
        _lines(one, "funding", ["mean_funding_success", "mean_funding_failed", "rate_with_funding", "rate_without_funding",
                                "funded_lift_pp"]),
        _lines(one, "timing", ["median_age_at_success", "pct_early_exit", "pct_late_exit"]),
        _lines(one, "technology", ["n_tech_concluded", "tech_success_rate", "tech_vs_overall_pp"]),
        geography(v).select(F.lit("geography").alias("section"), F.col("country_code").alias("metric"),
                            F.col("success_rate").alias("value")),
        high_opportunity(opportunity(v), settings).select(F.lit("high_opportunity").alias("section"),
                                                          F.col("primary_category").alias("metric"),
                                                          F.col("success_rate").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
