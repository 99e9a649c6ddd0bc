"""Dashboard panel tables (d1_* .. d7_*): the data behind every chart of the analysis.

Each function takes the cleaned venture table and returns a small DataFrame.
Gates (minimum group sizes), bucket edges and top-k sizes are those of the
original analysis (see ``config``).  Means of money are rounded to cents and
means of ages to 4 decimals so that results do not depend on summation order;
rates and shares are computed from integer counts and are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Settings
from ..functions import exprs as X
from ..operators import cohorts as K
from ..operators import distinct as D
from ..operators import stats as S
from ..operators.quantiles import grouped_quantiles, quantile_row

EDGE_DIGITS = 6
class _Cols:
    """Frequently used columns (built lazily: a Column needs an active session)."""

    @property
    def age(self):
        return F.col("company_age_years")

    @property
    def fund(self):
        return F.col("funding_total_usd")

    @property
    def year(self):
        return F.year("founded_at")


_C = _Cols()


def _round_edges(df: DataFrame) -> DataFrame:
    return (df.withColumn("bin_lo", F.round("bin_lo", EDGE_DIGITS))
            .withColumn("bin_hi", F.round("bin_hi", EDGE_DIGITS)))


def _mean(c, digits: int) -> F.Column:
    return F.round(F.avg(c), digits)


# ---------------------------------------------------------------- d1 overview
def d1_missing_pct(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return S.missing_by_column(v).where(F.col("missing_pct") > 0)


def d1_completeness_hist(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return _round_edges(S.histogram(v.select(S.completeness(v).alias("score")), "score", 20))


def d1_age_hist(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return _round_edges(S.histogram(v.where(_C.age.between(0, 50)), "company_age_years", 30))


def d1_overview_stats(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    n = F.count(F.lit(1))
    return v.agg(
        n.alias("n_rows"),
        F.lit(len(v.columns)).alias("n_columns"),
        _mean(_C.age, 4).alias("mean_age"),
        F.sum("has_funding").cast("long").alias("n_funded"),
        X.pct(F.sum("has_funding"), n).alias("pct_funded"),
        F.sum("has_location").cast("long").alias("n_located"),
        X.pct(F.sum("has_location"), n).alias("pct_located"),
        _mean("funding_rounds", 4).alias("mean_rounds"),
    )


def d1_dtype_counts(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Columns by kind, from the schema: no row is read."""
    return S.schema_kinds(v)


def _yes_no(v: DataFrame, flag: str) -> DataFrame:
    return v.groupBy(F.col(flag).cast("int").alias(flag)).agg(F.count(F.lit(1)).alias("n"))


def d1_funding_status(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return _yes_no(v, "has_funding")


def d1_location_status(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return _yes_no(v, "has_location")


# ---------------------------------------------------------------- d2 outcomes
def d2_status_counts(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.value_counts(v, "status", order="count")


def d2_success_split(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.value_counts(K.concluded(v), "success_category", order="count")


def d2_rate_by_age(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.rate_by_bucket(K.concluded(v).where(_C.age.isNotNull()), _C.age, C.AGE_GROUPS, "age_group")


def d2_outcome_age_hist(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = K.concluded(v).where((_C.age > 0) & (_C.age < 30))
    return _round_edges(S.histogram(rows, _C.age, 20, by=["success_category"], shared_range=True))


def d2_rate_by_funded(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.rate_by(K.concluded(v), ["has_funding"])


def d2_success_metrics(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    valid_age = (_C.age > 0) & (_C.age < 30)
    funded = F.col("has_funding") == 1
    return v.agg(
        F.count_if(K.is_concluded()).alias("n_concluded"),
        X.pct(F.count_if(K.is_success()), F.count_if(K.is_concluded())).alias("success_rate"),
        F.coalesce(_mean(F.when(K.is_success() & valid_age, _C.age), 4), F.lit(0.0)).alias("avg_age_success"),
        F.coalesce(_mean(F.when(K.is_failed() & valid_age, _C.age), 4), F.lit(0.0)).alias("avg_age_failed"),
        X.pct(F.count_if(K.is_success() & funded), F.count_if(K.is_concluded() & funded)).alias("rate_funded"),
        X.pct(F.count_if(K.is_success() & ~funded), F.count_if(K.is_concluded() & ~funded)).alias("rate_unfunded"),
    )


# ---------------------------------------------------------------- d3 funding
def _funded(v: DataFrame) -> DataFrame:
    return v.where(_C.fund.isNotNull())


def d3_funding_density(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = _funded(v).where(F.col("status").isNotNull())
    h = S.histogram(rows, F.log10(_C.fund + 1), 25, by=["status"], density=True)
    return _round_edges(h).withColumn("density", F.round("density", EDGE_DIGITS))


def d3_efficiency_box(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = _funded(v).where(F.col("funding_per_round").isNotNull() & F.col("status").isNotNull())
    return S.box_stats(rows, "funding_per_round", ["status"], settings)


def d3_first_funding_hist(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    d = F.col("days_to_first_funding")
    rows = v.where(d.between(0, C.MAX_DAYS_TO_FUNDING) & F.col("status").isin(*C.CONCLUDED_STATUSES))
    return _round_edges(S.histogram(rows, d / F.lit(365.25), 20, by=["status"]))


def d3_rate_by_bracket(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.rate_by_bucket(K.concluded(_funded(v)), _C.fund, C.FUNDING_BRACKET_PANEL, "funding_bracket")


def d3_rate_by_rounds(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    r = F.col("funding_rounds")
    rows = K.concluded(v.where(r.isNotNull() & (r <= 10)))
    return K.rate_by(rows, ["funding_rounds"], min_n=C.MIN_ROUNDS_GROUP)


def d3_funding_stats(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = _funded(v).where(F.col("status").isNotNull())
    med = grouped_quantiles(rows, _C.fund, [0.5], ["median_funding"], by=["status"], settings=settings).drop("n")
    means = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), _mean(_C.fund, 2).alias("mean_funding"))
    return means.join(med, "status")


def d3_funding_summary(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = _funded(v)
    med = quantile_row(rows, {"f": _C.fund}, [0.5], ["median"], settings=settings)
    return (rows.agg(F.count(F.lit(1)).alias("n"), _mean(_C.fund, 2).alias("mean_funding"))
            .crossJoin(med.select(F.col("f__median").alias("median_funding"))))


# ---------------------------------------------------------------- d4 geography
def _geo(v: DataFrame) -> DataFrame:
    return v.where(F.col("country_code").isNotNull())


def d4_top_countries(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.value_counts(_geo(v), "country_code", top=15)


def d4_country_success(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    top = K.value_counts(_geo(v), "country_code", top=10).select("country_code", "rank")
    rows = K.concluded(_geo(v)).join(F.broadcast(top), "country_code")  # <= 10 keys
    return K.rate_by(rows, ["country_code", "rank"], min_n=C.MIN_COUNTRY_CONCLUDED)


def d4_country_funding(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    means = (_geo(v).groupBy("country_code").agg(_mean(_C.fund, 2).alias("mean_funding")))
    return K.top_k(means, "mean_funding", "country_code", 10)


def d4_concentration(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    geo = _geo(v)
    total = F.broadcast(geo.agg(F.count(F.lit(1)).alias("_total")))
    top = K.value_counts(geo, "country_code", top=10)
    return top.crossJoin(total).withColumn("pct", X.pct(F.col("n"), F.col("_total"))).drop("_total")


def geo_summary(countries: DataFrame, top_n: int | None = 15) -> DataFrame:
    """Concentration from the counts of the countries (country_code, n).

    The original sums the squared shares of the 15 largest only; ``top_n=None``
    takes all countries.
    """
    totals = countries.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("n_countries"))
    top = K.top_k(countries, "n", "country_code", max(top_n or 10, 10))
    r = F.col("rank")
    summary = top.agg(
        F.max_by("country_code", F.struct(F.col("n"), -r)).alias("top_country"),
        F.max("n").alias("top_count"),
        F.sum(F.when(r <= (top_n or 0), F.col("n") * F.col("n"))).alias("_sq"),
        F.sum(F.when(r <= 3, F.col("n"))).alias("_t3"),
        F.sum(F.when(r <= 5, F.col("n"))).alias("_t5"),
        F.sum(F.when(r <= 10, F.col("n"))).alias("_t10"),
    )
    if top_n is None:
        summary = summary.drop("_sq").crossJoin(F.broadcast(countries.agg(F.sum(F.col("n") * F.col("n")).alias("_sq"))))
    tot = F.col("_total")
    hhi = X.ratio(F.col("_sq"), tot * tot)
    return summary.crossJoin(F.broadcast(totals)).select(
        "n_countries", "top_country", "top_count", hhi.alias("hhi"), (F.lit(1.0) - hhi).alias("diversity"),
        X.ratio(F.col("_t3"), tot).alias("top3_share"), X.ratio(F.col("_t5"), tot).alias("top5_share"),
        X.ratio(F.col("_t10"), tot).alias("top10_share"))


def diversity_bars(summary: DataFrame) -> DataFrame:
    """(measure, value): what the diversity chart shows of the summary."""
    shown = ("diversity", "top3_share", "top5_share", "top10_share")
    return summary.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in shown])))


def d4_geo_summary(v: DataFrame, settings: Settings = DEFAULT, top_n: int | None = 15) -> DataFrame:
    return geo_summary(K.value_counts(_geo(v), "country_code"), top_n)


def d4_diversity(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return diversity_bars(d4_geo_summary(v, settings))


# ---------------------------------------------------------------- d5 categories
def top_categories(lists: DataFrame, k: int) -> DataFrame:
    return K.top_k(K.category_counts(lists), "n", "category", k)


def matched_lists(lists: DataFrame, mode: str = "substring") -> DataFrame:
    """The distinct category lists of each of the ten most frequent categories: the detail rows are not matched one by one."""
    return K.match_categories(lists, top_categories(lists, 10).select("category", "rank"), mode=mode)


def category_success(lists: DataFrame, mode: str = "substring") -> DataFrame:
    out = matched_lists(lists, mode).groupBy("category", "rank").agg(F.sum("n_concluded").alias("n"), F.sum("n_success").alias("n_success"))
    out = out.withColumn("success_rate", X.pct(F.col("n_success"), F.col("n")))
    return out.where(F.col("n") > C.MIN_CATEGORY_CONCLUDED)


def category_funding(lists: DataFrame, mode: str = "substring") -> DataFrame:
    mean = F.round(F.try_divide(F.sum("amount"), F.sum("n_amounts")), 2)
    return matched_lists(lists, mode).groupBy("category").agg(mean.alias("mean_funding")).where(F.col("mean_funding").isNotNull())


def d5_top_categories(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return top_categories(K.category_lists(v), 15)


def d5_category_success(v: DataFrame, settings: Settings = DEFAULT, mode: str = "substring") -> DataFrame:
    return category_success(K.category_lists(v), mode)


def d5_category_funding(v: DataFrame, settings: Settings = DEFAULT, mode: str = "substring") -> DataFrame:
    return K.top_k(category_funding(K.category_lists(v), mode), "mean_funding", "category", 8)


def d5_diversity_by_year(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    y = v.where(_C.year.between(2000, 2020)).withColumn("year", _C.year)
    if settings.distinct_mode == "approx":
        lists = K.category_lists(y, F.col("year"))  # the sketch reads distinct lists, the row counts come from the rows
        cats = D.roll_up(D.sketches(K.explode_categories(lists, ["year"]), ["year"], {"n_categories": "category"}), ["year"], ["n_categories"]).drop("n")
        sizes = y.groupBy("year").agg(F.count(F.lit(1)).alias("n_ventures")).where(F.col("n_ventures") > C.MIN_YEAR_VENTURES)
        return sizes.join(cats, "year", "left").select("year", "n_ventures", F.coalesce("n_categories", F.lit(0)).alias("n_categories"))
    sizes = y.groupBy("year").agg(F.count(F.lit(1)).alias("n_ventures")).where(F.col("n_ventures") > C.MIN_YEAR_VENTURES)
    cats = K.explode_categories(y, ["year"]).groupBy("year").agg(F.count_distinct("category").alias("n_categories"))
    return sizes.join(cats, "year", "left").select("year", "n_ventures",
                                                  F.coalesce("n_categories", F.lit(0)).alias("n_categories"))


def d5_category_count_dist(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.value_counts(v.where(F.col("category_count") <= 10), "category_count", order="key")


def category_insights(lists: DataFrame, mean_count: DataFrame) -> DataFrame:
    counts = K.category_counts(lists)
    top1 = K.top_k(counts, "n", "category", 1).select(F.col("category").alias("most_popular"),
                                                      F.col("n").alias("most_popular_n"))
    n_cat = counts.agg(F.count(F.lit(1)).alias("n_categories"))
    best = K.top_k(category_success(lists).select("category", "success_rate", "rank"), "success_rate", "rank", 1, rank_name="_k")
    best = best.select(F.col("category").alias("best_rate_category"), F.col("success_rate").alias("best_rate"))
    fund = K.top_k(category_funding(lists), "mean_funding", "category", 1).select(
        F.col("category").alias("top_funded_category"), F.col("mean_funding").alias("top_funded_mean"))
    # every side has at most one row: cross joins of bounded one-row tables
    out = n_cat.crossJoin(top1).crossJoin(mean_count)
    return out.join(best, F.lit(True), "left").join(fund, F.lit(True), "left")


def d5_category_insights(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return category_insights(K.category_lists(v), v.agg(_mean("category_count", 4).alias("mean_category_count")))


# ---------------------------------------------------------------- d6 time
def _temporal(v: DataFrame) -> DataFrame:
    return v.where(F.col("founded_at").isNotNull() & _C.year.between(C.FIRST_YEAR, 2023))


def d6_year_counts(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return K.value_counts(_temporal(v), _C.year.alias("year"), name="year", order="key")


def d6_rate_by_year(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = K.concluded(_temporal(v)).where(_C.year.between(1995, 2019))
    return K.rate_by(rows, [_C.year.alias("year")], min_n=C.MIN_YEAR_CONCLUDED)


def d6_median_funding_year(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = _temporal(v).where(_C.fund.isNotNull() & (_C.year >= 1995)).withColumn("year", _C.year)
    return grouped_quantiles(rows, _C.fund, [0.5], ["median_funding"], by=["year"], settings=settings)


def d6_month_counts(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    counts = _temporal(v).groupBy(F.month("founded_at").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = v.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    # every month kept; the month counts (12 rows at most) are the broadcast side
    return months.join(F.broadcast(counts), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def d6_rate_by_era(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    edges, labels, lowest = C.ECONOMIC_ERAS
    rows = _temporal(v).select(X.bucketize(_C.year, edges, labels, lowest).alias("economic_era"),
                               "success_category").where(F.col("economic_era").isNotNull())
    agg = rows.groupBy("economic_era").agg(F.count_if(K.is_success()).alias("n_success"),
                                           F.count_if(K.is_failed()).alias("n_failed"))
    out = K.bucket_labels(v, labels, "economic_era").join(F.broadcast(agg), "economic_era", "left")
    s, f = F.coalesce("n_success", F.lit(0)), F.coalesce("n_failed", F.lit(0))
    return out.select("economic_era", "bucket_order", s.alias("n_success"), f.alias("n_failed"),
                      F.coalesce(X.pct(s, s + f), F.lit(0.0)).alias("success_rate"))


def _successes_by_age(v: DataFrame) -> DataFrame:
    return _temporal(v).where(K.is_success() & (_C.age > 0) & (_C.age < 25))


def d6_time_to_success(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return _round_edges(S.histogram(_successes_by_age(v), _C.age, 20))


def d6_temporal_summary(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    t = _temporal(v)
    years = K.value_counts(t, _C.year.alias("year"), name="year")
    peak = years.agg(F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("peak_year"),
                     F.max("n").alias("peak_count"))
    months = t.groupBy(F.month("founded_at").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    top_month = months.agg(F.max_by("month", F.struct(F.col("n"), -F.col("month"))).alias("top_month"))
    succ = _successes_by_age(v)
    med = quantile_row(succ, {"a": _C.age}, [0.5], ["median"], settings=settings)
    times = succ.agg(_mean(_C.age, 4).alias("mean_time_to_success"))
    return (peak.crossJoin(top_month).crossJoin(times)
            .crossJoin(med.select(F.col("a__median").alias("median_time_to_success"))))


# ---------------------------------------------------------------- d7 correlation
def _corr_frame(v: DataFrame) -> DataFrame:
    return v.select(*C.CORR_COLUMNS, K.is_success().cast("int").alias("is_success"))


def d7_corr_matrix(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return S.corr_long(_corr_frame(v), list(C.CORR_COLUMNS) + ["is_success"])


def d7_corr_ranked(v: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    out = S.corr_with(_corr_frame(v), list(C.CORR_COLUMNS), "is_success")
    return out.where(F.col("abs_corr") > 0.05)


PANELS = {
    name: fn for name, fn in sorted(globals().items())
    if name[:3] in ("d1_", "d2_", "d3_", "d4_", "d5_", "d6_", "d7_") and callable(fn)
}
