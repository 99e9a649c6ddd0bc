"""All dashboard panels from three shared scans of the venture table.

Each panel of ``panels`` is a query of its own.  Writing a whole dashboard that way
scans the table once or more per panel; here the panels share their passes:

1. one wide aggregate: counts, means, missing values, correlations and the ranges
   of the ungrouped histograms,
2. one exact quantile pass over all measured values (medians, quartiles, and the
   ranges of the grouped histograms as their 0 and 1 quantiles).  Above
   ``Settings.select_rows`` values it takes a scan more for each round of the
   multi-select,
3. one grouped aggregate: every row gives one entry per grouping set that it
   belongs to (status, age group, country, year, category list, histogram bin, ...),
   combined in the tasks before the shuffle.

The three results are small tables, stored, and every panel is a projection of
them.  The tables are those of the single queries; means of money and ages come
from sums and are rounded alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Settings
from ..functions import exprs as X
from ..operators import cohorts as K
from ..operators import stats as S
from ..operators.quantiles import quantile_table
from ..session import cut_lineage
from . import panels as P

AGE, FUND = "company_age_years", "funding_total_usd"
BINS = {"completeness": 20, "age": 30, "outcome_age": 20, "density": 25, "first": 20, "time": 20}
QUANTILES = {"lo": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "hi": 1.0}


def _temporal() -> Column:
    return F.col("founded_at").isNotNull() & F.year("founded_at").between(C.FIRST_YEAR, 2023)


def _samples(v: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Histogram -> (which rows, value)."""
    age, fund, days = F.col(AGE), F.col(FUND), F.col("days_to_first_funding")
    return {
        "completeness": (F.lit(True), S.completeness(v)),
        "age": (age.between(0, 50), age),
        "outcome_age": (K.is_concluded() & (age > 0) & (age < 30), age),
        "density": (fund.isNotNull() & F.col("status").isNotNull(), F.log10(fund + 1)),
        "first": (days.between(0, C.MAX_DAYS_TO_FUNDING) & F.col("status").isin(*C.CONCLUDED_STATUSES), days / F.lit(365.25)),
        "time": (_temporal() & K.is_success() & (age > 0) & (age < 25), age),
    }


def _entries(v: DataFrame, entries: list[Column], schema: str, *keep: str) -> DataFrame:
    """One row per entry whose condition holds."""
    held = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return v.select(*keep, F.explode(held).alias("e")).select(*keep, *[f"e.{c}" for c in schema.split()])


class Dashboard:
    """The shared tables of a dashboard; ``tables()`` has all panels."""

    def __init__(self, v: DataFrame, settings: Settings = DEFAULT):
        self.v, self.settings, self.spark = v, settings, v.sparkSession
        self.wide = self._wide()
        self.one = self.wide.first().asDict()  # one row of numbers
        self.quantiles = self._quantiles()
        self.groups = self._groups()

    # --- the three scans --------------------------------------------------------------------------------------

    def _wide(self) -> DataFrame:
        v, age, funded = self.v, F.col(AGE), F.col("has_funding") == 1
        young = (age > 0) & (age < 30)
        count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
        corr = [c for c in C.CORR_COLUMNS] + ["is_success"]
        value = lambda c: (K.is_success().cast("int") if c == "is_success" else F.col(c)).cast("double")
        ranges = []
        for name in ("completeness", "age", "outcome_age", "time"):
            on, x = _samples(v)[name]
            ranges += [F.min(F.when(on, x)).cast("double").alias(f"{name}_min"), F.max(F.when(on, x)).cast("double").alias(f"{name}_max")]
        return cut_lineage(v.agg(
            F.count(F.lit(1)).alias("n"), F.avg(age).alias("mean_age"), F.sum("has_funding").cast("long").alias("n_funded"),
            F.sum("has_location").cast("long").alias("n_located"), F.avg("funding_rounds").alias("mean_rounds"),
            F.avg("category_count").alias("mean_category_count"), F.count(FUND).alias("n_amounts"), F.avg(FUND).alias("mean_funding"),
            count(K.is_concluded(), "n_concluded"), count(K.is_success(), "n_success"), count(K.is_concluded() & funded, "n_concluded_funded"),
            count(K.is_success() & funded, "n_success_funded"), count(K.is_concluded() & ~funded, "n_concluded_unfunded"),
            count(K.is_success() & ~funded, "n_success_unfunded"), F.avg(F.when(K.is_success() & young, age)).alias("age_success"),
            F.avg(F.when(K.is_failed() & young, age)).alias("age_failed"),
            F.avg(F.when(_samples(v)["time"][0], age)).alias("mean_time_to_success"), *ranges,
            *[F.count_if(F.col(c).isNull()).alias(f"missing_{i}") for i, c in enumerate(v.columns)],
            *[F.round(S.pearson(value(corr[i]), value(corr[j])), 6).alias(f"corr_{i}_{j}") for i in range(len(corr)) for j in range(i)]))

    def _quantiles(self) -> DataFrame:
        """(measure, key, n, lo, q1, median, q3, hi); the key is text, empty where there is none."""
        fund, status, samples = F.col(FUND), F.col("status"), _samples(self.v)
        entry = lambda on, name, key, x: F.when(on, F.struct(F.lit(name).alias("measure"), key.cast("string").alias("key"), x.cast("double").alias("x")))
        none = F.lit("")
        entries = [
            entry(fund.isNotNull() & status.isNotNull(), "fund", status, fund),
            entry(fund.isNotNull(), "fund_all", none, fund),
            entry(fund.isNotNull() & F.col("funding_per_round").isNotNull() & status.isNotNull(), "per_round", status, F.col("funding_per_round")),
            entry(_temporal() & fund.isNotNull() & (F.year("founded_at") >= 1995), "fund_year", F.year("founded_at"), fund),
            *[entry(samples[name][0], name, status if name != "time" else none, samples[name][1]) for name in ("density", "first", "time")]]
        long = _entries(self.v, entries, "measure key x").withColumnRenamed("measure", "of")
        out = quantile_table(long, {"x": "x"}, list(QUANTILES.values()), list(QUANTILES), by=["of", "key"], settings=self.settings,
                             rows=self.one["n"] * len(entries))
        return cut_lineage(out.drop("measure").withColumnRenamed("of", "measure"))

    def _ranges(self, name: str) -> DataFrame:
        """Ranges of a grouped histogram: (status, _lo, _hi)."""
        q = self.quantiles.where(F.col("measure") == name)
        return q.select(F.col("key").alias("status"), *S.bin_range(F.col("lo"), F.col("hi")))

    def _groups(self) -> DataFrame:
        """(set, key, part, n, n_concluded, n_success, n_failed, n_amounts, amount, least, most) of every grouping set."""
        v, one = self.v, self.one
        fund, age, status, year, rounds = F.col(FUND), F.col(AGE), F.col("status"), F.year("founded_at"), F.col("funding_rounds")
        # a few rows per status at most: the ranges and fences of the grouped histograms and boxes
        iqr = F.col("q3") - F.col("q1")
        box = self.quantiles.where("measure = 'per_round'").select(
            F.col("key").alias("status"), (F.col("q1") - 1.5 * iqr).alias("box_lo"), (F.col("q3") + 1.5 * iqr).alias("box_hi"))
        of_status = box
        for name in ("density", "first"):
            r = self._ranges(name).select("status", F.col("_lo").alias(f"{name}_lo"), F.col("_hi").alias(f"{name}_hi"))
            of_status = of_status.join(r, "status", "full_outer")
        v = v.join(F.broadcast(cut_lineage(of_status)), "status", "left")

        def entry(on, name, key=None, part=None, x=None):
            none = F.lit(None).cast("string")
            return F.when(F.coalesce(on, F.lit(False)), F.struct(
                F.lit(name).alias("set"), (none if key is None else key.cast("string")).alias("key"), (none if part is None else part.cast("string")).alias("part"),
                (F.lit(None) if x is None else x).cast("double").alias("x")))

        label = lambda x, b: X.bucketize(x, *b)
        era, ages, bracket = label(year, C.ECONOMIC_ERAS), label(age, C.AGE_GROUPS), label(fund, C.FUNDING_BRACKET_PANEL)
        per_round, concluded = F.col("funding_per_round"), K.is_concluded()
        entries = [
            entry(status.isNotNull(), "status", status),
            entry(concluded, "outcome", F.col("success_category")),
            entry(F.lit(True), "has_funding", F.col("has_funding")),
            entry(F.lit(True), "has_location", F.col("has_location")),
            entry(concluded & ages.isNotNull(), "age_group", ages),
            entry(concluded & bracket.isNotNull(), "bracket", bracket),
            entry(concluded & (rounds <= 10), "rounds", rounds),
            entry(F.col("country_code").isNotNull(), "country", F.col("country_code")),
            entry(_temporal(), "year", year),
            entry(_temporal(), "month", F.month("founded_at")),
            entry(_temporal() & era.isNotNull(), "era", era),
            entry(F.col("category_count") <= 10, "category_count", F.col("category_count")),
            entry(F.col("category_list").isNotNull(), "list", F.col("category_list"), F.when(year.between(2000, 2020), year)),
            entry(fund.isNotNull() & per_round.isNotNull() & status.isNotNull(), "box", status,
                  F.when(per_round < F.col("box_lo"), "low").when(per_round > F.col("box_hi"), "high").otherwise("inside"), per_round)]
        edge = {name: S.bin_range(F.lit(one[f"{name}_min"]), F.lit(one[f"{name}_max"])) for name in ("completeness", "age", "outcome_age", "time")
                if one[f"{name}_min"] is not None}
        edge |= {name: (F.col(f"{name}_lo"), F.col(f"{name}_hi")) for name in ("density", "first")}
        keys = {"outcome_age": F.col("success_category"), "density": status, "first": status}
        for name, (low, high) in edge.items():
            on, x = _samples(self.v)[name]
            entries.append(entry(on, f"hist {name}", keys.get(name), S.bin_index(x.cast("double"), low, high, BINS[name])))
        rows = _entries(v, entries, "set key part x", "success_category", FUND)
        return cut_lineage(rows.groupBy("set", "key", "part").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(K.is_concluded()).alias("n_concluded"), F.count_if(K.is_success()).alias("n_success"),
            F.count_if(K.is_failed()).alias("n_failed"), F.count(FUND).alias("n_amounts"), F.sum(FUND).alias("amount"),
            F.min("x").alias("least"), F.max("x").alias("most")))

    # --- the panels -------------------------------------------------------------------------------------------

    def _set(self, name: str, key: str = "key", kind: str = "string") -> DataFrame:
        return self.groups.where(F.col("set") == name).withColumn(key, F.col("key").cast(kind))

    def _counts(self, name: str, key: str, kind: str = "string") -> DataFrame:
        return self._set(name, key, kind).select(key, "n")

    def _rates(self, rows: DataFrame, *keys: str, min_n: int | None = None) -> DataFrame:
        out = rows.select(*keys, F.col("n_concluded").alias("n"), "n_success").where(F.col("n") > (min_n or 0))
        return out.withColumn("success_rate", X.pct(F.col("n_success"), F.col("n")))

    def _histogram(self, name: str, by: str | None = None, density: bool = False) -> DataFrame:
        keys = [by] if by else []
        counts = self._set(f"hist {name}", by or "key").select(*keys, F.col("part").cast("int").alias("bin"), "n")
        if name in ("density", "first"):
            frame = self._ranges(name).withColumnRenamed("status", by)
        else:
            one = self.wide.select(*S.bin_range(F.col(f"{name}_min"), F.col(f"{name}_max")))
            frame = counts.select(*keys).distinct().crossJoin(F.broadcast(one)) if keys else one
        out = P._round_edges(S.fill_bins(frame, counts, BINS[name], keys, density))
        return out.withColumn("density", F.round("density", P.EDGE_DIGITS)) if density else out

    def _of(self, measure: str, key: str = "key", kind: str = "string") -> DataFrame:
        return self.quantiles.where(F.col("measure") == measure).withColumn(key, F.col("key").cast(kind))

    def tables(self) -> dict[str, DataFrame]:
        """Panel name -> table, as ``panels.PANELS`` gives them one by one."""
        out = {**self._overview(), **self._outcomes(), **self._funding(), **self._places(), **self._categories(), **self._times(), **self._correlations()}
        return dict(sorted(out.items()))

    def _overview(self) -> dict[str, DataFrame]:
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"missing_{i}").alias("n_missing")) for i, c in enumerate(self.v.columns)])
        missing = self.wide.select("n", F.explode(cells).alias("c")).select("c.*", X.pct(F.col("c.n_missing"), F.col("n")).alias("missing_pct"))
        n = F.col("n")
        return {
            "d1_missing_pct": missing.where(F.col("missing_pct") > 0),
            "d1_dtype_counts": P.d1_dtype_counts(self.v),
            "d1_completeness_hist": self._histogram("completeness"),
            "d1_age_hist": self._histogram("age"),
            "d1_funding_status": self._counts("has_funding", "has_funding", "int"),
            "d1_location_status": self._counts("has_location", "has_location", "int"),
            "d1_overview_stats": self.wide.select(
                F.col("n").alias("n_rows"), F.lit(len(self.v.columns)).alias("n_columns"), F.round("mean_age", 4).alias("mean_age"), "n_funded",
                X.pct(F.col("n_funded"), n).alias("pct_funded"), "n_located", X.pct(F.col("n_located"), n).alias("pct_located"),
                F.round("mean_rounds", 4).alias("mean_rounds")),
        }

    def _outcomes(self) -> dict[str, DataFrame]:
        labels = C.AGE_GROUPS[1]
        mean = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
        return {
            "d2_status_counts": K.in_order(self._counts("status", "status"), "status", "count"),
            "d2_success_split": K.in_order(self._counts("outcome", "success_category"), "success_category", "count"),
            "d2_rate_by_age": K.all_buckets(self._set("age_group", "age_group").select("age_group", "n", "n_success"), labels, "age_group"),
            "d2_outcome_age_hist": self._histogram("outcome_age", "success_category"),
            "d2_rate_by_funded": self._rates(self._set("has_funding", "has_funding", "int"), "has_funding"),
            "d2_success_metrics": self.wide.select(
                "n_concluded", X.pct(F.col("n_success"), F.col("n_concluded")).alias("success_rate"), mean("age_success").alias("avg_age_success"),
                mean("age_failed").alias("avg_age_failed"), X.pct(F.col("n_success_funded"), F.col("n_concluded_funded")).alias("rate_funded"),
                X.pct(F.col("n_success_unfunded"), F.col("n_concluded_unfunded")).alias("rate_unfunded")),
        }

    def _funding(self) -> dict[str, DataFrame]:
        box = self._set("box", "status").groupBy("status").agg(
            F.min(F.when(F.col("part") != "low", F.col("least"))).alias("_wlo"), F.max(F.when(F.col("part") != "high", F.col("most"))).alias("_whi"),
            F.coalesce(F.sum(F.when(F.col("part") != "inside", F.col("n"))), F.lit(0)).alias("n_outliers"), F.min("least").alias("min"), F.max("most").alias("max"))
        q = self._of("per_round", "status").select("status", "n", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))
        stats = self._set("status", "status").where("n_amounts > 0").select(
            "status", F.col("n_amounts").alias("n"), F.round(F.col("amount") / F.col("n_amounts"), 2).alias("mean_funding"))
        return {
            "d3_funding_density": self._histogram("density", "status", density=True),
            "d3_efficiency_box": q.join(box, "status").select("status", "n", *S.box_columns()),
            "d3_first_funding_hist": self._histogram("first", "status"),
            "d3_rate_by_bracket": K.all_buckets(self._set("bracket", "funding_bracket").select("funding_bracket", "n", "n_success"),
                                                C.FUNDING_BRACKET_PANEL[1], "funding_bracket"),
            "d3_rate_by_rounds": self._rates(self._set("rounds", "funding_rounds", "double"), "funding_rounds", min_n=C.MIN_ROUNDS_GROUP),
            "d3_funding_stats": stats.join(self._of("fund", "status").select("status", F.col("median").alias("median_funding")), "status"),
            "d3_funding_summary": self.wide.select(F.col("n_amounts").alias("n"), F.round("mean_funding", 2).alias("mean_funding"))
                .join(self._of("fund_all").select(F.col("median").alias("median_funding")), F.lit(True), "left"),
        }

    def _places(self) -> dict[str, DataFrame]:
        rows = self._set("country", "country_code")
        counts = rows.select("country_code", "n")
        total = F.broadcast(counts.agg(F.sum("n").alias("_total")))
        top10 = K.top_k(counts, "n", "country_code", 10)
        means = rows.select("country_code", F.round(F.try_divide("amount", "n_amounts"), 2).alias("mean_funding"))
        summary = P.geo_summary(counts)
        success = rows.join(F.broadcast(top10.select("country_code", "rank")), "country_code")
        return {
            "d4_top_countries": K.top_k(counts, "n", "country_code", 15),
            "d4_country_success": self._rates(success, "country_code", "rank", min_n=C.MIN_COUNTRY_CONCLUDED),
            "d4_country_funding": K.top_k(means, "mean_funding", "country_code", 10),
            "d4_concentration": top10.crossJoin(total).withColumn("pct", X.pct(F.col("n"), F.col("_total"))).drop("_total"),
            "d4_geo_summary": summary,
            "d4_diversity": P.diversity_bars(summary),
        }

    def _categories(self) -> dict[str, DataFrame]:
        by_year = self._set("list", "category_list")
        lists = by_year.groupBy("category_list").agg(*[F.sum(c).alias(c) for c in ("n", "n_concluded", "n_success", "n_amounts", "amount")])
        sizes = self._counts("year", "year", "int").where(F.col("year").between(2000, 2020) & (F.col("n") > C.MIN_YEAR_VENTURES))
        items = by_year.where("part IS NOT NULL").select("category_list", F.col("part").cast("int").alias("year"))
        cats = K.explode_categories(items, ["year"]).groupBy("year").agg(F.count_distinct("category").alias("n_categories"))
        return {
            "d5_top_categories": P.top_categories(lists, 15),
            "d5_category_success": P.category_success(lists),
            "d5_category_funding": K.top_k(P.category_funding(lists), "mean_funding", "category", 8),
            "d5_diversity_by_year": sizes.join(cats, "year", "left").select("year", F.col("n").alias("n_ventures"),
                                                                            F.coalesce("n_categories", F.lit(0)).alias("n_categories")),
            "d5_category_count_dist": K.in_order(self._counts("category_count", "category_count", self.v.schema["category_count"].dataType.simpleString()),
                                                 "category_count", "key"),
            "d5_category_insights": P.category_insights(lists, self.wide.select(F.round("mean_category_count", 4).alias("mean_category_count"))),
        }

    def _times(self) -> dict[str, DataFrame]:
        rows = self._set("year", "year", "int")
        months = self._counts("month", "month", "int")
        every = self.spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
        eras = K.bucket_labels(self.v, C.ECONOMIC_ERAS[1], "economic_era").join(
            F.broadcast(self._set("era", "economic_era").select("economic_era", "n_success", "n_failed")), "economic_era", "left")
        s, f = F.coalesce("n_success", F.lit(0)), F.coalesce("n_failed", F.lit(0))
        peak = rows.agg(F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("peak_year"), F.max("n").alias("peak_count"))
        top_month = months.agg(F.max_by("month", F.struct(F.col("n"), -F.col("month"))).alias("top_month"))
        times = self.wide.select(F.round("mean_time_to_success", 4).alias("mean_time_to_success"))
        median = self._of("time").select(F.col("median").alias("median_time_to_success"))
        return {
            "d6_year_counts": K.in_order(rows.select("year", "n"), "year", "key"),
            "d6_rate_by_year": self._rates(rows.where(F.col("year").between(1995, 2019)), "year", min_n=C.MIN_YEAR_CONCLUDED),
            "d6_median_funding_year": self._of("fund_year", "year", "int").select("year", "n", F.col("median").alias("median_funding")),
            "d6_month_counts": every.join(F.broadcast(months), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n")),
            "d6_rate_by_era": eras.select("economic_era", "bucket_order", s.alias("n_success"), f.alias("n_failed"),
                                          F.coalesce(X.pct(s, s + f), F.lit(0.0)).alias("success_rate")),
            "d6_time_to_success": self._histogram("time"),
            "d6_temporal_summary": peak.crossJoin(top_month).crossJoin(times).join(median, F.lit(True), "left"),
        }

    def _correlations(self) -> dict[str, DataFrame]:
        corr = [*C.CORR_COLUMNS, "is_success"]
        cells = [F.struct(F.lit(corr[i]).alias("col_a"), F.lit(corr[j]).alias("col_b"), F.col(f"corr_{i}_{j}").alias("corr"))
                 for i in range(len(corr)) for j in range(i)]
        matrix = self.wide.select(F.inline(F.array(*cells)))
        ranked = matrix.where("col_a = 'is_success'").select(F.col("col_b").alias("feature"), "corr", F.abs("corr").alias("abs_corr"))
        return {"d7_corr_matrix": matrix, "d7_corr_ranked": ranked.where(F.col("abs_corr") > 0.05)}
