"""Model features (FEA-*): a fit/transform pair over DataFrames.

``fit_features`` computes every statistic the features depend on from the
training rows, as small DataFrames: one row of medians/maxima/percentiles, the
target-encoding tables (category and country success rates) and the market
density table.  ``FeatureModel.transform`` applies them to any venture rows.
Only the one-row statistics tables (a bounded row of numbers each) are read
back and applied as literals; the keyed tables are joins, broadcast behind a
row-count check.

Reference behaviour (``refit=True``): statistics are recomputed on the rows
being transformed, and without a target both success rates are the constant
0.1.  Default: statistics come from the fitted (training) rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Settings
from ..functions import exprs as X
from ..session import cut_lineage, per_group, sized_broadcast
from .quantiles import quantile_row

# Float-typed columns of the feature frame, winsorized to [q01, q99] then median-filled.
WINSORIZED = (
    "funding_total_usd", "funding_rounds", "company_age_years", "days_to_first_funding", "funding_duration_days",
    "category_count", "funding_per_round", "funding_total_usd_filled", "funding_log", "funding_per_round_filled",
    "funding_intensity", "funding_velocity", "founded_year_filled", "founded_decade",
    "days_to_first_funding_filled", "funding_speed_score", "category_diversity", "category_success_rate",
    "country_success_rate", "funding_country_interaction", "tech_funding_interaction", "age_funding_interaction",
)


def with_target(v: DataFrame) -> DataFrame:
    """Concluded ventures with ``target`` = 1 for acquired/ipo, 0 for closed."""
    return (v.where(F.col("status").isin(*C.CONCLUDED_STATUSES))
            .withColumn("target", F.col("status").isin(*C.SUCCESS_STATUSES).cast("int")))


def _base_stats(df: DataFrame, settings: Settings) -> DataFrame:
    """One row: medians of amount, amount per round, founding year, days to funding; max category count."""
    meds = quantile_row(df, {"f": "funding_total_usd", "fpr": "funding_per_round",
                             "year": F.year("founded_at"), "days": "days_to_first_funding",
                             "cc": "category_count"}, [0.5, 1.0], ["med", "max"], settings=settings)
    return meds.withColumnRenamed("cc__max", "max_cc")  # the 1.0 quantile is the maximum


def _lit(row: dict, key: str):
    """A fitted one-row statistic as a literal (null stays a typed null)."""
    v = row.get(key)
    return F.lit(None).cast("double") if v is None else F.lit(v)


def one_row(df: DataFrame) -> dict:
    """The values of a stored one-row statistics table (bounded: one row of numbers)."""
    r = df.first()
    return r.asDict() if r is not None else {}


def _stage_a(df: DataFrame, s: dict, settings: Settings) -> DataFrame:
    """Fills, logs, ratios and flags (the one-row base statistics are literals)."""
    filled = F.coalesce(F.col("funding_total_usd"), _lit(s, "f__med"), F.lit(0.0))
    age = X.clip(F.coalesce(F.col("company_age_years"), F.lit(0.0)), 0, C.MAX_AGE_YEARS)
    year_fill = F.coalesce(_lit(s, "year__med"), F.lit(float(C.DEFAULT_MEDIAN_YEAR)))
    year = X.clip(F.coalesce(F.year("founded_at").cast("double"), year_fill), C.FIRST_YEAR, settings.current_year)
    days_fill = F.coalesce(_lit(s, "days__med"), F.lit(float(C.DEFAULT_MEDIAN_DAYS)))
    days = X.clip(F.coalesce(F.col("days_to_first_funding").cast("double"), days_fill), 0, C.MAX_DAYS_TO_FUNDING)
    max_cc = F.lit(1 if not s.get("max_cc") else s["max_cc"])
    df = df.select(
        *[c for c in df.columns if c != "company_age_years"],
        filled.alias("funding_total_usd_filled"),
        F.coalesce(F.col("funding_per_round"), _lit(s, "fpr__med"), F.lit(0.0)).alias("funding_per_round_filled"),
        age.alias("company_age_years"),
        year.alias("founded_year_filled"),
        days.alias("days_to_first_funding_filled"),
        max_cc.alias("_max_cc"),
    )
    age, filled = F.col("company_age_years"), F.col("funding_total_usd_filled")
    fy, days = F.col("founded_year_filled"), F.col("days_to_first_funding_filled")
    return df.select(
        *[c for c in df.columns if c not in ("_max_cc", "is_tech_startup", "founded_in_recession")],
        X.safe_log10(filled + 1).alias("funding_log"),
        X.safe_divide(filled, age + 1).alias("funding_intensity"),
        X.safe_divide(filled, X.at_least(age, 0.1)).alias("funding_velocity"),
        (F.floor(fy / 10) * 10).cast("double").alias("founded_decade"),
        X.safe_divide(F.lit(1.0), days + 1).alias("funding_speed_score"),
        X.flag(fy.isin(*[float(y) for y in C.RECESSION_YEARS])).alias("founded_in_recession"),
        X.any_substring("category_list", C.TECH_KEYWORDS_MODEL).alias("is_tech_startup"),
        X.safe_divide(F.col("category_count"), F.col("_max_cc")).alias("category_diversity"),
    )


@dataclass
class FeatureModel:
    """Fitted feature statistics (all lazy DataFrames)."""

    base: DataFrame            # one row
    density: DataFrame         # primary_category, founded_year_filled, _density
    category_rates: DataFrame  # primary_category, _cat_rate
    country_rates: DataFrame   # country_code, _cty_rate
    risk: DataFrame            # one row: _p90
    winsor: DataFrame          # one row: <col>__lo, <col>__hi, <col>__med
    settings: Settings = DEFAULT
    has_target: bool = True
    base_row: dict | None = None    # the one-row tables' values, applied as literals
    risk_row: dict | None = None
    winsor_row: dict | None = None
    extra: tuple[tuple[str, str], ...] = ()  # the caller's own features: name and SQL expression over the frame

    def transform(self, df: DataFrame) -> DataFrame:
        return _apply(df, self)

    def save(self, path: str) -> None:
        for name in ("base", "density", "category_rates", "country_rates", "risk", "winsor"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        rows = [(n, e) for n, e in self.extra]
        self.base.sparkSession.createDataFrame(rows, "name string, expression string").write.mode("overwrite").parquet(f"{path}/extra")

    @classmethod
    def load(cls, spark, path: str, settings: Settings = DEFAULT) -> FeatureModel:
        """The statistics that ``save`` wrote."""
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("base", "density", "category_rates", "country_rates", "risk", "winsor")}
        keyed = {n: sized_broadcast(t[n])[0] for n in ("density", "category_rates", "country_rates")}
        extra = tuple((r["name"], r["expression"]) for r in spark.read.parquet(f"{path}/extra").collect())
        return cls(t["base"], **keyed, risk=t["risk"], winsor=t["winsor"], settings=settings, base_row=one_row(t["base"]),
                   risk_row=one_row(t["risk"]), winsor_row=one_row(t["winsor"]), extra=extra)


def _stage_b(df: DataFrame, m: FeatureModel) -> DataFrame:
    """Market density and target-encoded success rates (joins), interactions and risk flags."""
    df = (df.join(m.density, ["primary_category", "founded_year_filled"], "left")
          .join(m.category_rates, "primary_category", "left")
          .join(m.country_rates, "country_code", "left")
          .withColumn("_p90", _lit(m.risk_row, "_p90")))
    default = F.lit(C.DEFAULT_RATE)
    cat_rate = X.clip(F.coalesce(F.col("_cat_rate"), default), 0, 1) if m.has_target else default
    cty_rate = X.clip(F.coalesce(F.col("_cty_rate"), default), 0, 1) if m.has_target else default
    df = df.select(
        *[c for c in df.columns if not c.startswith("_")],
        X.clip(F.coalesce(F.col("_density"), F.lit(1)), 1, C.MARKET_DENSITY_MAX).cast("long").alias("market_density"),
        cat_rate.cast("double").alias("category_success_rate"),
        cty_rate.cast("double").alias("country_success_rate"),
        F.col("_p90"),
    )
    log, tier1 = F.col("funding_log"), F.col("tier1_country")
    return df.select(
        *[c for c in df.columns if c != "_p90"],
        (log * tier1).alias("funding_country_interaction"),
        (F.col("is_tech_startup") * log).alias("tech_funding_interaction"),
        (F.col("company_age_years") * log).alias("age_funding_interaction"),
        X.flag((F.col("funding_total_usd_filled") > F.col("_p90")) & (F.col("founded_in_recession") == 1))
        .alias("high_risk_profile"),
        X.flag((tier1 == 1) & (F.col("category_success_rate") > 0.2) & (F.col("has_funding") == 1))
        .alias("low_risk_profile"),
    )


def encoded_rates(df: DataFrame, key: str, target: str = "target", fold: str = "fold", prefix: str = "") -> DataFrame:
    """Success rate of a row's key without the row's own influence: ``<prefix>oof`` and ``<prefix>loo``.

    FEA-16/17 of the original encode a row by a mean that includes the row itself
    and later test rows.  Here only rows with a fold count (the training rows):

    - out of fold: the key's mean over the other folds; a row without a fold (test,
      scoring) takes all training rows,
    - leave one out: the key's mean over the other training rows.

    Both subtract from the key's (sum, count), so the detail rows are aggregated once
    per (key, fold) and read a small table back.  A key without other rows, and a
    null key, get the default rate; results lie in [0, 1].
    """
    known = df.where(F.col(key).isNotNull() & F.col(fold).isNotNull())
    parts = known.groupBy(key, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    whole = Window.partitionBy(key)  # one row per fold
    parts = parts.withColumns({"_all_s": F.sum("_s").over(whole), "_all_n": F.sum("_n").over(whole)})
    every = parts.select(key, F.lit(None).cast(df.schema[fold].dataType).alias("_f"), F.lit(0).alias("_s"), F.lit(0).alias("_n"), "_all_s", "_all_n").distinct()
    table = per_group(parts.select(key, F.col(fold).alias("_f"), "_s", "_n", "_all_s", "_all_n").unionByName(every).withColumnRenamed(key, "_k"))
    joined = df.join(table, (F.col(key) == F.col("_k")) & F.col(fold).eqNullSafe(F.col("_f")), "left")
    # a fold that the key does not have takes the key's whole sums, as a row without a fold does
    fallback = per_group(every.select(F.col(key).alias("_k2"), F.col("_all_s").alias("_s2"), F.col("_all_n").alias("_n2")))
    joined = joined.join(fallback, F.col(key) == F.col("_k2"), "left")
    total, count = F.coalesce("_all_s", "_s2"), F.coalesce("_all_n", "_n2")
    own, one = F.when(F.col(fold).isNotNull(), F.col(target)).otherwise(0), F.when(F.col(fold).isNotNull(), 1).otherwise(0)
    rate = lambda t, n: X.clip(F.coalesce(F.when(n > 0, F.try_divide(t.cast("double"), n.cast("double"))), F.lit(C.DEFAULT_RATE)), 0, 1)
    return joined.select(*df.columns, rate(total - F.coalesce("_s", F.lit(0)), count - F.coalesce("_n", F.lit(0))).alias(f"{prefix}oof"),
                         rate(total - own, count - one).alias(f"{prefix}loo"))


def _winsor_stats(df: DataFrame, settings: Settings) -> DataFrame:
    """One row: q01, median, q90 and q99 of every winsorized column (q90 of the filled amount is the risk cut)."""
    return quantile_row(df, {c: c for c in WINSORIZED}, [C.WINSOR_LOW, 0.5, 0.9, C.WINSOR_HIGH],
                        ["lo", "med", "p90", "hi"], settings=settings)


def _stage_c(df: DataFrame, winsor: dict) -> DataFrame:
    """Winsorize every float column to its [q01, q99] and fill what is still null with its median."""
    out = []
    for c in df.columns:
        if c in WINSORIZED:
            lo, hi, med = _lit(winsor, f"{c}__lo"), _lit(winsor, f"{c}__hi"), _lit(winsor, f"{c}__med")
            clipped = F.when(lo.isNotNull() & hi.isNotNull(), X.clip(F.col(c), lo, hi)).otherwise(F.col(c))
            med_clipped = F.when(lo.isNotNull() & hi.isNotNull(), X.clip(med, lo, hi)).otherwise(med)
            out.append(F.coalesce(clipped.cast("double"), med_clipped, F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fit_features(train: DataFrame, settings: Settings = DEFAULT, extra_features: dict[str, str] | None = None) -> FeatureModel:
    """Fit feature statistics on training rows (must hold ``target``).

    ``extra_features`` adds the caller's own: name -> SQL expression over the
    finished feature frame; name them in ``select_features(..., candidates=...)``.
    """
    has_target = "target" in train.columns
    base = _base_stats(train, settings)
    base_row = one_row(base)
    a = _stage_a(train, base_row, settings)
    density = (a.where(F.col("primary_category").isNotNull() & F.col("founded_year_filled").isNotNull())
               .groupBy("primary_category", "founded_year_filled").agg(F.count(F.lit(1)).alias("_density")))
    if has_target:
        cat_rates = (a.where(F.col("primary_category").isNotNull()).groupBy("primary_category")
                     .agg(F.avg("target").alias("_cat_rate")))
        cty_rates = (a.where(F.col("country_code").isNotNull()).groupBy("country_code")
                     .agg(F.avg("target").alias("_cty_rate")))
    else:
        cat_rates = a.select("primary_category", F.lit(None).cast("double").alias("_cat_rate")).limit(0)
        cty_rates = a.select("country_code", F.lit(None).cast("double").alias("_cty_rate")).limit(0)
    # fitted encoding tables: one row per category / country / (category, year); stored once
    density, cat_rates, cty_rates = cut_lineage(density), cut_lineage(cat_rates), cut_lineage(cty_rates)
    # keyed tables: one row per category / country / (category, year); broadcast behind a row-count check
    density, _ = sized_broadcast(density)
    cat_rates, _ = sized_broadcast(cat_rates)
    cty_rates, _ = sized_broadcast(cty_rates)
    partial = FeatureModel(base, density, cat_rates, cty_rates, risk=None, winsor=None, settings=settings,
                           has_target=has_target, base_row=base_row, risk_row={"_p90": None}, extra=tuple((extra_features or {}).items()))
    # The winsorized columns do not depend on the risk flags, so the 90th percentile of the filled
    # amount comes out of the same ranking pass as the winsor bounds.
    b = _stage_b(a, partial)
    partial.winsor = _winsor_stats(b, settings)
    partial.winsor_row = one_row(partial.winsor)
    partial.risk = partial.winsor.select(F.col("funding_total_usd_filled__p90").alias("_p90"))
    partial.risk_row = {"_p90": partial.winsor_row.get("funding_total_usd_filled__p90")}
    return partial


def _apply(df: DataFrame, m: FeatureModel) -> DataFrame:
    a = _stage_a(df, m.base_row, m.settings)
    b = _stage_b(a, m)
    return _stage_c(b, m.winsor_row).withColumns({n: F.expr(e) for n, e in m.extra})


def build_features(df: DataFrame, settings: Settings = DEFAULT, model: FeatureModel | None = None,
                   refit: bool = False) -> tuple[DataFrame, FeatureModel]:
    """Feature frame of ``df``: with ``model`` (fit elsewhere) unless ``refit`` or no model."""
    if model is None or refit:
        model = fit_features(df, settings)
    return model.transform(df), model
