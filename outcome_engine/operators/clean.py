"""Cleaning and derived columns (CLN-*, DRV-*): raw venture rows -> analysis table.

The step order follows the original analysis because it is observable:
derived durations and funding-per-round are computed before the round and date
repairs.  Statistics that depend on the whole table (the 99.9th percentile cap,
the IQR outlier bounds) are computed as a one-row table and broadcast-joined, so
nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Settings
from ..functions import exprs as X
from .quantiles import quantile_row

def typed(raw: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Steps 1-5: numeric/date coercion, text trimming, category cleaning, upper-case regions."""
    cols = set(raw.columns)
    raw = raw.select(*[X.na_to_null(f.name).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in raw.schema.fields])
    out = []
    for c in raw.columns:
        if c == "k":
            out.append(F.col(c).alias("venture_id"))
        elif c == "funding_total_usd":
            out.append(X.to_number(c).alias(c))
        elif c in ("founded_at", "first_funding_at", "last_funding_at"):
            out.append(X.to_date(c, settings.date_formats).alias(c))
        elif c in ("name", "homepage_url"):
            out.append(X.clean_text(c).alias(c))
        elif c == "category_list":
            out.append(X.clean_category_list(X.clean_text(c), settings.whole_word).alias(c))
        elif c in ("country_code", "state_code"):
            out.append(X.strip(F.upper(F.col(c).cast("string"))).alias(c))
        elif c == "funding_rounds":
            out.append(X.to_number(c).alias(c))
        else:
            out.append(F.col(c))
    if "k" not in cols and "venture_id" not in cols:
        # no id given: a content hash (works on streams too).  Equal rows share it; nothing joins rows on it.
        out.append(F.xxhash64(*[F.col(c) for c in raw.columns]).alias("venture_id"))
    df = raw.select(*out)
    missing = [c for c in ("name", "status") if c not in cols]
    if missing:
        raise ValueError(f"input lacks required columns {missing}")
    return df


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Step 6: rows without a status or a name are removed."""
    return df.na.drop(subset=["status", "name"])


def funding_stats(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row: q1, q3 and the cap quantile of the amount (for outlier flags and the cap)."""
    return quantile_row(df, {"f": "funding_total_usd"}, [0.25, 0.75, C.CAP_QUANTILE], ["q1", "q3", "cap"],
                        settings=settings)


def cap_funding(df: DataFrame, settings: Settings = DEFAULT, stats: DataFrame | None = None) -> DataFrame:
    """Step 7: cap amounts above the 99.9th percentile (nulls stay null)."""
    stats = funding_stats(df, settings) if stats is None else stats
    cap = stats.first()["f__cap"]  # one stored row: applied as a literal
    if cap is None:  # no amounts at all
        return df
    f = F.col("funding_total_usd")
    return df.withColumn("funding_total_usd", F.when(f > F.lit(cap), F.lit(cap)).otherwise(f))


def derive(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Steps 8-9: derived columns, computed before the repairs of step 10."""
    f, founded = F.col("funding_total_usd"), F.col("founded_at")
    first, last = F.col("first_funding_at"), F.col("last_funding_at")
    cats = F.col("category_list")
    as_of = F.lit(settings.as_of).cast("date")
    edges, labels, lowest = C.FUNDING_BRACKET_ALL
    return df.select(
        "*",
        X.flag(f > 0).alias("has_funding"),
        F.round(F.datediff(as_of, founded) / F.lit(365.25), 2).alias("company_age_years"),
        F.datediff(first, founded).alias("days_to_first_funding"),
        F.datediff(last, first).alias("funding_duration_days"),
        F.when(cats.isNull(), F.lit(0)).otherwise(F.size(F.split(cats, r"\|"))).alias("category_count"),
        F.coalesce(F.split_part(cats, F.lit("|"), F.lit(1)), F.lit("Unknown")).alias("primary_category"),
        F.col("country_code").isNotNull().cast("int").alias("has_location"),
        (F.col("city").isNotNull() & F.col("state_code").isNotNull()).cast("int").alias("has_detailed_location"),
        F.col("homepage_url").isNotNull().cast("int").alias("has_homepage"),
        X.domain_type("homepage_url").alias("domain_type"),
        X.nan_to_null(F.try_divide(f, F.col("funding_rounds"))).alias("funding_per_round"),
        X.any_substring(cats, C.TECH_KEYWORDS_BASIC).alias("is_tech_startup"),
        X.flag(F.col("country_code").isin(*C.TIER1_COUNTRIES)).alias("tier1_country"),
        X.flag(F.col("country_code").isin(*C.EMERGING_MARKETS)).alias("emerging_market"),
        X.flag(F.year(founded).isin(*C.RECESSION_YEARS)).alias("founded_in_recession"),
        X.bucketize(F.coalesce(f, F.lit(0.0)), edges, labels, include_lowest=lowest).alias("funding_bracket"),
    )


def repair(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Step 10: rounds of funded rows default to 1, first funding not before founding,
    status normalised (unknown values -> null, the row stays), outcome label rebuilt.

    ``settings.recompute`` brings what was derived from repaired columns up to date;
    the original leaves it as it was."""
    f, rounds = F.col("funding_total_usd"), F.col("funding_rounds")
    first, founded = F.col("first_funding_at"), F.col("founded_at")
    status = F.lower(F.col("status"))
    status = F.when(status.isin(*C.KNOWN_STATUSES), status)
    out = (df
            .withColumn("funding_rounds", F.when((f > 0) & rounds.isNull(), F.lit(1.0)).otherwise(rounds))
            .withColumn("first_funding_at", F.when(first < founded, founded).otherwise(first))
            .withColumn("status", status)
            .withColumn("success_category", X.outcome_of("status")))
    if settings.recompute:
        first, last = F.col("first_funding_at"), F.col("last_funding_at")
        out = out.withColumns({"days_to_first_funding": F.datediff(first, F.col("founded_at")), "funding_duration_days": F.datediff(last, first),
                               "funding_per_round": X.nan_to_null(F.try_divide("funding_total_usd", "funding_rounds"))})
    return out


def clean(raw: DataFrame, settings: Settings = DEFAULT, stats: DataFrame | None = None) -> DataFrame:
    """Raw venture rows -> cleaned analysis table with every derived column.

    ``stats``: the one-row funding statistics of the kept rows, if already computed.
    """
    df = drop_incomplete(typed(raw, settings))
    df = cap_funding(df, settings, stats)
    df = derive(df, settings)
    return repair(df, settings)


def cleaning_report(raw: DataFrame, settings: Settings = DEFAULT, stats: DataFrame | None = None,
                    kept: DataFrame | None = None) -> DataFrame:
    """One row of cleaning counts: removed rows, IQR outliers, capped rows, suspicious rounds, date repairs."""
    t = typed(raw, settings)
    kept = drop_incomplete(t) if kept is None else kept
    stats = F.broadcast(funding_stats(kept, settings) if stats is None else stats)
    f = F.col("funding_total_usd")
    iqr = F.col("f__q3") - F.col("f__q1")
    lo = F.col("f__q1") - F.lit(C.OUTLIER_IQR_FACTOR) * iqr
    hi = F.col("f__q3") + F.lit(C.OUTLIER_IQR_FACTOR) * iqr
    capped = F.when(f > F.col("f__cap"), F.col("f__cap")).otherwise(f)
    rounds = F.col("funding_rounds")
    rounds_fixed = F.when((capped > 0) & rounds.isNull(), F.lit(1.0)).otherwise(rounds)
    first, founded = F.col("first_funding_at"), F.col("founded_at")
    dates = [c for c in ("founded_at", "first_funding_at", "last_funding_at") if c in raw.columns]
    lost = [(X.na_to_null(F.col(c).cast("string")).isNotNull() & X.to_date(c, settings.date_formats).isNull()).cast("long") for c in dates]
    removed = raw.agg(F.count(F.lit(1)).alias("rows_in"), F.coalesce(F.sum(sum(lost, F.lit(0).cast("long"))), F.lit(0)).alias("unparsed_dates"))
    body = kept.crossJoin(stats).agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.count_if((f < lo) | (f > hi)).alias("funding_outliers"),
        F.max("f__cap").alias("cap_value"),
        F.count_if(f > F.col("f__cap")).alias("capped_rows"),
        F.count_if((rounds_fixed > 0) & capped.isNull()).alias("suspicious_rounds"),
        F.count_if(first.isNotNull() & founded.isNotNull() & (first < founded)).alias("date_fixes"),
    )
    return (removed.crossJoin(body)
            .select("rows_in", "rows_kept", (F.col("rows_in") - F.col("rows_kept")).alias("rows_removed"),
                    "funding_outliers", "cap_value", "capped_rows", "suspicious_rounds", "date_fixes", "unparsed_dates"))
