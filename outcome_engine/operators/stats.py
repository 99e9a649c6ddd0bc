"""Statistics operators (STA-*): histograms, density, box plots, correlation, concentration.

Whole-table statistics are computed as small aggregate tables (one row per group)
and joined back; bin tables are generated on the executors with ``sequence``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import exprs as X
from ..session import per_group
from .quantiles import quantile_table


def _bin_edge(j: Column, lo: Column, hi: Column, step: Column, bins: int) -> Column:
    return F.when(j == bins, hi).otherwise(j.cast("double") * step + lo)


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy.histogram's bin of x for equal-width bins on [lo, hi] (last bin closed).

    First guess from ``(x-lo)*bins/(hi-lo)``, then corrected against the edges
    ``lo + i*step`` exactly as numpy corrects against ``linspace`` edges.
    """
    step = (hi - lo) / F.lit(float(bins))
    norm = F.lit(float(bins)) / (hi - lo)
    i0 = F.least(F.floor((x - lo) * norm).cast("int"), F.lit(bins - 1))
    i1 = F.when(x < _bin_edge(i0, lo, hi, step, bins), i0 - 1).otherwise(i0)
    return F.when((x >= _bin_edge(i1 + 1, lo, hi, step, bins)) & (i1 != bins - 1), i1 + 1).otherwise(i1)


def histogram(df: DataFrame, value: str | Column, bins: int, by: Sequence[str] = (),
              shared_range: bool = False, density: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max] of the non-null values (numpy semantics).

    ``by`` gives one histogram per group, each over its own range unless
    ``shared_range`` (one range for all groups, like a multi-series plot).  A
    constant column uses [v-0.5, v+0.5].  All bins are emitted, empty ones with
    n=0.  Columns: ``*by, bin, bin_lo, bin_hi, n`` (+ ``density``).
    """
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    data = df.select(*by, v.cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    range_keys = [] if shared_range else by
    rng = data.groupBy(*range_keys).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    rng = rng.select(*range_keys, *bin_range(F.col("_mn"), F.col("_mx")))
    if range_keys:
        rng = per_group(rng)
    joined = data.join(rng, range_keys) if range_keys else data.crossJoin(F.broadcast(rng))
    counts = (joined.select(*by, bin_index(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
              .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")))
    frame = rng
    if by and shared_range:  # one shared range (1 row, broadcast) for every group present
        frame = data.select(*by).distinct().crossJoin(F.broadcast(rng))
    return fill_bins(frame, counts, bins, by, density)


def bin_range(low: Column, high: Column) -> tuple[Column, Column]:
    """``_lo`` and ``_hi`` of a histogram: half a unit around a constant."""
    same = low == high
    return F.when(same, low - 0.5).otherwise(low).alias("_lo"), F.when(same, high + 0.5).otherwise(high).alias("_hi")


def fill_bins(frame: DataFrame, counts: DataFrame, bins: int, by: Sequence[str] = (), density: bool = False) -> DataFrame:
    """A histogram from its ranges (``*by, _lo, _hi``) and the counts of its filled bins (``*by, bin, n``)."""
    by = list(by)
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    all_bins = frame.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    all_bins = all_bins.select(*by, "bin",
                               _bin_edge(F.col("bin"), F.col("_lo"), F.col("_hi"), step, bins).alias("bin_lo"),
                               _bin_edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), step, bins).alias("bin_hi"))
    out = all_bins.join(counts, by + ["bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    if density:
        tot = counts.groupBy(*by).agg(F.sum("n").alias("_tot"))
        out = out.join(tot, by) if by else out.crossJoin(F.broadcast(tot))
        out = out.withColumn("density", F.try_divide(F.col("n").cast("double"),
                                                     F.col("_tot") * (F.col("bin_hi") - F.col("bin_lo")))).drop("_tot")
    return out


def box_stats(df: DataFrame, value: str | Column, by: Sequence[str], settings: Settings = DEFAULT,
              whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers (most extreme points within
    ``whisker`` x IQR of the box), outlier count."""
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    data = df.select(*by, v.cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    q = quantile_table(data, {"x": "_x"}, [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=by, settings=settings)
    q = q.drop("measure").withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("fence_lo", F.col("q1") - whisker * F.col("iqr")).withColumn(
        "fence_hi", F.col("q3") + whisker * F.col("iqr"))
    q = per_group(q)
    x = F.col("_x")
    agg = data.join(q, by).groupBy(*by).agg(
        F.min(F.when(x >= F.col("fence_lo"), x)).alias("_wlo"),
        F.max(F.when(x <= F.col("fence_hi"), x)).alias("_whi"),
        F.count_if((x < F.col("fence_lo")) | (x > F.col("fence_hi"))).alias("n_outliers"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    return q.join(agg, by).select(*by, "n", *box_columns())


def box_columns() -> list[Column | str]:
    """The box's columns from its quartiles and the most extreme values inside the fences (``_wlo``, ``_whi``)."""
    return ["min", "q1", "median", "q3", "max", "iqr",
            F.when(F.col("_wlo").isNull() | (F.col("_wlo") > F.col("q1")), F.col("q1")).otherwise(F.col("_wlo")).alias("whisker_lo"),
            F.when(F.col("_whi").isNull() | (F.col("_whi") < F.col("q3")), F.col("q3")).otherwise(F.col("_whi")).alias("whisker_hi"),
            "n_outliers"]


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation; a constant side gives null (no ANSI error)."""
    both = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    a2, b2 = F.when(both, a), F.when(both, b)
    den = F.sqrt(F.var_pop(a2) * F.var_pop(b2))
    return F.when(den > 0, F.try_divide(F.covar_pop(a2, b2), den))


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], digits: int = 6,
                      names: tuple[str, str] = ("col_a", "col_b"), width: int = 9) -> DataFrame:
    """Pearson correlation of each (a, b) pair.

    A few global aggregates of ``width`` pairs each: no row is multiplied, a scan
    reads just its pairs' columns, one row per task is shuffled, and each aggregate
    stays small enough for whole-stage codegen.
    """
    na, nb = names
    out = None
    for k in range(0, len(pairs), width):
        part = pairs[k:k + width]
        row = df.agg(*[F.round(pearson(F.col(a).cast("double"), F.col(b).cast("double")), digits).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        cells = row.select(F.inline(F.array(*[F.struct(F.lit(a).alias(na), F.lit(b).alias(nb), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(part)])))
        out = cells if out is None else out.unionAll(cells)
    return out


def corr_long(df: DataFrame, columns: Sequence[str], lower_only: bool = True, digits: int = 6) -> DataFrame:
    """All pairwise correlations as a long table (col_a, col_b, corr).

    ``lower_only`` keeps pairs below the diagonal (the masked heat-map's cells).
    """
    cols = list(columns)
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(len(cols))
             if (i > j if lower_only else i != j)]
    return pair_correlations(df, pairs, digits)


def corr_with(df: DataFrame, columns: Sequence[str], target: str, digits: int = 6) -> DataFrame:
    """Correlation of every column with ``target`` (feature, corr, abs_corr)."""
    out = pair_correlations(df, [(c, target) for c in columns], digits, names=("feature", "_t")).drop("_t")
    return out.withColumn("abs_corr", F.abs("corr"))


def null_count_expr(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Row completeness score: (1 - nulls/columns) * 100."""
    cols = list(columns or df.columns)
    return (F.lit(1.0) - null_count_expr(cols) / F.lit(float(len(cols)))) * F.lit(100.0)


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent per column in one aggregation pass (column_name, n_missing, missing_pct)."""
    cols = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in cols])
    out = row.select("_n", F.explode(cells).alias("c")).select("_n", "c.*")
    return out.select("column_name", "n_missing", X.pct(F.col("n_missing"), F.col("_n")).alias("missing_pct"))


def schema_type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per data type (metadata of the schema, not a scan of the data)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "data_type string, n_columns int")


def schema_kinds(df: DataFrame) -> DataFrame:
    """(kind, n_columns): how many columns hold numbers, text, dates or other values."""
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        name = f.dataType.typeName()
        number = name in ("byte", "short", "integer", "long", "float", "double", "decimal")
        kind = "number" if number else "text" if name == "string" else "date" if name in ("date", "timestamp", "timestamp_ntz") else "other"
        kinds[kind] = kinds.get(kind, 0) + 1
    return df.sparkSession.createDataFrame(sorted(kinds.items()), "kind string, n_columns int")
