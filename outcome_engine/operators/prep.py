"""Model preparation (PRP-*): exact stratified split and folds, robust scaling.

The split ranks rows inside each class by ``md5(seed || '-' || id)``; the first
``round(test_fraction * n_class)`` of a class form the test set and the training
rows get folds by rank.  md5 digests are uniform, so their hex prefix is a
balanced monotone block id for the distributed running count (no single task
per class).  The same definition runs in SQL, so the split is checked exactly.

Nearest-neighbour imputation is in ``impute``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .quantiles import quantile_row
from .ranks import cumulative_before


def hash_key(id_col: str, seed: int):
    return F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, label: str = "target", id_col: str = "venture_id", test_fraction: float = 0.2,
                     n_folds: int = 5, settings: Settings = DEFAULT, prefix_len: int = 3) -> DataFrame:
    """Add ``is_test`` (0/1) and ``fold`` (0..n_folds-1 for training rows, null for test rows)."""
    keyed = df.withColumn("_h", hash_key(id_col, settings.seed))
    ranked = cumulative_before(keyed.withColumn("_one", F.lit(1)), [label], "_h", ["_one"], settings,
                               block=F.substring("_h", 1, prefix_len), inclusive=True)
    sizes = keyed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    sizes = sizes.withColumn("_k", F.floor(F.col("_n") * F.lit(test_fraction) + F.lit(0.5)))
    out = ranked.join(F.broadcast(sizes), label)
    rank = F.col("_one_before")
    is_test = (rank <= F.col("_k")).cast("int")
    fold = F.when(is_test == 0, F.pmod(rank - F.col("_k") - 1, F.lit(n_folds)).cast("int"))
    return out.select(*[c for c in df.columns], is_test.alias("is_test"), fold.alias("fold"))


def fit_robust_scaler(df: DataFrame, features: Sequence[str], settings: Settings = DEFAULT) -> DataFrame:
    """One row: median and interquartile range of every feature (``<f>__med``, ``<f>__q1``, ``<f>__q3``)."""
    return quantile_row(df, {f: f for f in features}, [0.25, 0.5, 0.75], ["q1", "med", "q3"], settings=settings)


def scaler_values(scaler: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """feature -> (center, scale) from the stored one-row scaler (bounded: two numbers per feature)."""
    row = scaler.first().asDict()
    out = {}
    for f in features:
        q1, med, q3 = row.get(f"{f}__q1"), row.get(f"{f}__med"), row.get(f"{f}__q3")
        iqr = None if q1 is None or q3 is None else q3 - q1
        out[f] = (0.0 if med is None else med, 1.0 if iqr is None or abs(iqr) < 1e-12 else iqr)
    return out


def robust_scale(df: DataFrame, scaler: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(x - median) / IQR, with an IQR of 0 (or unknown) treated as 1 (fitted values as literals)."""
    vals = scaler_values(scaler, features)
    cols = [((F.col(f) - F.lit(vals[f][0])) / F.lit(vals[f][1])).alias(f) for f in features]
    return df.select(*keep, *cols)


def scaler_table(scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """The fitted scaler as a long table (feature, center, scale), by the rule of ``scaler_values``."""
    vals = scaler_values(scaler, features)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__med").alias("center"),
                               F.lit(vals[f][1]).alias("scale")) for f in features])
    return scaler.select(F.explode(cells).alias("c")).select("c.*")
