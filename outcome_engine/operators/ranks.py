"""Distributed running sums over an ordered value (the building block of ranks, ROC/PR
curves, AUC and exact stratified splits).

A window ``sum(...) over (partition by group order by value)`` puts a whole group
on one task.  Here the ordered values are cut into blocks (cut points from a
``percentile_approx`` sketch, or from a value prefix when values are uniform
hashes); block totals get a running sum over at most ``blocks`` rows, and rows
get a running sum inside their block only.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..session import per_group
from .quantiles import block_of


def cumulative_before(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                      settings: Settings = DEFAULT, block: Column | None = None,
                      inclusive: bool = False) -> DataFrame:
    """For each row, add ``<s>_before``: the sum of ``s`` over rows of the same ``keys``
    with a smaller ``value`` (``inclusive``: smaller or equal and earlier in order).

    ``df`` should hold one row per distinct (keys, value) for exact tie handling
    (pre-aggregate first).  ``block`` may give a monotone block id directly
    (e.g. a hash prefix); otherwise cut points come from a sketch per group.
    """
    keys = list(keys)
    if block is None:
        nb = max(int(settings.quantile_blocks), 1)
        fracs = [i / nb for i in range(1, nb)]
        cuts = df.groupBy(*keys).agg(
            (F.percentile_approx(value, fracs, settings.approx_accuracy) if fracs
             else F.array().cast("array<double>")).alias("_cuts"))
        cuts = per_group(cuts) if keys else F.broadcast(cuts)
        base = (df.join(cuts, keys) if keys else df.crossJoin(cuts))
        base = base.withColumn("_blk", block_of(F.col("_cuts"), F.col(value), len(fracs))).drop("_cuts")
    else:
        base = df.withColumn("_blk", block)
    totals = base.groupBy(*keys, "_blk").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_blk", *[F.coalesce(F.sum(f"_t_{s}").over(prev), F.lit(0)).alias(f"_o_{s}")
                                             for s in sums])
    if not keys:
        offsets = F.broadcast(offsets)
    end = Window.currentRow if inclusive else -1
    within = Window.partitionBy(*keys, "_blk").orderBy(value).rowsBetween(Window.unboundedPreceding, end)
    out = base.join(offsets, keys + ["_blk"])
    return out.select(*[c for c in out.columns if not c.startswith("_o_") and c != "_blk"],
                      *[(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0))).alias(f"{s}_before")
                        for s in sums])
