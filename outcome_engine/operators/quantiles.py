"""Exact and approximate quantiles that stay distributed.

Spark's exact ``percentile`` merges a value->count map of the whole group on one
task, which does not hold for a column with billions of distinct values.  The
exact mode here is a distributed multi-select.  Every wanted rank lies in a
segment of the values, at first the whole group:

1. a ``percentile_approx`` sketch (bounded memory, mergeable) gives cut points of
   each segment,
2. one aggregation counts the values between the cut points, and those equal to
   one.  A rank that falls on a cut point is settled: a hot value never has to be
   sorted.  A rank between two of them has a segment that is smaller by about the
   number of cut points,
3. segments of at most ``Settings.select_rows`` rows are ranked, one task each; for
   the others the two steps are repeated on their rows alone.

So the rows that any task sorts are bounded by a number and not by a share of the
table, and all other values are only counted.  The two values around rank
``p*(n-1)`` are interpolated linearly, the definition used by pandas/numpy and
DuckDB's ``quantile_cont``.

The approximate mode is ``percentile_approx`` with a configurable accuracy.
Several columns are handled in one pass by unpivoting them into
``(measure, value)`` and grouping by the measure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..session import cut_lineage, per_group


def _long(df: DataFrame, values: Mapping[str, Column | str], by: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(m).alias("_m"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_v"))
             for m, v in values.items()]
    if len(items) == 1:
        m = next(iter(values))
        v = values[m]
        out = df.select(*by, F.lit(m).alias("_m"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_v"))
    else:
        out = df.select(*by, F.explode(F.array(*items)).alias("_s")).select(*by, "_s._m", "_s._v")
    return out.where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def block_of(cuts: Column, v: Column, n_cuts: int) -> Column:
    """Number of cut points strictly below ``v`` (cuts sorted ascending), by binary search.

    ``ceil(log2(n_cuts + 1))`` steps of an ``aggregate`` over a short sequence, so
    thousands of blocks cost a dozen comparisons per value, not thousands.
    """
    steps = max(1, (n_cuts + 1).bit_length())
    init = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        right = F.element_at(cuts, mid + 1) < v
        moved = F.when(right, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(
            F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo < hi, moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def _lerp(a: Column, b: Column, t: Column) -> Column:
    return F.when(t == 0, a).otherwise(a + (b - a) * t)


def quantile_table(df: DataFrame, values: Mapping[str, Column | str], probs: Sequence[float],
                   names: Sequence[str], by: Sequence[str] = (), settings: Settings = DEFAULT, rows: int | None = None) -> DataFrame:
    """One row per (group..., measure) with one column per probability.

    ``rows`` saves counting the table, if it is known to have at most so many rows.

    Columns: ``*by, measure, n, <names...>``.  Nulls and NaN are ignored; a group
    with no values and a null group produce no row.
    """
    by = list(by)
    keys = by + ["_m"]
    long = _long(df, values, by)
    for c in by:
        long = long.where(F.col(c).isNotNull())
    if settings.quantile_mode == "approx":
        acc = settings.approx_accuracy
        out = long.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.percentile_approx("_v", float(p), acc).cast("double").alias(nm) for p, nm in zip(probs, names)])
        return out.withColumnRenamed("_m", "measure")

    # the rows of the table bound those of any group, and counting them reads no column
    if (df.count() if rows is None else rows) * len(values) <= settings.select_rows:
        found = _rank_all(long, keys, probs)
    else:
        sizes = per_group(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
        found = multi_select(long, keys, sizes, probs, settings)
    picked = found.groupBy(*keys).agg(F.max("_n").alias("n"), *[
        F.max(F.when(F.array_contains("_at", k), F.col("_v"))).alias(f"_{side}{i}")
        for i in range(len(probs)) for side, k in (("a", 2 * i), ("b", 2 * i + 1))])
    outs = []
    for k, (p, nm) in enumerate(zip(probs, names)):
        pos = (F.col("n") - 1).cast("double") * F.lit(float(p))
        outs.append(_lerp(F.col(f"_a{k}"), F.col(f"_b{k}"), pos - F.floor(pos)).alias(nm))
    return picked.select(*by, F.col("_m").alias("measure"), "n", *outs)


def _wanted(n: Column, probs: Sequence[float]) -> Column:
    """The ranks (from 0) around every probability, two for each: floor and ceiling of ``p * (n - 1)``."""
    pos = [(n - 1).cast("double") * F.lit(float(p)) for p in probs]
    return F.array(*[f(x).cast("long") for x in pos for f in (F.floor, F.ceil)])


def _places(ranks: Column, low: Column, high: Column) -> Column:
    """Which of the wanted ranks lie in [low, high): their places in the list."""
    at = F.transform(ranks, lambda r, i: F.when((r >= low) & (r < high), i))
    return F.filter(at, lambda i: i.isNotNull())


def _ranked(counts: DataFrame, keys: Sequence[str], n: Column, ranks: Column, before: Column) -> DataFrame:
    """(keys, _n, _v, _at) of the values that hold wanted ranks; sorts each key's distinct values in one task."""
    running = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = counts.withColumn("_hi", before + F.sum("_c").over(running)).withColumn("_n", n)
    return up_to.withColumn("_at", _places(ranks, F.col("_hi") - F.col("_c"), F.col("_hi"))).where(F.size("_at") > 0)


def _rank_all(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """For tables of at most ``select_rows`` values: all are ranked at once."""
    counts = long.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c").over(Window.partitionBy(*keys))
    return _ranked(counts, keys, n, _wanted(F.col("_n"), probs), F.lit(0)).select(*keys, "_n", "_v", "_at")


def _inside(long: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values that lie in a segment (both ends open, null is none), beside its columns."""
    v = F.col("_v")
    hit = (F.col("_lo").isNull() | (v > F.col("_lo"))) & (F.col("_hi").isNull() | (v < F.col("_hi")))
    return long.join(per_group(segments), list(keys)).where(hit)


def multi_select(long: DataFrame, keys: Sequence[str], sizes: DataFrame, probs: Sequence[float], settings: Settings) -> DataFrame:
    """(keys, _n, _v, _at): the values at the wanted ranks, each with the places it has among them.

    ``long`` has the keys and ``_v``, ``sizes`` the rows of each key.
    """
    keys = list(keys)
    cuts_wanted = [i / max(2, settings.quantile_blocks) for i in range(1, max(2, settings.quantile_blocks))]
    none = F.lit(None).cast("double")
    open_ = cut_lineage(sizes.select(*keys, "_n", F.lit(0).alias("_s"), none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_before"),
                                     F.col("_n").alias("_rows"), _wanted(F.col("_n"), probs).alias("_ranks")))
    found, small = [], []
    while True:
        small.append(open_.where(F.col("_rows") <= settings.select_rows))
        open_ = open_.where(F.col("_rows") > settings.select_rows)
        if open_.isEmpty():
            break
        part = [*keys, "_s"]
        cuts = _inside(long, open_.select(*part, "_lo", "_hi"), keys).groupBy(*part).agg(
            F.array_sort(F.array_distinct(F.percentile_approx("_v", cuts_wanted, settings.approx_accuracy))).alias("_cuts"))
        open_ = cut_lineage(open_.join(cuts, part))
        # an even block lies between two cut points, an odd one is the cut point itself
        below = block_of(F.col("_cuts"), F.col("_v"), len(cuts_wanted))
        on = F.coalesce(F.try_element_at("_cuts", F.col("_b") + 1) == F.col("_v"), F.lit(False)).cast("int")
        counted = _inside(long, open_.select(*part, "_lo", "_hi", "_cuts"), keys).withColumn("_b", below) \
            .groupBy(*part, (F.col("_b") * 2 + on).alias("_block")).agg(F.count(F.lit(1)).alias("_c"))
        running = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        blocks = counted.join(open_, part).withColumn("_end", F.col("_before") + F.sum("_c").over(running))  # the blocks of a segment
        blocks = blocks.withColumn("_at", _places(F.col("_ranks"), F.col("_end") - F.col("_c"), F.col("_end"))).where(F.size("_at") > 0)
        blocks = cut_lineage(blocks)
        left = F.expr("_block div 2").cast("int")
        found.append(blocks.where("_block % 2 = 1").select(*keys, "_n", F.element_at("_cuts", left + 1).alias("_v"), "_at"))
        edge = lambda i, old: F.coalesce(F.try_element_at("_cuts", F.when(i > 0, i)), F.col(old)).alias(old)
        open_ = cut_lineage(blocks.where("_block % 2 = 0").select(
            *keys, "_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_s", "_block")).alias("_s"), edge(left, "_lo"), edge(left + 1, "_hi"),
            (F.col("_end") - F.col("_c")).alias("_before"), F.col("_c").alias("_rows"), "_ranks"))
    part = [*keys, "_s"]
    for segments in small:
        values = _inside(long, segments.select(*part, "_lo", "_hi"), keys).groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_c"))
        counts = values.join(per_group(segments.select(*part, "_n", "_before", "_ranks")), part)
        found.append(_ranked(counts, part, F.col("_n"), F.col("_ranks"), F.col("_before")).select(*keys, "_n", "_v", "_at"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def quantile_row(df: DataFrame, values: Mapping[str, Column | str], probs: Sequence[float],
                 names: Sequence[str], settings: Settings = DEFAULT) -> DataFrame:
    """A single row with columns ``<measure>__<name>``; all-null measures give null.

    The row is computed now and checkpointed (reliably, into the shared
    checkpoint folder): later plans reference one stored row instead of
    re-planning the whole input lineage, and it survives executor loss.  It
    has exactly one row, so callers broadcast it.
    """
    table = quantile_table(df, values, probs, names, settings=settings)
    cols = []
    for m in values:
        for nm in names:
            cols.append(F.max(F.when(F.col("measure") == m, F.col(nm))).alias(f"{m}__{nm}"))
    return cut_lineage(table.agg(*cols))


def grouped_quantiles(df: DataFrame, value: Column | str, probs: Sequence[float], names: Sequence[str],
                      by: Sequence[str], settings: Settings = DEFAULT) -> DataFrame:
    """Quantiles of one value per group: columns ``*by, n, <names...>``."""
    t = quantile_table(df, {"v": value}, probs, names, by=by, settings=settings)
    return t.drop("measure")


def bounded_quantile_row(df: DataFrame, values: Mapping[str, Column | str], probs: Sequence[float],
                         names: Sequence[str]) -> DataFrame:
    """Quantiles of a table whose size is bounded by construction (a top-k table).

    Same definition as ``quantile_row``; the whole (bounded) table is ranked with
    one window, which is only acceptable because it holds at most k rows.
    """
    out = []
    for m, v in values.items():
        col = (F.col(v) if isinstance(v, str) else v).cast("double")
        ranked = (df.select(col.alias("_v")).where(F.col("_v").isNotNull())
                  .withColumn("_r", F.row_number().over(Window.orderBy("_v")) - 1)
                  .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
        aggs = []
        for p, nm in zip(probs, names):
            pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
            a = F.max(F.when(F.col("_r") == F.floor(pos), F.col("_v")))
            b = F.max(F.when(F.col("_r") == F.ceil(pos), F.col("_v")))
            t = F.max(pos - F.floor(pos))
            aggs.append(_lerp(a, b, t).alias(f"{m}__{nm}"))
        out.append(ranked.agg(*aggs))
    row = out[0]
    for o in out[1:]:
        row = row.crossJoin(o)
    return row
