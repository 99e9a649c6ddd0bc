"""Cohort operators (AGG-*, JN-*, SRT-*): value counts, success rates, top-k, shares,
containment matching of categories.

All of them are one ``groupBy`` (partial aggregation before the shuffle) or a
join against a table whose size is bounded by construction (top-k, bucket
labels); none collects data to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X


def is_concluded() -> Column:
    return F.col("success_category").isin("Success", "Failed")


def is_success() -> Column:
    return F.col("success_category") == "Success"


def is_failed() -> Column:
    return F.col("success_category") == "Failed"


def concluded(df: DataFrame) -> DataFrame:
    return df.where(is_concluded())


def value_counts(df: DataFrame, key: str | Column, name: str | None = None, top: int | None = None, order: str | None = None) -> DataFrame:
    """Counts per non-null key; ``top`` keeps the k largest, with their rank (count desc, key asc).

    ``order`` adds the row's ``position``, by ``count`` (desc, then key) or by ``key``:
    for keys of a few values only, as one task ranks them.
    """
    k = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "key")
    counts = df.where(k.isNotNull()).groupBy(k.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    if order:
        return in_order(counts, name, order)
    return top_k(counts, "n", name, top) if top else counts


def in_order(counts: DataFrame, name: str, order: str) -> DataFrame:
    """Counts (name, n) with their ``position``, by ``count`` or by ``key``; for a few values, as one task ranks them."""
    by = [F.col("n").desc(), F.col(name)] if order == "count" else [F.col(name)]
    return counts.withColumn("position", F.row_number().over(Window.orderBy(*by)))


def top_k(df: DataFrame, value: str, key: str, k: int, rank_name: str = "rank") -> DataFrame:
    """The k rows with the largest ``value`` (ties broken by ``key``), with their 1-based rank.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps its
    own k best rows, so only k rows per partition reach the final task.
    """
    best = df.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc()).limit(k)
    w = Window.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc())
    return best.withColumn(rank_name, F.row_number().over(w))  # window over <= k rows


def rate_by(df: DataFrame, keys: Sequence[str | Column], success: Column | None = None,
            min_n: int | None = None) -> DataFrame:
    """Per group: rows, successes and the success rate in percent (``n > min_n`` if given)."""
    success = is_success() if success is None else success
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("n_success"))
    out = out.withColumn("success_rate", X.pct(F.col("n_success"), F.col("n")))
    if min_n is not None:
        out = out.where(F.col("n") > min_n)
    return out


def bucket_labels(df: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """The bucket label table (label, order): a bounded constant used to emit empty buckets."""
    spark = df.sparkSession
    arr = F.array(*[F.lit(x) for x in labels])
    return (spark.range(len(labels)).select(F.element_at(arr, (F.col("id") + 1).cast("int")).alias(name),
                                            F.col("id").cast("int").alias("bucket_order")))


def rate_by_bucket(df: DataFrame, value: str | Column, bucket_def, name: str,
                   success: Column | None = None, keep_empty: bool = True) -> DataFrame:
    """Success rate per right-closed bucket of ``value``; empty buckets get a null rate.

    Rows outside every bucket (e.g. age 0 with a bucket starting at 0) drop out,
    as with ``pandas.cut``.
    """
    edges, labels, lowest = bucket_def
    success = is_success() if success is None else success
    v = F.col(value) if isinstance(value, str) else value
    b = df.select(X.bucketize(v, edges, labels, lowest).alias(name), success.alias("_s")).where(F.col(name).isNotNull())
    agg = b.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count_if("_s").alias("n_success"))
    if keep_empty:
        return all_buckets(agg, labels, name)
    agg = agg.withColumn("bucket_order", X.bucket_order(name, labels))
    return agg.withColumn("success_rate", X.pct(F.col("n_success"), F.col("n")))


def all_buckets(agg: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """Rates of every bucket label from (name, n, n_success); at most one row per label is broadcast."""
    out = bucket_labels(agg, labels, name).join(F.broadcast(agg), name, "left")
    out = out.select(name, "bucket_order", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_success", F.lit(0)).alias("n_success"))
    return out.withColumn("success_rate", X.pct(F.col("n_success"), F.col("n")))


def shares(counts: DataFrame, n_col: str, total: Column) -> DataFrame:
    """Add ``share`` = n / total (total is a column of a broadcast one-row table)."""
    return counts.withColumn("share", X.ratio(F.col(n_col), total))


def explode_categories(df: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """One row per (venture, category item); a repeated item counts twice."""
    return df.where(F.col("category_list").isNotNull()).select(
        *cols, F.explode(F.transform(F.split("category_list", r"\|"), lambda x: X.strip(x))).alias("category"))


def category_lists(df: DataFrame, *keys: Column) -> DataFrame:
    """Counts and sums of every distinct category list: what category panels need of the detail rows.

    Columns: ``category_list, *keys, n, n_concluded, n_success, n_amounts, amount``.
    """
    amount = F.col("funding_total_usd")
    return df.where(F.col("category_list").isNotNull()).groupBy("category_list", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_concluded()).alias("n_concluded"), F.count_if(is_success()).alias("n_success"),
        F.count(amount).alias("n_amounts"), F.sum(amount).alias("amount"))


def category_counts(lists: DataFrame) -> DataFrame:
    """(category, n) from distinct lists: an item that a list repeats counts twice, as in the detail rows."""
    return explode_categories(lists, ["n"]).groupBy("category").agg(F.sum("n").alias("n"))


def match_categories(df: DataFrame, cats: DataFrame, mode: str = "substring", cat_col: str = "category") -> DataFrame:
    """Pair ventures with the categories they belong to.

    ``substring``: the category text occurs anywhere in the venture's list (the
    original behaviour; 'Software' also hits 'Enterprise Software').  ``regex``:
    the category is used as a regular expression.  ``token``: exact item match
    via explode + equi-join.  ``cats`` must be small (a top-k table): it is
    broadcast and the containment join is a broadcast nested-loop join, linear in
    the venture rows.
    """
    cats = F.broadcast(cats)
    if mode == "token":
        items = df.select("*", F.explode(F.array_distinct(F.split("category_list", r"\|"))).alias("_item"))
        return items.join(cats, F.col("_item") == cats[cat_col]).drop("_item")
    if mode == "regex":
        cond = F.expr(f"category_list rlike {cat_col}")
    else:
        cond = F.col("category_list").contains(cats[cat_col])
    return df.join(cats, cond & F.col("category_list").isNotNull())
