"""Nearest-neighbour imputation (PRP-01): an exact k-nearest-neighbour join.

A null is replaced by the mean of that column over the ``k`` nearest donors that
have it.  The distance of two rows counts the columns that both have, scaled up to
all columns: ``sqrt(columns / common * sum of squared differences)``.  Ties go to
the smaller donor id.  Without any donor at a known distance the donors' mean of
the column is taken, and without any value the null stays.

Comparing every receiver with every donor would be a cross join.  Instead:

1. Rows are grouped by their mask of present columns.  Inside a pair of masks the
   common columns are fixed, so the distance is a metric there: a *space*.
2. In each space the donors are reduced to the ``k`` smallest ids of every
   distinct point, which is all that ties allow; a value that a third of the
   donors share is no hot spot.  Receivers with equal values are one receiver.
3. Each donor belongs to its nearest pivot and to a ring around it.  Pivots are a
   bounded sample; which ones they are changes the cost, never the result.
4. A receiver first searches the ring it falls into.  The distance of the k-th
   neighbour there bounds its search: by the triangle inequality only rings whose
   range of pivot distances meets that radius can hold nearer donors, and only
   those are visited.  Receivers travel, not donors.  Rings with many visitors are
   copied and their visitors salted.
5. The neighbours of all spaces meet per receiver and column, and the k nearest
   give the mean.

Distances are summed in numpy, as a heap per receiver has no built-in form that
would not first emit every pair.  What reaches the driver: the masks (at most two to the
number of columns that have nulls), ``Layout.pivots`` points and their rings' ranges a space.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CELLS = 1 << 21  # distances held at once


@dataclass(frozen=True)
class Layout:
    """How the donors are cut up; it changes the cost and never the result."""
    pivots: int = 64
    rings: int = 64          # around a pivot, at most
    ring_rows: int = 4096    # fewer rings where a space has few donors
    visitors: int = 1 << 16  # of a ring in one task

    def block(self, space, pivot, ring):
        return (space * self.pivots + pivot) * self.rings + ring


@dataclass
class _Space:
    """Donors with the mask ``donor``, compared on the columns of ``common``."""
    donor: int
    common: int
    columns: list[int]
    pivots: np.ndarray | None = None                       # points, one a row
    edges: list[np.ndarray] = field(default_factory=list)  # per pivot: upper ends of its rings but the last
    rings: np.ndarray | None = None                        # rows (pivot, ring, least, greatest distance, donors)

    def to_pivots(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(_squares(rows, self.pivots, self.columns))


def _squares(a: np.ndarray, b: np.ndarray, columns: list[int]) -> np.ndarray:
    """Sums of squared differences of all pairs, column by column in their order."""
    out = np.zeros((len(a), len(b)))
    for c in columns:
        d = a[:, c, None] - b[None, :, c]
        out += d * d
    return out


def _bits(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def _mask(columns: Sequence[str]):
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out + F.when(F.col(c).isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def _numbers(df: DataFrame, columns: Sequence[str], *keep) -> DataFrame:
    """The columns as doubles under short names, NaN as null."""
    value = lambda c: F.col(c).cast("double")
    return df.select(*keep, *[F.when(~F.isnan(value(c)), value(c)).alias(f"x{i}") for i, c in enumerate(columns)])


def _matrix(batch: pa.RecordBatch | pa.Table, n: int) -> np.ndarray:
    return np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
                     else batch.column(f"x{i}").to_numpy() for i in range(n)], 1) if n else np.zeros((batch.num_rows, 0))


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    space = batch.column("space").to_numpy(zero_copy_only=False)
    for s in np.unique(space):
        yield int(s), np.flatnonzero(space == s)


@dataclass
class KnnImputer:
    """Fitted on donors: their stored rows (``id``, ``mask``, ``x0`` ...) and column means."""

    donors: DataFrame
    columns: tuple[str, ...]
    means: dict[str, float | None]
    k: int = 5
    layout: Layout = Layout()

    def save(self, path: str) -> None:
        self.donors.write.mode("overwrite").parquet(f"{path}/donors")
        spark = self.donors.sparkSession
        meta = json.dumps({"columns": list(self.columns), "means": self.means, "k": self.k})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/imputer")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnnImputer:
        meta = json.loads(spark.read.parquet(f"{path}/imputer").first()["meta"])
        return cls(spark.read.parquet(f"{path}/donors"), tuple(meta["columns"]), meta["means"], meta["k"])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the nulls (and NaN) of the fitted columns filled; these columns become doubles."""
        own = [f"__x{i}" for i in range(len(self.columns))]
        value = lambda c: F.col(c).cast("double")
        df = df.withColumns({o: F.when(~F.isnan(value(c)), value(c)) for o, c in zip(own, self.columns)})
        lacking = " OR ".join(f"{o} IS NULL" for o in own)
        receivers = df.where(lacking).select(*[F.col(o).alias(f"x{i}") for i, o in enumerate(own)]).distinct()
        names = [f"x{i}" for i in range(len(own))]
        receivers = cut_lineage(receivers.withColumn("rid", F.monotonically_increasing_id()).withColumn("mask", _mask(names)))
        filled = self._filled(receivers)
        # one row per distinct receiver; dealt out anew so that a hot one's rows can be split between tasks
        given = receivers.join(filled, "rid", "left").select(*[F.col(f"x{i}").alias(f"__r{i}") for i in range(len(own))],
                                                             *[F.col(f"f{i}").alias(f"__f{i}") for i in range(len(own))]).hint("rebalance")
        same = None
        for i, o in enumerate(own):
            one = F.col(o).eqNullSafe(F.col(f"__r{i}"))
            same = one if same is None else same & one
        out = df.join(given, same, "left")
        done = {c: F.coalesce(F.col(o), F.col(f"__f{i}"), F.lit(self.means[c]).cast("double"))
                for i, (o, c) in enumerate(zip(own, self.columns))}
        return out.select(*[done[c].alias(c) if c in done else F.col(c) for c in df.columns if c not in own])

    # --- the neighbour join ---------------------------------------------------------------------------------

    def _spaces(self, receivers: DataFrame) -> tuple[list[_Space], list[tuple[int, int]]]:
        """Spaces of the pairs of masks that can help each other, and (receiver mask, space) of each."""
        have = [r["mask"] for r in self.donors.select("mask").distinct().collect()]
        want = [r["mask"] for r in receivers.select("mask").distinct().collect()]
        spaces: dict[tuple[int, int], int] = {}
        pairs = []
        for r in sorted(want):
            for d in sorted(have):
                if r & d and d & ~r:
                    pairs.append((r, spaces.setdefault((d, r & d), len(spaces))))
        return [_Space(d, s, _bits(s)) for d, s in spaces], pairs

    def _points(self, spaces: list[_Space]) -> DataFrame:
        """(space, id, x...) of the donors that can be neighbours: the k smallest ids of each distinct point."""
        spark, n = self.donors.sparkSession, len(self.columns)
        table = spark.createDataFrame([(s.donor, i, s.common) for i, s in enumerate(spaces)], "mask long, space int, common long")
        at = self.donors.join(F.broadcast(table), "mask")
        point = [F.when(F.col("common").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col(f"x{i}")) for i in range(n)]
        first = F.row_number().over(Window.partitionBy("space", *point).orderBy("id", *[f"x{i}" for i in range(n)]))
        return cut_lineage(at.withColumn("_n", first).where(F.col("_n") <= self.k).select("space", "id", *[f"x{i}" for i in range(n)]))

    def _rings(self, points: DataFrame, spaces: list[_Space]) -> DataFrame:
        """Points with their block (space, pivot and ring as one number); fills in the spaces' pivots and rings."""
        n, lay = len(self.columns), self.layout
        names = [f"x{i}" for i in range(n)]
        drawn = points.withColumn("_n", F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("id"), "id"))).where(F.col("_n") <= lay.pivots)
        rows = drawn.select("space", *names).collect()  # at most so many a space
        for i, s in enumerate(spaces):
            mine = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in rows if r["space"] == i]).reshape(-1, n)
            _, one = np.unique(mine[:, s.columns], axis=0, return_index=True)
            s.pivots = mine[np.sort(one)]

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s, at in _split(batch):
                    part = batch.take(pa.array(at))
                    d = spaces[s].to_pivots(_matrix(part, n))
                    pivot = d.argmin(1)
                    near = d[np.arange(len(at)), pivot]
                    edges = spaces[s].edges
                    ring = np.array([np.searchsorted(edges[p], x) if edges else 0 for p, x in zip(pivot, near)], np.int64)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lay.block(s, pivot, ring)), pa.array(near)],
                                                     [*part.schema.names, "block", "near"])

        schema = f"space int, id long, {', '.join(f'{c} double' for c in names)}, block long, near double"
        cuts = [i / lay.rings for i in range(1, lay.rings)] or [1.0]
        found = points.mapInArrow(nearest, schema).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("near", cuts, 10000).alias("cuts"))
        edges = {r["block"] // lay.rings: (r["n"], r["cuts"]) for r in found.collect()}
        for i, s in enumerate(spaces):
            for p in range(len(s.pivots)):
                size, ends = edges.get(i * lay.pivots + p, (0, []))
                step = lay.rings // max(1, min(lay.rings, size // lay.ring_rows))
                s.edges.append(np.unique(np.array(ends[step - 1::step])))
        placed = cut_lineage(points.mapInArrow(nearest, schema))
        stats = placed.groupBy("block").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        by_space: dict[int, list] = {}
        for r in sorted(stats, key=lambda r: r["block"]):
            by_space.setdefault(r["block"] // (lay.pivots * lay.rings), []).append((r["block"] // lay.rings % lay.pivots, r["block"] % lay.rings, r["lo"], r["hi"], r["n"]))
        for i, s in enumerate(spaces):
            s.rings = np.array(by_space.get(i, []), np.float64).reshape(-1, 5)
        return placed

    def _search(self, visits: DataFrame, placed: DataFrame, spaces: list[_Space]) -> DataFrame:
        """The k nearest donors of each visitor in the block it visits, none beyond its ``limit``."""
        spark, n, k = visits.sparkSession, len(self.columns), self.k
        sizes = visits.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()  # the rings
        salts = spark.createDataFrame([(r["block"], -(-r["n"] // self.layout.visitors)) for r in sizes], "block long, salts int")
        left = visits.join(F.broadcast(salts), "block").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int")).drop("salts")
        right = placed.join(F.broadcast(salts), "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "near")

        def search(visitors: pa.Table, donors: pa.Table) -> pa.Table:
            if not visitors.num_rows or not donors.num_rows:
                return _neighbours([], [], [], [], n)
            space = visitors.column("space")[0].as_py()
            columns = spaces[space].columns
            a, b = _matrix(visitors, n), _matrix(donors, n)
            ids, rid, limit = donors.column("id").to_numpy(), visitors.column("rid").to_numpy(), visitors.column("limit").to_numpy()
            found = []
            for at in range(0, len(a), max(1, CELLS // len(b))):
                stop = min(len(a), at + max(1, CELLS // len(b)))
                d = _squares(a[at:stop], b, columns) * n / len(columns)
                most = np.minimum(limit[at:stop], np.partition(d, k - 1, axis=1)[:, k - 1] if len(b) > k else np.inf)
                row, col = np.nonzero(d <= most[:, None])
                order = np.lexsort((ids[col], d[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[rank < k], col[rank < k]
                found.append((row + at, col, d[row, col]))
            row, col, d = (np.concatenate(x) for x in zip(*found))
            return _neighbours(rid[row], np.full(len(row), space), ids[col], d, n, b[col])

        return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(
            search, f"rid long, space int, id long, d double, {', '.join(f'x{i} double' for i in range(n))}")

    def _filled(self, receivers: DataFrame) -> DataFrame:
        """(rid, f0, f1, ...): the mean of the nearest donors for each column that the receiver lacks."""
        spark, n, k, lay = receivers.sparkSession, len(self.columns), self.k, self.layout
        names = [f"x{i}" for i in range(n)]
        spaces, pairs = self._spaces(receivers)
        if not pairs:
            return spark.createDataFrame([], "rid long, " + ", ".join(f"f{i} double" for i in range(n)))
        points = self._points(spaces)
        placed = self._rings(points, spaces)
        asked = receivers.join(F.broadcast(spark.createDataFrame(pairs, "mask long, space int")), "mask").select("space", "rid", *names)

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The ring of the nearest pivot that the receiver falls into, or the next one that holds donors."""
            for batch in batches:
                for s, at in _split(batch):
                    space, part = spaces[s], batch.take(pa.array(at))
                    d = space.to_pivots(_matrix(part, n))
                    pivot = d.argmin(1)
                    gap = np.maximum(space.rings[:, 2] - d[np.arange(len(at)), pivot][:, None], d[np.arange(len(at)), pivot][:, None] - space.rings[:, 3])
                    gap[space.rings[:, 0] != pivot[:, None]] = np.inf
                    block = _block(lay, s, space.rings, gap.argmin(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block), pa.array(np.full(len(at), np.inf))], [*part.schema.names, "block", "limit"])

        visit = f"space int, rid long, {', '.join(f'{c} double' for c in names)}, block long, limit double"
        first = cut_lineage(self._search(asked.mapInArrow(home, visit), placed, spaces))
        reach = first.groupBy("rid", "space").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("limit"))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """All other rings that the radius of the k-th neighbour so far meets."""
            for whole in batches:
                for begin in range(0, whole.num_rows, 1024):
                    batch = whole.slice(begin, 1024)
                    for s, at in _split(batch):
                        space, part = spaces[s], batch.take(pa.array(at))
                        rings, rows = space.rings, np.arange(len(at))
                        d = space.to_pivots(_matrix(part, n))
                        limit = part.column("limit").to_numpy(zero_copy_only=False).astype(np.float64)
                        limit = np.where(np.isnan(limit), np.inf, limit)
                        radius = np.sqrt(limit * len(space.columns) / n)
                        radius = np.minimum(radius, _upper(d, rings, k))
                        near = d[:, rings[:, 0].astype(int)]
                        gap = np.maximum(rings[:, 2] - near, near - rings[:, 3])
                        meets = gap <= (radius + 1e-9 * (radius + near.max(1)))[:, None]  # rounding may only add visits
                        pivot = d.argmin(1)
                        own = np.where(rings[:, 0] == pivot[:, None], gap, np.inf).argmin(1)
                        meets[rows, own] = False
                        row, ring = np.nonzero(meets)
                        columns = [part.column(c).take(pa.array(row)) for c in ("space", "rid", *names)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(_block(lay, s, rings, ring)), pa.array(limit[row])],
                                                         ["space", "rid", *names, "block", "limit"])

        second = self._search(cut_lineage(asked.join(reach, ["rid", "space"], "left").select("space", "rid", *names, "limit").mapInArrow(others, visit)),
                              placed, spaces)
        every = first.unionByName(second).join(receivers.select("rid", "mask"), "rid")
        offers = F.filter(F.array(*[F.when((F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) == 0) & F.col(c).isNotNull(),
                                           F.struct(F.lit(i).alias("c"), F.col(c).alias("v"))) for i, c in enumerate(names)]), lambda o: o.isNotNull())
        cells = every.select("rid", "id", "d", F.explode(offers).alias("o")).select("rid", "id", "d", "o.c", "o.v")
        rank = F.row_number().over(Window.partitionBy("rid", "c").orderBy("d", "id", "v"))
        near = cells.withColumn("_n", rank).where(F.col("_n") <= k)
        # summed in the order of their ranks, so that the last digits do not depend on the plan
        ranked = near.groupBy("rid", "c").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("_n") == j, F.col("v"))).alias(f"v{j}") for j in range(1, k + 1)])
        total = reduce(lambda a, b: a + b, [F.coalesce(f"v{j}", F.lit(0.0)) for j in range(1, k + 1)])
        means = ranked.select("rid", "c", (total / F.col("n")).alias("v"))
        return means.groupBy("rid").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"f{i}") for i in range(n)])


def _block(layout: Layout, space: int, rings: np.ndarray, at: np.ndarray) -> np.ndarray:
    return layout.block(space, rings[at, 0].astype(np.int64), rings[at, 1].astype(np.int64))


def _upper(d: np.ndarray, rings: np.ndarray, k: int) -> np.ndarray:
    """A radius that holds k donors for sure: those within a pivot's first rings lie no farther than to the pivot and out to the ring's edge."""
    out = np.full(len(d), np.inf)
    for p in np.unique(rings[:, 0]):
        mine = rings[rings[:, 0] == p]
        enough = np.flatnonzero(np.cumsum(mine[:, 4]) >= k)
        if len(enough):
            out = np.minimum(out, d[:, int(p)] + mine[:enough[0] + 1, 3].max())
    return out


def _neighbours(rid, space, ids, d, n: int, rows: np.ndarray | None = None) -> pa.Table:
    rows = np.zeros((0, n)) if rows is None else rows
    values = [pa.array(rows[:, i], from_pandas=True) for i in range(n)]  # NaN is a null
    return pa.table([pa.array(rid, pa.int64()), pa.array(space, pa.int32()), pa.array(ids, pa.int64()), pa.array(d, pa.float64()),
                     *[v.cast(pa.float64()) for v in values]], ["rid", "space", "id", "d", *[f"x{i}" for i in range(n)]])


def fit_knn(donors: DataFrame, columns: Sequence[str], id_col: str = "venture_id", k: int = 5, layout: Layout = Layout()) -> KnnImputer:
    """Store the donors' columns and their means.  A null id counts as the largest."""
    if not 0 < len(columns) < 63 or k < 1:
        raise ValueError("one to 62 columns and at least one neighbour")
    rows = _numbers(donors, columns, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    names = [f"x{i}" for i in range(len(columns))]
    rows = cut_lineage(rows.withColumn("mask", _mask(names)).where("mask <> 0"))
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    return KnnImputer(rows, tuple(columns), {c: means[f"x{i}"] for i, c in enumerate(columns)}, k, layout)
