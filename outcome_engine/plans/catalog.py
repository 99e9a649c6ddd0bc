"""The query catalog: every registered query, built from the driver's tables.

Each query takes ``(spark, sf_dir)``, derives the venture table from
``customer`` and ``orders`` with Spark, cleans it and runs one operator.  The
matching DuckDB SQL lives in ``oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.clean import cap_funding, cleaning_report, derive, drop_incomplete, funding_stats, repair, typed
from ..session import cut_lineage
from ..sources.fixture import ventures_raw
from . import panels as P

Query = Callable[[SparkSession, str], DataFrame]


def ventures(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT, stored: bool = True) -> DataFrame:
    """The cleaned venture table derived from the scale-factor folder.

    The typed rows are written once to the shared checkpoint folder; the cap,
    the derived columns and the repairs are row-level projections over them,
    so every statistic and panel reads the stored rows instead of re-deriving
    them from the raw tables.  Shared by the queries of one session.
    """
    return _ventures(spark, sf_dir, settings, stored)


@lru_cache(maxsize=8)
def _kept(spark: SparkSession, sf_dir: str, settings: Settings) -> DataFrame:
    """Typed rows with a name and a status, stored once (the raw tables are read one time)."""
    return cut_lineage(drop_incomplete(typed(ventures_raw(spark, sf_dir), settings)))


@lru_cache(maxsize=8)
def _funding_stats(spark: SparkSession, sf_dir: str, settings: Settings) -> DataFrame:
    """The stored one-row amount statistics (quartiles, cap) shared by the cleaner and its report."""
    return funding_stats(_kept(spark, sf_dir, settings), settings)


@lru_cache(maxsize=8)
def _ventures(spark: SparkSession, sf_dir: str, settings: Settings, stored: bool) -> DataFrame:
    # cap, derived columns and repairs are row-level over the stored rows: no second write needed
    kept = _kept(spark, sf_dir, settings)
    return repair(derive(cap_funding(kept, settings, _funding_stats(spark, sf_dir, settings)), settings), settings)


def _clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ventures(spark, sf_dir)
    dates = ("founded_at", "first_funding_at", "last_funding_at")
    return v.select(*[F.col(c).cast("string").alias(c) if c in dates else F.col(c) for c in v.columns])


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning_report(ventures_raw(spark, sf_dir), DEFAULT, _funding_stats(spark, sf_dir, DEFAULT),
                           kept=_kept(spark, sf_dir, DEFAULT))


def _panel(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ventures(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"clean_report": _report, "ventures_clean": _clean_table}
    out.update({name: _panel(fn) for name, fn in P.PANELS.items()})
    from . import ml_queries  # features, selection, metrics, models, scoring, insights
    out.update(ml_queries.queries())
    from . import io_queries  # sinks and sources, written and read back
    out.update(io_queries.queries())
    return out


def oracle() -> dict[str, str]:
    from . import oracle_sql as O
    out = {"clean_report": O.CLEAN_REPORT_SQL, "ventures_clean": O.CLEAN_TABLE_SQL}
    out.update(O.PANEL_SQL)
    out.update(O.ml_sql())
    from . import oracle_io
    out.update(oracle_io.IO_SQL)
    return out
