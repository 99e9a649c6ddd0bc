"""Sinks (SNK-*): cleaned table, panel tables, model table, predictions, fitted models.

Output layout (SRC-02): ``<root>/data``, ``<root>/panels``, ``<root>/models`` under
any Hadoop-compatible URI; Spark's writers create the folders.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..config import DEFAULT, Settings


def layout(root: str) -> dict[str, str]:
    root = root.rstrip("/")
    return {"root": root, "data": f"{root}/data", "panels": f"{root}/panels", "models": f"{root}/models"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    out = df.coalesce(partitions) if partitions else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_panels(panels: Mapping[str, DataFrame], root: str) -> list[str]:
    """One Parquet folder per panel table; panel tables are small, one file each."""
    done = []
    for name, df in panels.items():
        write_table(df, f"{layout(root)['panels']}/{name}", partitions=1)
        done.append(name)
    return done


def write_dashboard(ventures: DataFrame, root: str, settings: Settings = DEFAULT) -> list[str]:
    """All panel tables of a venture table, from its three shared scans."""
    from ..plans.dashboard import Dashboard

    return write_panels(Dashboard(ventures, settings).tables(), root)


def model_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def save_models(models: Mapping[str, object], root: str) -> list[str]:
    """Spark ML persistence of every fitted model (an ensemble is saved member by member)."""
    saved = []
    base = layout(root)["models"]
    for name, m in models.items():
        key = model_key(name)
        members = m if isinstance(m, list) else [m]
        for i, mm in enumerate(members):
            suffix = f"_member{i}" if isinstance(m, list) else ""
            mm.write().overwrite().save(f"{base}/{key}{suffix}")
        saved.append(name)
    return saved
