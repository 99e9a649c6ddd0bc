"""Helpers shared by the operators: reading, Arrow slices, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


_CACHING: list[tuple[str, Callable[[], None]]] = []


def sole_cache(owner: str, release: Callable[[], None]) -> None:
    """Called by an operator that remembers words: what another one remembered in this worker is released."""
    if _CACHING and _CACHING[0][0] != owner:
        _CACHING[0][1]()
    _CACHING[:] = [(owner, release)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names (shared by driver and executors)."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/llm-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """The result of an aggregate, dealt out anew before it is joined back to detail rows.

    A join right on top of the aggregate would share its shuffle, and adaptive
    execution then cannot split a hot key's detail rows over several tasks; with a
    shuffle of its own on each side it can.  The aggregate is the small side.
    """
    return df.hint("rebalance")


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + max_bytes
            stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def by_text(df: DataFrame, id_col: str, text_col: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
            max_bytes: int = 2 << 20) -> DataFrame:
    """Map slices of (id, text) to rows; only these two columns leave the scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", max_bytes):
            yield fn(batch)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, judge: Callable[[list[str | None]], list[bool]], max_bytes: int = 1 << 20) -> DataFrame:
    """The rows, with all columns, whose text passes; a filter in the task that reads them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, max_bytes):
            yield batch.filter(pa.array(judge(batch.column(text_col).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
