"""Multi-line CSV read in splits: quoted line breaks without a task per file.

Spark's ``multiLine`` reader gives each file to one task, as only the whole file
tells whether a line break lies inside quotes.  Here the text reader cuts files at
line breaks, wherever its splits fall, and two passes settle the rest:

1. Each split folds its lines into one small function: does the split end inside
   quotes, if it starts outside, and if it starts inside.  The functions of a file,
   composed in the order of ``_metadata.file_block_start``, say how each split starts.
2. Each split joins its own lines to records.  What belongs to a record that began
   earlier, and a record that is still open at the split's end, are fragments: two
   a split at most, and only they are shuffled and put together.

The records are parsed by Spark's ``from_csv``.  A quote opens a field only at its
start, and a doubled quote inside one is a quote.  The first line of a file tells
whether its lines end in ``\\n`` or in ``\\r\\n``; the latter become ``\\n`` inside
quotes too, as in Spark's reader.

Definitions for odd cases: empty lines are no records; the first record of every
file is its header, and the first file (by path) names the columns; a file whose
last quote never closes ends with one long record; a folder of empty files has no
columns and raises ``ValueError``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, sized_broadcast

_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')  # up to the quote that closes a field
_OPEN = re.compile(r'(?:^|,)"')


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line that starts inside (or outside) quotes end inside them?"""
    at = 0
    if inside:
        close = _CLOSE.match(line)
        if not close:
            return True
        at = close.end()
        if (comma := line.find(",", at)) < 0:
            return False
        at = comma
    while True:
        opened = _OPEN.search(line, at) if at or not inside else None
        if opened is None:
            return False
        close = _CLOSE.match(line, opened.end())
        if not close:
            return True
        at = line.find(",", close.end())
        if at < 0:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Runs of rows of one split: (file, block, from, to)."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    start = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or (files[i], blocks[i]) != (files[start], blocks[start]):
            yield files[start], blocks[start], start, i
            start = i


def _split_functions(lines: DataFrame) -> DataFrame:
    """(file, block, if_out, if_in, crlf): how each split ends, and whether the first line of a file ends in ``\\r\\n``."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, inn, crlf = None, False, True, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([out]), pa.array([inn]), pa.array([crlf])],
                                              ["file", "block", "if_out", "if_in", "crlf"])

        for batch in batches:
            quoted = pc.match_substring(batch.column("value"), '"')
            for file, block, a, b in _blocks(batch):
                if (file, block) != now:
                    if now:
                        yield row()
                    now, out, inn = (file, block), False, True
                    crlf = block == 0 and batch.column("value")[a].as_py().endswith("\r")
                for line in batch.column("value").slice(a, b - a).filter(quoted.slice(a, b - a)).to_pylist():  # others change nothing
                    out, inn = ends_inside(line, out), ends_inside(line, inn)
        if now:
            yield row()

    return lines.mapInArrow(fold, "file string, block long, if_out boolean, if_in boolean, crlf boolean")


def _starts(functions: DataFrame) -> DataFrame:
    """(file, block, inside, crlf): the functions of a file composed in order; one row per split.

    A split sets the state (both ends alike), turns it, or leaves it.  So the state
    is that of the last split that set it, turned by those since.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("if_out") == F.col("if_in"), F.col("if_out") & ~F.col("if_in")
    part = functions.withColumn("turned", F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0)))
    # the number of turns up to a setting split, and the state it leaves behind
    setting = F.when(sets, F.struct((F.col("turned") + 0).alias("turned"), F.col("if_out").cast("int").alias("state")))
    part = part.withColumn("setting", setting)
    last = F.last("setting", ignorenulls=True).over(before)
    since = F.col("turned") - F.coalesce(last["turned"], F.lit(0))
    state = (F.coalesce(last["state"], F.lit(0)) + since) % 2 == 1
    return part.select("file", "block", state.alias("inside"), F.max("crlf").over(Window.partitionBy("file")).alias("crlf"))


def _records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, kind, first, record): whole records (kind 0), the rest of an earlier record (1), a record left open (2)."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, held, kind, first = None, False, [], 0, False

        def emit(rows: list, kind: int) -> None:
            rows.append((now[0], now[1], kind, first, "\n".join(held)))

        def batch_of(rows: list) -> pa.RecordBatch:
            f, b, k, h, r = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(h), pa.array(r, pa.string())],
                                              ["file", "block", "kind", "first", "record"])

        def end(rows: list) -> None:
            if held:  # the split is over: what is held is open, or the middle of a longer record
                emit(rows, 1 if kind == 1 else 2)

        for batch in batches:
            rows: list = []
            lead = batch.column("inside").to_pylist()
            for file, block, a, b in _blocks(batch):
                if (file, block) != now:
                    end(rows)
                    now, inside, held, kind, first = (file, block), bool(lead[a]), [], 1 if lead[a] else 0, block == 0
                for line in batch.column("value").slice(a, b - a).to_pylist():
                    held.append(line)
                    inside = ends_inside(line, inside) if '"' in line else inside
                    if not inside:
                        if kind == 1 or line or len(held) > 1:
                            emit(rows, kind)
                            first = first and kind == 1
                        held, kind = [], 0
            if rows:
                yield batch_of(rows)
        rows = []
        end(rows)
        if rows:
            yield batch_of(rows)

    value = F.when(F.col("crlf"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    stated = lines.join(sized_broadcast(starts)[0], ["file", "block"]).select(value.alias("value"), "file", "block", "inside")
    return stated.mapInArrow(join, "file string, block long, kind int, first boolean, record string")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record) of every record; ``first`` marks a file's header."""
    lines = _lines(spark, path)
    starts = cut_lineage(_starts(_split_functions(lines)))
    parts = cut_lineage(_records(lines, starts))
    pieces = parts.where("kind > 0")
    # an open record comes after the rest of an earlier one in its split; two rows per split of one file at most
    by_file = Window.partitionBy("file").orderBy("block", "kind")
    number = F.sum((F.col("kind") == 2).cast("int")).over(by_file)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"]), "\n")
    joined = pieces.withColumn("number", number).groupBy("file", "number").agg(F.max("first").alias("first"), text.alias("record"))
    return parts.where("kind = 0").select("file", "first", "record").unionByName(joined.select("file", "first", "record"))


def read_csv_in_splits(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """Headered CSV with line breaks in quoted fields, all columns as text, read by as many tasks as there are splits."""
    records = csv_records(spark, path)
    head = records.where("first").agg(F.min_by("record", "file").alias("h")).first()["h"]
    if head is None:
        raise ValueError(f"no header in {path}")
    parser = {k: v for k, v in options.items() if k != "header"} | {"multiLine": "true"}
    head = head.removeprefix("﻿")
    width = spark.range(1).select(F.from_csv(F.lit(head), F.lit(", ".join(f"c{i} string" for i in range(head.count(",") + 1))), parser).alias("h")).first()["h"]
    names = [n for n in width if n is not None]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
    return records.where(~F.col("first")).select(F.from_csv("record", ddl, parser).alias("r")).select("r.*")
