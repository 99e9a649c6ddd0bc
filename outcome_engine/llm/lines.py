"""Line dedup with two Bloom filters, for hashes seen in one and in two documents.

1. Every task hashes the keys of its lines and sends each distinct hash of a run
   once, marked if two documents of the run hold it.  Per segment of the hash
   space the two filters are built by streaming over these hashes: one that
   already lies in the once-filter enters the twice-filter.
2. The twice-filter goes to all tasks.  Its size follows the number of lines up
   to ``max_filter_bytes``, the bound of what is broadcast; in a fuller filter
   more lines are suspects, and no repeat is ever missed.
3. Only suspected lines shuffle, with their whole key: the smallest document of
   each key is chosen, and keys of a single document fall out (exact).
4. The verdicts meet the documents by id, and the lines are dropped there.

Definitions for odd cases: null or empty text is one empty line; rows with the
same id are one document; a null id counts as one document behind all others;
keys shorter than ``min_chars`` code points always stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import discard, raw_texts, slices, spread, stored

SEGMENT_BITS = 1 << 19
BITS_PER_LINE = 16
MAX_FILTER_BYTES = 64 << 20
RUN_HASHES = 1 << 18
NO_ID = (1 << 63) - 1
BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower()  # on bytes: the ASCII blanks and letters only
        out.append(key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars) else None)
    return out


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _hash(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2]


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    """Three bits of a segment for every hash; the segment comes from the hash's upper half."""
    mask = np.uint64(SEGMENT_BITS - 1)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return [(hashes & mask).astype(np.int64), ((mixed >> np.uint64(20)) & mask).astype(np.int64), ((mixed >> np.uint64(42)) & mask).astype(np.int64)]


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def _plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), df[text_col].cast("string").alias("text"))


def _line_hashes(docs: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """(segment, once, twice): hashes of a run of documents, each once, as u64 arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            hashes, ids = np.concatenate(held), np.concatenate(owner)
            held.clear()
            owner.clear()
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            many = np.zeros(len(hashes), bool)
            many[1:] = ~new[1:] & (ids[1:] != ids[:-1])
            group = np.cumsum(new) - 1
            twice = np.bincount(group, many) > 0
            hashes = hashes[new]
            order = np.argsort(segment := _segment(hashes, segments), kind="stable")
            hashes, twice, segment = hashes[order], twice[order], segment[order]
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            stops = np.append(cuts[1:], len(hashes))
            return pa.RecordBatch.from_arrays([
                pa.array(segment[cuts]), pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary()),
                pa.array([hashes[a:b][twice[a:b]].tobytes() for a, b in zip(cuts, stops)], pa.binary())], ["segment", "once", "twice"])

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text")):
                if digests := [_digest(k) for k in set(line_keys(text, min_chars)) if k is not None]:
                    held.append(_hash(digests))
                    owner.append(np.full(len(digests), doc, np.int64))
            if sum(map(len, held)) >= RUN_HASHES:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "segment long, once binary, twice binary")


def _test(bits: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(places[0]), bool)
    for p in places:
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return out


def _set(bits: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))


def _filters(hashes: DataFrame) -> DataFrame:
    """(segment, bits) of the twice-filter; the once-filter of a segment lives while its rows stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if s != segment:
                    if segment is not None and twice.any():
                        yield close()
                    segment, once, twice = s, np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
                places = _places(np.frombuffer(a, "<u8"))
                again = _test(once, places)
                _set(twice, [p[again] for p in places])
                _set(twice, _places(np.frombuffer(b, "<u8")))
                _set(once, places)
        if segment is not None and twice.any():
            yield close()

    return hashes.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment long, bits binary")


def suspected_lines(docs: DataFrame, min_chars: int, max_filter_bytes: int) -> tuple[DataFrame, Broadcast]:
    """(key, digest, doc_id) of every line whose hash the twice-filter holds, each key once per document; and that filter."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = max(1, min(max_filter_bytes * 8, lines * BITS_PER_LINE) // SEGMENT_BITS)
    rows = _filters(_line_hashes(docs, segments, min_chars)).collect()  # at most max_filter_bytes
    bits = spark.sparkContext.broadcast({r.segment: bytes(r.bits) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {s: np.frombuffer(b, np.uint8) for s, b in bits.value.items()}
        for batch in slices(batches, "text"):
            keys, digests, docs_of = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text")):
                own = [k for k in dict.fromkeys(line_keys(text, min_chars)) if k is not None]
                keys += own
                docs_of += [doc] * len(own)
            if not keys:
                continue
            digests = [_digest(k) for k in keys]
            hashes = _hash(digests)
            order = np.argsort(segment := _segment(hashes, segments), kind="stable")
            hit = np.zeros(len(keys), bool)
            cuts = np.flatnonzero(np.diff(segment[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                if (own := table.get(int(segment[order[a]]))) is not None:
                    hit[order[a:b]] = _test(own, _places(hashes[order[a:b]]))
            at = np.flatnonzero(hit).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i].decode() for i in at]), pa.array([digests[i] for i in at], pa.binary()),
                                                  pa.array([docs_of[i] for i in at], pa.int64())], ["key", "digest", "doc_id"])

    return docs.mapInArrow(run, "key string, digest binary, doc_id long"), bits


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                max_filter_bytes: int = MAX_FILTER_BYTES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The table with the kept lines as its text, and two more columns: the lines before, and those dropped.

    Columns of the input with the names in ``counts`` are replaced.
    """
    docs = _plain(df, id_col, text_col)
    suspects, bits = suspected_lines(docs, min_chars, max_filter_bytes)
    suspects = stored(suspects, "suspects")
    bits.unpersist()
    first = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    drops = suspects.join(spread(first.drop("last")), "key").filter("doc_id > first").groupBy("doc_id") \
        .agg(F.collect_set("digest").alias("__drops"))  # at most the lines of one document
    drops = stored(drops.select(F.col("doc_id").alias("__id"), "__drops"), "line-drops")
    discard(suspects)
    base = df.drop(*counts)
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in base.schema.fields]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in counts)])
    joined = base.withColumn(text_col, base[text_col].cast("string")).withColumn("__id", F.coalesce(base[id_col].cast("long"), F.lit(NO_ID))) \
        .join(drops, "__id", "left").select(*base.columns, "__drops")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            kept, n_lines, n_dropped = [], [], []
            for text, drops in zip(raw_texts(batch, text_col), batch.column("__drops").to_pylist()):
                if not drops:
                    kept.append(text.decode())
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone, lines = set(drops), text.split(b"\n")
                stay = [line for line, key in zip(lines, line_keys(text, min_chars)) if key is None or _digest(key) not in gone]
                kept.append(b"\n".join(stay).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [pa.array(kept, pa.string()) if f.name == text_col else batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [f.name for f in schema.fields])

    return joined.mapInArrow(cut, schema)
