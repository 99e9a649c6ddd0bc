"""A Bloom filter over 64-bit hashes: built by Spark in segments, broadcast whole within a bound.

The filter only spares work: in a fuller one more keys pass, and none that was
put in is ever missed.  Its users confirm what passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 19
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    """Three bits of a segment for every hash; the segment itself comes from the upper half."""
    mask = np.uint64(SEGMENT_BITS - 1)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return [(hashes & mask).astype(np.int64), ((mixed >> np.uint64(20)) & mask).astype(np.int64), ((mixed >> np.uint64(42)) & mask).astype(np.int64)]


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


class HashFilter:
    def __init__(self, bits: bytes, segments: int):
        self.bits, self.segments = bits, segments

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bits, base = np.frombuffer(self.bits, np.uint8), _segment(hashes, self.segments) * SEGMENT_BITS
        out = np.ones(len(hashes), bool)
        for p in _places(hashes):
            p = p + base
            out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return out


def hash_filter(keys: DataFrame, column: str = "h", max_bytes: int = MAX_FILTER_BYTES) -> Broadcast:
    """A broadcast HashFilter of a long column; at most ``max_bytes`` reach the driver and the tasks."""
    spark = keys.sparkSession
    count = keys.agg(F.count(column).alias("n")).first()["n"]
    segments = max(1, min(max_bytes * 8, count * BITS_PER_KEY) // SEGMENT_BITS + (count * BITS_PER_KEY < max_bytes * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(segment := _segment(hashes, segments), kind="stable")
            hashes, segment = hashes[order], segment[order]
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(hashes))):
                bits = held.setdefault(int(segment[a]), np.zeros(SEGMENT_BITS, bool))
                for p in _places(hashes[a:b]):
                    bits[p] = True
                if len(held) > 64:  # parts of a segment are joined below
                    yield close(held)
                    held = {}
        if held:
            yield close(held)

    def close(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = [np.packbits(b, bitorder="little").tobytes() for b in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["segment", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, bits = None, None
        for batch in batches:
            for s, part in zip(*(c.to_pylist() for c in batch.columns)):
                if s != segment:
                    if segment is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["segment", "bits"])
                    segment, bits = s, np.zeros(SEGMENT_BITS // 8, np.uint8)
                bits |= np.frombuffer(part, np.uint8)
        if segment is not None:
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["segment", "bits"])

    # hashes of one segment meet in one task, so a segment is made once; their number follows the filter's fill
    with_segment = keys.filter(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("h"))
    place = F.pmod(F.shiftrightunsigned("h", 32), F.lit(segments))
    rows = with_segment.repartition(place).mapInArrow(run, "segment long, bits binary") \
        .repartition("segment").sortWithinPartitions("segment").mapInArrow(join, "segment long, bits binary").collect()
    whole = bytearray(segments * SEGMENT_BITS // 8)
    for r in rows:
        whole[r.segment * SEGMENT_BITS // 8:(r.segment + 1) * SEGMENT_BITS // 8] = r.bits
    return spark.sparkContext.broadcast(HashFilter(bytes(whole), segments))
