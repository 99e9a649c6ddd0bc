"""Token-id output as wavelet matrices: one succinct, self-contained file per shard.

A shard holds the ids of whole documents in order.  Its symbols (the distinct
ids, ascending) need ``ceil(log2)`` bits; plane l holds bit l of every symbol,
from the highest, after a stable partition by the bits above it.  A sampled rank
directory of one count per 512 bits gives rank and select, so the file answers
access, counting and occurrence lookups without being unpacked.

File layout, little-endian: ``WVM1``, then u32 levels, u64 tokens, documents and
symbols; the symbols (u32), document ids (i64, with a u8 mask for null), their
lengths (u64), zeros per plane (u64); per plane the bits as u64 words (lowest
bit first) and the rank directory (u64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .tables import slices

MAGIC, BLOCK = b"WVM1", 512
SHARD_TOKENS = 1 << 20


def _bits(values: np.ndarray) -> np.ndarray:
    """Truth values as u64 words, lowest bit first, padded to whole rank blocks."""
    packed = np.packbits(values, bitorder="little")
    words = np.zeros((len(values) // BLOCK + 1) * (BLOCK // 8), np.uint8)
    words[:len(packed)] = packed
    return words.view("<u8")


class WaveletMatrix:
    """A sequence of ids with access, rank, select and occurrence lookup over bit-planes."""

    def __init__(self, symbols: np.ndarray, n: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.symbols, self.n, self.zeros, self.planes, self.ranks = symbols, n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max(initial=0)) + 1
        seen = np.zeros(top, bool)
        seen[ids] = True
        symbols = np.flatnonzero(seen).astype(np.uint32)
        place = np.zeros(top, np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        place[symbols] = np.arange(len(symbols))
        now, zeros, planes, ranks = place[ids], [], [], []
        for level in range(max(1, int(len(symbols) - 1).bit_length()) - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            words = _bits(bit)
            planes.append(words)
            per_block = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
            ranks.append(np.cumsum(per_block) - per_block)
            low, high, after = np.flatnonzero(~bit), np.flatnonzero(bit), np.empty_like(now)
            np.take(now, low, out=after[:len(low)], mode="clip")  # by index: twice as fast as by truth values
            np.take(now, high, out=after[len(low):], mode="clip")
            now = after
            zeros.append(len(low))
        return cls(symbols, len(ids), np.array(zeros, np.uint64), planes, ranks)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the directory's count, whole words, and a part of one."""
        words, word = self.planes[level], at >> 6
        out = self.ranks[level][at // BLOCK].astype(np.int64)
        for k in range(BLOCK // 64 - 1):
            whole = (at // BLOCK) * (BLOCK // 64) + k
            out += np.where(whole < word, np.bitwise_count(words[whole]).astype(np.int64), 0)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(words[word] & mask)

    def access(self, at) -> np.ndarray:
        at = np.atleast_1d(np.asarray(at, np.int64))
        code = np.zeros(len(at), np.int64)
        for level, zero in enumerate(self.zeros.astype(np.int64)):
            bit, ones = self._bit(level, at), self._rank1(level, at)
            code = code << 1 | bit
            at = np.where(bit, zero + ones, at - ones)
        return self.symbols[code]

    def _code(self, symbol: int) -> int | None:
        i = int(np.searchsorted(self.symbols, symbol))
        return i if i < len(self.symbols) and self.symbols[i] == symbol else None

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        """Where the symbol's occurrences in [start, stop) lie below the last plane."""
        code = self._code(symbol)
        if code is None:
            return 0, 0
        for level, zero in enumerate(self.zeros.astype(np.int64)):
            a, b = self._rank1(level, np.array([start, stop], np.int64))
            start, stop = (zero + a, zero + b) if code >> (len(self.zeros) - 1 - level) & 1 else (start - a, stop - b)
        return int(start), int(stop)

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        return b - a

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of a plane: search the directory, then the bits of its block."""
        starts = np.arange(len(self.ranks[level]), dtype=np.int64) * BLOCK
        before = self.ranks[level].astype(np.int64) if bit else starts - self.ranks[level].astype(np.int64)
        block = np.searchsorted(before, k, "right") - 1
        words = self.planes[level].reshape(-1, BLOCK // 64)[block]
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little").reshape(len(k), BLOCK)
        seen = np.cumsum(bits == bit, axis=1)
        return block * BLOCK + np.argmax(seen > (k - before[block])[:, None], axis=1)

    def occurrences(self, symbol: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Positions of an id in [start, stop), ascending: select from the last plane upwards."""
        code = self._code(symbol)
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        at = np.arange(a, b, dtype=np.int64)
        for level in range(len(self.zeros) - 1, -1, -1) if code is not None and b > a else ():
            bit = code >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, bit, at - int(self.zeros[level]) if bit else at)
        return np.sort(at)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        return int(self.occurrences(symbol)[k])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane upwards."""
        now = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for shift, (zero, words) in enumerate(zip(self.zeros[::-1].astype(np.int64), self.planes[::-1])):
            bit = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~bit)] = now[:zero]
            up[np.flatnonzero(bit)] = now[zero:] | now.dtype.type(1 << shift)
            now = up
        return self.symbols[now] if self.n else np.zeros(0, np.uint32)

    def to_bytes(self, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
        head = [MAGIC, struct.pack("<IQQQ", len(self.planes), self.n, len(doc_ids), len(self.symbols)), self.symbols.astype("<u4").tobytes(),
                np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
                lengths.astype("<u8").tobytes(), self.zeros.astype("<u8").tobytes()]
        return b"".join([*head, *(x.astype("<u8").tobytes() for pair in zip(self.planes, self.ranks) for x in pair)])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        levels, n, docs, sigma = struct.unpack_from("<IQQQ", data, 4)
        at = 4 + struct.calcsize("<IQQQ")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        symbols, ids, null, lengths, zeros = take("<u4", sigma), take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u8", levels)
        blocks, planes, ranks = n // BLOCK + 1, [], []
        for _ in range(levels):
            planes.append(take("<u8", blocks * (BLOCK // 64)))
            ranks.append(take("<u8", blocks))
        return cls(symbols, n, zeros, planes, ranks), [None if x else int(d) for d, x in zip(ids, null)], lengths.astype(np.int64)


SHARDS = "part long, shard long, first long, first_doc long, first_hash long, n_tokens long, n_docs long, data binary"


def write_shards(df: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int | None = 0, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every document and write its ids, in ascending id order, as wavelet shards.

    The documents are range-partitioned by (id, hash of text), so null ids or
    ids with many texts spread over tasks too; nulls come first, a null text
    counts as empty.  A document is never cut, so a shard holds at least
    ``shard_tokens`` ids unless its part ends.  The files are written by Spark's
    committer, one row per shard, so a lost executor repeats its part only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list, list]] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, first, held
            ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            docs, hashes = [d for h in held for d in h[2]], held[0][3]
            row = {"part": part, "shard": shard, "first": first, "first_doc": docs[0], "first_hash": hashes[0], "n_tokens": len(ids),
                   "n_docs": len(docs), "data": WaveletMatrix.build(ids).to_bytes(docs, lengths)}
            shard, first, held = shard + 1, first + len(ids), []
            return pa.RecordBatch.from_pylist([row], schema=_shard_schema())

        for batch in slices(batches, "text", 4 << 20):  # each different word of a slice is looked up once
            ids, lengths = encoder(tokenizer, kind).encode(batch.column("text").to_pylist(), end_id)
            held.append((ids, lengths, batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist()))
            if sum(len(h[0]) for h in held) >= shard_tokens:
                yield close()
        if held:
            yield close()

    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    docs.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").mapInArrow(run, SHARDS) \
        .write.option("compression", "none").parquet(path)


def _shard_schema() -> pa.Schema:
    long = pa.int64()
    return pa.schema([("part", long), ("shard", long), ("first", long), ("first_doc", long), ("first_hash", long), ("n_tokens", long),
                      ("n_docs", long), ("data", pa.binary())])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    The ids before a shard within its part stand in its row; those before its
    part are summed over one row per part (their number is that of the tasks
    that wrote, not of the documents).
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.min(F.struct("first_doc", "first_hash")).alias("key"), F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix, docs, lengths = WaveletMatrix.from_bytes(batch.column("data")[row].as_buffer().to_pybytes())
                ids = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                here = batch.column("before")[row].as_py() + batch.column("first")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(here + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(F.broadcast(parts), "part").select("first", "before", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
