"""Repeated passages: suffix arrays of shards, merged across shards.

A window of ``length`` bytes is repeated if the same bytes start anywhere else;
every byte that a repeated window covers goes.

1. A task cuts its documents into shards of ``SHARD_BYTES`` (a longer text into
   pieces that overlap by less than a window).  Larsson and Sadakane's refinement
   in numpy sorts a shard's suffixes: a few bytes first, then twice as many a
   round, among the groups that are still open, up to ``length`` bytes.  A window
   over a suffix that its first few bytes tell from all others is left out after the
   first sort.  Suffixes that are still together at the end share a window, which is
   repeated; the first window of each class stands for it from here on.
2. Windows meet across shards by a core: the ``CORE``-byte string with the least
   hash in them, which equal windows choose alike.  Neighbouring windows with the
   same core are a region.  Shards send their sorted core hashes, cut by binary
   search into ranges; a range merges the runs of all shards by binary search.
   Cores found twice go into a filter of bounded size.
3. Regions whose core passes are compared whole, by a 128-bit digest of their
   bytes: if another shard has the region, all its windows are repeated.  Of the
   other regions (ends of passages) each window is compared by its own digest, with
   one of each settled region that has the same core.
4. The spans meet their documents by id and digest of the text.

Regions and windows are only counted and joined by key, so a passage that a third
of all documents hold is never gathered anywhere.  Windows, too, pass a filter of
shared hashes first, and only texts that may be concerned are shuffled.

Definitions for odd cases: null or empty text has no bytes and no spans; texts
shorter than a window keep all; rows that repeat a text repeat all its windows,
with or without the same id; null ids are ids like others.  An empty table gives
an empty one; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import hash_filter
from .tables import discard, raw_texts, slices, spread, stored

SHARD_BYTES = 2_000_000
LENGTH, CORE = 400, 256
STOP = b"\xff"  # no UTF-8 text holds this byte
PLACE_BITS = np.uint64(21)
RUN_KEYS = 1 << 21
NO_ID = (1 << 63) - 1


def _refined(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of all suffixes of fewer than 2 M bytes, by Larsson-Sadakane refinement, up to ``depth`` bytes if given.

    A key and its place share one 64-bit number, so that numpy sorts values and
    not indices, which takes a third of the time.  Beside the order come the slots of
    the windows of ``depth`` bytes that start elsewhere too, and which begin a group.
    """
    n = len(data)
    if n >= 1 << 21:
        raise ValueError("a shard holds fewer than 2 M bytes")
    used = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)  # 0 is the end
    width = int(len(used)).bit_length()
    step = min(43 // width, depth or 43)  # symbols of the first key
    symbols = np.concatenate([code[data], np.zeros(step, np.uint64)])
    packed = symbols[:n].copy()
    for j in range(1, step):
        packed <<= np.uint64(width)
        packed |= symbols[j:j + n]
    del symbols  # arrays of eight bytes a byte of text go as soon as they can: two workers share an executor's memory
    packed <<= np.uint64(21)
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    mask, bits = np.uint64((1 << 21) - 1), np.uint64(21)
    order = (packed & mask).view(np.int64)
    packed >>= bits
    new = np.ones(n + 1, bool)
    new[1:n] = packed[1:] != packed[:-1]
    del packed
    open_ = ~(new[:n] & new[1:])
    seen, likely = slice(None), None
    if depth and step < depth:  # a place alone already is in no repeated window; only places of windows without one go on
        alone, reach, windows = np.zeros(n + 1, np.int32), depth - step + 1, max(0, n - depth + 1)
        alone[order[~open_] + 1] = 1
        alone = np.cumsum(alone, dtype=np.int32)
        likely = np.zeros(n, bool)
        likely[:windows] = alone[reach:reach + windows] == alone[:windows]
        open_ &= covered(np.flatnonzero(likely), reach, n)[order]
        seen = open_  # a likely window asks for no other place's rank
    slots, begins = np.flatnonzero(open_), new[:n][open_]
    rank = np.zeros(n + 1, np.uint64)  # 0 past the end; all other ranks count from 1
    at = np.arange(1, n + 1)
    at[~new[:n]] = 0
    rank[order[seen]] = np.maximum.accumulate(at, out=at)[seen]
    del at
    while len(slots) and step != depth:
        ahead = min(step, depth - step) if depth else step  # the last two stretches overlap, so as to end at the depth
        place = order[slots]
        packed = rank[place]
        packed <<= bits
        packed |= rank[np.minimum(place + ahead, n)]
        packed <<= bits
        packed |= place.view(np.uint64)
        packed.sort()
        order[slots] = place = (packed & mask).astype(np.int64)
        packed >>= bits
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = packed[1:] != packed[:-1]
        first = np.flatnonzero(new[:-1])
        rank[place] = np.repeat(slots[first] + 1, np.diff(first, append=len(slots)))
        open_ = ~(new[:-1] & new[1:])
        slots, begins = slots[open_], new[:-1][open_]
        step += ahead
    if likely is not None:  # what else is still together lacks some ranks
        keep = likely[order[slots]]
        slots, begins = slots[keep], begins[keep]
    return order, slots, begins


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The order of all suffixes of fewer than 2 M bytes."""
    return _refined(data)[0]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lane: int = 128) -> np.ndarray:
    """Of each place, the bytes (``most`` at most) that its suffix shares with the one before it in ``order``.

    At least one byte value must not occur (UTF-8 leaves several).
    Kasai's algorithm: a place shares at least one byte less than the place before
    it did.  Every stretch of ``lane`` places is a lane, and all of them go on at
    once, eight bytes a step.
    """
    n = len(data)
    # behind the end stands a byte that the text lacks, so no match runs over it; the first suffix meets nothing else
    unused = np.flatnonzero(np.bincount(data, minlength=256) == 0)[-1]
    padded = np.concatenate([data, np.full(most + 16, unused, np.uint8)])
    word = np.ndarray(n + most + 8, "<u8", padded, strides=(1,))
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = n
    out = np.zeros(n, np.int32)
    place = np.arange(0, n, lane)
    end = np.minimum(place + lane, n)
    size = np.zeros(len(place), np.int64)
    while len(place):
        other = before[place]
        differ = word[place + size] ^ word[other + size]
        low = np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3  # equal bytes at the start: eight if all are
        size += low
        done = np.flatnonzero((low < 8) | (size >= most))
        now = np.minimum(size[done], most)
        out[place[done]] = now
        size[done] = np.maximum(now - 1, 0)
        place[done] += 1
        live = place < end
        if not live.all():
            place, end, size = place[live], end[live], size[live]
    return out


def window_classes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place: does its window of ``length`` bytes start elsewhere too, and is it the first of its class.

    Suffixes that the refinement has not told apart after ``length`` bytes are a
    class, its places in ascending order; how they go on does not matter.
    """
    order, slots, begins = _refined(data, length)
    repeated, first = np.zeros(len(data), bool), np.ones(len(data), bool)
    repeated[order[slots]] = True
    first[order[slots[~begins]]] = False
    return repeated, first


def _window_hash(data: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """A rolling hash of every ``size`` bytes, doubled up from single bytes; it only chooses cores."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    part, width, power = rng.integers(1, 2**63, 256, np.uint64)[data], 1, base
    out, done = None, 0
    while True:
        if size & width:
            out = part.copy() if out is None else part[:len(part) - done] * np.uint64(pow(base, done, 1 << 64)) + out[width:][:len(part) - done]
            done += width
        if 2 * width > size:
            break
        part = part[:-width] * np.uint64(power) + part[width:]
        width, power = 2 * width, power * power % (1 << 64)
    out = out[:len(data) - size + 1]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15)


def _least_in(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def cores_of(data: np.ndarray, length: int, core: int) -> np.ndarray:
    """The place of each window's core, for every place where a window starts."""
    hashes = _window_hash(data, core)
    hashes >>= PLACE_BITS
    hashes <<= PLACE_BITS
    hashes |= np.arange(len(hashes), dtype=np.uint64)
    least = _least_in(hashes, length - core + 1)
    return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).view(np.int64)


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a window that starts at one of the places."""
    edge = np.bincount(starts, minlength=n + 1)[:n]
    edge -= np.bincount(starts + length, minlength=n + 1)[:n]
    return np.cumsum(edge, out=edge) > 0


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


PIECE = "doc_id long, digest binary, starts array<long>, stops array<long>, region_starts array<long>, region_stops array<long>, cores binary, regions binary"
PIECE_TYPES = [pa.int64(), pa.binary(), *(pa.list_(pa.int64()),) * 4, pa.binary(), pa.binary()]
PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _shard_rows(pieces: list[tuple[int, bytes, int, bytes]], length: int, core: int) -> list[list]:
    """One row per piece (doc_id, digest, place in the text, bytes) of a shard: spans repeated in it, and its regions."""
    whole: dict[tuple[bytes, int], int] = {}
    copies: dict[int, int] = {}
    for i, (_, digest, base, _) in enumerate(pieces):
        j = whole.setdefault((digest, base), i)  # the same piece of the same text
        copies[j] = copies.get(j, 0) + 1
    own = sorted(whole.values())
    ends = np.cumsum([len(pieces[i][3]) + 1 for i in own])
    data = np.frombuffer(b"".join(pieces[i][3] + STOP for i in own), np.uint8)
    repeated, first = window_classes(data, length)
    n_windows = np.array([len(pieces[i][3]) - length + 1 for i in own])
    begin = ends - n_windows - length
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(begin, n_windows)])
    for k, i in enumerate(own):
        if copies[i] > 1:
            repeated[begin[k]:begin[k] + n_windows[k]] = True
    chosen = cores_of(data, length, core)
    inside = covered(starts[repeated[starts]], length, len(data))
    cut = np.ones(len(starts), bool)
    cut[1:] = chosen[starts[1:]] != chosen[starts[:-1]]
    at = np.flatnonzero(cut)
    new = np.logical_or.reduceat(first[starts], at)  # a region without a first window is another one's copy
    left, right = starts[at][new], starts[np.append(at[1:], len(starts)) - 1][new]
    owner = np.searchsorted(ends, left, "right")
    raw, edges = data.tobytes(), np.searchsorted(owner, np.arange(len(own) + 1))
    place = {i: k for k, i in enumerate(own)}
    rows = []
    for i, (doc, digest, base, text) in enumerate(pieces):
        k = place[whole[digest, base]]
        a, b = _spans(inside[begin[k]:begin[k] + len(text)])
        row = [doc, digest, (a + base).tolist(), (b + base).tolist(), [], [], b"", b""]
        if i == own[k]:  # copies in the shard need no regions of their own
            lo, hi = left[edges[k]:edges[k + 1]], right[edges[k]:edges[k + 1]]
            at = chosen[lo]
            row[4:] = [(lo - begin[k] + base).tolist(), (hi - begin[k] + base).tolist(),
                       b"".join(xxhash.xxh3_64_digest(raw[c:c + core]) for c in at.tolist()),
                       b"".join(_digest(raw[x:y + length]) for x, y in zip(lo.tolist(), hi.tolist()))]
        rows.append(row)
    return rows


def _shards(docs: DataFrame, length: int, core: int, shard_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(pieces: list) -> pa.RecordBatch:
            columns = zip(*_shard_rows(pieces, length, core))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, PIECE_TYPES)], PIECE_NAMES)

        held, size = [], 0
        for batch in slices(batches, "text", shard_bytes):
            for doc, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), raw_texts(batch, "text")):
                for base in range(0, len(text) - length + 1, shard_bytes):
                    piece = text[base:base + shard_bytes + length - 1]
                    if held and size + len(piece) >= shard_bytes + length:
                        yield close(held)
                        held, size = [], 0
                    held.append((doc, digest, base, piece))
                    size += len(piece) + 1
        if held:
            yield close(held)

    return docs.mapInArrow(run, PIECE)


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Keys that two or more of the sorted runs hold, by binary search of each pair of neighbours, then of their merged runs."""
    level = [(r, r[:0]) for r in runs]
    while len(level) > 1:
        after = []
        for (a, x), (b, y) in zip(level[::2], level[1::2]):
            at = np.searchsorted(a, b)
            both = (at < len(a)) & (a[np.minimum(at, max(0, len(a) - 1))] == b) if len(a) else np.zeros(len(b), bool)
            after.append((np.insert(a, at[~both], b[~both]), np.unique(np.concatenate([x, y, b[both]]))))
        level = after + level[len(level) // 2 * 2:]
    return level[0][1] if level else np.zeros(0, np.uint64)


def short_hash(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What ``shared_hashes`` tells apart of a hash, with ``2 ** bits`` ranges: the range and 32 bits below it, mixed anew."""
    return (hashes >> np.uint64(32 - bits)) * np.uint64(0x9E3779B97F4A7C15)


def shared_hashes(packed: DataFrame, step: int = 1) -> tuple[DataFrame, int]:
    """(h) of the short hashes that occur twice or more, and the ``bits`` that they were shortened by.

    Sorted runs of many rows are cut into ranges of the hashes, and all runs of a
    range are merged.  Below its range 32 bits of a hash are sent: different hashes
    may then count as one, which a filter may do.  ``packed`` has one binary column of
    64-bit hashes, every ``step``-th of its numbers one.
    """
    size = packed.agg(F.sum(F.octet_length(packed.columns[0])).alias("b")).first()["b"] or 0
    ranges = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // step // (32 << 20))
    bits = min(31, max(1, (ranges - 1).bit_length()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            keys, count = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            group, low = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            parts = list(zip(starts, np.append(starts[1:], len(keys))))
            return pa.RecordBatch.from_arrays([
                pa.array(group[starts]), pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()),
                pa.array([low[a:b][count[a:b] > 1].tobytes() for a, b in parts], pa.binary())], ["range", "run", "many"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 64):  # a batch may hold tens of MB: no second copy of all of it
                for x in batch.column(0).slice(begin, 64).to_pylist():
                    if x:
                        held.append(np.frombuffer(x, "<u8")[::step].copy() if step > 1 else np.frombuffer(x, "<u8"))
                        size += len(held[-1])
                        if size >= RUN_KEYS:
                            yield close()
                            held, size = [], 0
        if held:
            yield close()

    def merge(table: pa.Table) -> pa.Table:
        runs, many = ([np.frombuffer(x, "<u4") for x in table.column(c).to_pylist()] for c in ("run", "many"))
        low = np.unique(np.concatenate([merge_runs(runs).astype(np.uint32), *many])).astype(np.uint64)
        keys = low | np.uint64(table.column("range")[0].as_py()) << np.uint64(32)
        return pa.table([pa.array(short_hash(keys << np.uint64(32 - bits), bits).view(np.int64))], ["h"])

    return packed.mapInArrow(cut, "range long, run binary, many binary").groupBy("range").applyInArrow(merge, "h long"), bits


def _suspects(pieces: DataFrame, cores: Broadcast, bits: int) -> DataFrame:
    """(part, start, stop, region, core) of each region whose core passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("region_starts").value_lengths().to_numpy(zero_copy_only=False)
            if not sizes.sum():
                continue
            core = np.frombuffer(b"".join(batch.column("cores").to_pylist()), "<u8")
            hit = np.flatnonzero(cores.value.holds(short_hash(core, bits)))
            owner = np.searchsorted(np.cumsum(sizes), hit, "right")
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)[hit]
            regions = b"".join(batch.column("regions").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(owner)), pa.array(flat("region_starts")), pa.array(flat("region_stops")),
                                              pa.array([regions[16 * i:16 * i + 16] for i in hit.tolist()], pa.binary()), pa.array(core[hit].view(np.int64))],
                                             ["part", "start", "stop", "region", "core"])

    return pieces.select("part", "region_starts", "region_stops", "cores", "regions").mapInArrow(
        run, "part long, start long, stop long, region binary, core long")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(part, starts, windows): places and 128-bit digests of all windows of the regions that ``texts`` names, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            starts, windows = [], []
            for regions, text in zip(batch.column("regions").to_pylist(), raw_texts(batch, "text")):
                at = np.unique(np.concatenate([np.arange(r["start"], r["stop"] + 1) for r in regions]))
                starts.append(at.astype("<i8").tobytes())
                windows.append(b"".join(_digest(text[p:p + length]) for p in at.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(starts, pa.binary()), pa.array(windows, pa.binary())], ["part", "starts", "windows"])

    return texts.select("part", "regions", "text").mapInArrow(run, "part long, starts binary, windows binary")


def _passing(windows: DataFrame, known: Broadcast, bits: int) -> DataFrame:
    """(part, start, window) of the windows whose hash passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                packed = part.column("windows").to_pylist()
                whole = b"".join(packed)
                hit = np.flatnonzero(known.value.holds(short_hash(np.frombuffer(whole, "<u8")[::2], bits)))
                owner = pa.array(np.searchsorted(np.cumsum([len(x) // 16 for x in packed]), hit, "right"))
                starts = np.frombuffer(b"".join(part.column("starts").to_pylist()), "<i8")
                yield pa.RecordBatch.from_arrays([part.column("part").take(owner), pa.array(starts[hit]),
                                                  pa.array([whole[16 * i:16 * i + 16] for i in hit.tolist()], pa.binary())], ["part", "start", "window"])

    return windows.mapInArrow(run, "part long, start long, window binary")


def _rows_of(starts: DataFrame, length: int) -> DataFrame:
    """(part, spans) from the places of repeated windows: windows in a row make one span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column("starts").to_pylist():
                at = np.sort(np.array(places, np.int64))
                first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                last = at[np.append(first[1:], len(at)) - 1] + length
                spans.append([{"start": a, "stop": b} for a, b in zip(at[first].tolist(), last.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                                             ["part", "spans"])

    return starts.mapInArrow(run, "part long, spans array<struct<start:long,stop:long>>")


def _key():
    return F.xxhash64("doc_id", "digest")


def _may_hold(known: Broadcast):
    """Does a filter of documents pass this one; only the hash leaves the JVM."""
    @F.pandas_udf("boolean")
    def run(h: pd.Series) -> pd.Series:
        return pd.Series(known.value.holds(h.to_numpy().view(np.uint64)))

    return run(_key())


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, digest, spans) of the documents that hold repeated windows; spans may touch or overlap.

    ``docs`` has doc_id, text and the text's digest.
    """
    # a piece of a text goes by a number from here on
    pieces = stored(_shards(docs, length, core, shard_bytes).withColumn("part", F.monotonically_increasing_id()), "pieces")
    whose = pieces.select("part", "doc_id", "digest")
    hashes, bits = shared_hashes(pieces.select("cores"))
    suspects = _suspects(pieces, hash_filter(hashes), bits)
    again = suspects.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("region", F.lit(True).alias("again"))
    marked = stored(suspects.join(spread(again), "region", "left").select(*suspects.columns, "again"), "regions")
    # windows of the other regions may lie in a region that is settled as a whole: one of each such kind is compared with them
    other = marked.filter("again IS NULL")
    settled = marked.filter("again").groupBy("region").agg(F.min(F.struct("part", "start", "stop")).alias("one"), F.min("core").alias("core"))
    settled = settled.join(spread(other.select("core").distinct()), "core", "left_semi").select("one.*")
    open_ = other.select("part", "start", "stop").unionByName(settled).groupBy("part").agg(F.collect_set(F.struct("start", "stop")).alias("regions"))
    open_ = stored(open_.join(whose, "part"), "open-regions")
    # only the texts that may hold such regions are shuffled
    texts = docs.filter(_may_hold(hash_filter(open_.select(_key().alias("h")))))
    windows = stored(_windows(texts.join(spread(open_), ["doc_id", "digest"]), length), "windows")
    hashes, bits = shared_hashes(windows.select("windows"), 2)
    likely = stored(_passing(windows, hash_filter(hashes), bits), "likely-windows")
    discard(windows)
    twice = likely.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    # windows in a row are one span
    starts = likely.join(spread(twice), "window").groupBy("part").agg(F.collect_set("start").alias("starts"))
    spans = [marked.filter("again").groupBy("part").agg(F.collect_set(F.struct(F.col("start"), (F.col("stop") + length).alias("stop"))).alias("spans")),
             _rows_of(starts, length)]
    kind = "array<struct<start:long,stop:long>>"
    parts = [p.join(whose, "part").select("doc_id", "digest", F.col("spans").cast(kind).alias("spans")) for p in spans]
    parts.append(pieces.filter(F.size("starts") > 0).select("doc_id", "digest", F.arrays_zip(F.col("starts").alias("start"), F.col("stops").alias("stop"))
                                                            .cast(kind).alias("spans")))
    union = reduce(DataFrame.unionByName, parts).select("doc_id", "digest", F.explode("spans").alias("s"))
    found = stored(union.groupBy("doc_id", "digest").agg(F.collect_set("s").alias("spans")), "spans")
    for table in (pieces, marked, open_, likely):
        discard(table)
    return found


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap, as one."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int = CORE,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, spans, kept).

    ``spans`` are the maximal removed runs of bytes; ``kept`` is binary, as a cut
    may fall inside a character.
    """
    if not 0 < core <= length or shard_bytes + 2 * length >= 1 << int(PLACE_BITS):
        raise ValueError("a core lies in a window, and a shard holds fewer than 2 M bytes")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    found = repeated_spans(docs, length, core, shard_bytes)
    # a null id and the largest long share a key only if their texts are equal, and then their spans are
    mine = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"),
                     F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    known = hash_filter(found.select(_key().alias("h")))
    joined = mine.filter(_may_hold(known)).join(spread(found), ["doc_id", "digest"], "left").select("id", "text", "spans", F.lit(None).cast("long").alias("h"))
    # the other rows meet the filter in the step that writes them: one Python worker a task, where a filter of its own would be a second
    every = joined.unionByName(mine.select("id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), _key().alias("h")))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h")  # null: joined above
            held = known.value.holds(h.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pc.or_(h.is_null(), pa.array(~held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(others(batches), "text", 4 << 20):
            texts, spans = raw_texts(batch, "text"), batch.column("spans").fill_null([])
            flat, bound = spans.flatten(), np.append(0, np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False)))
            start, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            size, starts, stops, kept = [], [], [], []
            for text, lo, hi in zip(texts, bound[:-1].tolist(), bound[1:].tolist()):
                if lo < hi:
                    a, b = _merged(start[lo:hi], stop[lo:hi])
                    starts.append(a)
                    stops.append(b)
                    ends = zip([0, *b.tolist()], [*a.tolist(), len(text)])
                    kept.append(b"".join([text[x:y] for x, y in ends]))
                else:
                    kept.append(text)
                size.append(len(starts[-1]) if lo < hi else 0)
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64()) for x in (starts, stops)], ["start", "stop"])
            n = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(n), pa.array(n - np.array([len(k) for k in kept], np.int64)),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), runs), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return every.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
