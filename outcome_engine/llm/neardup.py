"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

1. Every text becomes the set of its shingles' 64-bit hashes.  A first random
   permutation sends a shingle to a place of a circle, a second one is a table
   over the circle; coordinate k of the signature is the least table value ``k``
   steps behind the shingles' places, so two permutations give all coordinates,
   and those of one shingle lie side by side in the table.
2. Documents with equal sets form one class.  It gets a number of its own, and one
   text that stands for it: an id says nothing about its rows' texts.
3. Bands of coordinates are bucket keys.  A class that shares a bucket belongs
   with the bucket's smallest number to one cluster of candidates (one link per
   member and bucket, never a pair of members).
4. Clusters are packed into blocks of bounded size.  In a block, and between
   blocks of one cluster, an inverted index of shingles counts the
   intersections, and each pair is linked or not by its whole sets.  Of a
   cluster in many blocks, all blocks meet the first; then only the classes
   outside the cluster's largest component, packed anew, meet all blocks.
5. Components of the links, their smallest document ids, and back to the documents by class.

With 32 bands of 4 coordinates a pair at the threshold 0.75 shares no bucket with
probability (1 - 0.75**4)**32 = 5e-6.

Definitions for odd cases: null or empty texts, and those of blanks only, have no
shingle and stand alone; rows that repeat an id are judged by their own texts; a null id counts as
one document behind all others, and its component is null if it is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import discard, raw_texts, slices, spread, stored

NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    circle_bits: int = 20
    seed: int = 7
    block_shingles: int = 200_000  # shingles in a block of candidates, about


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    data = b"\n".join(t.lower() for t in texts) + b"\n"  # on bytes: A-Z only
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # words before each text
    codes, distinct = pd.factorize(np.array(data.split(), dtype=object))
    value = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]
    power, base = np.ones(1, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    window = value.copy()
    for n in range(1, min(words, len(value))):
        power = power * base
        window[:len(value) - n] += value[n:] * power  # a window's last places are not read
    window = _mix(window)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(window[a:b - words + 1]))
        elif b > a:  # fewer words: the whole sequence is one shingle
            out.append(np.array([xxhash.xxh3_64_intdigest(value[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache
def _circle(bits: int, coordinates: int, seed: int) -> np.ndarray:
    """The second permutation, followed by its start so that a shift never runs over the end."""
    table = np.random.default_rng(seed).permutation(1 << bits).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, rules: NearRules) -> np.ndarray:
    circle = _circle(rules.circle_bits, rules.bands * rules.rows, rules.seed)
    places = (_mix(shingles + np.uint64(rules.seed)) >> np.uint64(64 - rules.circle_bits)).astype(np.int64)
    parts = [circle[places[i:i + 4096]].min(axis=0) for i in range(0, len(places), 4096)]
    return np.min(parts, axis=0)


def band_keys(signatures: np.ndarray, rules: NearRules) -> np.ndarray:
    """One 64-bit bucket key per band."""
    rows = signatures.reshape(len(signatures), rules.bands, rules.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, rules.bands + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(rules.rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, row, n_shingles, class, keys) of each row of (doc_id, row, text); class and keys are null without shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(raw_texts(batch, "text"), rules.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys(np.stack([signature(sets[i], rules) for i in full]), rules)):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array(list(map(len, sets)), pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "n_shingles", "class", "keys"])

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, class binary, keys array<long>")


# ---- links inside clusters of candidates ----

BLOCK = "cluster long, slot long, ids binary, sizes binary, shingles binary"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["shingles"], "<u8")


def _block_links(a: tuple, b: tuple, percent: int) -> list[tuple[int, int]]:
    """Linked pairs between the classes of two blocks, as a forest (no pair whose ends are joined already)."""
    ids_a, sizes_a, shingles_a = a
    ids_b, sizes_b, shingles_b = b
    order = np.argsort(shingles_a, kind="stable")
    index, owner = shingles_a[order], np.repeat(np.arange(len(ids_a)), sizes_a)[order]
    root = {int(i): int(i) for i in [*ids_a, *ids_b]}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, stop = [], np.cumsum(sizes_b)
    for k, (y, size) in enumerate(zip(ids_b.tolist(), sizes_b.tolist())):
        own = shingles_b[stop[k] - size:stop[k]]
        lo, hi = np.searchsorted(index, own, "left"), np.searchsorted(index, own, "right")
        n = hi - lo
        hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(ids_a))
        for i in np.flatnonzero(100 * common >= percent * (sizes_a + size - common)).tolist():
            p, q = find(int(ids_a[i])), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(ids_a[i]), y))
    return out


def _links(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of rows that hold one block (a) or two (a, b)."""
    two = "b" in pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                a = _unpack(batch.column("a")[row].as_py())
                found += _block_links(a, _unpack(batch.column("b")[row].as_py()) if two else a, percent)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _packed(members: DataFrame, slots: str) -> DataFrame:
    """Blocks of the rows (cluster, id, shingles), dealt over as many slots per cluster as the expression says."""
    def pack(table: pa.Table) -> pa.Table:
        sets = table.column("shingles").to_pylist()
        row = {"cluster": table.column("cluster")[0].as_py(), "slot": table.column("slot")[0].as_py(),
               "ids": np.array(table.column("id").to_pylist(), "<i8").tobytes(),
               "sizes": np.array([len(s) // 8 for s in sets], "<i8").tobytes(), "shingles": b"".join(sets)}
        schema = pa.schema([("cluster", pa.int64()), ("slot", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("shingles", pa.binary())])
        return pa.Table.from_pylist([row], schema=schema)

    slot = F.expr(f"pmod(xxhash64(id), {slots})").cast("long")
    return members.select("cluster", slot.alias("slot"), "id", "shingles").groupBy("cluster", "slot").applyInArrow(pack, BLOCK)


def _shingled(docs: DataFrame, words: int, extra: str) -> DataFrame:
    """The rows with their text replaced by its shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = pa.array([s.astype("<u8").tobytes() for s in shingle_sets(raw_texts(batch, "text"), words)], pa.binary())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sets], [*keep, "shingles"])

    return docs.mapInArrow(run, f"{extra}, shingles binary")


def _block(side: DataFrame, name: str) -> DataFrame:
    return side.select("cluster", F.struct("ids", "sizes", "shingles").alias(name))


def _judged(df: DataFrame, id_col: str, text_col: str, rules: NearRules) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) of every row; ``row`` is a hash of the text."""
    docs = df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), df[text_col].cast("string").alias("text"))
    signed = stored(signatures(docs.withColumn("row", F.xxhash64("text")), rules), "signatures")
    # a class is a node of its own, numbered as the table is written; one of its rows stands for it
    classes = signed.filter("class IS NOT NULL").groupBy("class") \
        .agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")) \
        .select("class", "least.doc_id", "least.row", "n", "keys", F.monotonically_increasing_id().alias("id"))
    classes = stored(classes, "classes")

    members = classes.select("id", F.explode("keys").alias("key"))
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head < last").drop("last")
    near = members.join(spread(heads), "key").filter("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct()
    clusters = components(near, "candidates").withColumnRenamed("node", "id").join(classes.select("id", "doc_id", "row", "n"), "id")
    clusters = stored(clusters.withColumnRenamed("component", "cluster"), "clusters")

    weight = stored(clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / rules.block_shingles).cast("long").alias("slots")), "cluster-sizes")
    placed = clusters.join(weight, "cluster").select("id", "doc_id", "row", "cluster", "slots")

    def packed(chosen: DataFrame) -> DataFrame:
        """Blocks of the chosen rows of ``placed``; rows that repeat an id and text give one set."""
        texts = docs.withColumn("row", F.xxhash64("text")).join(chosen, ["doc_id", "row"]).select("cluster", "slots", "id", "text")
        sets = _shingled(texts, rules.words, "cluster long, slots long, id long")
        return _packed(sets.groupBy("cluster", "slots", "id").agg(F.first("shingles").alias("shingles")), "slots")

    blocks = stored(packed(placed), "blocks")

    links = stored(_links(_block(blocks, "a").drop("cluster"), rules.percent), "links")
    large = weight.filter("slots > 1").select("cluster")
    if not large.isEmpty():
        wide = blocks.join(large, "cluster")
        first = wide.filter("slot = 0")
        more = _links(_block(first, "a").join(_block(wide.filter("slot > 0"), "b"), "cluster").drop("cluster"), rules.percent)
        links = stored(links.union(more), "links")
        # those outside the largest component of their cluster meet all blocks
        own = components(links, "links").withColumnRenamed("component", "own")
        state = placed.join(large, "cluster").join(own.withColumnRenamed("node", "id"), "id", "left").withColumn("own", F.coalesce("own", "id"))
        state = stored(state, "states")
        sizes = state.groupBy("cluster", "own").count()
        largest = sizes.groupBy("cluster").agg(F.max_by("own", F.struct("count", "own")).alias("largest"))
        rest = stored(state.join(largest, "cluster").filter("own <> largest").select("id", "doc_id", "row", "cluster", "slots"), "rest")
        more = _links(_block(packed(rest), "a").join(_block(wide, "b"), "cluster").drop("cluster"), rules.percent)
        links = stored(links.union(more), "links")
    found = stored(components(links, "links").withColumnRenamed("node", "id").join(classes.select("id", "doc_id"), "id"), "found")
    least = found.groupBy("component").agg(F.min("doc_id").alias("least"))

    mapped = found.join(spread(least), "component").select("id", "least")
    by_class = classes.select("class", "id", "doc_id").join(mapped, "id", "left") \
        .select("class", F.coalesce("least", "doc_id").alias("component"))
    out = signed.drop("keys").join(by_class, "class", "left")
    mine = F.coalesce("component", "doc_id")
    real = lambda c: F.when(c != F.lit(NO_ID), c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), "row", "n_shingles", real(mine).alias("component_id"),
                      (F.col("doc_id") == mine).alias("kept"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules = NearRules()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; the smallest id of a component is kept."""
    return _judged(df, id_col, text_col, rules).drop("row")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules = NearRules()) -> DataFrame:
    """The rows of one document of each component: the smallest id (rows that repeat its id and text stay together)."""
    kept = _judged(df, id_col, text_col, rules).filter("kept").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return df.join(kept, df[id_col].eqNullSafe(kept["__id"]) & (F.xxhash64(df[text_col].cast("string")) == kept["__row"]), "left_semi")
