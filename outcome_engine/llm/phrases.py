"""Phrase collocations by vertical partitioning of the suffixes of all pieces.

1. Words are counted, then pairs of words that are frequent enough for a
   candidate: by short hashes first, exactly where these reach the least count.  All
   are combined in the tasks first.  A suffix ends before the first pair that is too
   rare.
2. Pairs are the first prefixes.  One that starts more suffixes than the memory
   budget is extended by a word and counted again, until each fits or has the full
   depth.  The prefixes are then grouped, in the order of their hashes, up to the
   budget.
3. Each group gets its suffixes of at most ``max_words`` words, equal ones of a
   run of documents combined, and builds its subtree independently of all others:
   sorted suffixes, the words each shares with the one before, and leaf totals
   summed at every inner node.  The counts of extended prefixes are known from 2.
4. Cuts and containment are joins of candidates with the counts of their parts.

What reaches the driver or all tasks is bounded: filters of frequent words and
pairs (fuller beyond their bound, never wrong), at most ``MAX_PREFIXES`` extended
prefixes a level and as many cells of the hash order, as the budget grows with
the number of suffixes beyond that.

Definitions for odd cases: null or empty text has no words; a null language
counts as ``und``, with documents that bear that name; every row counts, repeated
ones and null ids too; equal scores and counts are ranked by the phrase's bytes.
An empty table gives an empty one; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import sized_broadcast
from .filters import hash_filter
from .tables import raw_texts, slices, stored

BLANK = b" "
BREAK = b"\xff"  # no UTF-8 text holds this byte
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
UNIT_BYTES = 4 << 20
HELD_WORDS, HELD_PAIRS = 1 << 20, 1 << 21
MAX_PREFIXES = 1 << 22
LEAST_BUDGET, MOST_BUDGET = 1 << 16, 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PhraseRules:
    max_words: int = 5
    min_count: int = 100
    swallow_percent: int = 100  # a phrase goes if a longer candidate around it has this share of its count
    top: int = 2000


class Unit:
    """The words of a run of documents, as codes with their hashes; breaks stand between pieces."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        tokens, lang_of = [], []
        names: dict[str, int] = {}
        for text, lang in zip(texts, langs):
            own = text.lower().translate(PIECES).replace(BREAK, b" \xff ").split()
            own.append(BREAK)
            tokens += own
            lang_of.append((names.setdefault(lang, len(names)), len(own)))
        self.langs = list(names)
        lang = np.repeat([x for x, _ in lang_of], [n for _, n in lang_of]).astype(np.int64)
        code, words = pd.factorize(np.array(tokens, dtype=object)) if tokens else (np.zeros(0, np.int64), [])
        self.vocabulary = list(words)
        pair, at = np.unique(code * max(1, len(names)) + lang, return_inverse=True)
        self.lang, word = pair % max(1, len(names)), pair // max(1, len(names))
        self.word_of = word
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs]
        self.key = np.fromiter((xxhash.xxh3_64_intdigest(self.vocabulary[w], seeds[x]) for w, x in zip(word.tolist(), self.lang.tolist())),
                               np.uint64, len(pair))
        self.at = at.reshape(-1)  # each token's (word, language)
        self.is_word = np.fromiter((self.vocabulary[w] != BREAK for w in word.tolist()), bool, len(pair))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(self.at, minlength=len(self.key))
        keep = np.flatnonzero(self.is_word & (n > 0))
        return keep, n[keep]

    def pairs(self, frequent) -> tuple[np.ndarray, np.ndarray]:
        """Places of two frequent words in a row, and the hash of each such pair."""
        good = np.zeros(len(self.key), bool)
        good[self.is_word] = frequent.holds(self.key[self.is_word])
        token = good[self.at]
        place = np.flatnonzero(token[:-1] & token[1:])  # a break ends every document
        return place, _mix(self.key[self.at[place]], self.key[self.at[place + 1]])

    def suffixes(self, frequent, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of three words at least whose pairs are all frequent: place, words (``max_words`` at most), hash of the first pair."""
        words, pairs = frequent
        place, key = self.pairs(words)
        good = pairs.holds(key)
        place, key = place[good], key[good]
        last = np.ones(len(place), bool)
        last[:-1] = place[1:] != place[:-1] + 1
        stop = np.flatnonzero(last)
        size = np.minimum(stop[np.searchsorted(stop, np.arange(len(place)))] - np.arange(len(place)) + 2, max_words)
        return place[size >= 3], size[size >= 3], key[size >= 3]


def _mix(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (prefix * MIX) ^ word
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _known(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _prefixes(unit: Unit, place: np.ndarray, size: np.ndarray, pair: np.ndarray, extended: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each suffix's prefix: its first pair, longer while that is extended.  Returns its hash, its depth, and whether the suffix goes on that far."""
    key, depth = pair.copy(), np.full(len(place), 2)
    alive, open_ = np.ones(len(place), bool), np.arange(len(place))
    for level, hot in enumerate(extended, 2):
        open_ = open_[_known(hot, key[open_])]
        short = open_[size[open_] == level]
        alive[short] = False  # the suffix is an extended prefix itself, counted already
        open_ = open_[size[open_] > level]
        key[open_] = _mix(key[open_], unit.key[unit.at[place[open_] + level]])
        depth[open_] += 1
    return key, depth, alive


COUNTED = "lang string, phrase string, h long, n long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    for batch in slices(batches, "text", UNIT_BYTES):
        yield Unit(raw_texts(batch, "text"), batch.column("lang").to_pylist())


def _counted(lang: list[str], phrase: list[bytes], key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(key.view(np.int64)),
                                       pa.array(n.astype(np.int64))], ["lang", "phrase", "h", "n"])


def _summed(counts: DataFrame, label: str, min_count: int) -> DataFrame:
    return stored(counts.groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), label)


def count_words(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, h, n) of the words found ``min_count`` times, and (lang, total) of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = _counted([k[0] for k in held], [k[1] for k in held], np.array([h for h, _ in held.values()], np.uint64),
                           np.array([n for _, n in held.values()], np.int64))
            held.clear()
            return out

        for unit in _units(batches):
            keep, n = unit.counts()
            for x, w, h, c in zip(unit.lang[keep].tolist(), unit.word_of[keep].tolist(), unit.key[keep].tolist(), n.tolist()):
                lang = unit.langs[x]
                if (old := held.get((lang, unit.vocabulary[w]))) is None:
                    held[lang, unit.vocabulary[w]] = [h, c]
                else:
                    old[1] += c
                if (total := held.get((lang, BLANK))) is None:
                    held[lang, BLANK] = [0, c]
                else:
                    total[1] += c
            if len(held) > HELD_WORDS:
                yield flush()
        if held:
            yield flush()

    # a blank is no word: its row is the sum of the language
    counts = stored(docs.mapInArrow(run, COUNTED).groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
                    .filter((F.col("n") >= min_count) | (F.col("phrase") == BLANK.decode())), "words")
    return counts.filter(F.col("phrase") != BLANK.decode()), counts.filter(F.col("phrase") == BLANK.decode()).select("lang", F.col("n").alias("total"))


def _short(h: np.ndarray) -> np.ndarray:
    """40 bits of a hash, mixed anew: what counts by hash tell apart."""
    return (h >> np.uint64(24)) * MIX


def frequent_pairs(docs: DataFrame, words, min_count: int, size: int):
    """A filter of the pairs of frequent words found ``min_count`` times: counts by 40 bits of their hash.

    Pairs that share these bits are counted together, so the filter passes some
    more, which the exact counts drop.  A task combines what it counts, sorts it and
    cuts it into ranges of the hashes; an entry of a range takes four bytes.
    """
    bits = min(24, max(12, (size >> 22).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            group = (keys >> np.uint64(40 - bits)).astype(np.int64)
            entry = ((keys & np.uint64((1 << (40 - bits)) - 1)) << np.uint64(4)).astype(np.uint32) | np.minimum(counts, 15).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            many = counts >= 15
            parts = list(zip(cuts, np.append(cuts[1:], len(keys))))
            return pa.RecordBatch.from_arrays([
                pa.array(group[cuts]), pa.array([entry[a:b].tobytes() for a, b in parts], pa.binary()),
                pa.array([counts[a:b][many[a:b]].astype(np.uint32).tobytes() for a, b in parts], pa.binary())], ["range", "entries", "more"])

        for unit in _units(batches):
            _, pair = unit.pairs(words.value)
            own, n = np.unique(pair >> np.uint64(24), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > HELD_PAIRS:
                yield flush()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        group = table.column("range")[0].as_py()
        entry = np.frombuffer(b"".join(table.column("entries").to_pylist()), np.uint32)
        counts = (entry & np.uint32(15)).astype(np.int64)
        counts[counts == 15] = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint32)
        own, at = np.unique(entry >> np.uint32(4), return_inverse=True)
        total = np.bincount(at, counts, len(own))
        keys = own[total >= min_count].astype(np.uint64) | np.uint64(group << (40 - bits))
        return pa.table([pa.array(_short(keys << np.uint64(24)).view(np.int64))], ["h"])

    ranges = docs.mapInArrow(run, "range long, entries binary, more binary")
    return hash_filter(stored(ranges.groupBy("range").applyInArrow(merge, "h long"), "pair-hashes"))


def _distinct(unit: Unit, place: np.ndarray, key: np.ndarray, size: int) -> pa.RecordBatch:
    """Counts of the phrases of ``size`` words at the places; equal ones are told by their words and not by their hash."""
    columns = [unit.at[place + k] for k in range(size)]
    order = np.lexsort(columns) if size > 2 else np.argsort(columns[0] * len(unit.key) + columns[1])
    new = np.ones(len(place), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    first = np.flatnonzero(new)
    n, one = np.diff(first, append=len(place)), order[first]
    words = [[unit.vocabulary[w] for w in unit.word_of[c[one]]] for c in columns]
    lang = [unit.langs[x] for x in unit.lang[columns[0][one]]]
    return _counted(lang, list(map(b" ".join, zip(*words))), key[one], n)


def count_pairs(docs: DataFrame, frequent, min_count: int) -> DataFrame:
    """(lang, phrase, h, n) of the pairs found ``min_count`` times."""
    words, likely = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            place, key = unit.pairs(words.value)
            good = likely.value.holds(_short(key))
            if good.any():
                yield _distinct(unit, place[good], key[good], 2)

    return _summed(docs.mapInArrow(run, COUNTED), "pairs", min_count)


def _extend(docs: DataFrame, frequent, extended: list[np.ndarray], rules: PhraseRules) -> DataFrame:
    """Counts of the prefixes one word longer than the last extended ones."""
    level = len(extended) + 1
    hot = docs.sparkSession.sparkContext.broadcast(extended)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            place, size, pair = unit.suffixes([f.value for f in frequent], rules.max_words)
            key, depth, alive = _prefixes(unit, place, size, pair, hot.value)
            at = np.flatnonzero(alive & (depth == level + 1))
            if len(at):
                yield _distinct(unit, place[at], key[at], level + 1)

    return _summed(docs.mapInArrow(run, COUNTED), f"prefixes-{level + 1}", rules.min_count)


def _hot(counts: DataFrame, budget: int) -> np.ndarray:
    """Hashes of the prefixes above the budget: at most the number of words over the budget, so bounded by MAX_PREFIXES."""
    rows = counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > budget).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _cells(finals: DataFrame, budget: int, groups: int) -> np.ndarray:
    """The group of each cell of the hash order: neighbouring cells, up to the budget."""
    bits = min(22, max(4, (64 * groups).bit_length()))
    rows = finals.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.sum("n").alias("n")).collect()
    size = np.zeros(1 << bits, np.int64)
    size[[r.cell for r in rows]] = [r.n for r in rows]
    return ((np.cumsum(size) - size // 2) // max(1, budget)).astype(np.int32)


def _pack(unit: Unit, place: np.ndarray, size: np.ndarray, depth: np.ndarray, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes combined: columns of (word, language) codes with 0 behind the end, depth and number."""
    columns = np.zeros((max_words, len(place)), np.int64)
    for k in range(max_words):
        on = size > k
        columns[k, on] = unit.at[place[on] + k] + 1
    order = np.lexsort(columns)
    columns, depth = columns[:, order], depth[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any(columns[:, 1:] != columns[:, :-1], axis=0)
    first = np.flatnonzero(new)
    return columns[:, first], depth[first], np.diff(first, append=len(order))


def _suffix_blocks(docs: DataFrame, frequent, extended: list[np.ndarray], cells: np.ndarray, max_words: int) -> DataFrame:
    """(group, block): the suffixes of a unit for one group, with a vocabulary of their own."""
    hot = docs.sparkSession.sparkContext.broadcast((extended, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, cell_group = hot.value
        shift = np.uint64(64 - (len(cell_group).bit_length() - 1))
        for unit in _units(batches):
            place, size, pair = unit.suffixes([f.value for f in frequent], max_words)
            key, depth, alive = _prefixes(unit, place, size, pair, levels)
            place, size, depth = place[alive], size[alive], depth[alive]
            group = cell_group[(key[alive] >> shift).astype(np.int64)]
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            groups, blocks = [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                at = order[a:b]
                columns, deep, n = _pack(unit, place[at], size[at], depth[at], max_words)
                used, local = np.unique(columns, return_inverse=True)
                local, used = local.reshape(columns.shape).astype(np.uint32), used[used > 0] - 1
                if columns.size and columns.min() > 0:
                    local += 1  # 0 stays the end
                words = [unit.vocabulary[w] for w in unit.word_of[used]]
                langs = [unit.langs[x] for x in unit.lang[used]]
                groups.append(int(group[at[0]]))
                blocks.append({"words": words, "langs": langs, "codes": local.tobytes(), "depths": deep.astype(np.uint8).tobytes(),
                               "counts": n.astype(np.uint32).tobytes()})
            if groups:
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), *(pa.array([b[c] for b in blocks], t) for c, t in BLOCK)],
                                                 ["group", *(c for c, _ in BLOCK)])

    return docs.mapInArrow(run, "group int, words array<binary>, langs array<string>, codes binary, depths binary, counts binary")


BLOCK = [("words", pa.list_(pa.binary())), ("langs", pa.list_(pa.string())), ("codes", pa.binary()), ("depths", pa.binary()), ("counts", pa.binary())]


def subtree_counts(columns: np.ndarray, depths: np.ndarray, counts: np.ndarray, min_count: int) -> list[tuple[int, int, int]]:
    """(row, words, total) of each node below the pairs with at least ``min_count``: the phrase is the first words of that row.

    ``columns`` holds a suffix a column, 0 behind its end; the subtree is the sorted
    suffixes with the number of words that each shares with the one before.
    """
    order = np.lexsort(columns[::-1])
    columns, depths, counts = columns[:, order], depths[order], counts[order]
    differ = np.ones(columns.shape, bool)
    differ[:, 1:] = columns[:, 1:] != columns[:, :-1]
    shared = np.where(differ.any(0), differ.argmax(0), len(columns))
    out = []
    for size in range(3, len(columns) + 1):
        first = np.flatnonzero(shared < size)
        total = np.add.reduceat(counts, first) if len(first) else counts[:0]
        good = (columns[size - 1, first] > 0) & (depths[first] <= size) & (total >= min_count)
        out += [(int(order[i]), size, int(n)) for i, n in zip(first[good], total[good])]
    return out


def _subtrees(blocks: DataFrame, rules: PhraseRules) -> DataFrame:
    """(lang, phrase, n) of the frequent phrases below the prefixes of each group."""
    def build(table: pa.Table) -> pa.Table:
        names: dict[tuple[str, bytes], int] = {}
        columns, depths, counts = [], [], []
        for row in range(table.num_rows):
            words, langs, codes, deep, n = (table.column(c)[row].as_py() for c, _ in BLOCK)
            own = np.array([0, *(names.setdefault(k, len(names) + 1) for k in zip(langs, words))], np.int64)
            columns.append(own[np.frombuffer(codes, np.uint32).reshape(rules.max_words, -1)])
            depths.append(np.frombuffer(deep, np.uint8))
            counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
        columns, keys = np.concatenate(columns, 1), [("", b""), *names]
        found = subtree_counts(columns, np.concatenate(depths), np.concatenate(counts), rules.min_count)
        phrases = [b" ".join(keys[c][1] for c in columns[:size, i]) for i, size, _ in found]
        return pa.table([pa.array([keys[columns[0, i]][0] for i, _, _ in found], pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                         pa.array([n for *_, n in found], pa.int64())], ["lang", "phrase", "n"])

    return blocks.groupBy("group").applyInArrow(build, "lang string, phrase string, n long")


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", rules: PhraseRules = PhraseRules(),
                  budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of one to ``max_words`` words found ``min_count`` times, and (lang, total) of all words."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), df[text_col].cast("string").alias("text"))
    common, totals = count_words(docs, rules.min_count)
    size = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    words = hash_filter(common)
    pairs = count_pairs(docs, (words, frequent_pairs(docs, words, rules.min_count, size)), rules.min_count)
    known = [common.select("lang", "phrase", "n"), pairs.select("lang", "phrase", "n")]
    size = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    if budget is None:
        budget = max(LEAST_BUDGET, min(MOST_BUDGET, size // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    budget = max(1, budget, size // MAX_PREFIXES)
    if not size or rules.max_words < 3:
        return stored(reduce(DataFrame.unionByName, known), "phrases"), stored(totals, "totals")
    frequent = (words, hash_filter(pairs))
    counts, extended, finals = pairs, [], []
    while True:
        hot = _hot(counts, budget) if len(extended) < rules.max_words - 2 else np.zeros(0, np.uint64)
        marks = spark.createDataFrame([(int(x),) for x in hot.view(np.int64)], "h long") if len(hot) else None
        finals.append(counts.join(F.broadcast(marks), "h", "left_anti") if len(hot) else counts)
        if extended and len(hot):
            known.append(counts.join(F.broadcast(marks), "h", "left_semi").select("lang", "phrase", "n"))
        if not len(hot):
            break
        extended.append(hot)
        counts = _extend(docs, frequent, extended, rules)
    cells = _cells(reduce(DataFrame.unionByName, [f.select("h", "n") for f in finals]), budget, size // budget + 1)
    blocks = _suffix_blocks(docs, frequent, extended, cells, rules.max_words)
    known.append(_subtrees(blocks, rules))
    return stored(reduce(DataFrame.unionByName, known), "phrases"), stored(totals, "totals")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", rules: PhraseRules = PhraseRules(),
                 budget: int | None = None) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    counts, totals = phrase_counts(df, lang_col, text_col, rules, budget)
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    found = counts.withColumn("m", size).filter("m >= 2").withColumnRenamed("n", "a")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    parts = cuts.select("lang", "phrase", "m", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.expr("substring_index(phrase, ' ', k)").alias("part"), F.col("k").alias("words")),
        F.struct(F.lit(False).alias("left"), F.expr("substring_index(phrase, ' ', k - m)").alias("part"), (F.col("m") - F.col("k")).alias("words"))))
        .alias("p")).select("lang", "phrase", "m", "a", "k", "p.*")
    known = sized_broadcast(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))[0]
    both = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k") \
        .agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    scored = both.join(sized_broadcast(totals)[0], "lang").withColumnRenamed("total", "n") \
        .withColumn("top", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n")).withColumn("below", big("l") * big("r")) \
        .withColumn("score", F.expr("top div below"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # a longer candidate around a phrase passes its count on to the ones in between, so one word more is enough
    around = parts.filter("words = m - 1").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left") \
        .filter(F.col("longer").isNull() | (big("longer") * 100 < big("a") * rules.swallow_percent))
    ranked = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= rules.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
