"""Benchmark decontamination over templates: also finds questions with other numbers, names or units.

Text becomes a sequence of canonical tokens: numbers, names (capitalised words
inside a sentence) and units behind a number turn into typed placeholders, other
words into lower case.  Windows of ``window`` tokens are hashed in three forms and
joined with those of the benchmark: as they are, in lower case (so a verbatim copy
in any case hits whatever its placeholders); with placeholders; and with
capitalised words that open a sentence as names, too.  Each token of an item is
aligned to one token of the document, best diagonal first, others in order and
within ``stretch`` tokens of it; the item counts as leaked if

* the windows that hit cover at least ``coverage`` of its tokens, and
* its slots are filled consistently: at least ``consistent`` of the aligned
  placeholders follow one value in the document per value in the item.

The hash join is one against broadcast slices of the benchmark: ``slice_chars``
bounds a slice, and a larger benchmark is searched slice by slice.  The
documents are not shuffled; what leaves a task is one row per leaked item.

Items of fewer than ``least_tokens`` tokens, and windows of fewer than
``least_literals`` literals, count only with equal values, whatever their length;
items shorter than a window count as one window.  Null texts have no tokens.
Rows that share an id share their verdict; null ids count as one document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep_rows, slices, sole_cache, spread


@dataclass(frozen=True)
class LeakRules:
    window: int = 8
    least_tokens: int = 5
    least_literals: int = 3   # words that are no placeholder, in a window
    coverage: float = 0.5
    consistent: float = 0.8
    stretch: int = 256        # how far hits may lie off the best diagonal
    slice_chars: int = 16 << 20


_tokens = re.compile(r"[$€£]?\d[\d.,:/]*%?|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]").findall
UNITS = frozenset("""mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons
ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years s min h
dollar dollars euro euros cent cents percent degree degrees mph kmh km/h watt watts volt volts joule joules newton newtons meter meters metre metres
kilometer kilometers kilometre kilometres centimeter centimeters""".split())
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
LITERAL, CAPITAL, NUMBER, UNIT, END = range(5)
NAME_SLOT, NUMBER_SLOT, UNIT_SLOT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"<name>", b"<number>", b"<unit>"))


def _value(token: str) -> str:
    """A token in lower case; a number without the stop behind it."""
    return token.lower().rstrip(".,:/") if token[-1] in ".,:/" else token.lower()


class _Vocabulary:
    """Each distinct token's kind and hash, remembered by a worker."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.kind, self.hash = np.zeros(0, np.uint8), np.zeros(0, np.uint64)

    def look_up(self, tokens: list[str]) -> np.ndarray:
        if len(self.place) > self.most:
            self.clear()
        sole_cache("templates", self.clear)
        at = np.fromiter(map(self.place.get, tokens, repeat(-1)), np.int64, len(tokens))
        if (unknown := np.flatnonzero(at < 0)).size:
            new = list(dict.fromkeys(tokens[i] for i in unknown))
            kinds, hashes = zip(*map(self._classify, new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.kind = np.concatenate([self.kind, np.array(kinds, np.uint8)])
            self.hash = np.concatenate([self.hash, np.array(hashes, np.uint64)])
            at[unknown] = [self.place[tokens[i]] for i in unknown]
        return at

    @staticmethod
    def _classify(token: str) -> tuple[int, int]:
        low = token.lower()
        digest = xxhash.xxh3_64_intdigest(_value(token).encode("utf-8", "surrogatepass"))
        if token in ".!?\n":
            return END, 0
        if low in NUMBER_WORDS or any(c.isdigit() for c in token):
            return NUMBER, digest
        if low in UNITS:
            return UNIT, digest
        return (CAPITAL if len(token) > 1 and token[0].isupper() and token[1:].islower() else LITERAL), digest


_VOCABULARY = _Vocabulary()


@dataclass
class Canonical:
    """Texts as canonical tokens, one after the other."""
    doc: np.ndarray       # the text of each token
    code: np.ndarray      # hash of the literal or of the placeholder
    slot: np.ndarray      # whether it is a placeholder
    opening: np.ndarray   # whether it is a capitalised word that opens a sentence: perhaps a name
    exact: np.ndarray     # hash of the value
    value: list[str]      # the token as written
    sums: dict = field(default_factory=dict)  # of each form: the longest window summed so far

    def _hashes(self, form: str, size: int) -> np.ndarray:
        """Hashes of all windows of a size, going on from a smaller size."""
        done, power, out = self.sums.get(form, (0, np.ones(1, np.uint64), None))
        if done > size or out is None:
            done, power, out = 0, np.ones(1, np.uint64), np.zeros(len(self.code) + 1, np.uint64)
        code = {"exact": self.exact, "code": self.code}.get(form)
        if code is None:
            code = np.where(self.opening, NAME_SLOT, self.code)
        n = len(code) - size + 1
        for j in range(done, size):
            power = power * np.uint64(0x9E3779B97F4A7C15)
            out = out[:len(code) - j] + code[j:] * power
        self.sums[form] = size, power, out
        out = out[:n] + np.uint64(size)
        return out ^ (out >> np.uint64(29))

    def _counts(self, form: str, size: int) -> np.ndarray:
        """How many tokens of every window are placeholders, or opening words."""
        if (form, 0) not in self.sums:
            self.sums[form, 0] = np.concatenate([[0], np.cumsum(self.slot if form == "slot" else self.opening)])
        c = self.sums[form, 0]
        return c[size:] - c[:-size]

    def windows(self, size: int, least_literals: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of a size that lie in one text: of values, or,
        if enough literals are left, with placeholders and with opening words as names."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.doc[:n] == self.doc[size - 1:]
        if least_literals is None:
            at = np.flatnonzero(inside)
            return at, self._hashes("exact", size)[at]
        slots, openings = self._counts("slot", size), self._counts("opening", size)
        a = np.flatnonzero(inside & (slots > 0) & (size - slots >= least_literals))  # without slots the values are the window
        b = np.flatnonzero(inside & (openings > 0) & (size - slots - openings >= least_literals))
        return np.concatenate([a, b]), np.concatenate([self._hashes("code", size)[a], self._hashes("named", size)[b]])


def canonical(texts: list[str | None]) -> Canonical:
    found = [_tokens(t) if t else [] for t in texts]
    tokens = [t for f in found for t in f]
    at = _VOCABULARY.look_up(tokens)
    doc = np.repeat(np.arange(len(texts)), list(map(len, found)))
    kind, code = _VOCABULARY.kind[at], _VOCABULARY.hash[at].copy()
    exact = code.copy()
    opens = np.concatenate([[True], (kind[:-1] == END) | (doc[1:] != doc[:-1])])[:len(kind)]
    after_number = np.concatenate([[False], (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])])[:len(kind)]
    name, unit, number = (kind == CAPITAL) & ~opens, (kind == UNIT) & after_number, kind == NUMBER
    code[name], code[unit], code[number] = NAME_SLOT, UNIT_SLOT, NUMBER_SLOT
    keep = np.flatnonzero(kind != END)
    return Canonical(doc[keep], code[keep], (name | unit | number)[keep], ((kind == CAPITAL) & opens)[keep], exact[keep],
                     [tokens[i] for i in keep.tolist()])


@dataclass
class Index:
    """A slice of the benchmark: sorted window hashes with item and place, and the items' slots."""
    items: list[list[int]]              # ids of equal items
    sizes: np.ndarray                   # tokens per item
    windows: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]  # by size, exact or not: hash, item, place
    slots: list[dict[int, str]]
    bits: dict[tuple[int, bool], np.ndarray]

    def look_up(self, key: tuple[int, bool], hashes: np.ndarray) -> np.ndarray:
        """Which hashes occur: a bitmap first, then the sorted hashes."""
        bits, (own, _, _) = self.bits[key], self.windows[key]
        maybe = np.flatnonzero(bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)])
        left = np.searchsorted(own, hashes[maybe])
        return maybe[own[np.minimum(left, len(own) - 1)] == hashes[maybe]]


def build_index(rows: list[tuple[int, str | None]], rules: LeakRules) -> Index:
    same: dict[str, list[int]] = defaultdict(list)
    for item, text in rows:
        same[text or ""].append(item)
    texts = list(same)
    c = canonical(texts)
    sizes = np.bincount(c.doc, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    windows, bits = {}, {}
    for size in sorted({min(rules.window, int(n)) for n in sizes if n}):
        for exact in (True, False):
            if not exact and size < rules.least_tokens:
                continue
            at, hashes = c.windows(size, None if exact else rules.least_literals)
            item = c.doc[at]
            fits = (np.minimum(sizes, rules.window) == size)[item]
            at, hashes, item = at[fits], hashes[fits], item[fits]
            order = np.argsort(hashes, kind="stable")
            if order.size:
                windows[size, exact] = hashes[order], item[order], (at - first[item])[order]
                bits[size, exact] = np.zeros(1 << max(16, int(64 * len(order)).bit_length()), bool)
                bits[size, exact][(hashes & np.uint64(len(bits[size, exact]) - 1)).astype(np.int64)] = True
    slots: list[dict[int, str]] = [{} for _ in texts]
    for i in np.flatnonzero(c.slot | c.opening).tolist():
        slots[c.doc[i]][i - int(first[c.doc[i]])] = _value(c.value[i])
    return Index(list(same.values()), sizes, windows, slots, bits)


def _align(best: int, near: list[int], tokens: dict[int, set[int]]) -> dict[int, int]:
    """Item tokens to document tokens: those of the best diagonal, then of others where order is kept."""
    out = {q: best + q for q in tokens[best]}
    taken = sorted(out)
    for d in sorted(near, key=lambda d: (-len(tokens[d]), abs(d - best), d)):
        if d == best:
            continue
        for q in sorted(tokens[d] - out.keys()):
            i = bisect_left(taken, q)
            if (i == 0 or out[taken[i - 1]] < d + q) and (i == len(taken) or d + q < out[taken[i]]):
                taken.insert(i, q)
                out[q] = d + q
    return out


def leaks(texts: list[str | None], index: Index, rules: LeakRules) -> list[tuple[int, int, float, float, bool]]:
    """(text, item, coverage, consistency, other values) of every leaked item; items by their place in the index."""
    c = canonical(texts)
    hits: dict[tuple[int, int], tuple[dict[int, set[int]], Counter]] = defaultdict(lambda: (defaultdict(set), Counter()))
    for (size, exact), (own, items, places) in index.windows.items():
        at, hashes = c.windows(size, None if exact else rules.least_literals)
        for i in index.look_up((size, exact), hashes).tolist():
            lo, hi = np.searchsorted(own, hashes[i], "left"), np.searchsorted(own, hashes[i], "right")
            for item, place in zip(items[lo:hi].tolist(), places[lo:hi].tolist()):
                tokens, equal = hits[int(c.doc[at[i]]), item]
                tokens[int(at[i]) - place].update(range(place, place + size))
                equal[int(at[i]) - place] += exact
    out = []
    for (doc, item), (tokens, equal) in hits.items():
        diagonals = sorted(tokens)
        # another copy in the text may hold where the best one does not
        for best in sorted(tokens, key=lambda d: (-len(tokens[d]), -equal[d], d)):
            near = diagonals[bisect_left(diagonals, best - rules.stretch):bisect_right(diagonals, best + rules.stretch)]
            if sum(len(tokens[d]) for d in near) < rules.coverage * int(index.sizes[item]):
                continue
            pairs = _align(best, near, tokens)
            coverage = len(pairs) / int(index.sizes[item])
            if coverage < rules.coverage:
                continue
            values: dict[str, Counter] = defaultdict(Counter)
            for q, p in pairs.items():
                if (own := index.slots[item].get(q)) is not None:
                    values[own][_value(c.value[p])] += 1
            total = sum(sum(v.values()) for v in values.values())
            agree = sum(max(v.values()) for v in values.values()) / total if total else 1.0
            if agree >= rules.consistent:
                out.append((doc, item, coverage, agree, any(v.most_common(1)[0][0] != own for own, v in values.items())))
                break
    return out


def _slices(benchmark: DataFrame, item_col: str, text_col: str, rules: LeakRules) -> Iterator[Broadcast]:
    """The benchmark as broadcast (index, ids of each entry), in slices of at most about ``slice_chars``."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].cast("string").alias("text"))
    # equal items lie in one slice and are one entry of its index
    chars = items.select("text").distinct().agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // rules.slice_chars))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        rows = part.groupBy("text").agg(F.collect_set("item").alias("items")).collect()  # bounded by slice_chars
        yield benchmark.sparkSession.sparkContext.broadcast((build_index([(i, r["text"]) for i, r in enumerate(rows)], rules), [sorted(r["items"]) for r in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", rules: LeakRules = LeakRules()) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, other_values) of every benchmark item that a document holds."""
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id long, items array<long>, coverage double, consistency double, other_values boolean"
    found = None
    for shared in _slices(benchmark, item_col, item_text_col, rules):
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value
            for batch in slices(batches, "text", 1 << 20):
                hits = leaks(batch.column("text").to_pylist(), index, rules)
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([h[0] for h in hits])),
                         pa.array([ids[index.items[h[1]][0]] for h in hits], pa.list_(pa.int64())), pa.array([h[2] for h in hits], pa.float64()),
                         pa.array([h[3] for h in hits], pa.float64()), pa.array([h[4] for h in hits], pa.bool_())],
                        ["doc_id", "items", "coverage", "consistency", "other_values"])

        one = plain.mapInArrow(run, schema)
        found = one if found is None else found.union(one)
    return found.select("doc_id", F.explode("items").alias("item_id"), "coverage", "consistency", "other_values")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  rules: LeakRules = LeakRules()) -> DataFrame:
    """The rows that hold no benchmark item; one filter per slice of the benchmark."""
    for shared in _slices(benchmark, item_col, item_text_col, rules):
        def judge(texts: list[str | None], shared=shared) -> list[bool]:
            bad = {h[0] for h in leaks(texts, shared.value[0], rules)}
            return [i not in bad for i in range(len(texts))]

        docs = keep_rows(docs, text_col, judge)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(doc_id, contaminated, kept, item_ids, coverage, other_values) of every row of the documents."""
    by_doc = find_leaks(docs, benchmark, id_col, text_col, **names).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),  # at most the benchmark's items
        F.max("coverage").alias("coverage"), F.max("other_values").alias("other_values"))
    by_doc = spread(by_doc)
    rows = docs.select(docs[id_col].cast("long").alias("id"))
    found = F.col("item_ids").isNotNull()
    return rows.join(by_doc, rows["id"].eqNullSafe(by_doc["doc_id"]), "left").select(
        F.col("id").alias("doc_id"), found.alias("contaminated"), (~found).alias("kept"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("other_values", F.lit(False)).alias("other_values"))
