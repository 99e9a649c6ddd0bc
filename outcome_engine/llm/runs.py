"""Periodic runs of words: suffix trees, longest common extensions, Lyndon roots.

A run is a stretch of words with smallest period q that is at least
``min_length`` words and ``min_power`` periods long and that no neighbouring word
extends.  For each document:

1. Ukkonen's algorithm builds the suffix trees of its words and of their
   reversal.  An Euler tour, kept as the shallowest node between neighbouring
   leaves, answers the depth of any two leaves' common ancestor with two lookups:
   that is their longest common extension.
2. The longest Lyndon word at each place, under the order of the words and its
   opposite, ends before the next smaller suffix.  Each run holds such a word as
   its root, so extending it to both sides finds every run.

Only stretches in which each ``GRAM``-word window occurs again in the document
enter the trees, joined by symbols that occur once: a run of the least length
repeats all its windows of that size, so none leaves such a stretch.

The work is one map over the documents.  The trees take about 1 KB a word of
the repeating stretches of one document at a time.

Definitions for odd cases: null or empty text has no word, no run and an empty
collapsed text; null ids and repeated rows are judged one by one; of runs with
the same length the first start, then the smallest period is the longest.  An
empty table gives an empty one; further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import by_text, raw_texts


@dataclass(frozen=True)
class RunRules:
    """A run has at least so many words and so many periods (two periods at the least)."""
    min_length: int = 6
    min_power: int = 4

    def gram(self) -> int:
        """The longest window that every run repeats: a run of period q repeats its windows of up to length - q words."""
        shortest = min(max(self.min_length, self.min_power * q) - q for q in range(1, max(2, self.min_length)))
        return max(1, shortest)


class SuffixTree:
    """Ukkonen's suffix tree of symbols >= 1, with constant-time longest common extensions."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]  # the end is a symbol of its own, smaller than all
        n = len(text)
        first, stop, link, edges = [0], [0], [0], {}
        node, edge_at, length, waiting = 0, 0, 0, 0
        base = max(text) + 1
        for i, symbol in enumerate(text):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge_at = i
                key = node * base + text[edge_at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(first)
                    first.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = first[child]
                    size = min(stop[child], i + 1) - begin
                    if length >= size:
                        node, edge_at, length = child, edge_at + size, length - size
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(first)
                    first += (begin, i)
                    stop += (begin + length, n)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * base + symbol] = split + 1
                    first[child] = begin + length
                    edges[split * base + text[begin + length]] = child
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge_at = i - waiting + 1
                else:
                    node = link[node]
        self.n = n
        self._tour(first, stop, edges, base)

    def _tour(self, first: list[int], stop: list[int], edges: dict[int, int], base: int) -> None:
        """Leaves in order, and the depth of the shallowest node that the tour passes before each."""
        n = self.n
        ordered = sorted(edges, reverse=True)  # by node, then symbol, the greatest first
        children: dict[int, list[int]] = {}
        for key in ordered:
            children.setdefault(key // base, []).append(edges[key])
        order, shared = [], []
        stack = [(0, 0, 0)]
        while stack:
            node, above, between = stack.pop()
            depth = above + stop[node] - first[node]
            below = children.get(node)
            if below is None:
                order.append(n - depth)
                shared.append(between)
                continue
            for child in below[:-1]:
                stack.append((child, depth, depth))
            stack.append((below[-1], depth, between))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.least = [np.array(shared, np.int32)]
        width = 1
        while 2 * width <= n:
            self.least.append(np.minimum(self.least[-1][:-width], self.least[-1][width:]))
            width *= 2

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of symbols that the different suffixes at ``a`` and ``b`` share at their start."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out


def _lyndon_ends(rank: list[int]) -> list[int]:
    """For each place the next one whose suffix ranks lower: the end of the longest Lyndon word there."""
    out, open_at = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_at and rank[open_at[-1]] > r:
            out[open_at.pop()] = i
        open_at.append(i)
    return out


def find_runs(symbols: list[int], rules: RunRules = RunRules()) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period; symbols are >= 1."""
    n = len(symbols)
    if n < rules.min_length:
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = ahead.rank[:n]
    found = []
    for r in (rank, -rank):
        start, stop = np.arange(n), np.array(_lyndon_ends(r.tolist()))
        near = (stop - start) * rules.min_power <= n
        if r is not rank:
            near &= stop < n  # the end is no smaller symbol in the opposite order; the first one finds runs that touch it
        start, stop = start[near], stop[near]
        right, left = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        inside, behind = stop < n, start > 0
        right[inside] = ahead.extension(start[inside], stop[inside])
        left[behind] = back.extension(n - start[behind], n - stop[behind])
        period = stop - start
        length = left + period + right
        good = length >= np.maximum(rules.min_length, rules.min_power * period)
        found.append(np.stack([(start - left)[good], length[good], period[good]], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)  # the smallest period of each stretch
    new[1:] = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
    return rows[new][np.lexsort((rows[new, 2], rows[new, 0]))]


def repeating_words(codes: np.ndarray, doc: np.ndarray, gram: int, seed: int = 1) -> np.ndarray:
    """Of each word: does it lie in a window of ``gram`` words that occurs again in its document.

    Windows are compared by hash; a collision only marks more words.
    """
    inside = np.zeros(len(codes), bool)
    if len(codes) < gram:
        return inside
    rng = np.random.default_rng(seed)
    value = rng.integers(1, 2**63, int(codes.max()) + 1, np.uint64)[codes]
    last = len(codes) - gram + 1
    window = rng.integers(1, 2**63, int(doc[-1]) + 1, np.uint64)[doc[:last]]
    for j in range(gram):
        window = (window ^ value[j:j + last]) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
    at = np.flatnonzero(doc[:last] == doc[gram - 1:])
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    again = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    edge = np.bincount(again, minlength=len(codes) + 1) - np.bincount(again + gram, minlength=len(codes) + 1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(codes: np.ndarray, inside: np.ndarray, rules: RunRules = RunRules()) -> np.ndarray:
    """The runs of one document, given its words as codes >= 0 and which of them may lie in a run."""
    at = np.flatnonzero(inside)
    if len(at) < rules.min_length:
        return np.zeros((0, 3), np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(starts, append=len(at))
    long_enough = np.repeat(sizes >= rules.min_length, sizes)
    at, keep = at[long_enough], sizes >= rules.min_length
    sizes = sizes[keep]
    if not len(sizes):
        return np.zeros((0, 3), np.int64)
    local = pd.factorize(codes[at])[0] + 1
    ends = np.cumsum(sizes)
    breaks = int(local.max()) + 1 + np.arange(len(sizes) - 1)
    joined = np.insert(local, ends[:-1], breaks)
    place = np.insert(at, ends[:-1], -1)  # where each symbol stands in the document
    rows = find_runs(joined.tolist(), rules)
    rows[:, 0] = place[rows[:, 0]]
    return rows


SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RunRules = RunRules()) -> DataFrame:
    """One row per document: its runs, the longest one, and its words without the repetitions of each run's first period."""
    gram = rules.gram()

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [t.split() for t in raw_texts(batch, "text")]  # on bytes: the ASCII blanks
        sizes = np.array([len(w) for w in split], np.int64)
        doc = np.repeat(np.arange(len(split)), sizes)
        codes = pd.factorize(np.array([x for w in split for x in w], dtype=object))[0] if len(doc) else np.zeros(0, np.int64)
        inside = repeating_words(codes, doc, gram)
        ends = np.cumsum(sizes)
        marked = np.add.reduceat(np.append(inside, False), np.append(0, ends[:-1])) if len(sizes) else sizes
        out, collapsed = [], []
        for k, words in enumerate(split):
            a, b = ends[k] - sizes[k], ends[k]
            rows = runs_of(codes[a:b], inside[a:b], rules) if sizes[k] and marked[k] else np.zeros((0, 3), np.int64)
            if len(rows):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
                np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            best = rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))[0]].tolist() if len(rows) else [None] * 3
            out.append({"n_runs": len(rows), "start": best[0], "length": best[1], "period": best[2],
                        "exponent_milli": 1000 * best[1] // best[2] if len(rows) else None,
                        "runs": [{"start": s, "length": n, "period": p} for s, n, p in rows.tolist()]})
            collapsed.append(b" ".join(words))
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        column = lambda c: pa.array([r[c] for r in out], pa.list_(kind) if c == "runs" else pa.int64())
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *map(column, names), pa.array(collapsed, pa.binary()).cast(pa.string())],
                                          ["doc_id", "n_words", *names, "collapsed"])

    return by_text(df, id_col, text_col, judge, SCHEMA, 1 << 20)
