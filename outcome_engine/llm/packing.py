"""Sequence packing: cut the token stream into windows at document or sentence ends.

Order-preserving dynamic programming over the places where the stream may be
cut.  ``f[j]``, the least cost of the stream up to place j, is

    min over i with pos[j] - pos[i] <= size of  f[i] + padding(pos[j] - pos[i])  + penalty[j]

where ``padding(n)`` is 0 for a power of two and ``size - n`` otherwise, and the
penalty is 0 at the end of a document, ``sentence_cost`` at the end of a sentence
inside one, and ``hard_cost`` elsewhere.  As the padding falls with the length,
the minimum of ``f[i] + pos[i]`` over the places within reach decides, which a
monotone queue holds; the few places a power of two back are tried beside it.

Every task packs the stream of the documents that it reads, in their order, in
stretches of bounded length: a stretch gives its finished windows and hands the
rest on.  So nothing is shuffled, and padding at the end of a stream arises once
per task at most.  Sequence ids are the task's number and a counter.

Null text counts as empty and gives the end id alone; repeated rows are packed
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .encoding import encoder
from .tables import slices


@dataclass(frozen=True)
class PackRules:
    size: int = 2048
    sentence_cost: int = 8
    hard_cost: int = 64
    hard_gap: int = 256       # where no sentence ends for so many tokens, cuts are allowed at any ``hard_step``-th
    hard_step: int = 32
    least_power: int = 64     # shorter powers of two are tried near the end of the stream only
    stretch: int = 1 << 19    # tokens per run of the dynamic programme


def cut_places(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, rules: PackRules) -> tuple[np.ndarray, np.ndarray]:
    """The allowed places (ascending, the first 0 and the last ``total``) and their penalties."""
    at = np.union1d(np.concatenate([[0, total], doc_ends]), sentence_ends)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > rules.hard_gap)
    if wide.size:
        inner = (gaps[wide] - 1) // rules.hard_step
        k = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        at = np.union1d(at, np.repeat(at[wide], inner) + k * rules.hard_step)
    cost = np.full(len(at), rules.hard_cost)
    cost[np.isin(at, sentence_ends)] = rules.sentence_cost
    cost[np.isin(at, doc_ends) | (at == 0) | (at == total)] = 0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, rules: PackRules, ended: bool) -> list[int]:
    """The windows' ends; if the stream goes on, those up to the cheapest place within the last window's reach."""
    size, n = rules.size, len(at)
    jumps_to, jumps_from = [], []
    for power in (1 << k for k in range((size - 1).bit_length())):
        i = np.searchsorted(at, at - power)
        hit = np.flatnonzero((at[np.minimum(i, n - 1)] == at - power) & ((power >= rules.least_power) | ended & (at > at[-1] - 2 * size)))
        jumps_to.append(hit)
        jumps_from.append(i[hit])
    order = np.argsort(to := np.concatenate(jumps_to), kind="stable")
    to, back = [*to[order].tolist(), n], np.concatenate(jumps_from)[order].tolist()
    pos, cost_of = at.tolist(), cost.tolist()
    f, g, came = [0] * n, [0] * n, [0] * n  # g[i] = f[i] + pos[i]
    queue, head, jump = [0], 0, 0
    for j in range(1, n):
        p = pos[j]
        while pos[queue[head]] < p - size:
            head += 1
        i = queue[head]
        best = g[i] + size - p
        while to[jump] == j:
            if f[back[jump]] < best:
                i = back[jump]
                best = f[i]
            jump += 1
        best += cost_of[j]
        f[j], came[j] = best, i
        best += p
        g[j] = best
        while len(queue) > head and g[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    if ended:
        j = n - 1
    else:
        first = int(np.searchsorted(at, at[-1] - size))
        j = min(range(max(first, 1), n), key=f.__getitem__)
    ends = []
    while j:
        ends.append(pos[j])
        j = came[j]
    return ends[::-1]


@lru_cache
def sentence_table(path: str) -> np.ndarray:
    """Per id of a tokenizer file: whether its token ends a sentence."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        out[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?", "…", "。")
    return out


class _Stream:
    """The tokens of a task that are not packed yet."""

    def __init__(self, rules: PackRules, ends_sentence: np.ndarray):
        self.rules, self.ends_sentence = rules, ends_sentence
        self.ids = np.zeros(0, np.uint32)
        self.docs: list = []
        self.begin = np.zeros(0, np.int64)  # where each document begins, below 0 if packed in part
        self.tokens = np.zeros(0, np.int64)
        self.sequence = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0

    def add(self, docs: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(lengths) - lengths])
        self.tokens = np.concatenate([self.tokens, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.docs += docs

    def pack(self, ended: bool) -> pa.RecordBatch:
        doc_ends = self.begin + self.tokens
        inside = np.flatnonzero(self.ends_sentence[self.ids]) + 1
        ends = best_cuts(*cut_places(len(self.ids), doc_ends, inside, self.rules), self.rules, ended)
        done = ends[-1]
        windows = np.array([0, *ends[:-1]])
        starts = np.union1d(windows, self.begin[(self.begin >= 0) & (self.begin < done)])
        stops = np.append(starts[1:], done)
        doc = np.searchsorted(self.begin, starts, "right") - 1
        window = np.searchsorted(windows, starts, "right") - 1
        raw = pa.py_buffer(self.ids[:done].astype("<u4").tobytes())
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((4 * np.append(starts, done)).astype(np.int32).tobytes()), raw])
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.docs[d] for d in doc], pa.int64()), pa.array(starts - self.begin[doc]), pa.array(stops - starts),
             pa.array(self.tokens[doc]), pa.array(self.sequence + window), pa.array(starts - windows[window]), pieces],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        self.sequence += len(windows)
        keep = int(np.searchsorted(doc_ends, done, "right"))
        self.ids, self.docs = self.ids[done:], self.docs[keep:]
        self.begin, self.tokens = self.begin[keep:] - done, self.tokens[keep:]
        return out


def pack_documents(df: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, rules: PackRules = PackRules(),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, doc_tokens, sequence_id, offset, ids); ids are little-endian u32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind)
        stream = _Stream(rules, sentence_table(tokenizer))
        for batch in slices(batches, "text", 1 << 20):
            ids, lengths = encode.encode(batch.column("text").to_pylist(), end_id)
            stream.add(batch.column("doc_id").to_pylist(), ids, lengths)
            if len(stream.ids) >= rules.stretch:
                yield stream.pack(ended=False)
        if len(stream.ids):
            yield stream.pack(ended=True)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
