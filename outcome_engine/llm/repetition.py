"""Quality rules from repetition: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths are made in numpy for a slice of
documents at once; equal hashes are confirmed word by word, so a collision
never counts.  No shuffle: every document is judged in the task that reads it.

Null text counts as empty: no words, so the base rule fails.  Repeated rows are
judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import by_text, raw_texts

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Largest share of a text's word characters.

    The shares are those published with the Gopher corpus and 0.10 more, as short
    texts count here too: in them one line at head and foot makes 0.15.
    """
    top: tuple[tuple[int, float], ...] = ((2, 0.30), (3, 0.28), (4, 0.26))
    repeated: tuple[tuple[int, float], ...] = ((5, 0.25), (6, 0.24), (7, 0.23), (8, 0.22), (9, 0.21), (10, 0.20))
    line_chars: float = 0.30
    lines: float = 0.30
    min_words: int = 10
    base_length: int = 5
    base_percent: int = 20


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, dup_line_chars long, repeated_chars array<long>, top_chars array<long>")


def _sums(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weights, n).astype(np.int64)


def _repeats(codes: np.ndarray, window: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that start at ``at``: those found twice or more in their document, and each one's group.

    Raises ArithmeticError if two different windows share a hash.
    """
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    for j in range(n):
        if np.any(codes[order[1:] + j][same] != codes[order[:-1] + j][same]):
            raise ArithmeticError
    if np.any(doc[order[1:]][same] != doc[order[:-1]][same]):
        raise ArithmeticError
    group = np.concatenate([[0], np.cumsum(~same)]) if order.size else np.zeros(0, np.int64)
    many = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if order.size else np.zeros(0, bool)
    return order[many], group[many]


def _measure(texts: list[bytes], rules: RepetitionRules, seed: int = 1) -> dict[str, np.ndarray]:
    n_docs, data = len(texts), b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    doc_start = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stop = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    doc = np.searchsorted(doc_start, start, "right") - 1
    size = chars[stop] - chars[start]
    codes, distinct = pd.factorize(np.array(data.split(), dtype=object))
    out = {"n_words": _sums(doc, n_docs), "word_chars": _sums(doc, n_docs, size)}
    symbol = np.flatnonzero(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)))
    out["n_symbols"] = _sums(np.searchsorted(doc_start, symbol, "right") - 1, n_docs)

    line_start = np.concatenate([[0], np.flatnonzero(raw == 10)[:-1] + 1])
    line_doc = np.searchsorted(doc_start, line_start, "right") - 1
    line_code = pd.factorize(np.array(data[:-1].split(b"\n"), dtype=object))[0].astype(np.int64)
    _, first = np.unique(line_doc * (len(line_start) + 1) + line_code, return_index=True)
    again = np.ones(len(line_start), bool)
    again[first] = False
    line_stop = np.concatenate([line_start[1:], [len(raw)]]) - 1
    again &= np.searchsorted(start, line_stop) > np.searchsorted(start, line_start)
    out["n_lines"] = _sums(line_doc, n_docs)
    out["n_dup_lines"] = _sums(line_doc[again], n_docs)
    out["dup_line_chars"] = _sums(line_doc[again], n_docs, (chars[line_stop] - chars[line_start])[again])

    rng = np.random.default_rng(seed)
    value = rng.integers(1, 2**63, len(distinct) + 1, np.uint64)[codes]
    window = rng.integers(1, 2**63, n_docs + 1, np.uint64)[doc]  # a window only equals those of its document
    power, base = np.ones(1, np.uint64), np.uint64(rng.integers(1, 2**62) * 2 + 1)
    ends = np.concatenate([[0], np.cumsum(size)])
    top_of, repeated_of = dict(rules.top), dict(rules.repeated)
    out |= {f"top_{n}": np.zeros(n_docs, np.int64) for n in top_of} | {f"repeated_{n}": np.zeros(n_docs, np.int64) for n in repeated_of}
    out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    at = np.arange(len(codes))
    for n in range(1, max([*top_of, *repeated_of, rules.base_length]) + 1):
        last = len(codes) - n + 1
        if last <= 0:
            break
        window = window[:last] + value[n - 1:] * power
        power = power * base
        at = at[at < last]
        at = at[doc[at] == doc[at + n - 1]]
        if n < 2:
            continue
        at, group = _repeats(codes, window, doc, at, n)  # a longer repeat starts with a shorter one
        if n in top_of and at.size:
            _, one, count = np.unique(group, return_index=True, return_counts=True)
            np.maximum.at(out[f"top_{n}"], doc[at[one]], count * (ends[at[one] + n] - ends[at[one]]))
        if n in repeated_of or n == rules.base_length:
            edge = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + n, minlength=len(codes) + 1)
            inside = np.cumsum(edge[:-1]) > 0
            if n in repeated_of:
                out[f"repeated_{n}"] = _sums(doc[inside], n_docs, size[inside])
            if n == rules.base_length:
                out["n_repeat_words"] = _sums(doc[inside], n_docs)
    return out


def measure(texts: list[bytes], rules: RepetitionRules = RepetitionRules()) -> dict[str, np.ndarray]:
    """The counts of each text, with another hash if two different n-grams share one."""
    for seed in range(1, 100):
        try:
            m = _measure(texts, rules, seed)
            break
        except ArithmeticError:
            continue
    m["base_failed"] = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.base_percent * m["n_words"])
    bad = m["base_failed"].copy()
    for n, share in rules.top:
        bad |= m[f"top_{n}"] > share * m["word_chars"]
    for n, share in rules.repeated:
        bad |= m[f"repeated_{n}"] > share * m["word_chars"]
    bad |= m["dup_line_chars"] > rules.line_chars * m["word_chars"]
    bad |= m["n_dup_lines"] > rules.lines * m["n_lines"]
    return m | {"kept": ~bad}


def repetition_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per document: the base counts and verdict, the method's shares and its verdict."""
    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(raw_texts(batch, "text"), rules)
        lists = [pa.array(list(np.stack([m[f"{kind}_{n}"] for n, _ in by], 1)), pa.list_(pa.int64()))
                 for kind, by in (("repeated", rules.repeated), ("top", rules.top))]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "dup_line_chars"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(m[c]) for c in names), *lists],
                                          ["doc_id", *names, "repeated_chars", "top_chars"])

    return by_text(df, id_col, text_col, judge, SCHEMA)
