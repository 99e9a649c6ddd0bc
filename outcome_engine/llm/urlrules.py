"""URL filters: all wildcard rules at once by a bit-parallel automaton.

Each rule is one glob over the canonical URL ``host + path``.  Every position
between two pattern characters is one bit; the bits of all rules lie one after
the other in multiword Shift-And masks, and one step moves the states of all
rules over the next byte of every URL of a slice:

    state = (((state << 1) | first) & follow[byte]) | (state & loop[byte])

``?`` takes any byte, ``*`` any run of bytes, and ``%`` any run of host labels:
nothing, or bytes that end in a dot and hold no slash.

No shuffle.  The rules are broadcast within the closure: ``MAX_RULE_BYTES``
bounds them.  A null URL, or one without ``://``, has an empty host and path, so
only rules that match the empty string fit it, and its verdict is ``missing``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_RULE_BYTES = 4 << 20
WORD = 64


@dataclass(frozen=True)
class UrlRule:
    """A host and a path prefix; fits the host, its subdomains and all paths below."""
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"%{self.host}{self.path}*"


#: What the method blocks where no rule fits: globs over host + path.
METHOD_GLOBS = ("*casino*", "*gambl*", "*-bets.*", "*spam*", "*ads-*", "*tracker*", "*porn*", "*/wp-login*", "*.exe")


class GlobAutomaton:
    """Patterns packed into Shift-And masks; ``match`` gives a (URLs x patterns) truth table."""

    def __init__(self, globs: Sequence[str]):
        if sum(map(len, globs)) > MAX_RULE_BYTES:
            raise ValueError("too many rules to send to every task")
        cells: list[tuple[int | None, str | None]] = []  # per bit: the byte that leads into it, and its loop
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(len(cells))
            cells.append((None, None))
            if "%" in glob[1:]:
                raise ValueError("a run of labels stands at the start of a glob only")
            for c in glob.encode():
                if c == ord("*"):
                    cells[-1] = (cells[-1][0], "any")
                elif c == ord("%"):
                    cells[-1] = (None, "labels")
                    cells.append((None, "host"))
                    cells.append((ord("."), None))
                else:
                    cells.append((-1 if c == ord("?") else c, None))
            self.last.append(len(cells) - 1)
        self.words = (len(cells) + WORD - 1) // WORD
        host = [b for b in range(256) if b not in b"/"]
        self.follow = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        skip: list[tuple[int, int]] = []  # from the start without a byte: a run of labels may be empty
        for i, (lead, loop) in enumerate(cells):
            w, bit = divmod(i, WORD)
            into = np.uint64(1) << np.uint64(bit)
            if lead is not None:
                self.follow[slice(None) if lead == -1 else lead, w] |= into
            if loop == "any":
                self.loop[:, w] |= into
            if loop == "host":
                self.loop[host, w] |= into
            if loop == "labels":
                skip += [(i, i + 1), (i, i + 2)]
        for i in self.first:
            self.start[i // WORD] |= np.uint64(1) << np.uint64(i % WORD)
        for _, j in skip:
            self.start[j // WORD] |= np.uint64(1) << np.uint64(j % WORD)

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(urls), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0)) + 1), "left")  # URLs longer than j
        state = np.tile(self.start, (len(urls), 1))
        for j in range(int(sizes.max(initial=0))):
            n = int(live[j])
            byte = text[begin[:n] + j]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(WORD - 1)
            state[:n] = (moved & self.follow[byte]) | (now & self.loop[byte])
        out = np.zeros((len(urls), len(self.last)), bool)
        for k, i in enumerate(self.last):
            out[order, k] = (state[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1) > 0
        return out


def canonical(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (ASCII letters in lower case) and path of a URL; both empty without ``://``."""
    _, mark, rest = (url or b"").partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def filter_urls(df: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url",
                method_globs: Sequence[str] = METHOD_GLOBS, missing: str = "block", per_slice: int = 4096) -> DataFrame:
    """One row per URL: (page_id, host, path, rule, verdict, method_rule).

    The longest fitting rule decides, the earlier one of equally long rules; else
    ``block`` if a method glob fits, ``missing`` without a host, or ``allow``.
    """
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([*(r.glob for r in rules), *method_globs])
        rank = np.array([-len(r.name.encode()) for r in rules], np.int64)
        by_rank = np.argsort(rank, kind="stable")
        for batch in batches:
            for at in range(0, batch.num_rows, per_slice):
                part = batch.slice(at, per_slice)
                split = [canonical(u) for u in part.column("url").cast(pa.binary()).to_pylist()]
                fits = automaton.match([h + p for h, p in split])
                out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": [], "method_rule": []}
                for (host, path), row in zip(split, fits):
                    hit = next((int(k) for k in by_rank if row[k]), None) if host else None
                    own = next((g for g, f in zip(method_globs, row[len(rules):]) if f), None)
                    out["host"].append(host.decode())
                    out["path"].append(path.decode())
                    out["rule"].append(None if hit is None else rules[hit].name)
                    out["verdict"].append(rules[hit].verdict if hit is not None else missing if not host else "block" if own else "allow")
                    out["method_rule"].append(own)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *(pa.array(v, pa.string()) for v in out.values())], ["page_id", *out])

    return df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, method_rule string")
