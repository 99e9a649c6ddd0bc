"""Tokenizer calls with a cache of text atoms.

A pre-tokenizer never joins characters over certain places of a text, so a text
can be cut there into atoms, every distinct atom encoded once, and the ids of
the text put together from the atoms' ids.  The ids equal those of encoding the
whole text in one call (``tests/llm/test_encoding.py`` compares both).

``word``  runs without white space: for pre-tokenizers that drop white space and
          lower the case.
``byte``  a run with the one space before it, or white space by itself: for
          byte-level pre-tokenizers, in which a space belongs to the next word.

Atoms are cut out of a slice's bytes at once, and Arrow finds the different ones among
them, so Python looks up each atom once a slice.  A pattern cuts texts with odd white space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa

from .tables import sole_cache

#: Unicode White_Space, which is what \s means in the tokenizers' patterns (fixed values).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
END = "\ud801"  # in no valid text
#: Distinct atoms that a worker remembers; beyond it the cache starts anew (bounded memory).
MAX_ATOMS = 1_000_000
#: Runs that one call of the tokenizer encodes.
JOINED = 256

_run = re.compile(f"[^{WS}]+")
_byte_atom = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]")
#: Punctuation behind a letter starts a pre-token in both kinds; an apostrophe may not.
TAIL = ".,;:!?*#$%&|"


def word_atoms(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' atoms in UTF-8, a blank behind each, where each atom begins, and each text's number of atoms."""
    cut = []
    for t in texts:
        # printable characters hold no white space but the blank; these two letters have a lower case of their own kind
        if not t.replace("\n", "").isprintable() or "Σ" in t or "İ" in t:
            t = " ".join(_run.findall(t))
        else:
            t = t.lower().replace("\n", " ")
            if "  " in t or t[:1] == " " or t[-1:] == " ":
                t = " ".join(t.split())
        cut.append(f"{t} ".encode() if t else b"")
    data = b"".join(cut)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    bounds = np.cumsum([0, *map(len, cut)])
    return data, np.concatenate([[0], ends])[:len(ends)], np.diff(np.searchsorted(ends, bounds, "right"))


def byte_atoms(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts in UTF-8, where each atom begins, and each text's number of atoms."""
    cut = [t.encode() for t in texts]
    data = b"".join(cut)
    raw, bounds = np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, cut)])
    line = raw == 10
    white = (raw == 32) | line
    begins = white.copy()
    begins[1:] |= line[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    # white space beside white space, or of another kind, needs the pattern
    odd = set(np.searchsorted(bounds, np.flatnonzero(white[1:] & white[:-1]), "right") - 1)
    odd.update(i for i, t in enumerate(texts) if not t.replace("\n", "").isprintable())
    for i in odd:
        sizes = [len(a.encode()) for a in _byte_atom.findall(texts[i])]
        begins[bounds[i]:bounds[i + 1]] = False
        begins[bounds[i] + np.cumsum([0, *sizes[:-1]])] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.diff(np.searchsorted(starts, bounds))


class _Grown:
    """An array that grows at its end, without a copy of the whole each time."""

    def __init__(self, dtype: type):
        self.held, self.n = np.empty(1 << 10, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.empty(max(len(values), self.n // 2 + 1), self.held.dtype)])
        self.held[self.n:self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.held[:self.n]


class AtomEncoder:
    """Encodes whole texts to id arrays; one instance lives in each Python worker."""

    def __init__(self, path: str, kind: str, max_atoms: int = MAX_ATOMS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.atoms = word_atoms if kind == "word" else byte_atoms
        self.spaced, self.max_atoms = kind == "byte", max_atoms
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self._start, self._size, self._ids = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the atoms at these places, one after the other, and each atom's end among them."""
        sizes = self._size.values[at]
        ends = np.cumsum(sizes)
        return self._ids.values[np.arange(ends[-1] if ends.size else 0) + np.repeat(self._start.values[at] - ends + sizes, sizes)], ends

    def _add(self, keys: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self._start.add(self._ids.n + np.cumsum(size) - size)
        self._size.add(size)
        self._ids.add(ids)
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys))))

    def _joined(self, keys: list[str]) -> tuple[Iterator[int], np.ndarray]:
        """The ids of keys that a blank keeps apart, one after the other, and each key's number of ids."""
        chunks = [keys[i:i + JOINED] for i in range(0, len(keys), JOINED)]
        encoded = self.tokenizer.encode_batch(["".join(c) for c in chunks], add_special_tokens=False)
        sizes = [np.zeros(0, np.int64)]
        for chunk, e in zip(chunks, encoded):
            ends = np.cumsum(np.fromiter(map(len, chunk), np.int64, len(chunk)))
            begins = np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e))
            sizes.append(np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(chunk)))
        return chain.from_iterable(e.ids for e in encoded), np.concatenate(sizes)

    def _learn(self, keys: list[str]) -> None:
        blank = "" if self.spaced else " "  # behind a word
        made, cores, tails, whole = [], [], [], []
        for k in keys:
            if k[-1 - len(blank):][:1] not in TAIL:
                whole.append(k)
                continue
            core = k.rstrip(TAIL + blank)
            if core[-1:].isalpha():
                made.append(k)
                cores.append(core + blank)
                tails.append(k[len(core):])
            else:
                whole.append(k)
        place = self.place
        whole = [k for k in dict.fromkeys(chain(whole, cores, tails)) if k not in place]
        # a blank between two runs keeps them apart, so many runs take one call; the tokens' offsets tell whose they are
        apart = [k for k in whole if k[0] != " " or k[1:].strip() != k[1:] or len(k) == 1] if self.spaced else []
        if apart:
            left_out = set(apart)
            whole = [k for k in whole if k not in left_out]
        ids, size = self._joined(whole)
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)]
        size = np.concatenate([size, np.fromiter(map(len, encoded), np.int64, len(encoded))])
        self._add(whole + apart, np.fromiter(chain(ids, chain.from_iterable(encoded)), np.uint32, int(size.sum())), size)
        if made:
            pairs = np.empty(2 * len(made), np.int64)
            pairs[::2], pairs[1::2] = [place[k] for k in cores], [place[k] for k in tails]
            ids, ends = self._gather(pairs)
            self._add(made, ids, np.diff(ends[1::2], prepend=0))

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's number of ids.

        ``end`` is an id to put behind each text.  A null text counts as empty.
        """
        if len(self.place) > self.max_atoms:
            self._forget()
        data, starts, counts = self.atoms([t or "" for t in texts])
        offsets = np.append(starts, len(data))
        atoms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        keys = atoms.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        if (unknown := np.flatnonzero(place < 0)).size:
            new = [keys[i] for i in unknown]
            self._learn(new)
            place[unknown] = [self.place[k] for k in new]
        at = place[atoms.indices.to_numpy()]
        if end is not None:  # an atom of its own behind each text
            stop = f"{END}{end}"
            if stop not in self.place:
                self._add([stop], np.array([end], np.uint32), np.ones(1, np.int64))
            at = np.insert(at, np.cumsum(counts), self.place[stop])
            counts = counts + 1
        out, ends = self._gather(at)
        doc_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        return out, np.diff(doc_ends, prepend=0)


_ENCODERS: dict[tuple[str, str], AtomEncoder] = {}


def encoder(path: str, kind: str) -> AtomEncoder:
    """The worker's encoder for a tokenizer file; kind: ``word`` or ``byte``."""
    sole_cache("encoding", _ENCODERS.clear)
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = AtomEncoder(path, kind)
    return _ENCODERS[path, kind]
