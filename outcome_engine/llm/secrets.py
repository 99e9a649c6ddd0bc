"""Secret scans: patterns, and an assignment-aware lexer over source and configuration text.

The base patterns are searched in every whole text.  The lexer cuts the text
into names, literals and operators, reads ``name = literal`` pairs of common
source and configuration syntaxes, follows names that stand for constants, and
scores every literal by the names that it reaches.

No shuffle: every text is scanned in the task that reads it.  Null text counts
as empty (no spans, the digest of the empty string).  Repeated rows are scanned
one by one.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .tables import by_text

KINDS = ("assign", "access", "hex", "literal")

# The base patterns.  Runs too short to count cannot hold a longer match of their own kind,
# so access and hex ask for the length at once; assign matches are dropped after matching.
_assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access = re.compile(r"AKIA[A-Z0-9]{14,}")
_hex = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED = 12

#: Parts of names that call for secrecy, with their weight, and parts that speak against it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
             "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0,
             "auth": 0.6, "bearer": 0.7, "signingkey": 1.0, "encryptionkey": 1.0, "connectionstring": 0.8, "dsn": 0.5, "key": 0.4}
HARMLESS = {"public", "url", "uri", "name", "path", "file", "field", "label", "type", "length", "len", "count", "id", "prompt", "hint", "regex"}
PLACEHOLDERS = re.compile(r"(?i)\A(?:x+|\*+|\.+|-+|null|none|nil|true|false|undefined|todo|change_?me|example.*|your[_-].*|dummy|test|<.*>|\$\{?.*|\{\{.*)\Z")
MIN_LITERAL, MIN_SCORE = 8, 0.45

# Lexical grammar of the assignment lexer.
_lexer = re.compile(r"""
    (?P<skip>[ \t]+ | \\\r?\n | /\* | \*/ | <!-- | -->)
  | (?P<line>\r?\n)
  | (?P<string>[bBuUrRfF]{0,2}(?:\"\"\".*?\"\"\" | '''.*?''' | "(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*' | `(?:[^`\\\n]|\\.)*`))
  | (?P<name>[A-Za-z_][A-Za-z0-9_.-]*[A-Za-z0-9_]|[A-Za-z_])
  | (?P<assign>:=|=>|==|!=|<=|>=|->|::|[:=])
  | (?P<number>[0-9][A-Za-z0-9_.+/=-]*)
  | (?P<plus>\+|\|\||\.\.)
  | (?P<other>.)
""", re.X | re.S)
ASSIGNS = {"=", ":", ":=", "=>"}
_bare = re.compile(r"[A-Za-z0-9+/_.=~!@%^&*-]+")
_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Texts without any of these cannot hold a match (the pattern is wider than the scans).
MAYBE = r"(?i)pass|pwd|secret|token|key|credential|auth|bearer|dsn|connection|AKIA|[0-9a-f]{16}"


@dataclass(frozen=True)
class Span:
    start: int
    kind: str
    end: int
    score: float = 1.0

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def name_weight(name: str) -> float:
    """How much a name calls for secrecy: its heaviest part or pair of parts, less if harmless parts stand there."""
    words = [w.lower() for w in _words.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    weight = max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs]), default=0.0)
    return weight * 0.3 if words and words[-1] in HARMLESS else weight


def value_weight(value: str) -> float:
    """How much a literal looks like a secret: 0 for placeholders, up to 1 by length, kinds of characters and entropy."""
    if len(value) < MIN_LITERAL or PLACEHOLDERS.match(value) or " " in value.strip():
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.15 * kinds + 0.1 * entropy + 0.01 * min(len(value), 30))


@dataclass
class _Literal:
    value: str
    parts: list[tuple[int, int]]


def assignments(text: str) -> list[tuple[str, str | _Literal]]:
    """Pairs of a name and what it is given: a literal (joined over ``+``) or another name.

    Comments are read like the rest, as a secret in one is no less known; tokens are
    read one by one, and only a chain of joined literals is held.
    """
    source = ((m.lastgroup, m.start(), m.end()) for m in _lexer.finditer(text) if m.lastgroup != "skip")
    ahead: deque[tuple[str, int, int]] = deque()

    def peek(k: int) -> tuple[str, int, int]:
        while len(ahead) <= k:
            ahead.append(next(source, ("end", len(text), len(text))))
        return ahead[k]

    out: list[tuple[str, str | _Literal]] = []

    def literal(kind: str, a: int, b: int) -> _Literal:
        if kind != "string":
            return _Literal(text[a:b], [(a, b)])
        body = text[a:b].lstrip("bBuUrRfF")
        quote = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
        a = b - len(body)
        return _Literal(body[quote:len(body) - quote], [(a + quote, b - quote)])

    now = ("end", 0, 0)
    while True:
        before, now = now, peek(0)
        ahead.popleft()
        kind, a, b = now
        if kind == "end":
            return out
        if kind != "assign" or text[a:b] not in ASSIGNS:
            continue
        if before[0] == "name":
            name = text[before[1]:before[2]]
        elif before[0] == "string":
            name = literal(*before).value
        else:
            continue
        after = peek(0)
        if after[0] == "string":
            value, j = literal(*after), 1
            while peek(j)[0] == "plus" and peek(j + 1)[0] == "string":
                more = literal(*peek(j + 1))
                value.value += more.value
                value.parts += more.parts
                j += 2
            out.append((name, value))
        elif after[0] in ("name", "number", "other") and (m := _bare.match(text, after[1])):
            bare = m[0]
            if after[0] == "name" and m.end() == after[2]:
                out.append((name, bare))  # a constant's name, or an unquoted value
            out.append((name, _Literal(bare, [(m.start(), m.end())])))


def lexed_spans(text: str) -> list[Span]:
    """Literals given to sensitive names, directly or over constants; the span is the literal without quotes."""
    pairs = assignments(text)
    names = {n for n, _ in pairs}
    weight = {n: name_weight(n) for n in names}
    # a constant is as sensitive as the names that it is given to; a pass per link of the longest chain
    links = [(n, v) for n, v in pairs if isinstance(v, str) and v in names and v != n]
    for _ in range(len(links)):
        changed = False
        for target, constant in links:
            if weight[target] > weight[constant]:
                weight[constant], changed = weight[target], True
        if not changed:
            break
    spans = {}
    for name, value in pairs:
        if isinstance(value, _Literal) and value.value not in names and weight[name] > 0:
            looks = value_weight(value.value)
            if (score := weight[name] * looks) >= MIN_SCORE:
                for a, b in value.parts:
                    spans[a, b] = max(score, spans.get((a, b), 0.0))
    return [Span(a, "literal", b, round(s, 4)) for (a, b), s in spans.items()]


def base_spans(text: str) -> list[Span]:
    found = [Span(m.start(), "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    found += [Span(m.start(), "access", m.end()) for m in _access.finditer(text)]
    found += [Span(m.start(), "hex", m.end()) for m in _hex.finditer(text)]
    return found


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans of a text, by start, then kind."""
    base = _ordered(base_spans(text or ""))
    return base, _ordered(base + lexed_spans(text or ""))


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long,score:double>>"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, spans) with kind, start, stop and score of every span."""
    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_pylist()
        rows = [[{"kind": s.kind, "start": s.start, "stop": s.end, "score": s.score} for s in scan(t)[1]] if m else []
                for t, m in zip(texts.to_pylist(), maybe)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return by_text(df, id_col, text_col, find, SCHEMA)


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
