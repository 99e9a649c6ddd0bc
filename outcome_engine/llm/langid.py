"""Language identification by a linear-chain conditional random field over words.

Every word gets features: itself if it stands in the learned lexicon, its
prefixes and suffixes, and its character n-grams.  The field scores a line of
words by the features of each word and by learned transitions between the
languages of neighbours; forward-backward gives each word's probabilities.  So a
text that changes its language is labelled piece by piece, and the document's
language is the one with the largest mean probability.

The field is fitted on the driver on a bounded sample of labelled rows
(``per_language`` documents of each language are expected, ``MAX_SAMPLE`` at
most) by AdaGrad on the conditional likelihood; a document's label holds for all
of its words.  Prediction needs no shuffle.

Null text, or text without a letter, is ``und`` with score 0; so is everything
if no labelled row is there to learn from.  Repeated rows are judged one by one;
lines of more than ``chain`` words are labelled in stretches of that length, and
runs of more than 64 letters count as several words: no character is left out.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import by_text, keep_rows, sole_cache

MAX_SAMPLE = 20_000
CELLS = 1 << 16  # words in one step of forward-backward
_words = re.compile(r"[^\W\d_]{1,64}").findall  # a longer run of letters is several words


@dataclass(frozen=True)
class CrfRules:
    per_language: int = 100        # sampled documents of each language
    longest: int = 20_000          # characters; longer documents are not sampled
    buckets: int = 1 << 16         # hashed features
    lexicon: int = 300             # most frequent words of each language
    steps: int = 16
    rate: float = 0.5
    ridge: float = 1e-3
    chain: int = 1024
    cached_words: int = 200_000


_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _buckets(kind: int, codes: list[np.ndarray], buckets: int) -> np.ndarray:
    """The buckets of a kind of feature, given the code points that it is made of."""
    h = np.full(len(codes[0]), kind, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for c, f in zip(codes, _FACTORS):
        h += c * f
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(33)) % np.uint64(buckets)


def word_features(words: list[str], lexicon: frozenset[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words at once, as (word's place, feature): lexicon entry, affixes, n-grams of 1 to 3 characters."""
    lower = [w.lower() for w in words]
    codes = np.frombuffer(f"<{'><'.join(lower)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, lower), np.int64, len(lower)) + 2
    stop = np.cumsum(size)
    start, owner = stop - size, np.repeat(np.arange(len(lower)), size)
    inner = np.ones(len(codes), bool)
    inner[start] = inner[stop - 1] = False
    owners, found = [owner[inner]], [_buckets(1, [codes[inner]], buckets)]
    for n in (2, 3):
        at = np.flatnonzero(owner[n - 1:] == owner[:1 - n])
        owners.append(owner[at])
        found.append(_buckets(n, [codes[at + k] for k in range(n)], buckets))
    for n in (1, 2, 3):
        long = np.flatnonzero(size - 2 > n)
        owners += [long, long]
        found += [_buckets(3 + n, [codes[start[long] + 1 + k] for k in range(n)], buckets),
                  _buckets(6 + n, [codes[stop[long] - 1 - n + k] for k in range(n)], buckets)]
    known = [i for i, w in enumerate(lower) if w in lexicon]
    owners.append(np.array(known, np.int64))
    found.append(np.array([zlib.crc32(lower[i].encode("utf-8", "surrogatepass")) % buckets for i in known], np.uint64))
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


class _Known:
    """The words that a worker remembers, of one field at a time: a field that is used no more leaves nothing behind."""
    key: str | None = None
    place: dict[str, int] = {}
    scores: np.ndarray = np.zeros((0, 0))


_KNOWN = _Known()


def _forget() -> None:
    _KNOWN.key, _KNOWN.place, _KNOWN.scores = None, {}, np.zeros((0, 0))


@dataclass
class LanguageField:
    languages: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    rules: CrfRules = CrfRules()
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # of the words that a worker remembers

    def scores(self, words: list[str]) -> np.ndarray:
        owner, feature = word_features(words, self.lexicon, self.rules.buckets)
        return np.stack([np.bincount(owner, w[feature], len(words)) for w in self.weights.T], 1)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's scores (words x languages), and whether it holds a letter."""
        known = _KNOWN
        sole_cache("language", _forget)
        if known.key != self.key or len(known.place) > self.rules.cached_words:
            known.key, known.place, known.scores = self.key, {}, np.zeros((0, len(self.languages) + 1), np.float32)
        at = np.fromiter(map(known.place.get, words, repeat(-1)), np.int64, len(words))
        if (unknown := np.flatnonzero(at < 0)).size:
            new = list(dict.fromkeys(words[i] for i in unknown))
            rows = self.scores(new)
            letter = np.array([[w.isalpha() or any(c.isalpha() for c in w)] for w in new], float)
            known.place.update(zip(new, range(len(known.scores), len(known.scores) + len(new))))
            known.scores = np.concatenate([known.scores, np.concatenate([rows, letter], axis=1).astype(np.float32)])
            at[unknown] = [known.place[words[i]] for i in unknown]
        rows = known.scores[at]
        return rows[:, :-1], rows[:, -1] > 0

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Forward-backward over chains that lie one after the other: every word's probabilities and the log partition sums.

        Chains of like length go together.  ``pairs``, if given, gets the expected transitions added.
        """
        out = np.empty_like(emissions)
        begin, total = np.cumsum(lengths) - lengths, 0.0
        order = np.argsort(lengths, kind="stable")
        move = np.exp(self.transitions)
        # groups of chains of like length, of at most CELLS places with their padding
        widest, cuts = lengths[order], [0]
        while cuts[-1] < len(order):
            here = cuts[-1]
            full = (np.arange(1, len(order) - here + 1) * widest[here:]) > CELLS if widest[-1] * (len(order) - here) > CELLS else np.zeros(1, bool)
            cuts.append(here + max(1, int(full.argmax()) if full.any() else len(order) - here))
        for group in (order[a:b] for a, b in zip(cuts, cuts[1:])):
            n, size = len(group), int(lengths[group].max(initial=0))
            if not size:
                continue
            # places before chains: the chains still running at a place, sorted by length, are the last ones
            at = begin[group] + np.arange(size)[:, None]
            real = np.arange(size)[:, None] < lengths[group]
            ended = np.searchsorted(lengths[group], np.arange(size), "right")
            e = np.where(real[..., None], emissions[np.where(real, at, 0)], 0.0)
            top = e.max(axis=2)
            e = np.exp(e - top[..., None])
            alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((size, n))
            for t in range(size):
                k = ended[t]
                x = alpha[t - 1, k:] @ move * e[t, k:] if t else np.exp(self.first) * e[0, k:]
                scale[t, k:] = x.sum(axis=1)
                np.divide(x, scale[t, k:, None], out=alpha[t, k:])
            e /= scale[..., None]
            back = np.ascontiguousarray(move.T)
            for t in range(size - 2, -1, -1):
                k = ended[t + 1]
                np.matmul(beta[t + 1, k:] * e[t + 1, k:], back, out=beta[t, k:])
            p = alpha[real] * beta[real]
            p /= p.sum(axis=1, keepdims=True)
            out[at[real]] = p
            total += float(np.log(scale)[real].sum() + top[real].sum())
            if pairs is not None and size > 1:
                later = (beta[1:] * e[1:]) * real[1:, :, None]
                pairs += move * np.einsum("tni,tnj->ij", alpha[:-1], later)
        return out, total

    def label(self, texts: list[str | None], with_runs: bool = True) -> tuple[list[str], list[float], list[list[tuple[str, int]]]]:
        """Each text's language, its score, and (if asked for) its runs of words in one language."""
        chains: list[list[str]] = []
        of: list[int] = []
        for i, text in enumerate(texts):
            for line in (text or "").split("\n"):
                words = _words(line)
                for k in range(0, len(words), self.rules.chain):
                    chains.append(words[k:k + self.rules.chain])
                    of.append(i)
        names, scores, runs = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if not chains or not self.languages:
            return names, scores, runs
        lengths = np.fromiter(map(len, chains), np.int64, len(chains))
        e, letter = self.emissions([w for c in chains for w in c])
        p, _ = self.marginals(e, lengths)
        doc = np.repeat(of, lengths)
        count = np.bincount(doc, letter, len(texts))
        mean = np.stack([np.bincount(doc, p[:, k] * letter, len(texts)) for k in range(p.shape[1])], 1) / np.maximum(count, 1)[:, None]
        if with_runs:
            word_best = p.argmax(axis=1)
            cuts = np.flatnonzero((np.diff(word_best, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
                runs[doc[a]].append((self.languages[word_best[a]], b - a))
        for i in np.flatnonzero(count).tolist():
            k = int(mean[i].argmax())
            names[i], scores[i] = self.languages[k], float(min(1.0, mean[i, k]))
        return names, scores, runs


def fit_field(texts: list[str], labels: list[str], rules: CrfRules = CrfRules()) -> LanguageField:
    """Fit the field to labelled texts held in memory."""
    languages = sorted(set(labels))
    chains = [(words[k:k + rules.chain], languages.index(label)) for text, label in zip(texts, labels) for line in text.split("\n")
              for words in [_words(line)] for k in range(0, len(words), rules.chain)]
    counts = [Counter() for _ in languages]
    for words, k in chains:
        counts[k].update(w.lower() for w in words)
    lexicon = frozenset(w for c in counts for w, _ in c.most_common(rules.lexicon))
    n = len(languages)
    model = LanguageField(languages, lexicon, np.zeros((rules.buckets, n)), np.zeros((n, n)), np.zeros(n), rules)
    if not chains or n < 2:
        return model
    words = [w for c, _ in chains for w in c]
    lengths = np.fromiter((len(c) for c, _ in chains), np.int64, len(chains))
    gold_chain = np.array([k for _, k in chains])
    gold = np.repeat(gold_chain, lengths)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter((distinct[w] for w in words), np.int64, len(words))
    owner, feature = word_features(list(distinct), lexicon, rules.buckets)
    stay = np.bincount(gold_chain, lengths - 1, n)
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.transitions, model.first)]
    for _ in range(rules.steps):
        scores = np.stack([np.bincount(owner, w[feature], len(distinct)) for w in model.weights.T], 1)
        pairs = np.zeros((n, n))
        p, _ = model.marginals(scores[at], lengths, pairs)
        p[np.arange(len(gold)), gold] -= 1
        opened = p[np.cumsum(lengths) - lengths].sum(axis=0)
        by_word = np.stack([np.bincount(at, p[:, k], len(distinct)) for k in range(n)], 1)
        by_feature = np.stack([np.bincount(feature, by_word[owner, k], rules.buckets) for k in range(n)], 1)
        for x, g, s in zip((model.weights, model.transitions, model.first), (by_feature, pairs - np.diag(stay), opened), squares):
            g = g / len(gold) + rules.ridge * x / rules.buckets
            s += g * g
            x -= rules.rate * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


def is_held_out(id_col: Column) -> Column:
    """The rows that are never learned from: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    rules: CrfRules = CrfRules()) -> LanguageField:
    """Fit the field on a sample of the labelled rows that are not held out; the sample is drawn by a hash of the id."""
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~is_held_out(F.col("id"))
                       & (F.length("text") <= rules.longest))
    scale = 1 << 30
    shares = {r["lang"]: min(scale, -(-scale * rules.per_language // r["count"])) for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return fit_field([], [], rules)
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(s)) for lang, s in shares.items()))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(scale))
    sample = rows.filter(drawn < share).limit(MAX_SAMPLE).collect()
    sample.sort(key=lambda r: (r["lang"], str(r["id"]), r["text"]))
    return fit_field([r["text"] for r in sample], [r["lang"] for r in sample], rules)


def label_languages(df: DataFrame, model: LanguageField, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, runs) of every row; runs are stretches of words in one language (empty unless asked for)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: rules.buckets x languages

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, runs = shared.value.label(batch.column("text").to_pylist(), with_runs)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names), pa.array(scores), pa.array([[{"lang": a, "words": n} for a, n in r] for r in runs], kind)],
            ["doc_id", "lang_pred", "score", "runs"])

    return by_text(df, id_col, text_col, judge, "doc_id long, lang_pred string, score double, runs array<struct<lang:string,words:long>>", 1 << 20)


def keep_identified(df: DataFrame, model: LanguageField, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows in a known language: those that are ``und`` or score less are rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str | None]) -> list[bool]:
        names, scores, _ = shared.value.label(texts, with_runs=False)
        return [n != "und" and s >= min_score for n, s in zip(names, scores)]

    return keep_rows(df, text_col, judge)
