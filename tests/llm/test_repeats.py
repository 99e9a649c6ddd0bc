"""Periodic runs, phrases and repeated passages against plain brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from outcome_engine.llm import queries as Q
from outcome_engine.llm.passages import common_prefixes, merge_runs, remove_repeats, suffix_array
from outcome_engine.llm.phrases import PhraseRules, collocations
from outcome_engine.llm.runs import RunRules, SuffixTree, find_runs, periodic_runs, repeating_words, runs_of

from .conftest import rows, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs ---------------------------------------------------------------------------------------

def brute_runs(s, rules=RunRules()):
    """All maximal stretches of each period, without those that a smaller period has too."""
    n, out = len(s), set()
    for q in range(1, n // rules.min_power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size, w = j + q - i, s[i:j + q]
            if j > i and size >= max(rules.min_length, rules.min_power * q) and not any(w[d:] == w[:-d] for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda t: (t[0], t[2]))


def coded(s):
    import numpy as np

    return np.array(s, dtype=np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_those_of_brute_force(seed):
    import numpy as np

    rng = random.Random(seed)
    for _ in range(20):
        s = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
        root = [rng.randint(1, 4) for _ in range(rng.randint(1, 5))]
        at = rng.randint(0, 20)
        s[at:at] = (root * 8)[:rng.randint(0, 30)]
        rules = rng.choice([RunRules(), RunRules(rng.randint(2, 9), rng.randint(2, 5))])
        assert list(map(tuple, find_runs(s, rules).tolist())) == brute_runs(s, rules)
        inside = repeating_words(coded(s), np.zeros(len(s), np.int64), rules.gram())
        assert list(map(tuple, runs_of(coded(s), inside, rules).tolist())) == brute_runs(s, rules)


def test_extensions_of_the_suffix_tree():
    import numpy as np

    rng = random.Random(3)
    s = [rng.randint(1, 3) for _ in range(80)]
    tree = SuffixTree(s)
    pairs = [(a, b) for a in range(80) for b in range(80) if a != b]
    want = [next((k for k in range(80) if max(a, b) + k >= 80 or s[a + k] != s[b + k]), 80) for a, b in pairs]
    assert tree.extension(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist() == want
    assert sorted(range(81), key=lambda i: s[i:]) == np.argsort(tree.rank).tolist()


def brute_document(text):
    words_ = WORD.findall(text or "")
    found = brute_runs(words_)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, [tuple(r) for r in found],
            " ".join(w for i, w in enumerate(words_) if i not in dropped))


def run_columns(df):
    return [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.collapsed)) for r in df.collect()]


def test_periodic_runs_on_odd_rows(odd_docs, odd_rows, clashing, no_docs, spark):
    got = run_columns(periodic_runs(odd_docs))
    plain = {k: (0, None, None, None, None, [], " ".join(WORD.findall(t or ""))) for k, t in [(r[0], r[1]) for r in odd_rows] if k and k != 8}
    assert len(got) == len(odd_rows)
    assert all(v == plain[k] for k, v in got if k in plain)
    assert sorted(run_columns(periodic_runs(clashing)), key=str) == sorted(got, key=str)
    assert rows(periodic_runs(no_docs)) == []
    again = [(1, "a b " * 9 + "c"), (1, "a b " * 9 + "c"), (None, "x x x x x x"), (2, "x x x x x"), (3, words(1, 400) + (" p q r" * 30) + " " + words(2, 30_000))]
    got = run_columns(periodic_runs(spark.createDataFrame(again, "doc_id long, text string")))
    assert sorted(got, key=str) == sorted([(k, brute_document(t)) for k, t in again if k != 3] + [g for g in got if g[0] == 3], key=str)
    assert [(v[0], v[2], v[3]) for k, v in got if k == 3] == [(1, 90, 3)]


def planted(doc_id, text):
    words_, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words_:
        n, g = len(words_), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words_ = words_[:a] + [words_[a + (i - a) % p] for i in range(a, n)]
    return " ".join(words_)


def test_op11_against_brute_force(spark, sf_dir=SF):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id: d.text for d in docs if len(WORD.findall(d.text or "")) <= 600}
    got = {r.doc_id: tuple(r)[1:] for r in Q.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs) and len(short) > 100
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for k, t in short.items():
        n, s, size, q, e, runs, collapsed = brute_document(planted(k, t))
        want[k] = (n, s, size, q, e, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed))
    assert {k: got[k] for k in want} == want
    assert sum(v[0] for v in got.values()) > 0


# --- phrases -----------------------------------------------------------------------------------------------

def brute_phrases(docs, rules):
    """Counts by hand; Python's integers are exact."""
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, rules.max_words + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= rules.min_count}
    out = {}
    for (lang, *w), a in found.items():
        inside = any(len(q) > len(w) + 1 and q[0] == lang and 100 * b >= rules.swallow_percent * a
                     and any(list(q[1 + i:1 + i + len(w)]) == w for i in range(len(q) - len(w))) for q, b in found.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((" ".join(w), a, left, right, n[lang], score))
    ranked = {lang: sorted(rs, key=lambda r: (-r[5], -r[1], r[0].encode())) for lang, rs in out.items()}
    return sorted((lang, i, *r) for lang, rs in ranked.items() for i, r in enumerate(rs[:rules.top], 1))


def phrase_docs(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "new", "york", "Zug", "é", "in", "big city"] + [words(100 + i, 1) for i in range(30)]
    marks = [" "] * 12 + [", ", ".\n", "\t", " - ", "  ", "!", "\x0b", " "]
    text = lambda: "".join(rng.choice(vocabulary[:rng.choice([4, 8, 38])]) + rng.choice(marks) for _ in range(rng.randint(0, 120)))
    docs = [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(n)]
    return docs + [("en", None), (None, ""), ("en", " \n "), docs[0], docs[0], ("de", "the new york of the new york " * 40)]


@pytest.mark.parametrize("seed,budget,rules", [(1, 1, PhraseRules(min_count=4)), (2, 40, PhraseRules(min_count=4, top=25)), (3, 300, PhraseRules(min_count=7)),
                                               (4, None, PhraseRules(min_count=3, max_words=3)), (5, 25, PhraseRules(min_count=5, swallow_percent=80))])
def test_collocations_are_those_of_brute_force(spark, seed, budget, rules):
    docs = phrase_docs(seed)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    assert sorted(tuple(r) for r in collocations(df, rules=rules, budget=budget).collect()) == brute_phrases(docs, rules)


def test_collocations_on_odd_rows(odd_docs, odd_rows, clashing, no_docs):
    rules = PhraseRules(min_count=2)
    want = brute_phrases([(r[2], r[1]) for r in odd_rows], rules)
    assert sorted(tuple(r) for r in collocations(odd_docs, rules=rules).collect()) == want and want
    assert sorted(tuple(r) for r in collocations(clashing, rules=rules).collect()) == want
    assert collocations(no_docs, rules=rules).collect() == []


def test_collocation_scores_pass_64_bits(spark, monkeypatch):
    """Products beyond 64 bits: the same expression on made-up counts of a very large corpus."""
    from outcome_engine.llm import phrases

    n, a, left, right = 9 * 10**13, 8 * 10**12, 9 * 10**12, 81 * 10**11 + 7
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", left), ("en", "y", right)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (counts, totals))
    got = collocations(counts).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, left, right, n, 1000 * a * n // (left * right))]


def test_extended_prefixes_fit_the_budget(spark):
    """No group holds more suffixes than twice the budget, however common its first words are."""
    from outcome_engine.llm import phrases

    held = []
    plain = phrases._subtrees

    def spy(blocks, rules):
        sizes = blocks.selectExpr("group", "length(counts) div 4 AS n").groupBy("group").sum("n").collect()
        held.extend(r[1] for r in sizes)
        return plain(blocks, rules)

    docs = phrase_docs(9, 200)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    phrases._subtrees = spy
    try:
        collocations(df, rules=PhraseRules(min_count=4), budget=100).collect()
    finally:
        phrases._subtrees = plain
    assert len(held) > 10 and max(held) <= 200


# --- repeated passages -------------------------------------------------------------------------------------

def brute_passages(docs, length=400):
    """(doc_id, n_bytes, spans, kept) of every row, by counting all windows."""
    data = [(k, (t or "").encode()) for k, t in docs]
    n = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((k, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def passage_rows(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()]


def passage_docs(seed, length):
    """Texts with copies of many kinds: whole, shifted, overlapping, within a text, of runs of one character."""
    rng = random.Random(seed)
    pool = [words(50 + i, 40) for i in range(4)] + ["ab" * 60, "a" * 150, "é€ " * 40]
    out = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.5:
                t = rng.choice(pool)
                a = rng.randint(0, len(t) - 1)
                parts.append(t[a:a + rng.randint(1, 3 * length)])
            else:
                parts.append(words(rng.randint(1000, 9999), rng.randint(1, 30)))
        out.append((i, " ".join(parts)))
    return out + [(3, out[3][1]), (200, out[3][1]), (None, out[5][1]), (None, None), (201, ""), (202, out[5][1] + out[6][1]), (203, "\x00" * 90 + out[7][1])]


@pytest.mark.parametrize("seed,length,core,shard", [(1, 24, 16, 400), (2, 24, 5, 120), (3, 60, 40, 1000), (4, 24, 24, 2_000_000), (5, 9, 4, 60)])
def test_passages_are_those_of_brute_force(spark, seed, length, core, shard):
    docs = passage_docs(seed, length)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = sorted(brute_passages(docs, length), key=str)
    assert sorted(passage_rows(remove_repeats(df, length=length, core=core, shard_bytes=shard)), key=str) == want
    assert sum(r[2] for r in want) > 0 and sum(r[1] - r[2] for r in want) > 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    from outcome_engine.llm import passages

    plain = passages.hash_filter
    monkeypatch.setattr(passages, "hash_filter", lambda keys: plain(keys, max_bytes=1))
    monkeypatch.setattr(plain.__module__ and __import__(plain.__module__, fromlist=["HashFilter"]).HashFilter, "holds",
                        lambda self, h: __import__("numpy").ones(len(h), bool))
    docs = passage_docs(6, 24)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(passage_rows(remove_repeats(df, length=24, core=10, shard_bytes=200)), key=str) == sorted(brute_passages(docs, 24), key=str)


def test_passages_on_odd_rows(odd_docs, odd_rows, clashing, no_docs):
    want = sorted(brute_passages([(r[0], r[1]) for r in odd_rows]), key=str)
    assert sorted(passage_rows(remove_repeats(odd_docs)), key=str) == want
    assert sorted(passage_rows(remove_repeats(clashing)), key=str) == want
    assert remove_repeats(no_docs).collect() == []


def test_suffix_order_and_common_prefixes():
    import numpy as np

    rng = random.Random(4)
    for _ in range(150):
        d = bytes(rng.choice(b"ab\x00\xffc"[:rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(1, 200)))
        d = d + d[:rng.randint(0, len(d))] + d if rng.random() < 0.5 else d
        data = np.frombuffer(d, np.uint8)
        order = suffix_array(data)
        assert order.tolist() == sorted(range(len(d)), key=lambda i: d[i:])
        got = common_prefixes(data, order, 40, rng.choice([1, 7, 128]))
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            same = next((k for k in range(40) if max(a, b) + k >= len(d) or d[a + k] != d[b + k]), 40)
            assert got[b] == same


def test_window_classes_need_no_order_beyond_the_window(monkeypatch):
    import numpy as np

    from outcome_engine.llm import passages

    monkeypatch.setattr(passages, "suffix_array", None)  # the whole order
    monkeypatch.setattr(passages, "common_prefixes", None)
    rng = random.Random(6)
    for _ in range(300):
        d = bytes(rng.choice(b"ab\x00cdefgh"[:rng.choice([1, 2, 3, 9])]) for _ in range(rng.randint(1, 150)))
        d = d + b"\xff" + d[rng.randint(0, len(d)):] + b"\xff" + d if rng.random() < 0.5 else d
        n = rng.choice([1, 2, 5, 8, 13, 40])
        windows = [d[i:i + n] for i in range(len(d) - n + 1)]
        repeated, first = passages.window_classes(np.frombuffer(d, np.uint8), n)
        assert repeated[:len(windows)].tolist() == [windows.count(w) > 1 for w in windows]
        assert first[:len(windows)].tolist() == [windows.index(w) == i for i, w in enumerate(windows)]


def test_a_shard_holds_few_arrays_at_once():
    import tracemalloc

    from outcome_engine.llm import passages

    pieces = [(i, b"%d" % i, 0, words(i, 90).encode()) for i in range(1200)]
    size = sum(len(p[3]) for p in pieces)
    tracemalloc.start()
    passages._shard_rows(pieces, 400, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * size


def test_passages_run_one_python_step_a_task_at_the_end(spark):
    """A filter in Python below the step that writes the rows would be a second worker beside it in each task."""
    df = spark.createDataFrame(passage_docs(7, 24), "doc_id long, text string").repartition(3)
    out = remove_repeats(df, length=24, core=16, shard_bytes=400)
    below = out._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")[2]
    assert below.count("ArrowEvalPython") == 1  # of the rows that are joined, before their shuffle
    assert "Exchange" in below.partition("ArrowEvalPython")[0]


def test_merged_runs():
    import numpy as np

    rng = random.Random(5)
    for _ in range(50):
        runs = [np.unique(np.array([rng.randint(0, 60) for _ in range(rng.randint(0, 30))], np.uint64)) for _ in range(rng.randint(0, 9))]
        n = Counter(x for r in runs for x in r.tolist())
        assert merge_runs(runs).tolist() == sorted(x for x, c in n.items() if c > 1)


def test_op13_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(k, n, m, len(s), hashlib.sha256(b).hexdigest()) for k, n, m, s, b in brute_passages(docs)]
    got = [tuple(r) for r in Q.op13_passages(spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 0
