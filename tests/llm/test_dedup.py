"""Line dedup, near copies and components against brute force."""

import random
from collections import Counter

import pytest

from outcome_engine.llm.graph import components
from outcome_engine.llm.lines import NO_ID, dedup_lines, suspected_lines
from outcome_engine.llm.neardup import NearRules, near_components, shingle_sets, without_near_copies

from .conftest import SCHEMA, words

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    of = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= 10:
                of.setdefault(key, set()).add(NO_ID if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, me = (text or "").split("\n"), NO_ID if doc is None else doc
        stay = [x for x in lines if not (len(k := x.strip(BLANK).translate(LOWER)) >= 10 and len(of[k]) > 1 and min(of[k]) < me)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def as_rows(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())


def test_lines_of_odd_rows(odd_docs, clashing, no_docs, odd_rows):
    want = Counter(brute_lines([r[:2] for r in odd_rows]))
    assert as_rows(dedup_lines(odd_docs)) == want
    assert as_rows(dedup_lines(clashing)) == want
    assert dedup_lines(no_docs).count() == 0


def test_lines_against_brute_force_with_a_tiny_filter(spark):
    rng = random.Random(1)
    pool = ["Line number %d of the pool  " % i for i in range(40)] + ["short", "", "ÄÖÜ äöü ßß", "ÄÖÜ äöü éé éé"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else words(i * 100 + k, 4) for k in range(rng.randint(0, 8)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_rows(dedup_lines(df)) == Counter(brute_lines(rows))
    assert as_rows(dedup_lines(df, max_filter_bytes=1)) == Counter(brute_lines(rows))


def test_only_suspected_lines_shuffle(spark):
    rows = [(i, f"{words(i, 5)}\nthe line that all of them share") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert suspected_lines(docs, 10, 1 << 20)[0].select("key").distinct().count() < 25  # one real key, few false suspects


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 7)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(find(n) == c for n, c in got.items())
    assert {n for a, b in links if a != b for n in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_near(rows):
    sets = []
    for _, text in rows:
        w = [x for x in "".join(" " if c in BLANK else c for c in (text or "")).translate(LOWER).split(" ") if x]
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), NO_ID), NO_ID if doc is None else doc)
    real = lambda x: None if x == NO_ID else x
    return Counter((doc, len(s), real(least[find(i)])) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def as_near(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def near_rows():
    """Exact copies, near copies at all distances, chains, and short texts."""
    rng, out = random.Random(4), []
    for g in range(8):
        base = words(1000 + g, 80).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    out += [words(i, rng.randint(0, 60)) for i in range(60)] + ["One two", "one TWO", "one", ""]
    return [(i * 3 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("rules", [NearRules(), NearRules(block_shingles=300)])
def test_near_copies_against_brute_force(spark, rules):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_components(df, rules=rules)
    assert as_near(got) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_copies_of_odd_rows(odd_docs, clashing, no_docs, odd_rows):
    got = near_components(clashing)
    assert as_near(got) == brute_near([r[:2] for r in odd_rows])
    assert near_components(no_docs).count() == 0
    kept = without_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 4, 6, 8, 9, 10, 11, None])
    assert without_near_copies(no_docs).count() == 0


@pytest.mark.parametrize("rules", [NearRules(), NearRules(block_shingles=60)])
def test_different_texts_of_one_id_are_different_nodes(spark, rules):
    a, b, c, d = (words(k, 60) for k in (7001, 7002, 7003, 7004))
    rows = [(3, a), (5, a + " more"), (5, b), (None, a + " other"), (None, c), (None, d), (9, d + " end"), (2, b + " end"), (5, c + " x")]
    rows += [(5, a + " more")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_near(near_components(df, rules=rules)) == brute_near(rows)
    kept = Counter(tuple(r) for r in without_near_copies(df, rules=rules).collect())
    assert kept == Counter([(3, a), (9, d + " end"), (2, b + " end"), (5, c + " x")])
    clean = [(3, a), (5, a + " more"), (5, b), (None, a + " other"), (None, c)]
    kept = without_near_copies(spark.createDataFrame(clean, "doc_id long, text string"), rules=rules).collect()
    assert Counter(map(tuple, kept)) == Counter([(3, a), (5, b), (None, c)])


def test_a_shingle_set_is_the_same_in_any_batch():
    texts = [words(i, 30).encode() for i in range(20)] + [b"", b"a b", b"A  B"]
    alone = [shingle_sets([t], 5)[0].tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets(texts, 5)] == alone
    assert alone[-1] == alone[-2] and alone[-3] == []


def test_schema_of_documents():
    assert SCHEMA.startswith("doc_id long, text string")
