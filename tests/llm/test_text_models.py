"""Language field, template leaks and licences: held-out accuracy, hand-made cases, brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcome_engine.llm import queries as Q
from outcome_engine.llm.langid import CrfRules, LanguageField, fit_field, keep_identified, label_languages, learn_languages, word_features
from outcome_engine.llm.licences import TEMPLATES, LicenceRules, Matcher, document_frequencies, scan_licences, template_terms
from outcome_engine.llm.templates import LeakRules, build_index, decontaminate, find_leaks, leaks, without_leaks

from .conftest import words

SMALL = CrfRules(buckets=1 << 12, steps=10)


def test_marginals_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    n, sizes = 3, np.array([4, 1, 0, 2, 4])
    model = LanguageField(list("abc"), frozenset(), np.zeros((4, n)), rng.normal(size=(n, n)), rng.normal(size=n))
    e = rng.normal(size=(sizes.sum(), n))
    pairs = np.zeros((n, n))
    p, total = model.marginals(e, sizes, pairs)
    at, log_z, want_pairs = 0, 0.0, np.zeros((n, n))
    for size in sizes:
        own, weight = np.zeros((size, n)), 0.0
        for path in itertools.product(range(n), repeat=int(size)) if size else ():
            w = np.exp(model.first[path[0]] + sum(e[at + t, k] for t, k in enumerate(path)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(path)))
            weight += w
            for t, k in enumerate(path):
                own[t, k] += w
        for path in itertools.product(range(n), repeat=int(size)) if size else ():
            w = np.exp(model.first[path[0]] + sum(e[at + t, k] for t, k in enumerate(path)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(path)))
            for a, b in itertools.pairwise(path):
                want_pairs[a, b] += w / weight
        if size:
            assert np.allclose(p[at:at + size], own / weight)
            log_z += np.log(weight)
        at += size
    assert np.isclose(total, log_z) and np.allclose(pairs, want_pairs)


def test_held_out_accuracy_and_independence_of_the_label(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.op8_language(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 250 and sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = learn_languages(docs)
    again = {r["doc_id"]: r["lang_pred"] for r in label_languages(docs.withColumn("lang", docs["source"]), model).collect()}
    assert again == {i: r["lang_pred"] for i, r in got.items()}


def test_code_switched_text_is_labelled_piece_by_piece():
    english = ["the cat and the dog were in the house with that thing"] * 20 + ["this is what they have been doing there"] * 20
    french = ["le chat et le chien sont dans la maison avec cette chose"] * 20 + ["voici ce que nous avons fait pour elle"] * 20
    model = fit_field(english + french, ["en"] * 40 + ["fr"] * 40, SMALL)
    names, scores, runs = model.label(["the dog and the cat le chien et la maison avec elle", None, "", "12 34 !", "½"])
    assert [a for a, _ in runs[0]] == ["en", "fr"] and sum(n for _, n in runs[0]) == 12
    assert names[1:] == ["und"] * 4 and scores[1:] == [0.0] * 4


def test_language_of_odd_rows(odd_docs, clashing, no_docs):
    model = learn_languages(odd_docs, rules=SMALL)
    got = {r["doc_id"]: r for r in label_languages(clashing, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3)) and got[8]["lang_pred"] != "und"
    assert label_languages(no_docs, model).count() == 0
    nothing = learn_languages(no_docs, rules=SMALL)
    assert {r["lang_pred"] for r in label_languages(odd_docs, nothing).collect()} == {"und"}
    kept = keep_identified(clashing, model)
    assert kept.columns == clashing.columns and {1, 2, 3}.isdisjoint(r["doc_id"] for r in kept.collect())


# ---- templates ----

QUESTION = "A train leaves the old station with Maria on board and travels 120 km in 3 hours before Maria gets off for lunch. How far was that each hour?"
OTHER = QUESTION.replace("Maria", "Chidi").replace("120", "455").replace("3 hours", "7 hours")


def flagged(text, items=((1, QUESTION),), rules=LeakRules()):
    return [(index_item, other) for _, index_item, _, _, other in leaks([text], build_index(list(items), rules), rules)]


def test_verbatim_and_reparameterised_questions_are_caught():
    assert flagged(f"{words(1, 50)} {QUESTION} {words(2, 50)}") == [(0, False)]
    assert flagged(f"{words(1, 50)}. {OTHER} {words(2, 50)}") == [(0, True)]
    assert flagged(QUESTION.replace("\n", " ").replace(".", " .\n")) == [(0, False)]
    assert flagged(words(3, 400)) == []
    assert flagged(QUESTION[:60]) == []


def test_inconsistent_slots_are_no_copy():
    many = "We saw Maria and Maria told Maria that Maria would call Maria so Maria said to Maria that we know Maria well."
    other = many
    for name in ("Anna", "Bela", "Cleo", "Dora", "Ella", "Fida", "Gina", "Hana"):
        other = other.replace("Maria", name, 1)
    assert flagged(many.replace("Maria", "Anna"), [(1, many)]) == [(0, True)]
    assert flagged(other, [(1, many)]) == []


SHORT = ("Compute 12 + 30 - 7.", "Did Marie Curie marry Pierre Curie?", "What is the capital of France?", "Oslo 12, Rome 15, Paris 18, Kyiv 21, Bern 24")


@pytest.mark.parametrize("item", SHORT)
def test_short_items_and_those_of_few_literals_are_found_verbatim(item):
    for text in (item, item.lower(), item.upper(), f"Question: {item} Answer", f"{words(4, 30)} {item} {words(5, 30)}"):
        assert flagged(text, [(1, item)]) == [(0, False)]
    assert flagged(f"Compute 12 + 30 - 8. {words(4, 30)}", [(1, SHORT[0])]) == []
    assert flagged("Did Anna Bell marry Carl Bell?", [(1, SHORT[1])]) == []


def test_a_question_may_stand_behind_a_label():
    assert flagged("Question: What is the capital of Norway?", [(1, SHORT[2])]) == [(0, True)]
    assert flagged("He said: Chidi has 3 red apples in a bag", [(1, "Maria has 5 red apples in a bag")]) == [(0, True)]


def test_repeating_templates_and_broken_copies_are_found():
    item = "Add 3 then add 4 then add 5 then add 6 then add 7."
    assert flagged(f"{words(4, 30)}. {item}", [(1, item)]) == [(0, False)]
    tokens = words(8, 42).split()
    parts = [" ".join(tokens[i:i + 14]) for i in (0, 14, 28)]
    broken = f"{parts[0]} {words(21, 6)} {parts[1]} {words(22, 40)} {parts[2]}"
    assert flagged(broken, [(1, " ".join(tokens))]) == [(0, False)]
    assert flagged(f"{parts[2]} {words(21, 9)} {parts[0]}", [(1, " ".join(tokens))]) == []
    assert flagged(f"{parts[0]} {words(23, 400)} {parts[1]} {words(24, 400)} {parts[2]}", [(1, " ".join(tokens))]) == []


def test_every_planted_passage_is_found_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda s: " ".join(s.split())
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    questions = {r["item_id"]: plain(r["text"]) for r in items.collect()}
    got = {r["doc_id"]: r for r in decontaminate(docs, items).collect()}
    verbatim = {i for i, t in texts.items() if any(q in t for q in questions.values())}
    found = {i for i, r in got.items() if r["contaminated"]}
    assert verbatim <= found and len(found - verbatim) <= 2 and set(got) == set(texts)
    assert all(r["kept"] != r["contaminated"] for r in got.values())
    sliced = find_leaks(docs, items, rules=LeakRules(slice_chars=2000))
    assert {(r["doc_id"], r["item_id"]) for r in sliced.collect()} == {(i, x) for i, r in got.items() for x in r["item_ids"]}
    assert {r["doc_id"] for r in without_leaks(docs, items, rules=LeakRules(slice_chars=2000)).collect()} == set(texts) - found


def test_leaks_in_odd_rows(spark, odd_docs, clashing, no_docs):
    items = spark.createDataFrame([(1, QUESTION), (2, None), (3, "too short"), (None, QUESTION), (1, QUESTION)], "item_id long, text string")
    none = items.filter("false")
    assert not any(r["contaminated"] for r in decontaminate(clashing, items).collect())
    assert decontaminate(odd_docs, none).count() == odd_docs.count() and decontaminate(no_docs, items).count() == 0
    bad = spark.createDataFrame([(None, QUESTION), (None, OTHER), (5, None), (6, OTHER), (6, OTHER)], "doc_id long, text string")
    got = decontaminate(bad, items).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in got) == [(0, True), (0, True), (5, False), (6, True), (6, True)]
    assert [r["doc_id"] for r in without_leaks(bad, items).collect()] == [5]
    assert without_leaks(clashing, none).count() == clashing.count()


# ---- licences ----

def matcher(n=100):
    return Matcher(n, {t: 1 for t in template_terms()})


@pytest.mark.parametrize("text,name", [
    ("code\n# Licensed under the Apache License, Version 2.0.\nmore code", "Apache-2.0"), ("Released under the MIT License.", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("All rights reserved.", "proprietary"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("/* Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software\n * and associated documentation files */", "MIT"),
    ("a copy of this work", None), ("", None), (None, None), (words(1, 500), None)])
def test_notices(text, name):
    assert matcher().best([text])[0][0] == name


def test_sparse_cosine_equals_the_dense_one():
    m = matcher()
    text = "licensed under the mit license by somebody else"
    tokens = text.split()
    axes = [*m.place, *(t for t in tokens if t not in m.place)]
    idf = {t: m.idf[m.place[t]] if t in m.place else m.idf[-1] for t in axes}
    vector = np.array([tokens.count(t) * idf[t] for t in axes])
    dense = max(vector[:len(m.place)] @ m.matrix[:-1, k] / np.linalg.norm(vector) for k in range(m.matrix.shape[1]))
    assert np.isclose(m.best([text])[0][1], dense)


def test_frequencies_count_all_texts(spark, odd_docs):
    n, found = document_frequencies(odd_docs)
    assert n == odd_docs.count() and found["of"] == 2 and found["apache"] == 0  # the boilerplate line, in two rows


def test_the_nearest_licensed_directory_is_inherited(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0"
    files = [(1, "LICENSE", mit), (2, "a/b/LICENSE.txt", apache), (3, "a/b/c/x.py", "x"), (4, "a/y.py", "y"), (5, "a/b/z.py", mit), (6, None, "x"),
             (7, "a/b/c/LICENSE", "no licence here"), (8, "/abs/x", "x"), (9, "a/b/LICENSE-2", mit), (10, "a/b/c/x.py", "x"), (11, "w.py", None)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("directory", F.lit("x"))
    got = {r["doc_id"]: (r["licence"], r["inherited_from"]) for r in scan_licences(df).collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", None), 3: ("Apache-2.0", "a/b"), 4: ("MIT", ""), 5: ("MIT", None), 6: (None, None),
                   7: ("Apache-2.0", "a/b"), 8: ("MIT", ""), 9: ("MIT", None), 10: ("Apache-2.0", "a/b"), 11: ("MIT", "")}
    assert scan_licences(df.filter("false")).count() == 0


def test_licence_query_finds_every_notice(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["own_licence"] for r in Q.op5_licences(spark, sf).collect()}
    notices = {"All rights reserved": "proprietary", "the MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0",
               "Creative Commons Attribution 4.0": "CC-BY-4.0"}
    for i, text in texts.items():
        assert got[i] == next((name for notice, name in notices.items() if notice in text), got[i] if "icens" in text else None)


@pytest.mark.parametrize("kind", ["", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND"])
def test_creative_commons_terms_are_told_apart(kind):
    full = kind.replace("NC", "NonCommercial").replace("ND", "NoDerivatives").replace("SA", "ShareAlike")
    for text in (f"Licensed under CC BY{kind} 4.0.", f"CC BY{kind} 4.0",
                 f"This work is licensed under a Creative Commons Attribution{full} 4.0 International License."):
        for n in (100, 1_000_000):
            assert matcher(n).best([text])[0][0] == f"CC-BY{kind}-4.0"


def test_every_notice_of_the_table_has_its_label(spark):
    """Whole lists: no text that holds a licence word is left out."""
    sf = "/root/testdata/sf0.01"
    notices = {"All rights reserved": "proprietary", "Released under the MIT License": "MIT", "Licensed under the Apache License, Version 2.0": "Apache-2.0",
               "GNU General Public License, version 3": "GPL-3.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0"}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["own_licence"] for r in Q.op5_licences(spark, sf).collect()}
    want = {i: {name for notice, name in notices.items() if notice in text} for i, text in texts.items()}
    assert all(got[i] in names if names else got[i] is None for i, names in want.items())
    assert set().union(*want.values()) == set(notices.values())


def test_a_cosine_does_not_drift_with_the_number_of_documents(spark):
    header = "This project is released under the MIT License."
    rows = [header, "this project is new", "the licence of that project is released", f"under {words(1, 6)}"] + [f"{words(2 + k, 5)} is the" for k in range(6)]
    scores = []
    for times in (1, 300):
        df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(rows * times)], "doc_id long, path string, text string")
        got = {(r["own_licence"], r["own_score"]) for r in scan_licences(df, rules=LicenceRules(stretches=False)).filter(F.col("doc_id") % len(rows) == 0).collect()}
        assert len(got) == 1
        scores.append(got.pop())
    assert scores[0][0] == scores[1][0] == "MIT" and abs(scores[0][1] - scores[1][1]) < 0.02
    # the weights of all words, by hand
    n, df = len(rows), {w: sum(w in t.lower().rstrip(".").split() for t in rows) for t in [header] for w in t.lower().rstrip(".").split()}
    idf = {w: np.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    template = "released under the mit license".split()
    assert np.isclose(scores[0][1], sum(idf[w] ** 2 for w in template) ** 0.5 / sum(x * x for x in idf.values()) ** 0.5)


def test_notices_inside_longer_text_are_found(spark):
    notices = [(name, t) for name, texts in TEMPLATES.items() for t in texts]
    rows = [(i, f"{words(3 * i, 150)} {t} {words(3 * i + 1, 150)}. And so on.") for i, (_, t) in enumerate(notices)]
    n = len(notices)
    rows += [(n, "Copyright 2021 Jane Doe. Released under the MIT License."), (n + 1, f"{words(5, 100)} the table is reserved for {words(6, 100)}"),
             (n + 2, f"{words(7, 100)} released under the sea {words(8, 100)} license {words(9, 100)}")]
    df = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_licence"] for r in scan_licences(df).collect()}
    assert got == {**{i: name for i, (name, _) in enumerate(notices)}, n: "MIT", n + 1: None, n + 2: None}


def test_the_tail_of_a_long_unspaced_run_counts():
    """No character of a run of letters is left out: two texts with the same first 64 letters differ by the rest."""
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(200))
    field = fit_field([text("abcde") for _ in range(20)] + [text("vwxyz") for _ in range(20)], ["left"] * 20 + ["right"] * 20)
    head = "".join(rng.choice("abcde") for _ in range(64))
    tails = {"left": "abcde", "right": "vwxyz"}
    for name, letters in tails.items():
        whole = head + "".join(rng.choice(letters) for _ in range(100_000))
        assert field.label([whole])[0] == [name]
    owner, feature = word_features(["a" * 64, "ab", "é"], frozenset(), 1 << 16)
    assert set(owner) == {0, 1, 2} and feature.min() >= 0 and feature.max() < 1 << 16
