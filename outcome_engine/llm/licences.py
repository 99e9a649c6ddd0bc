"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

1. Document frequencies of all words are counted over all texts, as a table; a
   word's weight is its frequency in a segment times ``log((1 + N) / (1 + df)) + 1``.
2. A text's segments are its lines, its paragraphs, and the whole text if it is
   not much longer than the longest template.  Vectors are sparse: only template
   terms meet the templates, and only their frequencies are collected.  Inside
   longer text, stretches of a template's length around its rarest term are
   segments too, if they hold that template's ``held`` share of words.
3. A segment is a candidate if it reached ``threshold`` were its other words in
   every text (the least weight).  Only the candidates' other words are joined
   with the table, so that each has its true weight.  The best cosine of at
   least ``threshold`` is the text's own licence.
4. A file called LICENSE, LICENCE, COPYING or NOTICE (any suffix) speaks for its
   directory.  Distinct directories join with their ancestors, the nearest one
   with a licence wins, and files without an own licence inherit it.

Only distinct directories are exploded into ancestors, so a directory with very
many files counts once there; the join back to the files is on the directory and
is split by adaptive skew joins.

Null or empty texts have no own licence; a null path has no directory.  Of
several licence files in a directory the best score wins, then the first name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import slices, spread, stored

# Notices and opening clauses of public licences (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("licensed under the GNU Affero General Public License version 3",
                 "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "Licensed under the simplified BSD License"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Licensed under CC BY 4.0"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0",
                     "Licensed under CC BY-NC 4.0"),
    "CC-BY-NC-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
                        "CC BY-NC-ND 4.0", "Licensed under CC BY-NC-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
                        "CC BY-NC-SA 4.0", "Licensed under CC BY-NC-SA 4.0"),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0",
                     "Licensed under CC BY-ND 4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "Licensed under CC BY-SA 4.0"),
    "CC0-1.0": ("dedicated to the public domain under the Creative Commons Zero CC0 1.0 Universal dedication",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    "ISC": ("Released under the ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License version 3",),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "proprietary": ("All rights reserved", "proprietary and confidential unauthorized copying is strictly prohibited"),
}
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
_terms = re.compile(r"[^\W_]+").findall


@dataclass(frozen=True)
class LicenceRules:
    threshold: float = 0.6
    whole_factor: int = 4
    held: float = 0.75       # share of a template's words in a stretch of its length
    stretches: bool = True


def template_terms() -> list[str]:
    return sorted({t for texts in TEMPLATES.values() for text in texts for t in _terms(text.lower())})


def word_frequencies(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(word, n): the number of texts that hold each word; the empty word stands for the number of texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                total.update(set(_terms((text or "").lower())))
            total[""] += batch.num_rows
            if len(total) > most:
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})
                total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def document_frequencies(docs: DataFrame, counts: DataFrame | None = None) -> tuple[int, dict[str, int]]:
    """The number of texts and, for each template term, the number of texts that hold it."""
    terms = template_terms()
    counts = word_frequencies(docs) if counts is None else counts
    found = {r["word"]: r["n"] for r in counts.filter(F.col("word").isin("", *terms)).collect()}  # one per term
    return found.pop("", 0), {t: found.get(t, 0) for t in terms}


class Matcher:
    """Cosines of segments with all templates."""

    def __init__(self, n: int, frequencies: dict[str, int], rules: LicenceRules = LicenceRules()):
        self.rules = rules
        self.place = {t: i for i, t in enumerate(frequencies)}
        self.idf = np.log((1 + n) / (1 + np.array([*frequencies.values(), 0], float))) + 1  # the last: any other word
        self.names = [name for name in sorted(TEMPLATES) for _ in TEMPLATES[name]]
        texts = [t for name in sorted(TEMPLATES) for t in TEMPLATES[name]]
        self.longest = max(len(_terms(t)) for t in texts)
        self.matrix = np.zeros((len(frequencies) + 1, len(texts)))
        for k, text in enumerate(texts):
            for term in _terms(text.lower()):
                self.matrix[self.place[term], k] += 1
        self.stretches: dict[str, list[tuple[int, int]]] = {}  # a template's rarest term: template, its place there
        self.template_words = [_terms(t.lower()) for t in texts]
        for k, words in enumerate(self.template_words):
            rarest = max(words, key=lambda t: (self.idf[self.place[t]], t))
            self.stretches.setdefault(rarest, []).extend((k, j) for j, t in enumerate(words) if t == rarest)
        self.matrix *= self.idf[:, None]
        self.matrix /= np.linalg.norm(self.matrix, axis=0)

    def segments(self, text: str, stretches: bool = False) -> list[list[str]]:
        lines = [_terms(line) for line in text.lower().split("\n")]
        out, block = [line for line in lines if line], []
        for line in [*lines, []]:
            if line:
                block.append(line)
            else:
                if len(block) > 1:
                    out.append([t for x in block for t in x])
                block = []
        words = [t for line in lines for t in line]
        if stretches and not self.stretches.keys().isdisjoint(words):
            out += self._stretches(words)
        return [*out, words] if 0 < len(words) <= self.rules.whole_factor * self.longest else out

    def _stretches(self, words: list[str]) -> list[list[str]]:
        """Stretches of a template's length with its rarest term in place and most of its words."""
        found = {}
        for at, word in enumerate(words):
            for k, place in self.stretches.get(word, ()):
                template, start = self.template_words[k], at - place
                stretch = words[max(start, 0):start + len(template)]
                if (Counter(template) & Counter(stretch)).total() >= self.rules.held * len(template):
                    found[tuple(stretch)] = None
        return list(map(list, found))

    def best(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """Each text's licence (None below the threshold) and its best cosine."""
        segments, of = [], []
        for i, text in enumerate(texts):
            own = self.segments(text) if text else []
            segments += own
            of += [i] * len(own)
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        for s, k, dot, square in self._scored(segments, self.idf[-1]):
            score = dot / square**0.5
            if score > out[of[s]][1]:
                out[of[s]] = (self.names[k] if score >= self.rules.threshold else None, score)
        return out

    def _scored(self, segments: list[list[str]], other_idf: float) -> Iterator[tuple[int, int, float, float]]:
        """(segment, best template, dot product, squared length) of the segments that can reach the threshold."""
        if not segments:
            return
        other, sizes = len(self.place), np.array(list(map(len, segments)))
        term = np.fromiter((self.place.get(t, other) for s in segments for t in s), np.int64, sizes.sum())
        segment = np.repeat(np.arange(len(segments)), sizes)
        known = term < other
        key, tf = np.unique(segment[known] * other + term[known], return_counts=True)
        seg, term_of = key // other, key % other
        weight = tf * self.idf[term_of]
        own = np.bincount(seg, weight**2, len(segments))
        square = own + np.bincount(segment[~known], minlength=len(segments)) * other_idf**2
        # a segment cannot reach the threshold unless its template terms carry enough of its vector
        hopeful = own >= self.rules.threshold**2 * square
        hopeful &= own > 0
        row = np.cumsum(hopeful) - 1
        use = hopeful[seg]
        dots = np.zeros((int(hopeful.sum()), self.matrix.shape[1]))
        np.add.at(dots, row[seg[use]], weight[use, None] * self.matrix[term_of[use]])
        for s in np.flatnonzero(hopeful).tolist():
            k = int(dots[row[s]].argmax())
            yield s, k, float(dots[row[s], k]), float(square[s])

    def candidates(self, text: str | None) -> list[dict]:
        """The text's segments that reach the threshold if their other words weigh least, with these words."""
        segments, best, out = self.segments(text, self.rules.stretches) if text else [], 0.0, {}
        for s, k, dot, square in self._scored(segments, 1.0):
            others = Counter(t for t in segments[s] if t not in self.place)
            known = square - others.total()
            bound = dot / (known + sum(n * n for n in others.values())) ** 0.5
            if bound < self.rules.threshold:
                continue
            if not others:
                best = max(best, bound)
            key = (k, dot, known, *sorted(others.items()))
            out[key] = bound, {"name": self.names[k], "dot": dot, "square": known, "others": [{"word": w, "tf": n} for w, n in others.items()]}
        return [c for bound, c in out.values() if bound > best or not c["others"]]


CANDIDATES = pa.list_(pa.struct([("name", pa.string()), ("dot", pa.float64()), ("square", pa.float64()),
                                 ("others", pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())])))]))


def own_licences(docs: DataFrame, rules: LicenceRules = LicenceRules()) -> DataFrame:
    """The rows (id, path, text) with their own licence and score in place of the text."""
    counts = stored(word_frequencies(docs), "word-frequencies")
    n, frequencies = document_frequencies(docs, counts)
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(n, frequencies, rules))  # bounded by the templates

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array(map(shared.value.candidates, batch.column("text").to_pylist()), CANDIDATES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), found], ["id", "path", "found"])

    found = docs.select("id", "path", "text").mapInArrow(
        judge, "id long, path string, found array<struct<name: string, dot: double, square: double, others: array<struct<word: string, tf: long>>>>")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "licence-candidates")
    segments = found.select("row", F.posexplode("found").alias("segment", "c"))
    words = segments.select("row", "segment", "c.name", "c.dot", "c.square", F.explode_outer("c.others").alias("o")) \
        .select("row", "segment", "name", "dot", "square", F.col("o.word").alias("word"), F.col("o.tf").alias("tf"))
    weight = F.coalesce(F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.coalesce("n", F.lit(0)))) + 1), F.lit(0.0))
    rest = words.filter("word IS NOT NULL").join(spread(counts), "word", "left")  # a hot word is split by the skew join
    rest = rest.unionByName(words.filter("word IS NULL").withColumn("n", F.lit(None).cast("long")))
    scores = rest.groupBy("row", "segment", "name", "dot", "square").agg(F.sum(weight * weight).alias("more")) \
        .select("row", "name", F.round(F.col("dot") / F.sqrt(F.col("square") + F.col("more")), 12).alias("score"))  # sums come in any order
    best = scores.groupBy("row").agg(F.min(F.struct(-F.col("score"), "name")).alias("best")).select(
        "row", F.when(-F.col("best.col1") >= rules.threshold, F.col("best.name")).alias("own_licence"), (-F.col("best.col1")).alias("own_score"))
    return found.select("row", "id", "path").join(spread(best), "row", "left").select(
        "id", "path", "own_licence", F.coalesce("own_score", F.lit(0.0)).alias("own_score"))


def _directory(path: Column) -> Column:
    return F.when(path.isNotNull(), F.regexp_replace(path, r"/?[^/]*$", ""))


def scan_licences(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                  rules: LicenceRules = LicenceRules()) -> DataFrame:
    """(doc_id, path, own_licence, own_score, licence, inherited_from) of every row."""
    docs = df.select(df[id_col].cast("long").alias("id"), df[path_col].cast("string").alias("path"), df[text_col].cast("string").alias("text"))
    files = stored(own_licences(docs, rules), "licences").withColumn("directory", _directory(F.col("path")))
    speaking = files.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE) & F.col("own_licence").isNotNull())
    licensed = speaking.groupBy("directory").agg(
        F.min_by("own_licence", F.struct(-F.col("own_score"), "own_licence")).alias("inherited")).withColumnRenamed("directory", "ancestor")
    parts = F.split("directory", "/")
    ancestors = files.select("directory").filter("directory IS NOT NULL").distinct().select("directory", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("ancestor"))
    nearest = ancestors.distinct().join(licensed, "ancestor").groupBy("directory").agg(
        F.max_by(F.struct("inherited", "ancestor"), F.length("ancestor")).alias("near"))
    out = files.join(spread(nearest), "directory", "left")
    inherits = F.col("own_licence").isNull() & F.col("near").isNotNull()
    return out.select(F.col("id").alias("doc_id"), "path", "own_licence", "own_score",
                      F.coalesce("own_licence", "near.inherited").alias("licence"), F.when(inherits, F.col("near.ancestor")).alias("inherited_from"))
