"""The corpus pipeline, each stage against brute force on what its predecessor kept."""

import corpus_pipeline
from outcome_engine.llm.langid import label_languages, learn_languages
from outcome_engine.llm.queries import packed_pieces
from outcome_engine.llm.tables import stored

from .test_dedup import brute_lines
from .test_tokens import WORD, crc, encoded

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def near_roots(rows):
    """The smallest id of each row's component, by all pairs that share a shingle."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders, root = {}, {}, {}
    for doc, text in rows:
        w = [x for x in "".join(" " if c in BLANK else c for c in text).translate(lower).split(" ") if x]
        sets[doc] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root[doc] = doc
        for s in sets[doc]:
            holders.setdefault(s, []).append(doc)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {doc: find(doc) for doc in root}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near copies", "benchmark", "packing"]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "language":
            field = {r["doc_id"]: r for r in label_languages(docs, learn_languages(docs)).collect()}
        after = stored(stage(spark, docs, SF), "test-stage")
        got = {} if name == "packing" else {r["doc_id"]: r for r in after.collect()}
        if name == "language":
            want = {d: t for d, t in before if field[d]["lang_pred"] != "und" and field[d]["score"] >= 0.3}
            assert len(want) >= 0.95 * len(before)
        elif name == "lines":
            want = {d: t for d, _, _, t in brute_lines(before)}
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif name == "near copies":
            roots = near_roots(before)
            want = {d: t for d, t in before if roots[d] == d}
        elif name == "benchmark":
            want = {d: t for d, t in before if not any(q in " ".join(t.split()) for q in items)}
            assert len(want) < len(before)
        else:
            total = {}
            for p in after.collect():
                total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
            assert total == {d: len(ids) for d, ids in encoded(WORD, before, 1)}
            break
        assert after.columns == columns and {d: r["text"] for d, r in got.items()} == want
        docs = after
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["start"])
    assert sorted((*key(r), r["length"], r["doc_tokens"]) for r in whole.collect())[:3] and {r["doc_id"] for r in whole.collect()} == set(total)


def test_pipeline_of_odd_rows(spark, odd_docs, clashing, no_docs, tmp_path):
    spark.createDataFrame([(1, None), (2, "no leak here at all, is there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (odd_docs, clashing, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, str(tmp_path)), "odd-stage")
            assert docs.columns == start.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_pieces_carry_the_checksum(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    [(_, ids)] = encoded(WORD, [(1, "one two three")], 1)
    assert [r["ids_crc32"] for r in packed_pieces(df).collect()] == [crc(ids)]
