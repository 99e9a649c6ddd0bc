"""Packing and wavelet shards: exact round trips, and the optimum by brute force."""

import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from outcome_engine.llm import queries as Q
from outcome_engine.llm.packing import PackRules, best_cuts, cut_places, pack_documents
from outcome_engine.llm.wavelet import WaveletMatrix, read_shards, write_shards

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def encoded(path, rows, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [(doc, t.encode(text or "", add_special_tokens=False).ids + [end]) for doc, text in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def padding(n, size):
    return 0 if n & (n - 1) == 0 else size - n


def brute_cost(at, cost, rules):
    f = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        f[j] = min(f[i] + padding(int(at[j] - at[i]), rules.size) for i in range(j) if at[j] - at[i] <= rules.size) + int(cost[j])
    return f


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=25), st.randoms(use_true_random=False), st.booleans())
def test_cuts_are_the_optimum(lengths, rng, ended):
    rules = PackRules(size=32, sentence_cost=2, hard_cost=5, hard_gap=8, hard_step=4, least_power=1)
    total = sum(lengths)
    sentences = np.array(sorted({rng.randint(1, total) for _ in range(total // 6 + 1)}))
    at, cost = cut_places(total, np.cumsum(lengths), sentences, rules)
    assert at[0] == 0 and at[-1] == total and np.diff(at).max() <= rules.size
    ends = best_cuts(at, cost, rules, ended)
    f, cost_of = brute_cost(at, cost, rules), dict(zip(at.tolist(), cost.tolist()))
    own = sum(padding(b - a, rules.size) + cost_of[b] for a, b in pairwise([0, *ends]))
    if ended:
        assert ends[-1] == total and own == f[-1]
    else:
        assert own == min(v for p, v in zip(at, f) if p >= total - rules.size and p > 0)


def check_pieces(df, rows, size=2048):
    """Every id in one piece, pieces gapless in their documents and sequences; the share of padding."""
    pieces = df.withColumn("crc", F.crc32("ids")).collect()
    documents = encoded(WORD, rows, 1)
    left = {}
    for doc, ids in documents:
        left.setdefault((doc, len(ids)), []).append(ids)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) <= size
    of = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        of.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for key, own in of.items():
        copies = left.pop(key)
        assert sum(p["length"] for p in own) == key[1] * len(copies)
        for p in own:
            assert any(crc(ids[p["start"]:p["start"] + p["length"]]) == p["crc"] for ids in copies)
    assert not left
    sizes = [sum(p["length"] for p in own) for own in by_sequence.values()]
    return sum(padding(n, size) for n in sizes) / max(1, sum(sizes))


def test_packing_of_odd_rows(odd_docs, clashing, no_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert check_pieces(pack_documents(odd_docs.coalesce(1), WORD), rows) < 0.1
    check_pieces(pack_documents(clashing, WORD), rows)
    assert pack_documents(no_docs, WORD).count() == 0


def test_packing_wastes_little(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert check_pieces(pack_documents(df, WORD, rules=PackRules(stretch=20_000)), rows) < 0.02
    assert check_pieces(pack_documents(df, WORD), rows) < 0.02


def test_long_runs_without_sentences_are_cut(spark):
    rows = [(1, "word " * 9000), (2, "x")]
    assert check_pieces(pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORD), rows) < 0.05


# ---- wavelet matrix ----

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 3), max_size=700))
def test_wavelet_matrix_against_the_plain_list(values):
    ids = np.array(values, np.uint32)
    data = WaveletMatrix.build(ids).to_bytes([None, 7], np.array([1, 2]))
    m, docs, lengths = WaveletMatrix.from_bytes(data)
    assert docs == [None, 7] and lengths.tolist() == [1, 2]
    assert m.decode().tolist() == values
    if values:
        assert m.access(np.arange(len(values))).tolist() == values
    for symbol in {*values[:5], 1, 99_999}:
        assert m.occurrences(symbol).tolist() == [i for i, v in enumerate(values) if v == symbol]
        a, b = len(values) // 4, len(values) // 2
        assert m.count(symbol, a, b) == values[a:b].count(symbol)
        assert m.occurrences(symbol, a, b).tolist() == [i for i in range(a, b) if values[i] == symbol]
        for k in range(min(3, values.count(symbol))):
            assert m.select(symbol, k) == [i for i, v in enumerate(values) if v == symbol][k]


def test_a_shard_is_smaller_than_plain_ids():
    rng = random.Random(1)
    ids = np.array([min(int(rng.expovariate(0.01)), 5000) for _ in range(100_000)], np.uint32)
    assert len(WaveletMatrix.build(ids).to_bytes([1], np.array([len(ids)]))) < 2 * len(ids)
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"other")


@pytest.mark.parametrize("shard_tokens", [50, 1 << 20])
def test_shards_hold_the_documents_in_order(spark, odd_docs, clashing, no_docs, odd_rows, tmp_path, shard_tokens):
    for name, docs in (("odd", odd_docs), ("clash", clashing)):
        write_shards(docs, str(tmp_path / name), BYTE, shard_tokens=shard_tokens)
        got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_shards(spark, str(tmp_path / name)).collect())
        assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
        assert [g[1] for g in got] == sorted(g[1] for g in got)
        want = sorted((-1 if d is None else d, len(ids), crc(ids)) for d, ids in encoded(BYTE, [r[:2] for r in odd_rows], 0))
        assert sorted(g[1:] for g in got) == want
    write_shards(no_docs, str(tmp_path / "none"), BYTE)
    assert read_shards(spark, str(tmp_path / "none")).count() == 0


def test_token_query_against_whole_text_encoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in Q.op6_token_ids(spark, sf).collect())
    start, want = 0, []
    for doc, ids in encoded(BYTE, rows, 0):
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
