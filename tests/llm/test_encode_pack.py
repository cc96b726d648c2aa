"""Encoding against the public tokenizer library; packing on odd sizes."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import encode as E
from textloom.llm import packing as P

ODD = [None, "", " ", "\n\n  a", "it's we'll '' 's", "<|endoftext|> x", "日本語 テキスト", "a" * 5000, "  \t\r\n x\x1c\x85​﻿", "é́ 😀😀 ½²", "x" + " " * 300 + "y", "\n's"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark, tokenizer):
    rnd = random.Random(3)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x4E00, 0x4E40), 0x1F600, 0x0B, 0x2028, 0x3000]] + ["'s", " ", "\n", "'re"]
    texts = ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for words in (0, 50, 60_000):
        got = {r.doc_id: r.ids for r in E.token_ids(rows, lexicon_words=words).collect()}
        assert all(got[i] == (tokenizer.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts))
    counts = {r.doc_id: r.n_tokens for r in E.token_counts(rows).collect()}
    assert all(counts[i] == len(got[i]) for i in got)


def test_empty_table_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.ids for r in E.token_ids(rows).collect()] == [[64, 275]] * 2
    assert E.token_ids(rows.limit(0)).count() == 0


def test_lexicon_is_exact_and_shares_suffixes():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "b", "bé"])}
    lex = E.Lexicon.build(words)
    assert lex.look_up([*words, b"", b"t", b"tapsx", b"zz"]) == [*words.values(), None, None, None, None]
    assert len(lex.final) < 8
    assert E.Lexicon.build({}).look_up([b"a"]) == [None]


def test_lexicon_is_read_from_the_map(tmp_path):
    words = {str(i).encode(): [i] for i in range(3000)}
    E.Lexicon.build(words).save(str(tmp_path / "lex"))
    lex = E.Lexicon.load(str(tmp_path / "lex"))
    assert all(isinstance(getattr(lex, name), np.memmap) for name in E.Lexicon.FILES)
    assert lex.look_up([*words, b"x"]) == [*words.values(), None]


def test_most_frequent_words_without_a_sort(spark):
    """What goes to the driver is what is kept, however many partitions there are; a class of counts is kept as a whole."""
    rows = spark.createDataFrame([(f"w{i}", 1 + i % 100) for i in range(10_000)], "word string, n long").repartition(200)
    got = E.most_frequent(rows, 2_550)
    assert got.count() == 2_500 and got.agg({"n": "min"}).first()[0] == 76
    assert E.most_frequent(rows, 50).count() == 0 and E.most_frequent(rows, 20_000).count() == 10_000 and E.most_frequent(rows.limit(0), 5).count() == 0


@pytest.mark.parametrize("capacity", [512, 1024, 2048, 8192])
def test_patterns_never_need_more_containers(capacity):
    rng = np.random.default_rng(capacity)
    for sizes in (rng.integers(1, capacity + 1, 4000), np.minimum(capacity, rng.lognormal(5.5, 1, 4000).astype(int) + 1), rng.choice([capacity // 3, capacity // 2 + 1, capacity // 6], 1000)):
        plain = np.zeros(len(sizes), np.int64)
        assert len(set(P.pack(sizes, capacity).tolist())) <= P.largest_first(P.Pool(sizes), plain, capacity, 0, [])


def test_long_words_merge_like_short_ones():
    rank = E.ranks(E.ranks_path())
    for w in (b"abcabcabc" * 30, b"=" * 100):
        parts = [w[i : i + 1] for i in range(len(w))]
        assert b"".join(k for i in E._merge_long(parts, rank) for k, v in rank.items() if v == i) == w


@pytest.mark.parametrize("capacity", [1, 7, 512, 8192])
def test_packing_never_overfills(capacity):
    rng = np.random.default_rng(capacity)
    for sizes in (np.zeros(0, int), np.zeros(3, int), np.full(50, capacity), rng.integers(0, capacity + 1, 3000), np.ones(500, int)):
        at = P.pack(sizes, capacity)
        assert len(at) == len(sizes) and (at >= 0).all()
        if sizes.sum():
            load = np.bincount(at, weights=sizes)
            assert load.max() <= capacity and len(load) <= 1.1 * sizes.sum() / capacity + 2


def test_fill_is_high_and_rows_are_kept(spark):
    rng = np.random.default_rng(5)
    sizes = [None, 0, 5000, *rng.lognormal(5.5, 0.8, 4000).astype(int).tolist()]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n_tokens long")
    rows = P.fill_containers(items, [(1, 512), (2, 2048)], 2).collect()
    for b, cap in ((1, 512), (2, 2048)):
        mine = [r for r in rows if r.budget_id == b]
        by, load = {}, {}
        for r in mine:
            by.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert set(by) == set(range(len(sizes))) and max(load.values()) <= cap
        for i, s in enumerate(sizes):
            pieces = sorted(by[i])
            assert sum(p[2] for p in pieces) == (s or 0) and (len(pieces) == 1) == ((s or 0) <= cap)
            assert [p[1] for p in pieces] == [sum(q[2] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(load.values()) / (cap * sum(v > 0 for v in load.values())) > 0.97
    assert P.fill_containers(items.limit(0), [(1, 512)], 1).count() == 0


def test_nnls_fits():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = P.nnls(a, np.array([4.0, 3.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [4, 3])
