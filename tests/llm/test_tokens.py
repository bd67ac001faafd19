import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from relspark.llm import tokens
from relspark.llm.packing import TournamentTree, first_fit_decreasing, pack

BYTE, WORD = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
ODD = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎  ​　﻿'sSté́İΣς1²٣!<|endoftext|>漢字😀a b  c"
texts = st.lists(st.one_of(st.sampled_from([*ODD, "<|endoftext|>", "<|startoftext|>", "  ", "'s", "don't ", " the", "End. ", "a.,", "É, ", "<|ENDOFTEXT|>", "x1.", "!.", "_.", "straße ", "née,", "ÿß ", "naïve."]), st.characters(exclude_categories=["Cs"])), max_size=60).map("".join)
library = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_pieces_give_the_librarys_ids(text):
    got = [i for v in next(iter(tokens.encoder(BYTE, tokens.BEFORE_SPACE, list).values([text]))) for i in v]
    assert got == library[BYTE].encode(text, add_special_tokens=False).ids
    got = np.frombuffer(next(tokens.word_encoder(WORD).ids([text])), "<u2").tolist()
    assert got == library[WORD].encode(text, add_special_tokens=False).ids


def test_words_of_symbols_and_letters_match_the_library():
    some = [chr(i) for i in range(33, 256)]
    odd = ["it's", "'S.", "THE&&&", "<|ENDOFTEXT|>", "x<|endoftext|>y", "a1b22,c.", "$$$.", "İx", "née's", "ÀÉ×÷", "_.", "a\u0301"]
    text = " ".join([a + b for a in some for b in some] + odd)
    enc = tokens.WordEncoder(WORD)
    for t in (text, text.replace(".", "").replace(",", "").replace("<|", ""), *odd):
        assert np.frombuffer(next(enc.ids([t])), "<u2").tolist() == library[WORD].encode(t, add_special_tokens=False).ids


def test_common_words_are_encoded_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 500)
    enc, want = tokens.WordEncoder(WORD), []
    for i in range(40):
        some = [f"the of&&& née x{'abcdefghij'[j % 10] * (i + 1)}{j}" for j in range(60)]
        assert [np.frombuffer(b, "<u2").tolist() for b in enc.ids(some)] == [library[WORD].encode(t, add_special_tokens=False).ids for t in some]
        want.append([enc.words[w] for w in ("the", "of&&&", "née")])
        assert len(enc.words) <= 500 + 64
    assert all(a is b for now in want for a, b in zip(now, want[0], strict=True))


def huge_texts():
    r = random.Random(4)
    words = ["the", "née", "x1", "foo,", "  ", "\n", "漢字", "<|endoftext|>"]
    return [" ".join(r.choices(words, k=3000)), "z" * 900, "ab" * 400 + " " + "y9" * 500, " " * 700, "one two " * 30, "　a" * 500, "a" * 80 + " b" * 300]


@pytest.mark.parametrize("chunk", [64, 500])
def test_huge_documents_match_the_library(spark, chunk):
    rows = list(enumerate(huge_texts()))
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    got = {r.doc: r.n_tokens for r in tokens.huge_counts(df, BYTE, chunk, 8).collect()}
    assert got == {i: len(library[BYTE].encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_token_counts(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é"), (4, "word é<|endoftext|> " * 4000), (5, "q" * 40_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, BYTE).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), len(library[BYTE].encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)
    assert tokens.token_counts(df.limit(0), BYTE).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_tree_is_first_fit_decreasing(sizes):
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
        room += [50] * (b == len(room))
        room[b] -= sizes[i]
        want[i] = b
    assert first_fit_decreasing(sizes, 50) == want
    assert TournamentTree(1, 5).place(5) == 0


def test_packing(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d"), (4, "long words go on "  * 900)] + [(i, "some text " * (i % 37)) for i in range(10, 300)]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, raw int").repartition(4)
    limit = 64
    got = pack(df, WORD, limit=limit, group_bytes=20_000).collect()
    ids = {(d, t): [*library[WORD].encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    left = sorted(str((d, tuple(ids[d, t][a : a + limit]), a, len(ids[d, t]))) for d, t in rows for a in range(0, len(ids[d, t]), limit))
    assert sorted(str((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.start, r.doc_tokens)) for r in got) == left
    seqs = {}
    for r in got:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) >= 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *s], s, strict=False)) and sum(n for _, n in s) <= limit
    assert len({s >> 32 for s in seqs}) > 1
    total = sum(r.length for r in got)
    assert total / (len(seqs) * limit) > 0.9
    assert pack(df.limit(0), WORD).collect() == []


def test_groups_do_not_depend_on_partitions(spark):
    rows = [(i % 50, f"text {i % 40} " * (i % 9)) for i in range(300)] + [(1, "same")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, r.start, r.ids, r.sequence_id, r.offset) for r in pack(df.repartition(n), WORD, limit=32, group_bytes=500).collect()) for n in (2, 7)]
    assert got[0] == got[1] and len(got[0]) >= len(rows)
    groups = {}
    for d, _, _, s, _ in got[0]:
        groups.setdefault(s >> 32, []).append(d)
    assert len(groups) > 5 and max(x.count(1) for x in groups.values()) < 60


def test_only_the_chunks_at_a_failed_seam_are_encoded_again(spark):
    """A run of letters over one seam, and one over three: the count is the library's, and pieces elsewhere stay as they are."""
    words = "some words and more of them, again and again " * 40
    rows = [(1, words + "q" * 300 + words), (2, words + "z" * 900 + words), (3, "y" * 2500), (4, words)]
    got = tokens.huge_counts(spark.createDataFrame(rows, "doc long, text string"), BYTE, 256, 16)
    assert {r.doc: r.n_tokens for r in got.collect()} == {d: len(library[BYTE].encode(t, add_special_tokens=False).ids) for d, t in rows}
    run = tokens._cut(256, 16)
    first = pa.RecordBatch.from_pydict({"doc": [1], "text": [rows[0][1]], "parts": [None]})
    coded = [x for b in tokens._encode_chunks(BYTE, 256, 16)(run(iter([first]))) for x in b.to_pylist()]
    again = tokens._splice(pa.Table.from_pylist(coded, schema=tokens._CODED)).to_pylist()[0]["again"]
    assert len(again) == 1 and again[0]["until"] - again[0]["no"] <= 3 and len(coded) > 10
