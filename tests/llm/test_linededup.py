import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from relspark.llm import linededup
from relspark.llm.linededup import wrapped_lines, without_repeated_lines


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["word ", "A. ", "b!c ", "\n", "  ", "...", "?", "é\t", "x. y. "]), st.characters(exclude_categories=["Cs"])), max_size=80).map("".join))
def test_lines_join_to_the_text(text):
    lines = wrapped_lines(text)
    assert "".join(lines) == text
    assert all(len(x.split()) <= linededup.WRAP for x in lines)


def brute(docs, min_words=0, wrap=True):
    """doc rows -> text and words removed, by dictionaries of windows in order; lines are split here on their own."""
    uniq = sorted(set(docs), key=lambda d: (d[0] is None, d[0], d[2]))
    seen, out = set(), {}
    for doc_id, text, _ in uniq:
        own = [x.split() for x in (text or "").splitlines() if x.split()]
        kinds = [("own", own, min_words)] + ([("wrapped", [x.split() for x in wrapped_lines(text or "") if x.split()], linededup.MIN_WORDS)] if wrap else [])
        gone = set()
        for kind, lines, least in kinds:
            first = 0
            for i in range(len(lines) - 2):
                size = sum(map(len, lines[i : i + 3]))
                if size >= least:
                    key = (kind, *(" ".join(w) for w in lines[i : i + 3]))
                    if key in seen:
                        gone |= set(range(first, first + size))
                    seen.add(key)
                first += len(lines[i])
        words = re.findall(r"\s*\S+\s*", text or "")
        out[doc_id, text] = "".join(x for j, x in enumerate(words) if j not in gone) if gone else text, len(gone)
    return sorted(((d, *out[d, t]) for d, t, _ in docs), key=str)


P = "the first line of a shared passage goes here\nthen comes a second line of it\nand at last the third line ends it here now"
LONG = " ".join(f"w{i}" for i in range(70))
ROWS = [
    (1, None), (2, ""), (3, "one\ntwo"), (4, f"own start\n{P}\nown end"), (5, f"other start here\n{P}\nother end"), (5, f"other start here\n{P}\nother end"), (None, P), (6, P), (7, "same line of five words\n" * 9),
    (8, f"intro. {LONG}"), (9, f"other opening sentence! {LONG} and more"), (10, "\n \n\n" * 20), (11, "a b c d e f g h. " * 3000),
    (12, "Home\nAbout us\nContact\nLogin\nown text of twelve"), (13, "Home\n\n About  us\nContact\nLogin"), (14, "x\nHome\nAbout us\nContact\nLogin\ny"),
]


def test_matches_brute_force(spark, monkeypatch):
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in ROWS], "doc_id long, text string, doc string, th int")
    import pyspark.sql.functions as F

    th = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = brute([(d, t, th[d, t]) for d, t in ROWS])
    for most in (10**6, 2, 0):
        monkeypatch.setattr(linededup, "MAX_BITMAP_HASHES", most)
        monkeypatch.setattr(linededup, "MAX_BROADCAST_WINDOWS", most)
        monkeypatch.setattr(linededup, "MAX_BROADCAST_DOCS", most)
        got = without_repeated_lines(df.repartition(3), removed="gone")
        assert got.columns == ["doc_id", "text", "doc", "th", "gone"]
        assert sorted(((r.doc_id, r.text, r.gone) for r in got.collect()), key=str) == want
    kept = {d: t for d, t, _ in want}
    assert kept[12] == ROWS[-3][1] and kept[13] == "" and kept[14] == "x\ny"
    assert kept[6] == "" and LONG not in kept[9] and kept[9].startswith("other opening") and kept[4] == ROWS[3][1]


def test_empty_table(spark):
    assert without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passage_at_any_place_in_a_sentence(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(n, " ".join([*(f"d{n}x{i}" for i in range(n)), passage, *(f"d{n}y{i}" for i in range(9))])) for n in range(41)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id: [w for w in r.text.split() if w.startswith("p")] for r in without_repeated_lines(df).collect()}
    assert len(kept[0]) == 60 and all(len(kept[n]) <= 30 for n in range(1, 41))


def test_passage_of_short_lines(spark):
    for end in (". ", "\n"):
        passage = end.join(f"P{i}" for i in range(60))
        rows = [(n, f"{f'Own d{n} words. ' * n}{passage}{end}{'Last words. ' * n}") for n in range(8)]
        kept = {r.doc_id: r.text.count("P") for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert kept[0] == 60 and all(kept[n] <= 24 for n in range(1, 8))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=80))
def test_places_are_taken_in_order_of_key(keys):
    key = np.array(keys, np.uint64)
    taken = []
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        if all(abs(i - j) >= linededup.APART for j in taken):
            taken.append(i)
    assert np.flatnonzero(linededup._taken(key)).tolist() == sorted(taken)


def test_bitmap_keeps_all_repeats(spark, monkeypatch):
    df = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id long, text string").repartition(3)
    want = sorted(without_repeated_lines(df).collect(), key=str)
    for bits, piece in ((1 << 26, 1 << 22), (64, 16), (8, 1 << 20)):
        monkeypatch.setattr(linededup, "BITMAP", bits)
        monkeypatch.setattr(linededup, "PIECE", piece)
        assert sorted(without_repeated_lines(df).collect(), key=str) == want


def test_counted_hashes_of_more_than_one_window(spark, monkeypatch):
    import random

    r = random.Random(1)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(3000)]
    rows = hashes + hashes[:700] + hashes[:50] * 30
    df = spark.createDataFrame([(np.array(rows[i : i + 7], np.int64).tobytes(),) for i in range(0, len(rows), 7)], "h binary").repartition(5)
    for at_once, buckets in ((10**6, 8), (200, 3)):
        monkeypatch.setattr(linededup, "SORTED", at_once)
        low = lambda h, n=buckets: ((h % (1 << 64)) >> 40) % n << 40 | h % (1 << 40)
        assert sorted(x.t for x in linededup._twice(df, buckets).collect()) == sorted(map(low, hashes[:700]))
    assert linededup._twice(df.limit(0), 8).collect() == []


def test_short_passages_inside_paragraphs(spark):
    import random

    r, rows, size = random.Random(2), [], 30
    for n in range(60):
        passage = [f"p{n}w{i}" for i in range(size)]
        for side in (0, 1):
            own = [f"d{n}s{side}x{i}" for i in range(160)]
            at = r.randrange(20, 120)
            rows.append((2 * n + side, " ".join(own[:at] + passage + own[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [sum(w.startswith("p") for w in x.text.split()) for x in without_repeated_lines(df).collect() if x.doc_id % 2]
    # what stays of a found passage are the cut lines at its ends, each shorter than two gaps
    assert len(left) == 60 and sum(n < size for n in left) >= 54 and sum(left) / 60 < 2 * (2 * linededup.APART - 1)


def test_floor_and_own_lines_only(spark):
    df = spark.createDataFrame([(d, t) for d, t in ROWS if d != 5], "doc_id long, text string").repartition(3)
    rows = [(d, t, 0) for d, t in ROWS if d != 5]
    for options in ({"wrap": False}, {"wrap": False, "min_words": 12}, {"min_words": 12}):
        got = sorted(((r.doc_id, r.text, r.gone) for r in without_repeated_lines(df, removed="gone", **options).collect()), key=str)
        assert got == brute(rows, **options)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=12))
def test_spans_merge(spans):
    got = linededup.merged(np.array([a << 32 | n for a, n in spans], np.int64))
    covered = [i in {a + j for a, n in spans for j in range(n)} for i in range(60)]
    assert [any((x >> 32) <= i < (x >> 32) + (x & 0xFFFFFFFF) for x in got.tolist()) for i in range(60)] == covered
    assert all((a >> 32) + (a & 0xFFFFFFFF) < (b >> 32) for a, b in zip(got.tolist(), got.tolist()[1:], strict=False))
