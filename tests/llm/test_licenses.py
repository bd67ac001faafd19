import random
import re
import time
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st

from relspark.llm import licenses
from relspark.llm.licenses import COVERAGE, TEMPLATES, Index, find_licenses, winnow


def found(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, license string")
    return sorted((tuple(r) for r in find_licenses(df, **kw).collect()), key=str)


def test_templates_are_found_whole_and_edited(spark):
    mit = re.sub(r"\s+", " ", TEMPLATES["mit"])
    edited = mit.replace("free of charge, to any person", "without any charge at all, to every person").replace("merge, ", "")
    rows = [(1, f"Intro wörds. {mit} Outro."), (2, f"x {edited} y"), (3, "nothing here is licensed at all"), (4, None), (5, ""), (6, "İ All rights reserved. ALL RIGHTS RESERVED")]
    rows += [(7, mit.upper()), (7, mit.upper()), (None, "Released under the MIT License."), (8, " ".join(mit.split()[:12])), (9, "all rights reserved " * 3000)]
    got = found(spark, rows)
    by = {}
    for d, *rest in got:
        by.setdefault(d, []).append(rest)
    assert by[1] == [["mit", 1.0, len(licenses._WORD.findall(mit)), 13, 13 + len(mit) - 1]]
    assert by[2][0][0] == "mit" and 0.85 < by[2][0][1] < 1 and rows[1][1][by[2][0][3] :].startswith("Permission")
    assert [x[0] for x in by[6]] == ["all-rights-reserved"] * 2 and [rows[5][1][x[3] : x[4]].lower() for x in by[6]] == ["all rights reserved"] * 2
    assert len(by[7]) == 2 and len(by[9]) == 3000 and by[None][0][0] == "mit-line"
    assert not {3, 4, 5, 8} & set(by)
    assert found(spark, rows, templates={}) == [] and found(spark, []) == []


def test_winnowing_keeps_one_of_every_window():
    h = [5, 3, 9, 3, 7, 8, 1, 1, 2, 6]
    got = winnow(h)
    assert all(any(i <= x < i + 4 for x in got) for i in range(len(h) - 3)) and winnow([4, 2]) == {1} and winnow([]) == set()


words = st.lists(st.sampled_from("abcdx"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(words)
def test_alignment_is_the_banded_common_subsequence(doc):
    template = "a b c d a c b d"
    index = Index({"t": template})
    numbers = licenses.np.array([index.number.get(w, 0) for w in doc], licenses.np.int64)
    t, band = template.split(), index.band(0)
    for k, low, high in index.candidates(numbers):

        @lru_cache(None)
        def best(i, j):
            if i == len(t) or j == len(doc):
                return 0
            take = best(i + 1, j + 1) + 1 if t[i] == doc[j] and low - band <= j - i <= high + band else 0
            return max(take, best(i + 1, j), best(i, j + 1))

        got = index.align(numbers, k, low, high)
        assert got[0] == best(0, 0)
        assert got[0] / len(t) >= 0 and COVERAGE > 0


def plain_finds(text, templates):
    """Every template in a text by lists and slices: hits of selected grams, bands, a full table a band, and the better of overlapping finds."""
    words = [(m[0].lower(), *m.span()) for m in licenses._WORD.finditer(text)]
    doc, out = [w[0] for w in words], []
    for name, t in templates.items():
        t = t.lower().split()
        index = Index(templates)
        k = index.names.index(name)
        grams = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
        chosen = {grams[i] for i in range(len(grams)) for g in [index.grams(index.words[k])[i]] if (k, i) in index.posts[int(g)]}
        at = sorted({j - i for j in range(len(doc) - 2) for i, g in enumerate(grams) if g in chosen and tuple(doc[j : j + 3]) == g and (k, i) in index.posts[int(index.grams(index.words[k])[i])]})
        bands, band = [], index.band(k)
        for d in at:
            if bands and d - bands[-1][0] <= band:
                bands[-1][1] = d
            else:
                bands.append([d, d])
        finds = []
        for low, high in bands:
            whole = [d for d in range(low, high + 1) if doc[max(d, 0) : d + len(t)] == t]
            best = (0, 0, -1)
            table = {}
            for i in range(len(t)):
                for j in range(max(0, low - band + i), min(len(doc), high + band + i + 1)):
                    here = max(table.get((i - 1, j), (0, 0, -1)), table.get((i, j - 1), (0, 0, -1)))
                    if t[i] == doc[j]:
                        m, s, _ = table.get((i - 1, j - 1), (0, 0, -1))
                        here = max(here, (m + 1, s if m else -j, j))
                    table[i, j] = here
                    best = max(best, here)
            m, s, e = (len(t), -whole[0], whole[0] + len(t) - 1) if whole else best
            if m >= COVERAGE * len(t):
                finds.append((-m / len(t), words[-s][1], words[e][2], m))
        kept = []
        for c, s, e, m in sorted(finds):
            if all(e <= x or s >= y for x, y in kept):
                kept.append((s, e))
                out.append((name, round(-c, 6), m, s, e))
    return out


def test_query_against_plain_lists(spark):
    r = random.Random(6)
    templates = {"one": "a b c d e f g a b", "two": "b c d x y z", "three": "a b a b a b c"}
    rows = [(i, " ".join(r.choice(["a b c d e f g a b", "b c d x y z", "a b a b a b c", *"abcdxyzq", "e f g"]) for _ in range(r.randrange(30)))) for i in range(60)]
    want = sorted(((d, *x) for d, t in rows for x in plain_finds(t, templates)), key=str)
    assert len(want) > 100 and found(spark, rows, templates=templates) == want


def test_a_long_text_of_one_notice(spark):
    began = time.time()
    text = (re.sub(r"\s+", " ", TEMPLATES["mit-line"]) + " ") * 160_000
    assert len(text) > 5_000_000 and len(found(spark, [(1, text)])) == 160_000
    assert time.time() - began < 60
