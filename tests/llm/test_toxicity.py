import math
import random

import pytest

from relspark.llm import toxicity


def brute(train, texts):
    """Evidence of ``texts(text, own)`` by the formulas, with dictionaries of words."""
    words = lambda t: toxicity.distinct_words(t or "")
    begin = lambda w: w[: toxicity.BEGINNING]
    n, b = ({}, {}), ({}, {})
    for t, y in train:
        for w in words(t):
            n[y][w] = n[y].get(w, 0) + 1
        for x in {begin(w) for w in words(t)}:
            b[y][x] = b[y].get(x, 0) + 1
    size = lambda m: [sum(c.values()) for c in m]

    def kept(m, c, w, parent, own):
        both = m[0].get(w, 0) + m[1].get(w, 0) - (own is not None)
        e = size(m)[c] / max(sum(size(m)), 1) * both * parent
        return max(m[c].get(w, 0) - (own == c) - e - toxicity.DISCOUNT - toxicity.DISCOUNT_SD * math.sqrt(e), 0), both

    def level(m, parent):
        """Ratio to the shared share by class, term and own document's class."""
        terms = set(m[0]) | set(m[1])
        left = [1 - sum(kept(m, c, w, parent(c, w, None), None)[0] for w in terms) / size(m)[c] if size(m)[c] else 1 for c in (0, 1)]
        alive = {w for w in terms if any(kept(m, c, w, parent(c, w, None), None)[0] > 0 for c in (0, 1))}

        def ratio(c, w, own):
            p = parent(c, w, own)
            if w not in alive:
                return left[c] * p
            x, both = kept(m, c, w, p, own)
            return (x * sum(size(m)) / size(m)[c] / both if both and size(m)[c] else 0) + left[c] * p

        return ratio

    rb = level(b, lambda c, w, own: 1.0)
    rw = level(n, lambda c, w, own: rb(c, begin(w), own))
    out = []
    for t, own in texts:
        own = toxicity.OWN[own]
        s = sum(math.log(rw(1, w, own) / rw(0, w, own)) for w in words(t))
        left = math.log(rw(1, "", None) / rw(0, "", None))
        out.append(100 * (s / (len(words(t)) + toxicity.LENGTH) if words(t) else left))
    return out


def corpus(n, seed, shortest=0):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(60)] + [f"common{i}" for i in range(5)] * 6
    rows = []
    for i in range(n):
        y = int(r.random() < 0.2)
        w = r.choices(plain, k=r.randint(shortest, 30)) + (r.choices(["nasty", "NASTY", "vile", "vileness", "vilely"], k=2) if y else [])
        r.shuffle(w)
        rows.append((" ".join(w), y))
    return rows


@pytest.mark.parametrize("most", [10**6, 3])
def test_evidence_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "MAX_WEIGHTS", most)
    monkeypatch.setattr(toxicity, "COUNTED", 50)
    train = corpus(300, 1)
    df = spark.createDataFrame(train, "text string, y int").repartition(3)
    counts = df.mapInArrow(toxicity._count, "kind int, h long, parent long, n0 long, n1 long").groupBy("kind", "h").agg({"parent": "first", "n0": "sum", "n1": "sum"})
    counts = counts.select("kind", "h", *(counts[f"{a}({b})"].alias(b) for a, b in (("first", "parent"), ("sum", "n0"), ("sum", "n1"))))
    model = toxicity.Model(*toxicity._weights(counts))
    assert 0 < model.weights.count() < 60
    asked = [(t, 0) for t, _ in corpus(40, 2)] + [("", 0), ("unheard words", 0), ("vileish", 0)] + [(t, 1 + y) for t, y in train[:40]]
    asked += asked[:3]
    got = toxicity.evidence(spark.createDataFrame([(i % 80, t, o) for i, (t, o) in enumerate(asked)], "i int, text string, own int"), model).collect()
    want = sorted(zip([i % 80 for i in range(len(asked))], brute(train, asked), strict=True))
    for g, w in zip(sorted((r.i, r.evidence) for r in got), want, strict=True):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-9


def test_toxic_words_score_high(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(corpus(900, 3, 25))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i].evidence, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 200 and min(e for e, y in held if y) > max(e for e, y in held if not y)
    assert sum(got[i].predicted == y for i, _, y in rows) > 0.99 * len(rows)
    assert got[5000].score == got[5001].score and got[5000].predicted == 0
