import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from relspark.llm import pii
from relspark.llm.pii import base_spans, contexts, entities, find_pii, sanitised, secret_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


pieces = ["a", "b.c", "@", "@x.y", "1", "22", ".", "..", "-", " ", "+", "+1 (555) 123-45", "4111111111111111", "4111 1111-1111 1111", "10.0.0.255", "256.1.1.1", "é", "٣", "%", "mail@a-b.co.uk", "0"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(pieces), max_size=14).map("".join))
def test_base_spans_are_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_long_runs_stay_fast():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "9" * 5000 + "@"):
        base_spans(t)


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"text number {i}: the patient Zephyrine wrote from ann@clinic.org about item{i}") for i in range(12)] + [(20 + i, f"ask Ondine or ann@clinic.org for leaf {i}") for i in range(4)]
    rows += [(i, f"plain words about the weather and text number {i}") for i in range(30, 220)] + [(300, None), (301, ""), (302, "x ann@clinic.org"), (302, "x ann@clinic.org"), (None, "10.1.1.1")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in find_pii(df).collect()}
    assert find_pii(df).count() == len(rows)
    text = rows[0][1]
    terms = {text[s:e]: k for k, s, e in got[0][1:]}
    assert got[0][0] == ("email", text.index("ann@"), text.index(" about"))
    # twelve texts prove much, four something, one nothing
    assert terms.get("Zephyrine") == "remove" and "the" not in terms and "number" not in terms and "item0" not in terms
    assert {rows[12][1][s:e]: k for k, s, e in got[20][1:]}["Ondine"] == "generalise"
    assert got[300] == got[301] == [] and got[None] == [("ip", 0, 8)] and got[30] == []
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert "ann@" not in clean[0] and "Zephyrine" not in clean[0] and "[EMAIL]" in clean[0] and clean[20].startswith("[WORD] [NAME] or [EMAIL]") and clean[300] is None and clean[None] == "[IP]"
    assert find_pii(df.limit(0)).collect() == []


def brute_terms(docs):
    """text -> {(start, end): kind} of the terms, by comparing distinct texts one by one."""
    texts = sorted({t or "" for _, t in docs})
    words = {t: {w.lower() for w in re.findall(r"\w{3,}", t)} for t in texts}
    near = {}
    for t in texts:
        spans = plain_spans(t) + [("secret", *m.span()) for m in re.finditer(r"[A-Za-z0-9_-]{24,}", t) if sum(c.isdigit() for c in m[0]) >= 6 and re.search("[A-Za-z]", m[0])]
        for kind, a, b in spans:
            own, group = entities(kind, t[a:b])
            before = [m.span() for m in re.finditer(r"\w{3,}", t[:a])][-8:]
            after = [(x + b, y + b) for x, y in (m.span() for m in re.finditer(r"\w{3,}", t[b:]))][:8]
            for x, y in before + after:
                if not any(x < f and s < y for _, s, f in spans):
                    near.setdefault(t, []).extend(((kind, e, i), (x, y)) for i, e in enumerate((own, group)) if e)
    n_e, n_et = {}, {}
    for t, each in near.items():
        for e in {e for e, _ in each}:
            n_e[e] = n_e.get(e, 0) + 1
        for k in {(e, t[x:y].lower()) for e, (x, y) in each}:
            n_et[k] = n_et.get(k, 0) + 1
    out, n = {}, len(texts)
    for t, each in near.items():
        for e, (x, y) in each:
            w = t[x:y].lower()
            if n_e[e] < n:
                n_t = sum(w in words[u] for u in texts)
                few = min(n_e[e], n_t)
                weight = n_et[e, w] / (n_et[e, w] + pii.PRIOR) * few / (few + pii.PRIOR)
                share = weight * math.log2(n_et[e, w] * n / (n_e[e] * n_t)) / math.log2(n / n_e[e])
                if share >= pii.DISCLOSURE - 1e-9:
                    kind = "remove" if share >= pii.DETERMINES - 1e-9 else "generalise"
                    out.setdefault(t, {})[x, y] = max(kind, out.get(t, {}).get((x, y), kind))
    return out


def test_terms_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "COUNTED", 30)
    r = random.Random(7)
    names = ["Zephyrine", "Quill", "Ondine", "Bram"]
    plain = [f"word{i}" for i in range(30)] + ["the", "and", "of", "a"] * 10
    rows = []
    for i in range(400):
        w = r.choices(plain, k=r.randint(3, 25))
        if r.random() < 0.5:
            k = r.randrange(4)
            w[r.randrange(len(w))] = r.choice([f"{names[k]} n{i}@host{k}.org", f"{names[k]}, 10.{k}.0.{i}", f"+49 30 1234 5{i:03d}", f"key = 0123456789abcdef01234567{i:02x}"])
        rows.append((i, " ".join(w)))
    rows += [(450 + i, f"the {'word1 ' * i} Xanthe ann@clinic.org and of word{i}") for i in range(14)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(40)] + [(900, None), (901, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, copies int").repartition(3)
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 40 and {k for m in want.values() for k in m.values()} == {"remove", "generalise"}
    for r in find_pii(df).collect():
        text = dict(rows)[r.doc_id] or ""
        assert {(s.start, s.end): s.kind for s in r.spans if s.kind in ("remove", "generalise")} == want.get(text, {})
        assert [tuple(s) for s in r.spans if s.kind in pii.KINDS] == plain_spans(text)


def test_keys_and_long_texts():
    t = 'token = "908038b7daaf91e730d2f64001c52934d43" and abcdefghijklmnopqrstuvwxyzabc 123456789012345678901234567890'
    assert secret_spans(t) == [("secret", 9, 44)]
    began = time.time()
    for long in ("mail a.b@c1.org by hand, then 10.0.0.1 too " * 25_000, "x@y.zz " * 150_000, "a1" * 500_000):
        spans = base_spans(long) + secret_spans(long)
        assert len(contexts(long, spans)) <= 32 * len(spans)
    assert time.time() - began < 60
