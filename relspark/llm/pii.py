"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence.

Protected entities are pattern matches (addresses, numbers) and keys: long runs of letters and digits
mixed. How much a term t near an entity e reveals of it is measured as in information-theoretic
sanitisation: PMI(e; t) = log2(n(e, t) N / (n(e) n(t))) against the information content
IC(e) = log2(N / n(e)). Few sightings prove little, so PMI is weighed by n(e, t) / (n(e, t) + PRIOR) and by m / (m + PRIOR), m the lesser of
n(e) and n(t): a term that was seen once with an entity seen once counts 0.44 of its PMI, and takes three texts to be generalised and ten to be removed
if it never stands elsewhere. A term whose weighed PMI reaches DISCLOSURE of IC is generalised where it stands
near e, one that reaches DETERMINES of it is removed. An entity counts as itself and as a member of its
class (mail domain, network, issuer, area), so that evidence on a class adds up over its members. All
numbers are numbers of distinct texts, and all are exact: a text that is there many times is one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed, small

KINDS = ("email", "ip", "card", "phone")
#: The kind of the entities that are no personal data by pattern, but keys to it.
SECRET = "secret"
#: Words on either side of an entity that are its context, and characters looked at for them. A term is a word of three letters or more.
CONTEXT, REACH = 8, 160
#: Shares of an entity's information from which a term is generalised, and removed.
DISCLOSURE, DETERMINES = 2 / 3, 0.9
#: What is added to numbers of sightings: as much doubt as half a sighting to the contrary.
PRIOR = 0.5
#: Different words that a task counts before it hands them on.
COUNTED = 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LETTER = re.compile("[A-Za-z]")
_KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+")
_WORD = re.compile(r"\w{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(m: re.Match) -> str:
    return "".join(filter(str.isdigit, m[0]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end in code points of every pattern match that passes its test, by kind and start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m)) <= 19 and _luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m)) <= 15]
    return out


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) - (1 << 63)


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Runs of 24 or more ASCII letters, digits, hyphens and underscores that hold letters and at least six digits."""
    return [(SECRET, *m.span()) for m in _KEY.finditer(text) if len(_DIGIT.findall(m[0])) >= 6 and _LETTER.search(m[0])]


def entities(kind: str, value: str) -> tuple[str, str]:
    """What a span's entity counts as: itself in a plain form, and its class."""
    if kind == "email":
        own = value.lower()
        return own, own.rpartition("@")[2]
    if kind == "ip":
        return value, ".".join(value.split(".")[:2])
    if kind == SECRET:
        return value, ""
    digits = "".join(filter(str.isdigit, value))
    return digits, digits[: 6 if kind == "card" else 4]


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """Entity hash, term hash, and the term's start and end, for the terms around each span; terms that touch a span are left out.

    Each span looks at a bounded stretch of text, and whether a term touches a span is a search among
    the merged spans, so a text full of entities takes time in proportion to its length.
    """
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(s: int, f: int) -> bool:
        i = bisect_right(starts, f - 1) - 1
        return i < 0 or ends[i] <= s

    out = []
    for kind, a, b in spans:
        own, group = entities(kind, text[a:b])
        as_what = [word_hash(f"{kind}:{own}")] + [word_hash(f"{kind} class:{group}")] * bool(group)
        lo, hi = max(0, a - REACH), min(len(text), b + REACH)
        before = [m.span() for m in _WORD.finditer(text, lo, a) if m.start() > lo or not lo or not text[lo - 1].isalnum()][-CONTEXT:]
        after = [m.span() for m in _WORD.finditer(text, b, hi) if m.end() < hi or hi == len(text) or not text[hi].isalnum()][:CONTEXT]
        for s, f in before + after:
            if free(s, f):
                t = word_hash(text[s:f])
                out += [(e, t, s, f) for e in as_what]
    return out


_LONGS = pa.list_(pa.int64())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of words with the number of texts that hold them, a text of ``copies`` counting as one in all."""
    counts: dict[int, Counter] = {}
    id_type = None

    def rows(ids: pa.Array, th: pa.Array, columns: list[list], words: list, ns: list) -> pa.RecordBatch:
        kinds, numbers = pa.array(columns[0], pa.list_(pa.string())), [pa.array(c, _LONGS) for c in columns[1:]]
        return pa.RecordBatch.from_arrays([ids, th, kinds, *numbers, pa.array(words, _LONGS), pa.array(ns, pa.list_(pa.float64()))], names=["doc_id", "th", "kind", "start", "end", "e", "t", "ts", "te", "w", "n"])

    def counted() -> Iterator[pa.RecordBatch]:
        for copies, c in counts.items():
            each = list(c.items())
            for i in range(0, len(each), 1 << 16):
                part = each[i : i + (1 << 16)]
                yield rows(pa.nulls(1, id_type), pa.nulls(1, pa.int64()), [[None]] * 7, [[word_hash(w) for w, _ in part]], [[n / copies for _, n in part]])
        counts.clear()

    for b in batches:
        id_type = b.column("doc_id").type
        found: list[list] = [[] for _ in range(7)]
        for text, copies in zip(b.column("text").to_pylist(), b.column("copies").to_pylist(), strict=True):
            counts.setdefault(copies, Counter()).update({w.lower() for w in _WORD.findall(text)})
            spans = base_spans(text) + secret_spans(text)
            near = contexts(text, spans)
            for c, x in zip(found, [*([s[i] for s in spans] for i in range(3)), *([n[i] for n in near] for i in range(4))], strict=True):
                c.append(x)
        yield rows(b.column("doc_id"), b.column("th"), found, [None] * len(b), [None] * len(b))
        if sum(map(len, counts.values())) > COUNTED:
            yield from counted()
    yield from counted()


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, th, spans``, one row for each row of ``docs``; ``th`` is the text's xxhash64.

    ``spans`` is an array of (kind, start, end) in code points, end exclusive: first the pattern
    spans of kinds email, ip, card and phone, each by start, then keys of kind ``secret``, then terms of kind ``generalise`` and
    ``remove``. A null text counts as empty and has no spans; repeated rows get equal spans and count as one
    text; an entity that all texts hold has no information, and nothing reveals it; an empty table gives an
    empty result. Texts of any length are read whole. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = checkpointed(rows.groupBy("th").agg(F.count("*").alias("copies")))
    total = texts.count()
    # texts that are there once need no number
    again = small(texts.filter("copies > 1"))
    rows = rows.join(again, "th", "left").select("doc_id", "th", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
    longs = ", ".join(f"{c} array<long>" for c in ("start", "end", "e", "t", "ts", "te"))
    seen = checkpointed(rows.mapInArrow(_scan, f"doc_id {kind}, th long, kind array<string>, {longs}, w array<long>, n array<double>"))
    found = seen.filter(F.col("w").isNull())

    # equal texts have equal contexts: one of them is enough
    near = found.filter(F.size("e") > 0).select("th", F.explode(F.arrays_zip("e", "t", "ts", "te")).alias("x")).select("th", "x.*").distinct()
    entity_texts = near.select("e", "th").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    pairs = checkpointed(near.select("e", "t", "th").distinct().groupBy("e", "t").agg(F.count("*").alias("n_et")))
    # words are counted in all texts, but only those near an entity are looked up
    terms = small(pairs.select("t").distinct())
    frequency = seen.select(F.explode(F.arrays_zip("w", "n")).alias("x")).select(F.col("x.w").alias("t"), "x.n").join(terms, "t", "left_semi").groupBy("t").agg(F.round(F.sum("n")).alias("n_t"))
    weighed = pairs.join(frequency, "t").join(entity_texts, "e")
    pmi = F.log2(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    few = F.least("n_e", "n_t")
    pmi = pmi * F.col("n_et") / (F.col("n_et") + PRIOR) * few / (few + PRIOR)
    share = F.when(F.col("n_e") < total, pmi / F.log2(F.lit(float(total)) / F.col("n_e")))
    risky = weighed.withColumn("share", share).filter(F.col("share") >= DISCLOSURE - 1e-9).select("e", "t", F.when(F.col("share") >= DETERMINES - 1e-9, "remove").otherwise("generalise").alias("kind"))
    flagged = (
        near.join(risky, ["e", "t"]).groupBy("th", "ts", "te").agg(F.max("kind").alias("kind"))
        .groupBy("th").agg(F.sort_array(F.collect_list(F.struct("kind", F.col("ts").alias("start"), F.col("te").alias("end")))).alias("terms"))
    )
    base = F.transform(F.arrays_zip("kind", "start", "end"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    both = found.select("doc_id", "th", base.alias("base")).join(small(flagged, size=F.size("terms")), "th", "left")
    return both.select("doc_id", "th", F.concat("base", F.coalesce("terms", none)).alias("spans"))


def general(term: str) -> str:
    """The class of a term by its shape: numbers by their digits, codes of letters and digits, names and acronyms by their capitals, else words."""
    if term.isdigit():
        return f"[NUMBER OF {len(term)} DIGITS]"
    if any(map(str.isdigit, term)):
        return "[CODE]"
    if term.isupper():
        return "[ACRONYM]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span replaced: patterns by [KIND], generalised terms by what they are (see ``general``), removed ones by nothing.

    Overlapping spans are replaced as one, by the first of them. Null texts stay null.
    """
    spans = find_pii(docs).dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("own"), "th", "spans")
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_th"))
    met = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("own_th") == F.col("th"))).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                parts, end = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= end:
                        what = general(text[s["start"] : s["end"]]) if s["kind"] == "generalise" else "" if s["kind"] == "remove" else f"[{s['kind'].upper()}]"
                        parts += [text[end : s["start"]], what]
                    end = max(end, s["end"])
                out.append(None if text is None else "".join([*parts, text[end:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return met.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
