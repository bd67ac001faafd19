"""Exact tokenizer calls with a cache of pieces, and token counts of huge documents by overlap resynchronisation.

A text is cut where its tokenizer provably starts afresh, and each distinct piece is encoded by the
library once a worker; the pieces' ids joined are the text's ids. Huge documents go to the library in
overlapping chunks over many tasks, which are spliced where neighbours have a stable boundary in common.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed

#: Unicode's White_Space, as the library's patterns read it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Byte-level BPE with the usual pattern: no pre-token holds white space but at its start, and its
#: end depends on no more than the next character, so it starts afresh wherever a space follows
#: another character.
BEFORE_SPACE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
CACHED_PIECES, CACHED_CHARS = 300_000, 6_000_000
#: Texts that are cut to pieces before the library is called for the new ones.
TEXTS = 64


class PieceEncoder:
    """Maps the pieces of texts to ``value(ids)``, calling the library once for each piece that the cache lacks."""

    def __init__(self, path: str, pieces: re.Pattern, value: Callable):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces, self.value = pieces, value
        self.cache: dict[str, object] = {}
        self.chars = 0

    def values(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its pieces."""
        for i in range(0, len(texts), TEXTS):
            cut = [self.pieces.findall(t) for t in texts[i : i + TEXTS]]
            if len(self.cache) > CACHED_PIECES or self.chars > CACHED_CHARS:
                self.cache.clear()
                self.chars = 0
            new = list(set().union(*cut).difference(self.cache))
            for piece, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                self.cache[piece] = self.value(e.ids)
                self.chars += len(piece)
            yield from (list(map(self.cache.__getitem__, c)) for c in cut)


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, pieces: re.Pattern, value: Callable) -> PieceEncoder:
    """The worker's encoder of this kind, made at the first call."""
    key = (path, pieces, value.__qualname__)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, pieces, value)
    return _encoders[key]


#: Words after which a worker begins a new generation; it remembers two.
CACHED_WORDS = 200_000
_WORDS = re.compile("[^ \t\n\r]+")
#: Texts in which a space before each full stop and comma could part symbols that belong together,
#: or that hold a special token or one of the controls at which str.split cuts and the library doesn't.
#: All begin at one of a few characters, so that the search skips the rest.
_TANGLED = re.compile(r"[.,<\x1c-\x1f](?:(?<=[^\w\s][.,])|(?<=_[.,])|(?<=<)(?=\|)|(?<=[\x1c-\x1f]))")
#: Letters that the library's chain lower-cases, and then leaves alone but for the bytes' stand-ins.
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Printable words without the apostrophe (of contractions) and the beginning of special tokens, and the parts that the library's pattern makes of them.
_PRINTED, _PARTED = re.compile("[!-&(-;=-~]+"), re.compile("[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


class WordEncoder:
    """Ids, as little-endian bytes, of texts by a byte-level tokenizer that lower-cases and drops white space.

    Words between white space are independent there, and so are a letter or digit and the full stop
    or comma after it. Words of plain letters, and the parts of printable ones, go to the library with
    its BPE model alone, all else through its whole chain; each is encoded once while it is remembered.
    Words of the generation before are taken over when met again, so that common ones stay;
    a new one begins after ``most`` words (CACHED_WORDS, if none is given).
    """

    def __init__(self, path: str, most: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = self.tokenizer.model
        self.bare = Tokenizer(model)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        #: The space stays, as it stands between words.
        self.stand_ins = _byte_characters() | {32: 32}
        vocabulary, mark = self.tokenizer.get_vocab(with_added_tokens=False), getattr(model, "end_of_word_suffix", None)
        #: Of each id, whether a part ends with it: where the parts of a batch end is read from its ids.
        self.final = np.zeros(1 + max(vocabulary.values()), bool)
        self.marked = bool(mark) and all(chr(_byte_characters().get(b, b)) + mark in vocabulary for b in range(256))
        if self.marked:
            self.final[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.most = CACHED_WORDS if most is None else most
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.chars = 0

    @staticmethod
    def split(text: str) -> list[str]:
        # lower-cased first: a letter can become a letter and a mark
        low = text.lower()
        if _TANGLED.search(low):
            return _WORDS.findall(text)
        if not text.isascii():
            low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return low.replace(".", " .").replace(",", " ,").split()

    def learn(self, words: set[str]) -> None:
        if len(self.words) > self.most or self.chars > CACHED_CHARS:
            self.before, self.words, self.chars = self.words, {}, 0
        new = words.difference(self.words)
        self.chars += sum(map(len, new))
        known = [w for w in new if w in self.before]
        self.words.update(zip(known, map(self.before.__getitem__, known), strict=True))
        rest = new.difference(known)
        if self.marked:
            plain = [w for w in rest if w.isascii() and w.isalpha()]
            rest.difference_update(plain)
            latin = list(filter(_PLAIN.fullmatch, rest))
            rest.difference_update(latin)
            printed = list(filter(_PRINTED.fullmatch, rest))
            rest.difference_update(printed)
            # whole lists at a time, as new words are most of the work
            parts = " ".join(plain).lower().split() + " ".join(latin).lower().encode().decode("latin-1").translate(self.stand_ins).split(" ")[: len(latin)]
            until = list(range(1, len(parts) + 1))
            for w in printed:
                parts += _PARTED.findall(w.lower())
                until.append(len(parts))
            ids = np.array(self.bare.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids if parts else [], self.dtype)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(parts):
                raise ValueError("a part without its one final id")
            raw, at = ids.tobytes(), (ends[np.array(until, int) - 1] * ids.itemsize).tolist()
            self.words.update(zip(plain + latin + printed, [raw[i:j] for i, j in zip([0, *at], at)], strict=True))
        rest = list(rest)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, self.dtype).tobytes()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), TEXTS):
            cut = [self.split(t) for t in texts[i : i + TEXTS]]
            self.learn(set().union(*cut))
            for words in cut:
                yield b"".join(map(self.words.__getitem__, words))


_word_encoders: dict[tuple, WordEncoder] = {}


def word_encoder(path: str, most: int | None = None) -> WordEncoder:
    """The worker's word encoder, made at the first call."""
    if (path, most) not in _word_encoders:
        _word_encoders[path, most] = WordEncoder(path, most)
    return _word_encoders[path, most]


#: Documents of more characters are encoded in chunks, each with the beginning of the next.
HUGE = 32_768
CHUNK, OVERLAP = 16_384, 256
#: Where the tokenizer provably starts afresh: between another character and white space.
_FRESH = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


_PARTS = "array<struct<no:bigint,until:bigint>>"
_CUT = pa.schema([("doc", pa.int64()), ("no", pa.int64()), ("until", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])


def _cut(chunk: int, overlap: int) -> Callable:
    """Rows ``doc, no, until, last, text`` of ``doc, text, parts``: the text's pieces ``no`` to ``until`` of ``chunk`` characters, with ``overlap`` characters more.

    Without ``parts`` each piece is a chunk of its own; the last is the longer one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, parts in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True):
                n = max(1, -(-(len(t) - overlap) // chunk))
                each = [(i, i) for i in range(n)] if parts is None else [(p["no"], p["until"]) for p in parts]
                for i in range(0, len(each), 64):
                    some = each[i : i + 64]
                    yield pa.RecordBatch.from_pydict(
                        {"doc": [d] * len(some), "no": [x for x, _ in some], "until": [y for _, y in some], "last": [y == n - 1 for _, y in some], "text": [t[x * chunk :] if y == n - 1 else t[x * chunk : (y + 1) * chunk + overlap] for x, y in some]},
                        schema=_CUT,
                    )

    return run


def _seams(text: str, ends: list[int], start: int, low: int, high: int) -> tuple[list[int], list[int]]:
    """The stable boundaries between ``low`` and ``high``: absolute offsets, and the chunk's tokens before each.

    ``ends`` are the library's end offsets of the tokens. A boundary is where a token ends and the
    tokenizer starts afresh, whatever stands before and behind.
    """
    at, tokens = [], []
    for m in _FRESH.finditer(text, low, high):
        i = bisect_right(ends, m.start())
        if i and ends[i - 1] == m.start():
            at.append(start + m.start())
            tokens.append(i)
    return at, tokens


_CODED = pa.schema([("doc", pa.int64()), ("no", pa.int64()), ("until", pa.int64()), ("last", pa.bool_()), ("total", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("head", "head_tokens", "tail", "tail_tokens"))])


def _encode_chunks(path: str, chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path, BEFORE_SPACE, len).tokenizer
        for b in batches:
            rows = []
            for r, t in zip(b.select(["doc", "no", "until", "last"]).to_pylist(), b.column("text").to_pylist(), strict=True):
                ends = [e for _, e in library.encode(t, add_special_tokens=False).offsets]
                start = r["no"] * chunk
                head = _seams(t, ends, start, 0, overlap) if r["no"] else ([], [])
                tail = ([], []) if r["last"] else _seams(t, ends, start, (r["until"] + 1) * chunk - start, len(t))
                rows.append({**r, "total": len(ends), "head": head[0], "head_tokens": head[1], "tail": tail[0], "tail_tokens": tail[1]})
            yield pa.RecordBatch.from_pylist(rows, schema=_CODED)

    return run


def _splice(rows: pa.Table) -> pa.Table:
    """One document's chunks to its token count, or to ``again``: the runs of chunks whose neighbours share no boundary."""
    chunks = sorted(rows.to_pylist(), key=lambda r: r["no"])
    total, begin, again = 0, 0, []
    for a, b in zip(chunks, [*chunks[1:], None], strict=True):
        if b is None:
            total += a["total"] - begin
            break
        head = dict(zip(b["head"], b["head_tokens"], strict=True))
        seam = next(((t, head[at]) for at, t in zip(a["tail"], a["tail_tokens"], strict=True) if at in head), None)
        if seam is None:
            if again and again[-1]["until"] == a["until"]:
                again[-1]["until"] = b["until"]
            else:
                again.append({"no": a["no"], "until": b["until"]})
            seam = (0, 0)
        total += seam[0] - begin
        begin = seam[1]
    kind = pa.list_(pa.struct([("no", pa.int64()), ("until", pa.int64())]))
    return pa.table({"doc": pa.array([chunks[0]["doc"]], pa.int64()), "n_tokens": pa.array([None if again else total], pa.int64()), "again": pa.array([again], kind)})


def huge_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc, n_tokens`` of ``docs(doc long, text)``: chunks spread over all tasks, neighbours spliced by document.

    Each chunk is encoded whole by the library. Neighbours are spliced at an offset in their overlap where
    both encodings have a boundary and the tokenizer starts afresh. Where two neighbours share none, their overlap is widened to the
    whole of the next: they are encoded again as one chunk, and all other chunks stand. Rounds end at the latest when one chunk holds the document.
    """

    def encoded(df: DataFrame) -> DataFrame:
        cut = df.mapInArrow(_cut(chunk, overlap), "doc long, no long, until long, last boolean, text string")
        return cut.repartition("doc", "no").mapInArrow(_encode_chunks(path, chunk, overlap), "doc long, no long, until long, last boolean, total long, head array<long>, head_tokens array<long>, tail array<long>, tail_tokens array<long>")

    coded, out = checkpointed(encoded(docs.withColumn("parts", F.lit(None).cast(_PARTS)))), None
    while True:
        done = checkpointed(coded.groupBy("doc").applyInArrow(_splice, f"doc long, n_tokens long, again {_PARTS}"))
        good = done.filter("n_tokens IS NOT NULL").select("doc", "n_tokens")
        out = good if out is None else out.unionByName(good)
        failed = done.filter("n_tokens IS NULL").select("doc", F.col("again").alias("parts"))
        if failed.isEmpty():
            return out
        inside = F.exists("parts", lambda p: (F.col("no") >= p["no"]) & (F.col("no") <= p["until"]))
        stand = coded.join(failed, "doc").filter(~inside).select(*coded.columns)
        coded = checkpointed(stand.unionByName(encoded(docs.join(failed, "doc"))))


def token_counts(docs: DataFrame, path: str, keep: Column | None = None) -> DataFrame:
    """``doc_id`` (or ``keep``)``, n_bytes, n_tokens`` for each row of ``docs``.

    ``n_tokens`` is the number of ids that the byte-level BPE tokenizer at ``path`` gives for the
    whole text, without added begin or end tokens; strings of special tokens inside a text are
    handled as the library does by default. A null text counts as empty (0 tokens); repeated rows
    and null ids stay apart; an empty table gives an empty result. Columns other than ``doc_id``
    and ``text`` are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select((F.col("doc_id") if keep is None else keep).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, BEFORE_SPACE, len)
        for b in batches:
            n = [sum(v) for v in enc.values(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    usual = rows.filter(F.length("text") <= HUGE).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    huge = rows.filter(F.length("text") > HUGE).withColumn("doc", F.monotonically_increasing_id())
    huge = checkpointed(huge)
    counted = huge.select("doc", "doc_id", "n_bytes").join(huge_counts(huge.select("doc", "text"), path), "doc")
    return usual.unionByName(counted.select("doc_id", "n_bytes", "n_tokens"))
