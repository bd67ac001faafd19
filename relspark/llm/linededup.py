"""Line dedup: hash every three consecutive lines, find the windows that occur before, and cut what they cover.

A text has two kinds of lines, and windows of either kind count. Its own lines are those between line
ends, blank ones left out; three of them that stand before are cut however short they are. Wrapped
lines are cut at line ends, after sentences, and inside sentences where the words themselves say so, so
a passage that many documents hold inside one long paragraph is several lines as well, and the same ones
wherever in a sentence it begins. Short lines and sentences are joined to wrapped lines of four words at
least, so that three of them are no chance repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed, small, stored, texts

WINDOW = 3
WRAP = 11
#: Words between two cuts at least; gaps of twice as many are cut again, so wrapped lines are shorter, and any 30 words in a row hold three whole ones.
APART = 4
#: Words that a window of wrapped lines has at least; only windows with a text's first or last line can have fewer, and those repeat by chance.
MIN_WORDS = APART * WINDOW
#: Characters of the texts that are cut together, and rounds of cuts before what is left is cut one by one.
TOGETHER, ROUNDS = 500_000, 8
#: Repeated windows, and documents with lines to cut, up to which their joins ask for a broadcast (about 100 and 200 bytes each).
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_DOCS = 100_000, 500_000
#: Spans of a document (8 bytes each) that are counted as one document.
SPANS_A_DOC = 10
#: Bits of a hash that are counted beside its bucket, and their bytes; hashes that a task sorts at once, and hashes of a bucket on average.
LOW_BITS, LOW_BYTES = 40, 5
SORTED, BUCKET = 2_000_000, 8_000_000
#: Bits of the filter for hashes of repeated windows, bits that one task makes, and hashes up to which the filter tells enough of the rest apart.
BITMAP, PIECE, MAX_BITMAP_HASHES = 1 << 26, 1 << 20, 10_000_000

_SENTENCE = re.compile(r"[^.!?]++(?:[.!?]++(?=[^\s.!?])[^.!?]++)*+[.!?]*+\s*+|[.!?]++\s*+(?:[^\s.!?][^.!?]*+[.!?]*+\s*+)?+")
_SPACED = re.compile(r"\s*+\S++\s*+")
_MIX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: A factor for each place in a line: its powers.
_PLACE = np.uint64(xxhash.xxh3_64_intdigest(b"place") | 1)
_LAST = np.iinfo(np.uint64).max


def _taken(key: np.ndarray) -> np.ndarray:
    """The places taken in order of ``key``, ties from the left, unless one within ``APART`` is taken; those of key ``_LAST`` never are.

    In each round every place goes that comes before all others near it, which has the same result.
    """
    n, r = len(key), APART - 1
    taken, wide = np.zeros(n, bool), np.full(n + 2 * r, _LAST)
    k = wide[r : r + n]
    k[:] = key
    for _ in range(ROUNDS):
        first = k < _LAST
        for j in range(r):
            first &= k < wide[j : j + n]
            first &= k <= wide[r + 1 + j : r + 1 + j + n]
        at = np.flatnonzero(first)
        if not len(at):
            return taken
        taken[at] = True
        for j in range(2 * r + 1):
            wide[at + j] = _LAST
    left = np.flatnonzero(k < _LAST)
    for i in left[np.argsort(k[left], kind="stable")].tolist():
        if not taken[max(0, i - r) : i + r + 1].any():
            taken[i] = True
    return taken


def _cut(words: list[str], ends: list[int], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and whether a line begins at each.

    ``ends``: the places behind lines and sentences, which are taken before others. ``firsts``: where each text begins, and where
    it ends; there are ``APART`` empty words behind each. Near those only ``ends`` are taken. Places are taken in order of a hash of the words on both sides, so
    what is taken depends on the words near by and not on how far the text's or sentence's start is.
    """
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    key = np.full(len(words), _LAST)
    key[1:] = ((h[:-1] * _MIX[0] + h[1:] * _MIX[1]) >> np.uint64(32)) | np.uint64(1 << 32)
    edges = np.array(firsts, np.int64)
    near = edges[:, None] + np.arange(1 - APART, APART)
    inner = key.copy()
    inner[near[(near >= 0) & (near < len(words))]] = _LAST
    inner[ends] = key[ends] & np.uint64(0xFFFFFFFF)
    key = inner
    key[edges] = _LAST
    key[(edges[1::2, None] + np.arange(APART)).ravel()] = _LAST
    begins = _taken(key)
    begins[edges] = True
    return h, begins


def wrapped_lines(text: str) -> list[str]:
    """The lines of ``text``, each with the white space after it; joined they are the text."""
    each: list[str] = []
    ends, before = [], ""
    for line in text.splitlines(keepends=True):
        for s in _SENTENCE.findall(line):
            if found := _SPACED.findall(s):
                each += found
                ends.append(len(each))
            elif each:
                each[-1] += s
            else:
                before += s
    if not each:
        return [text] if text else []
    each[0] = before + each[0]
    n = len(each)
    at = np.flatnonzero(_cut([*map(str.strip, each), *[""] * APART], ends, [0, n])[1]).tolist()
    return ["".join(each[a:b]) for a, b in pairwise(at)]


def _line_windows(h: np.ndarray, begins: np.ndarray, firsts: list[int], min_words: int, kind: int) -> tuple[np.ndarray, ...]:
    """Place of the text, first word there, number of words, hash and check hash of the windows of lines that begin where ``begins`` says."""
    start = np.flatnonzero(begins)
    size = np.diff(start, append=len(h))
    power = np.cumprod(np.full(size.max(initial=1), _PLACE))
    lines = np.add.reduceat(h * power[np.arange(len(h)) - np.repeat(start, size)], start)
    lines ^= lines >> np.uint64(31)
    # of an even number of edges behind it a line is in a text, else in the empty words between two
    edge = np.searchsorted(np.array(firsts), start, "right")
    n = max(len(start) - WINDOW + 1, 0)
    a, b = np.full(n, _MIX[0] + np.uint64(kind)), np.full(n, _MIX[1])
    for j in range(WINDOW):
        part = lines[j : j + n]
        a = (a ^ part) * _MIX[2]
        a ^= a >> np.uint64(29)
        b = (b + part) * _MIX[3]
        b ^= b >> np.uint64(31)
    total = sum(size[j : j + n] for j in range(WINDOW))
    at = np.flatnonzero((edge[:n] % 2 == 1) & (edge[:n] == edge[WINDOW - 1 :]) & (total >= min_words))
    text = edge[at] // 2
    word = start[at] - np.array(firsts)[::2][text]
    return text, word.astype(np.int32), total[at].astype(np.int32), a[at].view(np.int64), (b[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_hashes(each: list[str], min_words: int = 0, wrap: bool = True) -> tuple[np.ndarray, ...]:
    """Place in ``each``, first word, number of words, hash and check hash of the windows of ``WINDOW`` lines; white space in a line counts as one space.

    Windows are of the texts' own lines, with ``min_words`` words or more, and, if ``wrap``, of wrapped lines.
    """
    words: list[str] = []
    ends, firsts, own = [], [], []
    for text in each:
        firsts.append(len(words))
        for line in text.splitlines():
            own.append(len(words))
            for s in _SENTENCE.findall(line):
                words += s.split()
                ends.append(len(words))
        firsts.append(len(words))
        words += [""] * APART
    h, begins = _cut(words, ends, firsts)
    lines = np.zeros(len(words), bool)
    lines[own] = True
    lines[firsts] = True
    found = [_line_windows(h, lines, firsts, max(min_words, 1), 0)]
    if wrap:
        found.append(_line_windows(h, begins, firsts, MIN_WORDS, 1))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _together(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, some at a time, with the place of their first."""
    lo, each, size = 0, [], 0
    for t in texts(column):
        each.append(t)
        size += len(t)
        if size > TOGETHER:
            yield lo, each
            lo, each, size = lo + len(each), [], 0
    if each:
        yield lo, each


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values``, up to each of ``ends``, as bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """What ``_packed`` packed, the runs one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _windows(docs: DataFrame, min_words: int, wrap: bool) -> DataFrame:
    """``doc_id, th, h, c, i, n``: a row for each document with windows, ``th`` a hash of its text; the windows' hashes, check hashes, first words and numbers of words are packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th, text = b.column("doc_id"), b.column("th"), b.column("text")
            for lo, each in _together(text):
                at, i, n, h, c = window_hashes(each, min_words, wrap)
                order = np.argsort(at, kind="stable")
                row, size = np.unique(at, return_counts=True)
                ends = np.cumsum(size)
                row = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([ids.take(row), th.take(row), *(_packed(x[order], ends) for x in (h, c, i, n))], names=["doc_id", "th", "h", "c", "i", "n"])

    return rows.mapInArrow(run, f"doc_id {kind}, th long, h binary, c binary, i binary, n binary")


def _each(windows: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """``h, c, at``: the windows one by one; ``at`` orders them by doc_id (nulls last), hash of the text, and first word.

    With ``bits``, only those whose hash's low bits are set there: some unique windows stay, no repeated one goes.
    """
    shared = windows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _numbers(b.column("h"), np.int64)
            keep = np.arange(len(h))
            if shared.value is not None:
                x = h & (8 * len(shared.value) - 1)
                keep = np.flatnonzero(shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1)
            row = pa.array(np.repeat(np.arange(len(b)), pc.binary_length(b.column("h")).to_numpy() // h.itemsize)[keep])
            c, i, n = (_numbers(b.column(x), np.int32)[keep] for x in ("c", "i", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(c), b.column("doc_id").take(row), b.column("th").take(row), pa.array(i), pa.array(n)], names=["h", "c", "doc_id", "th", "i", "n"])

    kind = windows.schema["doc_id"].dataType.simpleString()
    found = windows.mapInArrow(run, f"h long, c int, doc_id {kind}, th long, i int, n int")
    return found.select("h", "c", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "i", "n").alias("at"))


def _counted(buckets: int) -> Column:
    """The part of ``h`` that is counted: its low bits, and above them one of ``buckets`` that its high bits choose."""
    return F.shiftleft(F.pmod(F.shiftrightunsigned("h", LOW_BITS), F.lit(buckets)), LOW_BITS).bitwiseOR(F.col("h").bitwiseAND((1 << LOW_BITS) - 1)).alias("t")


def _twice(windows: DataFrame, buckets: int) -> DataFrame:
    """``t``: the counted parts (see ``_counted``) of the packed hashes ``h`` that more than one window has.

    Only low bits cross the network, five bytes a window, sorted and packed by bucket; a task sends what it has
    many times no more than twice. Two hashes that differ in what is not counted let unique windows stay, no repeated one goes.
    """

    low_bits, low_mask = np.uint64(LOW_BITS), np.uint64((1 << LOW_BITS) - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, size = [], 0

        def rows() -> pa.RecordBatch:
            t = np.sort(np.concatenate(each))
            more = np.ones(len(t), bool)
            more[2:] = t[2:] != t[:-2]
            t = t[more]
            cuts = np.flatnonzero(np.diff(t >> LOW_BITS)) + 1
            low = [x.view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES].tobytes() for x in np.split(t, cuts)]
            bucket = (t[np.concatenate(([0], cuts))] >> LOW_BITS).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(low, pa.binary())], names=["bucket", "low"])

        for b in batches:
            h = _numbers(b.column("h"), np.uint64)
            each.append(((h >> low_bits) % np.uint64(buckets) << low_bits | h & low_mask).view(np.int64))
            size += len(h)
            if size >= SORTED:
                yield rows()
                each, size = [], 0
        if size:
            yield rows()

    def repeated(t: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, LOW_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :LOW_BYTES] = raw
        low = np.sort(wide.view("<i8").ravel())
        found = np.unique(low[1:][low[1:] == low[:-1]]) | t.column("bucket")[0].as_py() << LOW_BITS
        return pa.table({"t": pa.array(found, pa.int64())})

    packed = windows.select("h").mapInArrow(pack, "bucket int, low binary")
    return packed.groupBy("bucket").applyInArrow(repeated, "t long")


def _bitmap(twice: DataFrame) -> np.ndarray:
    """A bit for all low bits of the hashes of ``twice``, made in pieces by tasks; the driver gets no more than BITMAP bits."""
    size = min(BITMAP, PIECE)

    def bits(t: pa.Table) -> pa.Table:
        piece = np.zeros(size, bool)
        piece[t.column("x").to_numpy() % size] = True
        return pa.table({"piece": t.column("piece")[:1], "bits": pa.array([np.packbits(piece, bitorder="little").tobytes()], pa.binary())})

    x = twice.select(F.col("t").bitwiseAND(BITMAP - 1).cast("int").alias("x")).withColumn("piece", F.shiftright("x", size.bit_length() - 1))
    out = np.zeros((BITMAP // size, size >> 3), np.uint8)
    for r in x.groupBy("piece").applyInArrow(bits, "piece int, bits binary").toLocalIterator():
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def repeated_lines(docs: DataFrame, min_words: int = 0, wrap: bool = True) -> DataFrame:
    """``doc_id, th, spans``: for each document what its windows cover that occur before, there or in another document, merged, as first word * 2^32 + words."""
    packed = stored(_windows(docs, min_words, wrap))
    # most windows are unique: they go by a count of their hashes alone, before there is a row for each
    total = packed.agg(F.sum(F.octet_length("h").cast("long"))).first()[0] or 0
    buckets = max(packed.sparkSession.sparkContext.defaultParallelism, -(-total // (8 * BUCKET)))
    twice = checkpointed(_twice(packed, buckets))
    if twice.count() <= MAX_BITMAP_HASHES:
        windows = stored(_each(packed, _bitmap(twice)))
    else:
        windows = stored(_each(packed, None).withColumn("t", _counted(buckets)).join(twice, "t", "left_semi").drop("t"))
    again = checkpointed(windows.groupBy("h", "c").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = _met(windows, again).filter(F.col("at") != F.col("first"))
    span = F.shiftleft(F.col("at.i").cast("long"), 32).bitwiseOR(F.col("at.n").cast("long"))
    spans = later.groupBy("at.doc_id", "at.th").agg(F.collect_set(span).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [merged(x.values.to_numpy()) for x in b.column("spans")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(each, pa.list_(pa.int64()))], names=["doc_id", "th", "spans"])

    return spans.mapInArrow(run, spans.schema)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch as one, in order."""
    x = np.sort(spans)
    first, end = x >> 32, np.maximum.accumulate((x >> 32) + (x & 0xFFFFFFFF))
    new = np.concatenate(([True], first[1:] > end[:-1]))
    return first[new] << 32 | np.concatenate((end[np.flatnonzero(new)[1:] - 1], end[-1:])) - first[new]


def _met(windows: DataFrame, again: DataFrame) -> DataFrame:
    """``windows`` with the first place of each repeated one.

    If there are many of those, the ones that stand so often that no more than MAX_BROADCAST_WINDOWS can stand
    as often are joined by broadcast, so that a very common window is no single task's.
    """
    size = again.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    keys = again.select("h", "c", "first")
    if size["keys"] <= MAX_BROADCAST_WINDOWS:
        return windows.join(F.broadcast(keys), ["h", "c"])
    often = F.col("n") > size["rows"] // max(MAX_BROADCAST_WINDOWS, 1)
    common = F.broadcast(again.filter(often).select("h", "c", "first"))
    rest = windows.join(common, ["h", "c"], "left_anti").join(again.filter(~often).select("h", "c", "first"), ["h", "c"])
    return windows.join(common, ["h", "c"]).unionByName(rest)


def _without(text: str, spans: list[int]) -> tuple[str, int]:
    """``text`` without the words of ``spans``, each with the white space behind it, and how many they are."""
    words = _SPACED.findall(text)
    edges = np.zeros(len(words) + 1, np.int64)
    x = np.array(spans, np.int64)
    np.add.at(edges, x >> 32, 1)
    np.subtract.at(edges, (x >> 32) + (x & 0xFFFFFFFF), 1)
    gone = np.cumsum(edges[:-1]) > 0
    return "".join(compress(words, ~gone)), int(gone.sum())


def without_repeated_lines(docs: DataFrame, removed: str | None = None, min_words: int = 0, wrap: bool = True) -> DataFrame:
    """``docs`` with all its columns, each text without the lines that repeated windows cover.

    A window of three lines that occurs before (in a document of smaller doc_id, or further up) is
    removed; what overlapping windows cover is merged first, so a longer passage goes as a whole.
    The first occurrence stays, unless a repeat overlaps it. Windows of a text's own lines can be of any
    length, or of ``min_words`` words at least; ``wrap`` adds windows of wrapped lines. Null and empty texts,
    and texts of fewer than three lines of either kind, stay as they are; a text that repeats as a whole
    becomes empty, its row stays. Texts of any length are read whole. Rows with equal doc_id and text are one
    document and get equal results; null ids come last. An empty table gives an empty result. ``removed``
    names a column for the number of words removed.
    """
    hits = repeated_lines(docs, min_words, wrap).select(F.col("doc_id").alias("hit_doc"), "th", "spans")
    hits = small(hits, MAX_BROADCAST_DOCS, F.size("spans") / SPANS_A_DOC)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("own_doc"), "text", F.xxhash64("text").alias("own_th"))
    met = packed.join(hits, F.col("own_doc").eqNullSafe(F.col("hit_doc")) & (F.col("own_th") == F.col("th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = b.column("text"), [0] * len(b)
            if b.column("spans").null_count < len(b):
                out = texts.to_pylist()
                for i, spans in enumerate(b.column("spans").to_pylist()):
                    if spans:
                        out[i], gone[i] = _without(out[i], spans)
                texts = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([b.column("doc"), texts, pa.array(gone, pa.int64())], names=["doc", "cut", "gone"])

    kind = packed.schema["doc"].dataType.simpleString()
    done = met.select("doc", "text", "spans").mapInArrow(run, f"doc {kind}, cut string, gone long")
    columns = [F.col("cut").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns]
    return done.select(*columns, *([F.col("gone").alias(removed)] if removed else []))
