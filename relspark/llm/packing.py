"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed, small
from relspark.llm.tokens import word_encoder

LIMIT = 2048
END_ID = 1
#: UTF-8 bytes of text that make up a group on average.
GROUP_BYTES = 8 << 20
#: Partitions of groups; more groups share them.
MAX_PARTITIONS = 20_000


class TournamentTree:
    """Bins in order of opening; each inner node holds the larger remaining capacity of its two sides."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes ``size`` from the first bin that has room and returns the bin."""
        best, i = self.best, 1
        while i < self.leaves:
            i *= 2
            if best[i] < size:
                i += 1
        at = i - self.leaves
        best[i] -= size
        while i > 1:
            i //= 2
            top = max(best[2 * i], best[2 * i + 1])
            if best[i] == top:
                break
            best[i] = top
        return at


def first_fit_decreasing(sizes: list[int], limit: int) -> list[int]:
    """The bin of each size (at most ``limit``), sizes taken in falling order, ties in order of position."""
    tree, bins = TournamentTree(len(sizes), limit), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.place(sizes[i])
    return bins


def told_apart(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, text, mark`` of each row, null texts as empty, and all texts' bytes; ``mark`` is a random number of the id, the text and, among repeated rows, the copy.

    It depends on what the rows hold alone, so a task that is run again gives the same.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})
    keys = checkpointed(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.sum(F.octet_length("text")).alias("size")))
    size = keys.agg(F.sum("size")).first()[0] or 0
    mark = lambda copy: F.xxhash64("k1", "k2", copy)
    again = keys.filter("copies > 1").select("k1", "k2")
    if again.isEmpty():
        return rows.select("doc_id", "text", mark(F.lit(0)).alias("mark")), size
    again = small(again)
    once = rows.join(again, ["k1", "k2"], "left_anti").select("doc_id", "text", mark(F.lit(0)).alias("mark"))
    kept = rows.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").cast("int").alias("copies"))
    copied = kept.select("doc_id", "text", "k1", "k2", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return once.unionByName(copied.select("doc_id", "text", mark(F.col("copy")).alias("mark"))), size


def pieces(rows: DataFrame, path: str, limit: int, end_id: int, groups: int, seed: int, words: int | None = None) -> DataFrame:
    """The ids of ``rows(doc_id, text, mark)`` cut at every ``limit``; a document's pieces are in one group, which depends on the seed and the mark alone."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path, words)
        end, width = np.array([end_id], enc.dtype).tobytes(), np.dtype(enc.dtype).itemsize
        for b in batches:
            take, start, total, ids, group = [], [], [], [], []
            for i, (own, mark) in enumerate(zip(enc.ids(b.column("text").to_pylist()), b.column("mark").to_pylist(), strict=True)):
                own += end
                n = len(own) // width
                g = xxhash.xxh64_intdigest(b"%d" % mark, seed) % groups
                for at in range(0, n, limit):
                    take.append(i)
                    start.append(at)
                    total.append(n)
                    ids.append(own[at * width : (at + limit) * width])
                    group.append(g)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(take, pa.int64())), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32()), pa.array(group, pa.int64())],
                names=["doc_id", "start", "doc_tokens", "raw", "width", "grp"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, start long, doc_tokens long, raw binary, width int, grp long")


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, seed: int = 0, words: int | None = None) -> DataFrame:
    """Packs whole documents into sequences of at most ``limit`` tokens.

    A document is its text's ids by the tokenizer at ``path`` (one that drops white space),
    without added special tokens, and then ``end_id``; a null or empty text is ``end_id`` alone.
    Returns for each piece of a document ``doc_id, start, length, ids`` (little-endian unsigned
    32-bit), ``doc_tokens, sequence_id, offset``; sequences are gapless from offset 0. Pieces are
    cut at multiples of ``limit`` only. Repeated rows and null ids are packed on their own; an
    empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored. The number
    of groups follows the total size of the texts, so a group stays near ``group_bytes``, and the
    number of tasks follows the number of groups. What a group holds depends on the rows and
    ``seed`` alone, not on how they are partitioned. ``words`` sets how many words a worker
    remembers, and no result.
    """
    rows, size = told_apart(docs)
    groups = -(-size // group_bytes) or 1
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, MAX_PARTITIONS))
    cut = pieces(rows, path, limit, end_id, groups, seed, words).repartition(parts, "grp")
    kind = cut.schema["doc_id"].dataType.simpleString()

    def fill(t: pa.Table) -> pa.Table:
        width = t.column("width")[0].as_py()
        raw = t.column("raw").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (-len(raw[i]), zlib.crc32(raw[i]), str(t.column("doc_id")[i]), t.column("start")[i].as_py()))
        bins = first_fit_decreasing([len(raw[i]) // width for i in order], limit)
        used: dict[int, int] = {}
        offset = []
        for i, b in zip(order, bins, strict=True):
            offset.append(used.get(b, 0))
            used[b] = offset[-1] + len(raw[i]) // width
        t = t.take(pa.array(order, pa.int64()))
        length = [len(raw[i]) // width for i in order]
        ids = [np.frombuffer(raw[i], f"<u{width}").astype("<u4").tobytes() for i in order]
        first = t.column("grp")[0].as_py() << 32
        return pa.table(
            {"doc_id": t.column("doc_id"), "start": t.column("start"), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary()), "doc_tokens": t.column("doc_tokens"), "sequence_id": pa.array([first + b for b in bins], pa.int64()), "offset": pa.array(offset, pa.int64())}
        )

    return cut.groupBy("grp").applyInArrow(fill, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
