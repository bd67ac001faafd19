"""Benchmark decontamination: a broadcast set of test n-grams, probed while the training words are scanned.

Only DataFrame expressions are used. Any window of k words holds a whole aligned block of (k + 1) // 2
words, so a document probes the set with the hashes of its aligned blocks only; each window around a
block that is found is then looked up among the benchmark windows and verified on its words. Only hits
(and one marker row a document) reach the shuffle. The set is sized by the benchmark; the blocks of a
benchmark that is too large for it are joined by hash instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import ascii_lower, checkpointed, keyed, small

WINDOW = 10
#: Blocks of benchmark windows that the broadcast hash set holds at most, PER_BLOCK slots for each (a
#: megabyte in all, of which an eighth is set); it lets few false candidates through to the exact lookup, and never misses one.
MAX_BLOCKS, PER_BLOCK = 1 << 18, 16
#: Slots of a byte of the set; each block sets two slots.
PER_BYTE = 4
#: Benchmark windows (about 200 bytes each) up to which their lookup asks for a broadcast.
MAX_BROADCAST_WINDOWS = 200_000
#: Documents with hits up to which their removal asks for a broadcast.
MAX_BROADCAST_DOCS = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of ``text``: A-Z lower-cased, runs of ASCII letters, digits and characters from U+0080 on."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: ``h, k, gram, items``.

    An item with fewer than ``window`` words, but not none, is one window of ``k`` words.
    A null ``item_id`` is named "null"; null and wordless texts have no window.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")
    ).filter(F.size("w") > 0)
    starts = items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("i"))
    grams = starts.select("item", F.slice("w", F.col("i"), F.lit(window)).alias("gram"))
    return (
        grams.groupBy("gram")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.xxhash64("gram").alias("h"), F.size("gram").alias("k"), "gram", "items")
    )


def _block(k: int) -> int:
    """The longest block length of which every window of ``k`` words holds an aligned one."""
    return (k + 1) // 2


def _gram_hash(w: Column | str, at: Column, size: int) -> Column:
    return F.xxhash64(F.slice(w, at + 1, F.lit(size)))


def _block_starts(k: int) -> Column:
    """The starts, from 0, of the aligned blocks of ``w`` that a window of ``k`` words could hold."""
    b = _block(k)
    return F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - b, F.lit(b))).otherwise(F.array().cast("array<int>"))


def _slots(h: Column, slots: int) -> list[Column]:
    """The two slots of a hash: its low bits, and its bits from the 32nd on."""
    return [x.bitwiseAND(F.lit(slots - 1)).cast("int") for x in (h, F.shiftrightunsigned(h, 32))]


def _blocks(wins: DataFrame) -> DataFrame:
    """``h``: the hashes of all blocks of the windows."""
    size = F.floor((F.col("k") + 1) / 2).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), F.col("k") - size), lambda j: F.xxhash64(F.slice("gram", j + 1, size)))
    return wins.select(F.explode(hashes).alias("h")).distinct()


def _block_set(blocks: DataFrame, n: int) -> tuple[bytearray, int]:
    """The hash set of the ``n`` blocks, and its slots: a bit for each slot, four in a byte.

    It is small (about 4 bytes a block), as the plan carries it.
    """
    slots = 1 << max(10, (PER_BLOCK * n - 1).bit_length())
    out = bytearray(max(1, slots // PER_BYTE))
    for r in blocks.select(F.explode(F.array(*_slots(F.col("h"), slots))).alias("slot")).distinct().toLocalIterator():
        out[r.slot // PER_BYTE] |= 1 << r.slot % PER_BYTE
    return out, slots


def _probe(k: int, known: bytearray, slots: int) -> Column:
    """The starts of the aligned blocks of ``w`` of which both slots are in ``known``."""
    table = F.lit(known)

    def has(slot: Column) -> Column:
        byte = F.ascii(F.substring(table, F.shiftright(slot, 2) + 1, F.lit(1)).cast("string"))
        return F.bit_get(byte, slot.bitwiseAND(F.lit(PER_BYTE - 1))) == 1

    def is_known(s: Column) -> Column:
        first, second = _slots(_gram_hash("w", s, _block(k)), slots)
        return has(first) & has(second)

    return F.filter(_block_starts(k), is_known)


def _joined(rows: DataFrame, blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` with ``c{k}``, the starts of the aligned blocks of ``w`` that are among ``blocks``, found by a join on their hashes.

    Rows of equal words have equal blocks, so they are met by a hash of the words.
    """
    rows = rows.withColumns({"w1": F.xxhash64("w"), "w2": F.xxhash64(F.lit(1), "w")})
    each = lambda k: F.transform(_block_starts(k), lambda s: F.struct(F.lit(k).alias("k"), s.alias("s"), _gram_hash("w", s, _block(k)).alias("h")))
    probes = rows.select("w1", "w2", F.explode(F.concat(*map(each, sizes))).alias("x")).select("w1", "w2", "x.*")
    found = probes.join(small(blocks), "h", "left_semi").groupBy("w1", "w2").agg(*(F.collect_set(F.when(F.col("k") == k, F.col("s"))).alias(f"c{k}") for k in sizes))
    none = F.array().cast("array<int>")
    found = small(found, MAX_BROADCAST_DOCS, sum((F.size(f"c{k}") for k in sizes), F.lit(0)) / 10)
    return rows.join(found, ["w1", "w2"], "left").withColumns({f"c{k}": F.coalesce(f"c{k}", none) for k in sizes}).drop("w1", "w2")


def _windows_around(k: int) -> Column:
    """The windows of ``k`` words, as structs (i, k, gram), that hold a block of ``c{k}``."""

    def around(s: Column) -> Column:
        first, last = F.greatest(s - (k - _block(k)), F.lit(0)), F.least(s, F.size("w") - k)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(f"c{k}", around)))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), F.slice("w", i + 1, F.lit(k)).alias("gram")))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, keep: list[Column]) -> DataFrame:
    """One row a document: ``keep``, ``n_words``, sorted ``hits`` of structs (i, k) counted from 0, ``items``."""
    # lookups carry the items of a window, so their number counts as well
    wins = checkpointed(benchmark_windows(benchmark, window))
    own = small(wins.select("h", F.col("gram").alias("own"), "items"), MAX_BROADCAST_WINDOWS, F.size("items"))
    sizes = sorted(r.k for r in wins.select("k").distinct().collect())
    names = docs.select(*keep).columns
    rows = docs.select(*keep, words(F.col("text")).alias("w")).withColumn("uid", F.monotonically_increasing_id())
    blocks = checkpointed(_blocks(wins))
    n = blocks.count()
    if n <= MAX_BLOCKS:
        known = _block_set(blocks, n)
        rows = rows.withColumns({f"c{k}": _probe(k, *known) for k in sizes})
    else:
        rows = _joined(rows, blocks, sizes)
    marker = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("gram")))
    rows = rows.select("uid", *names, F.size("w").cast("long").alias("n_words"), F.concat(marker, *map(_windows_around, sizes)).alias("at"))
    rows = rows.select("uid", *names, "n_words", F.explode("at").alias("at"))
    found = rows.join(own, F.when(F.col("at.i") >= 0, F.xxhash64("at.gram")) == F.col("h"), "left")
    found = found.filter((F.col("at.i") < 0) | (F.col("at.gram") == F.col("own")))
    return found.groupBy("uid").agg(
        *(F.max_by(c, F.col("at.i") < 0).alias(c) for c in names),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("at.i") >= 0, F.struct("at.i", "at.k")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _covered(hits: Column) -> Column:
    """The number of positions that the intervals of ``hits`` (sorted) cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, x):
        end = F.greatest(acc["end"], x["i"] + x["k"])
        return F.struct((acc["n"] + end - F.least(end, F.greatest(acc["end"], x["i"]))).alias("n"), end.alias("end"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """What each document shares with the benchmark.

    Returns ``doc_id, n_words, n_hit, n_items, items array<string>, contaminated``, one row for
    each row of ``docs``: repeated and null doc_ids stay apart. A word is hit if any occurrence
    of a benchmark window covers it. Null and empty texts have no words and no hits; with an
    empty benchmark nothing is hit. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    hits = _hits(docs, benchmark, window, [F.col("doc_id")])
    return hits.select(
        "doc_id",
        "n_words",
        _covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, mode: str = "document") -> DataFrame:
    """``docs`` with all its columns, without what the benchmark holds.

    ``mode="document"`` removes every document with a hit word; ``mode="span"`` keeps all
    documents and removes the hit words, each with the separators that follow it. Rows of equal
    doc_id and text are treated alike; null, empty and wordless texts have no hits and stay; texts of any
    length are read whole; with an empty benchmark, or an empty table, nothing goes.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode is document or span, not {mode}")
    rows = keyed(docs)
    hits = _hits(rows, benchmark, window, [F.col("k1"), F.col("k2")]).filter(F.size("hits") > 0)
    hits = small(hits.select("k1", "k2", "hits").dropDuplicates(["k1", "k2"]), MAX_BROADCAST_DOCS, F.size("hits") / 10)
    if mode == "document":
        return rows.join(hits, ["k1", "k2"], "left_anti").select("doc.*")
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), 0)
    lead = F.col("text").rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").cast("int")
    kept = F.filter(
        F.transform("pieces", lambda p, j: F.struct(p.alias("p"), (j - F.col("lead")).alias("j"))),
        lambda s: ~F.exists("hits", lambda x: (s["j"] >= x["i"]) & (s["j"] < x["i"] + x["k"])),
    )
    met = rows.join(hits, ["k1", "k2"], "left").withColumns({"pieces": F.when(F.col("hits").isNotNull(), pieces), "lead": lead})
    cut = met.withColumn("cut", F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["p"]), "")))
    return cut.select(*(F.col("cut").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
