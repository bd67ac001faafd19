"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Identical fingerprints collapse first. The all-pairs comparison of the distinct ones is cut into
tiles: the 64 bits are split into ``radius + 1`` blocks, and two fingerprints within the radius
agree on at least one block, so only tiles that share a block value are compared, each with numpy
exclusive-or and bit counts, in order of population count; tile pairs whose population counts
differ by more than the radius are skipped. The result is exact. Tiles give a spanning set of
links (at most one a row and tile), never all pairs.

For a similarity of shingles (``similar``) the radius is wide, and every block would hold much of the
corpus. There tiles are shared values of min-wise keys of the same shingles: two texts of shingle
similarity s share none of KEYS keys with probability (1 - s)^KEYS, which is 3e-6 at 0.8. The radius
keeps pairs that stand 3.5 standard deviations farther apart than expected; what it finds is verified
on sketches of SKETCH min-wise values, which tell the shingle similarity to about 0.018.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed, small, texts
from relspark.llm.common import keyed as keyed_rows
from relspark.llm.components import connected_components

SEED = 42
BITS = 64
#: Rows of a tile in the numpy comparison.
TILE = 512
#: Distinct fingerprints that share a block value and are compared in one task: the mean share of
#: a task, within these bounds. Larger buckets are cut by population count and hash into pairs of tiles over many tasks.
LEAST_BUCKET, BUCKET = 256, 8192
#: Rows of such a tile: an ALONG-th of its bucket, within half of the same bounds. Beyond NARROW bits, population counts
#: keep few pairs of tiles apart, and tiles are by hash alone.
ALONG, NARROW = 8, 8

#: Min-wise keys of a text, and the seeded steps that make them.
KEYS = 8
_RNG = np.random.default_rng(3)
_TIMES = _RNG.integers(0, 1 << 63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, KEYS, dtype=np.uint64)
#: Values (a byte each) of a sketch, their steps, and how far below the asked similarity a sketch's may be.
SKETCH = 512
_SKETCH_TIMES = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_PLUS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
ALLOWANCE = 0.03


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text.

    A-Z is lower-cased, words are split at ASCII white space, shingles of ``shingle`` words are
    joined by a space (fewer words: the whole sequence; none: zero) and counted with repeats; a
    bit is set if it is set in over half the XXH64 values.
    """
    return _fingerprint(_shingle_hashes(text, shingle))


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    k = min(shingle, len(w))
    stop = ends[k - 1 :] - 1
    start = np.concatenate(([0], ends[: len(w) - k]))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(stop))


def _fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the hashes under each seeded step; zeros without hashes."""
    if not len(hashes):
        return np.zeros(KEYS, np.int64)
    return np.array([(hashes * a + b).min() for a, b in zip(_TIMES, _PLUS, strict=True)], np.uint64).view(np.int64)


def _sketch(hashes: np.ndarray) -> bytes:
    """A byte of the smallest of the hashes under each of SKETCH seeded steps; zeros without hashes."""
    if not len(hashes):
        return bytes(SKETCH)
    each = np.unique(hashes)
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for i in range(0, len(each), 256):
        np.minimum(least, (each[i : i + 256, None] * _SKETCH_TIMES + _SKETCH_PLUS).min(axis=0), out=least)
    return least.astype(np.uint8).tobytes()


def sketch_matches(similarity: float) -> int:
    """Equal bytes of two sketches from which texts count as similar: bytes are also equal by chance, one in 256."""
    s = similarity - ALLOWANCE
    return int(np.ceil(SKETCH * (s + (1 - s) / 256)))


def wide_radius(similarity: float) -> int:
    """Bits in which texts of this shingle similarity (distinct shingles) differ at most, but for a vanishing share of them."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(BITS * share + 3.5 * np.sqrt(BITS * share * (1 - share)))


def fingerprints(docs: DataFrame, shingle: int = 3, keep: Column | None = None, keys: bool = False) -> DataFrame:
    """``doc_id`` (or ``keep``), ``fp long`` (the fingerprint's bits as a signed number) and, if asked, ``keys`` and ``sketch`` of each row; null texts count as empty."""
    rows = docs.select((F.col("doc_id") if keep is None else keep).alias("doc_id"), "text")
    kind = rows.select("doc_id").schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = (_shingle_hashes(t, shingle) for t in texts(b.column("text")))
            found = [(_fingerprint(h), *((_keys(h), _sketch(h)) if keys else ())) for h in hashes]
            columns = {"doc_id": b.column("doc_id"), "fp": pa.array(np.array([x[0] for x in found], np.uint64).view(np.int64))}
            if keys:
                columns |= {"keys": pa.array([x[1] for x in found], pa.list_(pa.int64())), "sketch": pa.array([x[2] for x in found], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, f"doc_id {kind.dataType.simpleString()}, fp long" + ", keys array<long>, sketch binary" * keys)


def tile_links(fps: np.ndarray, radius: int, tile: int = TILE, sketches: np.ndarray | None = None, least: int = 0, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within ``radius`` among ``fps`` (uint64): the linked ones and the representative of each, by ``ids`` if given.

    With ``sketches`` (a row of bytes each) a link also needs ``least`` equal bytes.
    """
    ids = fps if ids is None else ids
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int64)
    sketches, ids = None if sketches is None else sketches[order], ids[order]
    label = np.arange(len(fps))
    for a in range(0, len(fps), tile):
        rows, low = fps[a : a + tile], counts[a]
        for b in range(0, a + 1, tile):
            if counts[min(b + tile, len(fps)) - 1] < low - radius:
                continue
            near = np.bitwise_count(rows[:, None] ^ fps[None, b : b + tile]) <= radius
            for r in np.flatnonzero(near.sum(axis=1) > (a == b)):
                at = b + np.flatnonzero(near[r])
                at = at[label[at] != label[a + r]]
                if sketches is not None and len(at):
                    at = at[(sketches[at] == sketches[a + r]).sum(axis=1) >= least]
                if len(at):
                    roots = np.unique(np.append(label[at], label[a + r]))
                    label[np.isin(label, roots[1:])] = roots[0]
    at = np.flatnonzero(label != np.arange(len(fps)))
    return ids[at], ids[label[at]]


def _block_masks(radius: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def fingerprint_links(distinct: DataFrame, radius: int = 2, bucket: int | None = None) -> DataFrame:
    """``src, dst``: links that span the components of ``distinct(fp long)`` within ``radius`` bits."""
    blocks = F.array(*(F.struct(F.lit(i).alias("b"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask)).alias("v")) for i, (lo, mask) in enumerate(_block_masks(radius))))
    keyed = distinct.select("fp", F.explode(blocks).alias("x")).select("fp", "x.b", "x.v")
    return bucket_links(keyed.withColumn("item", F.col("fp")), radius, bucket)


def _links_of(columns: dict[str, np.ndarray], lo: int, hi: int, radius: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    sketches = columns.get("sketch")
    fps, ids = columns["fp"][lo:hi].view(np.uint64), columns["item"][lo:hi]
    return tile_links(fps, radius, sketches=None if sketches is None else sketches[lo:hi], least=least, ids=ids)


def _columns(t: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: t.column(c).to_numpy() for c in t.schema.names if c in ("b", "v", "fp", "item")}
    if "sketch" in t.schema.names:
        out["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    return out


def bucket_links(keyed: DataFrame, radius: int, bucket: int | None = None, sketches: DataFrame | None = None, least: int = 0) -> DataFrame:
    """``src, dst``: links that span the components, within ``radius`` bits, of each bucket (b, v) of ``keyed(item long, fp long, b int, v long)``, by item.

    With ``sketches(item, sketch)`` a link also needs ``least`` equal bytes. Buckets of more than ``bucket`` rows
    (by default what suits the sizes, see ``BUCKET``) are compared by many tasks.
    """
    shared = keyed.groupBy("b", "v").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = checkpointed(keyed.join(shared, ["b", "v"]))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = bucket or max(LEAST_BUCKET, min(BUCKET, keyed.count() // parts))

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            x = _columns(t)
            new = np.flatnonzero((x["b"][1:] != x["b"][:-1]) | (x["v"][1:] != x["v"][:-1])) + 1
            cuts = np.concatenate(([0], new, [len(t)])) if last else np.concatenate(([0], new))
            found = [_links_of(x, i, j, radius, least) for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False) if j > i + 1]
            src, dst = (np.concatenate([y[k] for y in found] or [np.array([], np.int64)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"]), t.slice(int(cuts[-1]))

        for batch in batches:
            own = pa.Table.from_batches([batch])
            found, rest = out(own if rest is None else pa.concat_tables([rest, own]), False)
            yield found
        if rest is not None and rest.num_rows:
            yield out(rest, True)[0]

    def with_sketches(rows: DataFrame) -> DataFrame:
        return rows if sketches is None else rows.join(sketches, "item")

    usual = with_sketches(keyed.filter(F.col("n") <= bucket).select("b", "v", "fp", "item")).repartition(parts, "b", "v").sortWithinPartitions("b", "v", "fp", "item")
    links = usual.mapInArrow(cold, "src long, dst long")
    hot = keyed.filter(F.col("n") > bucket)
    return links if hot.isEmpty() else links.unionByName(_hot_links(hot, radius, bucket, with_sketches, least))


def _hot_links(keyed: DataFrame, radius: int, bucket: int, with_sketches: Callable[[DataFrame], DataFrame], least: int) -> DataFrame:
    """The links inside large buckets: tiles by population count and hash, one task group for each pair of tiles in reach."""
    keyed = keyed.withColumn("pc", F.bit_count("fp") if radius <= NARROW else F.lit(0))
    size = F.greatest(F.lit(bucket // 2), F.least(F.lit(BUCKET // 2), F.first("n") / ALONG))
    counts = keyed.groupBy("b", "v", "pc").agg(F.ceil(F.count("*") / size).cast("int").alias("chunks"))
    rows = keyed.join(counts, ["b", "v", "pc"]).select("b", "v", "fp", "item", F.struct("pc", F.pmod(F.xxhash64("fp", "item"), F.col("chunks")).alias("chunk")).alias("tile"))
    tiles = counts.select("b", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct("pc", c.cast("long").alias("chunk")))).alias("tile"))
    other = tiles.withColumnRenamed("tile", "other")
    pairs = tiles.join(other, ["b", "v"]).filter((F.col("other") >= F.col("tile")) & (F.col("other.pc") - F.col("tile.pc") <= radius))
    sides = pairs.select("b", "v", "tile", F.struct("tile", "other").alias("pair")).unionByName(
        pairs.filter("tile <> other").select("b", "v", F.col("other").alias("tile"), F.struct("tile", "other").alias("pair"))
    )

    def compare(t: pa.Table) -> pa.Table:
        src, dst = _links_of(_columns(t), 0, len(t), radius, least)
        return pa.table({"src": src, "dst": dst})

    met = with_sketches(rows.join(sides, ["b", "v", "tile"]).select("b", "v", "pair", "fp", "item"))
    return met.groupBy("b", "v", "pair").applyInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, keep: Column | None = None, bucket: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id``, one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` differing bits reach,
    the row's own included. Rows without words have fingerprint zero and link like any other;
    repeated rows share a component; a null doc_id is never the smallest; if all are null,
    component_id is null. An empty table gives an empty result. Columns other than ``doc_id`` and
    ``text`` are ignored. ``keep`` names another id expression.
    """
    fps = checkpointed(fingerprints(docs, shingle, keep).withColumn("item", F.col("fp")))
    return _components(fps, fingerprint_links(fps.select("fp").distinct(), radius, bucket))


def _components(fps: DataFrame, links: DataFrame) -> DataFrame:
    distinct = checkpointed(fps.groupBy("item").agg(F.min("doc_id").alias("low")))
    roots = connected_components(links)
    labelled = distinct.join(roots.withColumnRenamed("node", "item"), "item", "left").withColumn("root", F.coalesce("root", "item"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(labelled.join(lows, "root").select("item", "component_id"), "item").select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, keep: Column | None = None, bucket: int | None = None) -> DataFrame:
    """As ``near_duplicates``, but linking texts whose shingle similarity is at least ``similarity``, within what fingerprints and sketches tell.

    Compared are texts that share a min-wise key of their shingles, by fingerprints and then by sketches. Only texts of one
    fingerprint and one sketch are taken as one without a look; those of one fingerprint alone are compared like any others.
    """
    fps = checkpointed(fingerprints(docs, shingle, keep, keys=True).withColumn("item", F.xxhash64("fp", "sketch")))
    keyed = fps.select("item", "fp", F.posexplode("keys").alias("b", "v")).distinct()
    sketches = fps.groupBy("item").agg(F.min("sketch").alias("sketch"))
    return _components(fps.select("doc_id", "fp", "item"), bucket_links(keyed, wide_radius(similarity), bucket, sketches, sketch_matches(similarity)))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, with all columns, but one row of each group that ``similar`` finds: the one of smallest doc_id (nulls last, ties by a hash).

    Of rows with equal doc_id and text the one of least other columns' hash stays. All texts without words
    (null, empty or blank) are one group. Texts of any length are read whole; an empty table gives an empty result.
    """
    rows = keyed_rows(docs)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    found = checkpointed(similar(rows, shingle, similarity, key).select(F.col("doc_id").alias("key"), "component_id"))
    lost = small(found.filter(F.col("key") != F.col("component_id")).select("key.k1", "key.k2").distinct())
    kept = rows.join(lost, ["k1", "k2"], "left_anti")
    if not found.groupBy("key").count().filter("count > 1").isEmpty():
        kept = kept.groupBy("k1", "k2").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return kept.select("doc.*")
