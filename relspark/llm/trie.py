"""The prefix trie of conversations, and totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. Sequences are told apart by sums of hashes of their turns
(each hashed with its depth; four sums of 32 bits), which are running sums within a conversation, so that a
conversation of any length is keyed by many tasks. Subtree totals come from contraction: each round rakes the
leaves into their parents, then compresses unary chains by splicing out nodes that no neighbour in the chain is spliced
with; re-expansion goes back through the rounds and gives every spliced node its total. Rounds grow with the
logarithm of the number of nodes, whatever the depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed
from relspark.storage import numbered, running_within

KEYS = ("k0", "k1", "k2", "k3")
#: Characters of ids that are put together before they meet the rest of their node's.
CHUNK = 1 << 16


def _halves(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, t0, t1, chars``: each turn's place from 0, two hashes of its role and text, and its text's code points.

    Turns are in order of ``turn``, null first, then role and text; null roles and texts are empty, repeated rows are turns
    of their own; rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"t0": F.xxhash64("role", "text"), "t1": F.xxhash64(F.lit(1), "text", "role"), "chars": F.length("text").cast("long")})
    return running_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"], {}, place="place", keep=["t0", "t1", "chars"])


def rebuilt(turns: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """``conv_id, depth, t0, t1, chars`` of the turns of ``turns_in_order``, from depth 1, after conversations have been given common beginnings.

    The first h turns of conversation c become those of conversation c - c % ``family`` (all if it has fewer, none if it is absent); h is the
    unsigned CRC-32 of c in decimal modulo ``heads``. A family shares one beginning of fewer than ``heads`` turns, so the join has at most
    ``heads`` - 1 rows a conversation.
    """
    ids = turns.filter("place = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    first = turns.filter((F.col("place") < heads - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "place", "t0", "t1", "chars")
    begin = ids.join(first, "base").filter("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "t0", "t1", "chars")
    had = first.groupBy("base").agg(F.count("*").alias("n"))
    shift = ids.join(had, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got"))
    own = turns.join(shift, "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("got") + 1).alias("depth"), "t0", "t1", "chars")
    return begin.unionByName(own)


def keyed_prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, chars``, the prefix's KEYS and its parent's (``p0`` ...): one row for each conversation and depth from 1."""
    parts = [*_halves(F.xxhash64("depth", "t0", "t1")), *_halves(F.xxhash64(F.lit(1), "t1", "t0", "depth"))]
    own = turns.select("conv_id", "depth", "chars", *(x.alias(f"o{i}") for i, x in enumerate(parts)))
    run = running_within(own, ["conv_id"], ["depth"], {k: f"o{i}" for i, k in enumerate(KEYS)})
    return run.select("conv_id", "depth", "chars", *KEYS, *((F.col(k) - F.col(f"o{i}")).alias(f"p{i}") for i, k in enumerate(KEYS)))


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: the nodes of the trie, root included.

    ``ids(conv_id)`` are the conversations, each once; ``turns`` as ``rebuilt`` gives them. ``conv_id`` is a node's smallest
    member, which with the depth names it. ``saved_tokens`` sums, over the subtree, the node's (members - 1) times the code points of
    its last text. ``ends_sha256`` digests the ids, in order, of the members that end at the node. Without conversations there is no node.
    """
    prefixes = checkpointed(keyed_prefixes(turns))
    inner = prefixes.groupBy("depth", *KEYS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), *(F.min(f"p{i}").alias(f"p{i}") for i in range(4)))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(k) for k in KEYS), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), *(F.lit(-1).cast("long").alias(f"p{i}") for i in range(4)))
    nodes = numbered(inner.select(*root.columns).unionByName(root), ["conv_id", "depth"], "id")
    nodes = checkpointed(nodes)
    up = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(f"p{i}") for i, k in enumerate(KEYS)), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = checkpointed(nodes.join(up, ["depth", "p0", "p1", "p2", "p3"], "left").select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), *KEYS))
    totals = subtree_totals(tree.select("id", "parent", F.col("own").alias("saved")))
    return (
        tree.join(totals, "id")
        .join(_ends(ids, prefixes, tree), "id", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    )


def _ends(ids: DataFrame, prefixes: DataFrame, tree: DataFrame) -> DataFrame:
    """``id, ends_sha256`` of the nodes at which conversations end.

    Ids are put in order and into chunks of text by many tasks; a node's digest then takes its chunks in order, in bounded memory.
    A digest is sequential, so a node's chunks pass through one task.
    """
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", *KEYS)).alias("x")).select("conv_id", "x.*")
    zero = F.lit(0).cast("long")
    ended = ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(k), zero).alias(k) for k in ("depth", *KEYS)))
    at = ended.join(tree.select("id", "depth", *KEYS), ["depth", *KEYS]).select("id", "conv_id")
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["id", "first", "text"])

        node, begun, text, size = None, 0, [], 0
        for b in batches:
            rows = []
            for i, c in zip(b.column("id").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if i != node or size >= CHUNK:
                    if text:
                        rows.append((node, begun, ",".join(text)))
                    node, begun, text, size = i, c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
            yield out(rows)
        if text:
            yield out([(node, begun, ",".join(text))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "ends_sha256"])

        node, h = None, sha256()
        for b in batches:
            rows = []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if i != node:
                    if node is not None:
                        rows.append((node, h.hexdigest()))
                    node, h = i, sha256(t.encode())
                else:
                    h.update(b"," + t.encode())
            yield out(rows)
        if node is not None:
            yield out([(node, h.hexdigest())])

    sorted_ids = at.repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = sorted_ids.mapInArrow(chunks, "id long, first long, text string")
    return pieces.repartition(parts, "id").sortWithinPartitions("id", "first").mapInArrow(digests, "id long, ends_sha256 string")


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``id, saved, n_leaves, n_children`` for each row of ``tree(id, parent, saved)``: the sums of ``saved`` and the childless nodes over its subtree.

    ``parent`` is null for roots, of which there may be many. Rounds of contraction, each of two joins with sums by
    parent, until only roots are left; a parent of any number of children is summed before the shuffle. The rounds' removals are then replayed
    backwards. Columns other than the three are ignored; an empty tree gives an empty result.
    """
    zero = F.lit(0).cast("long")
    counts = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.bit_xor("id").alias("kid"))
    start = tree.select("id", "parent", "saved").join(counts, "id", "left").select("id", "parent", F.coalesce("kids", zero).alias("kids"), F.coalesce("kid", zero).alias("kid"), "saved", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    # kid is the exclusive-or of the ids of the children that are left: with one left, its id
    state = start = checkpointed(start)
    done, spliced, turn = [], [], 0
    while True:
        leaf = F.col("parent").isNotNull() & (F.col("kids") == 0)
        raked = state.filter(leaf)
        gains = raked.groupBy(F.col("parent").alias("to")).agg(F.count("*").alias("less"), F.bit_xor("id").alias("gone"), F.sum("saved").alias("more"), F.sum("leaves").alias("tops"))
        done.append(raked.select("id", "saved", "leaves"))
        met = state.filter(~leaf).join(gains, F.col("id") == F.col("to"), "left")
        state = checkpointed(
            met.select("id", "parent", (F.col("kids") - F.coalesce("less", zero)).alias("kids"), F.col("kid").bitwiseXOR(F.coalesce("gone", zero)).alias("kid"), (F.col("saved") + F.coalesce("more", zero)).alias("saved"), (F.col("leaves") + F.coalesce("tops", zero)).alias("leaves"))
        )
        if state.filter("parent IS NOT NULL").isEmpty():
            break
        # a unary node goes if its draw is above its child's and its parent's: never two neighbours
        draw = lambda c, turn=turn: F.xxhash64(F.lit(turn), F.col(c))
        goes = F.col("parent").isNotNull() & (F.col("kids") == 1) & (draw("id") > draw("kid")) & (draw("id") > draw("parent"))
        out = state.filter(goes)
        spliced.append((len(done), out.select("id", "kid", "saved", "leaves")))
        none = F.lit(None).cast("long")
        news = out.select(F.col("kid").alias("to"), F.col("parent").alias("above"), zero.alias("swap"), zero.alias("more"), zero.alias("tops"))
        news = news.unionByName(out.select(F.col("parent").alias("to"), none.alias("above"), F.col("kid").bitwiseXOR(F.col("id")).alias("swap"), F.col("saved").alias("more"), F.col("leaves").alias("tops")))
        news = news.groupBy("to").agg(F.max("above").alias("above"), F.bit_xor("swap").alias("swap"), F.sum("more").alias("more"), F.sum("tops").alias("tops"))
        met = state.filter(~goes).join(news, F.col("id") == F.col("to"), "left")
        state = checkpointed(
            met.select("id", F.coalesce("above", "parent").alias("parent"), "kids", F.col("kid").bitwiseXOR(F.coalesce("swap", zero)).alias("kid"), (F.col("saved") + F.coalesce("more", zero)).alias("saved"), (F.col("leaves") + F.coalesce("tops", zero)).alias("leaves"))
        )
        turn += 1
    totals = state.select("id", "saved", "leaves")
    at = len(done)
    for after, out in reversed(spliced):
        for raked in done[after:at]:
            totals = totals.unionByName(raked)
        at = after
        below = totals.select(F.col("id").alias("kid"), F.col("saved").alias("more"), F.col("leaves").alias("tops"))
        found = out.join(below, "kid").select("id", (F.col("saved") + F.col("more")).alias("saved"), (F.col("leaves") + F.col("tops")).alias("leaves"))
        totals = totals.unionByName(checkpointed(found))
    for raked in done[:at]:
        totals = totals.unionByName(raked)
    return totals.join(start.select("id", F.col("kids").alias("n_children")), "id").select("id", "saved", F.col("leaves").alias("n_leaves"), "n_children")
