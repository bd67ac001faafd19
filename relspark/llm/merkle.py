"""A Merkle manifest of a dataset: every row a leaf, a tree for each source, and a tree over the sources.

Rows are put in order by many tasks and cut into superblocks of FAN ** LEVELS leaves. Going up, each superblock is
reduced to its digest, and the digests are leaves of the next tier, until each source has one; the sources' digests
make one more tree. Going down, the nodes that stand beside a superblock's path (its outer nodes) are cogrouped with the
superblock's own nodes, tier by tier; the last cogroup finishes the local reduction, joins the proofs and folds
them, all in one function. A source of any size is spread over its superblocks.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import ascii_lower, checkpointed
from relspark.storage import numbered, running_within

FAN = 16
#: Levels that one task reduces: superblocks of 256 leaves.
LEVELS = 2
BLOCK = FAN**LEVELS
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path's outer nodes: level by level ``before:after``, each the digests on that side, levels parted by semicolons.
_LEVEL, _SIDE = ";", ":"


def digest(*parts: str) -> str:
    """The hash of a node or a proof: SHA-256, in lower-case hex, of the parts put together."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf(columns: dict[str, Column]) -> Column:
    """A row's hash: of each field in turn ``-`` if it is null, else its length in UTF-8 bytes, a colon and its value."""
    shown = [columns[f].cast("string") for f in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)).cast("binary"), 256)


def _levels(hashes: list[str], whole: bool) -> list[list[str]]:
    """The levels of nodes above and with ``hashes``: all LEVELS of them for a superblock among others, else up to the one node that remains."""
    out = [hashes]
    while len(out) <= LEVELS and (whole or len(out[-1]) > 1):
        below = out[-1]
        out.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def _reduced(nodes: pd.DataFrame, block: int) -> list[list[str]]:
    # the first superblock of several is full, so it has all levels in either case
    return _levels(nodes["h"].tolist(), block > 0)


def _beside(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The digests before and after leaf ``i``'s path in its run, at each level but the last."""
    out = []
    for nodes in levels[:-1]:
        run = i // FAN * FAN
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + FAN])))
        i //= FAN
    return out


def _path(text: str) -> list[tuple[str, ...]]:
    return [tuple(x.split(_SIDE)) for x in text.split(_LEVEL)] if text else []


def climb(nodes: DataFrame) -> DataFrame:
    """``grp, place, h`` of the next tier: the digests of the superblocks of ``nodes(grp long, place long, h string)``."""

    def reduce(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        top = _reduced(rows.sort_values("place"), key[1])[-1]
        return pd.DataFrame({"grp": [key[0]], "place": [key[1]], "h": [top[0]]})

    return nodes.groupBy("grp", F.expr(f"place div {BLOCK}").alias("block")).applyInPandas(reduce, "grp long, place long, h string")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tiers above, one at least, up to one node a group; each is checkpointed and smaller than the last by a factor of up to BLOCK."""
    out = [nodes, checkpointed(climb(nodes))]
    while not out[-1].filter("place > 0").isEmpty():
        out.append(checkpointed(climb(out[-1])))
    return out


def _by_superblock(nodes: DataFrame, outer: DataFrame):  # noqa: ANN202
    """``nodes`` cogrouped with the one row of ``outer`` that belongs to their superblock."""
    left = nodes.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("grp", "block")
    return left.cogroup(outer.withColumnRenamed("place", "block").groupBy("grp", "block"))


def paths(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """``grp, place, path, subroot, root`` of each of ``nodes``, given those of their superblocks."""

    def join(key: tuple[int, int], rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        levels, rest = _reduced(rows, key[1]), above["path"].iloc[0]
        own = [_LEVEL.join([*(_SIDE.join(x) for x in _beside(levels, i)), *([rest] if rest else [])]) for i in range(len(rows))]
        return pd.DataFrame({"grp": key[0], "place": rows["place"], "path": own, "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    return _by_superblock(nodes.select("grp", "place", "h"), outer).applyInPandas(join, "grp long, place long, path string, subroot string, root string")


def _down(levels: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The paths of the lowest of ``levels``, from those of the highest."""
    for nodes in reversed(levels[:-1]):
        outer = checkpointed(paths(nodes, outer))
    return outer


def proven(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    """The manifest's rows of ``leaves(grp, place, doc_id string, h, shown)``: each superblock reduced, its proofs joined and folded, in one task."""

    def finish(key: tuple[int, int], rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        levels, top = _reduced(rows, key[1]), above.iloc[0]
        rest = _path(top["path"])
        tail = "".join(b + a for b, a in rest)
        proofs, folds = [], []
        for i, own in enumerate(rows["shown"]):
            beside = _beside(levels, i)
            proofs.append(digest(*(b + a for b, a in beside), tail))
            for b, a in (*beside, *rest):
                own = digest(b, own, a)
            folds.append(own)
        made = {"doc_id": rows["doc_id"], "leaf": rows["h"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": proofs, "folded_root": folds}
        return pd.DataFrame(made).assign(verified=[f == top["root"] for f in folds])

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _by_superblock(leaves, outer).applyInPandas(finish, schema)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row for each row of ``docs``.

    ``tampered`` says which rows are verified with a text whose A-Z have been lower-cased (null: not). Within a source leaves are in order of
    doc_id, null first; rows of one doc_id in order of their hashes, so repeated rows are leaves of their own. A null source
    is a source, before all others. Nulls in any field have their own encoding, unlike an empty text. An empty table gives an empty result.
    Columns other than FIELDS are ignored.
    """
    plain = {f: F.col(f) for f in FIELDS}
    lowered = plain | {"text": ascii_lower(F.col("text"))}
    rows = docs.select("doc_id", "source", leaf(plain).alias("h"), F.when(tampered, leaf(lowered)).alias("shown"))
    # a source goes by the place of its first row among all, a number that sorts as the sources do
    placed = running_within(rows, ["source"], [F.col("doc_id").asc_nulls_first(), "h"], {}, place="place", start="grp", keep=["doc_id", "h", "shown"])
    leaves = placed.select("grp", "place", F.col("doc_id").cast("string").alias("doc_id"), "h", F.coalesce("shown", "h").alias("shown"))
    low = tiers(leaves.select("grp", "place", "h"))
    one, nothing = F.lit(0).cast("long").alias("grp"), F.lit("").alias("path")
    subroots = numbered(low[-1].select(one, F.col("grp").alias("source"), "h"), ["source"], "place")
    high = tiers(subroots.select("grp", "place", "h"))
    top = high[-1].select("grp", "place", nothing, F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    sources = subroots.join(_down(high, top).select("place", "path", "root"), "place")
    sources = checkpointed(sources.select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("place"), "path", F.col("h").alias("subroot"), "root"))
    return proven(leaves, _down(low[1:], sources)).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
