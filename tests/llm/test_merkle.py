"""The manifest against trees built in plain loops; sources of one row to more than two tiers."""

import random
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from relspark.llm.merkle import manifest

ROWS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and each leaf's siblings level by level, before and after it."""
    beside, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 16 * 16
            beside[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 16])))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], beside


def brute(rows):
    sources, out = {}, []
    for x in rows:
        sources.setdefault(x[1], []).append((x[0] is not None, x[0] or 0, leaf(x), x))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])[:]]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    for s, up in zip(order, above, strict=True):
        for (_, _, own, x), beside in zip(sorted(sources[s], key=lambda y: y[:3]), trees[s][1], strict=True):
            path, shown = beside + up, own
            if x[0] is not None and crc32(str(x[0]).encode()) % 5 == 0 and x[4] is not None:
                shown = leaf((*x[:4], "".join(c.lower() if c.isascii() else c for c in x[4])))
            for b, a in path:
                shown = h(b, shown, a)
            out.append((x[0], own, trees[s][0], root, h(*(b + a for b, a in path)), shown, shown == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(4).withColumn("grp", F.lit(3)).withColumn("place", F.lit("clash"))
    got = manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    return sorted((tuple(x) for x in got), key=str)


def test_manifest(spark):
    r = random.Random(3)
    rows = []
    for source, n in (("hot", 700), ("b", 17), ("c", 16), ("d", 1), ("é", 256), (None, 257), ("", 2), *((f"s{i}", 1) for i in range(20))):
        rows += [(len(rows) + k, source, r.choice(["en", None]), r.choice([1, None]), r.choice(["Text", "text", "ÉA", "", None])) for k in range(n)]
    rows += [(None, "hot", None, None, None), (None, "hot", None, None, None), (3, "hot", "en", 1, "Again"), (3, "hot", "en", 1, "Again"), (2**60 + 1, "b", "en", 1, "X" * 100000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {x[6] for x in got} == {True, False}


def test_small(spark):
    one = [(1, None, "en", 4, "Abcd")]
    assert run(spark, one) == brute(one)
    assert run(spark, one)[0][4] == h("")
    assert manifest(spark.createDataFrame([], ROWS), F.lit(True)).count() == 0
