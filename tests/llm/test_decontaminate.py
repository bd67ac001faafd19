import re

from relspark.llm import decontaminate
from relspark.llm.decontaminate import contamination, decontaminated


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    wins = {}
    for item, t in bench:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if got := wins.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= got
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


PASSAGE = "The quick-brown fox, jumps over 12 lazy DOGS and éclairs then rests awhile"
BENCH = [(1, PASSAGE), (10, "short item"), (2, None), (3, ""), (4, "?!"), (5, PASSAGE), (6, "É"), (7, "rep " * 12)]
DOCS = [
    (1, None), (2, ""), (3, "nothing in common"), (4, f"before {PASSAGE} after"), (5, "xx the quick brown fox jumps over 12 lazy dogs and"),
    (6, "a SHORT, item; short item"), (6, "a SHORT, item; short item"), (7, "rep " * 40 + "É é"), (None, PASSAGE[4:]), (8, "w " * 20000 + PASSAGE),
]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "h", [1]) for d, t in DOCS], "doc_id long, text string, h string, items array<int>")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(docs, bench).collect()]
    assert sorted(got, key=str) == brute(DOCS, BENCH)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in contamination(docs, bench).collect())


def test_removal_keeps_columns(spark):
    docs = spark.createDataFrame([(d, t, "h", [1]) for d, t in DOCS], "doc_id long, text string, h string, items array<int>")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == sorted((d, len(t or "")) for d, t in DOCS if not brute([(d, t)], [(1, PASSAGE)])[0][2])
    spans = {r.doc_id: r.text for r in decontaminated(docs, bench, mode="span").collect()}
    assert spans[4] == "before after" and spans[3] == "nothing in common" and spans[1] is None and spans[5] == "xx "


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(none, bench).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(some, bench).collect()] == [(2, 0, False)]


def test_large_benchmark(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for blocks, windows, most in ((1 << 18, 0, 200_000), (0, 200_000, 200_000), (0, 0, 0)):
        monkeypatch.setattr(decontaminate, "MAX_BLOCKS", blocks)
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", windows)
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_DOCS", most)
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(docs, bench).collect()]
        assert sorted(got, key=str) == brute(DOCS, BENCH)


def test_few_false_candidates_at_any_size(spark):
    """Of blocks that are not in the benchmark, few pass the fullest set; larger benchmarks have no set."""
    n = decontaminate.MAX_BLOCKS // 8
    bench = spark.range(n).selectExpr("array_join(transform(sequence(0, 9), j -> concat('b', id, 'x', j)), ' ') AS text", "id AS item_id")
    wins = decontaminate.benchmark_windows(bench)
    blocks = decontaminate._blocks(wins)
    known, slots = decontaminate._block_set(blocks, blocks.count())
    assert len(known) <= 1 << 20
    docs = spark.range(2000).selectExpr("transform(sequence(0, 49), j -> concat('d', id, 'y', j)) AS w")
    from pyspark.sql import functions as F

    passed = docs.select(F.sum(F.size(decontaminate._probe(10, known, slots))).alias("n")).first()["n"]
    assert passed < 0.02 * 2000 * 10
