import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from relspark.llm import quality, simhash
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import near_fps

SF = "/root/testdata/sf0.001"


def test_wide_tiles_find_similar_texts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for c in range(4):
            own = list(words)
            for at in rng.integers(0, 300, c):
                own[at] = f"edit{g}{c}{at}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100, ""), (101, None), (102, " "), (103, "unlike any other text"), (None, "unlike any other text"), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, k1 int")
    for bucket in (2, 8192):
        got = {r.doc_id: r.component_id for r in simhash.similar(df, bucket=bucket).collect()}
        assert all(got[i] == i // 4 * 4 for i in range(48)) and got[101] == got[102] == 100 and got[None] == 103
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(0, 48, 4), 100, 103], key=str)
    assert len(near_fps(3)) == 3


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5

    one = stages["quality_classifier"](spark, docs, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    keep = quality.scored(model, [r.text for r in rows]) >= quality.THRESHOLD
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r, k in zip(rows, keep, strict=True) if k) and one.columns == columns

    two = stages["line_dedup"](spark, one, SF)
    want = brute_lines([(r.doc_id, r.text, 0) for r in one.collect()])
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=str) == sorted(((d, t) for d, t, _ in want), key=str) and two.columns == columns
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = stages["simhash_near_dedup"](spark, two, SF)
    before = two.collect()
    near = {r.doc_id: r.component_id for r in simhash.similar(two).collect()}
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(near.values())) and three.columns == columns
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in before}
    alike = {(a, b): len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for a in shingles for b in shingles if a < b}
    assert all(near[a] == near[b] for (a, b), s in alike.items() if s >= 0.84)
    # whoever goes is linked to another of its group
    assert all(any(s > 0.7 for (a, b), s in alike.items() if d in (a, b) and near[a] == near[b]) for d, c in near.items() if d != c)

    four = stages["benchmark_decontamination"](spark, three, SF)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {d: n for d, _, n, _ in brute_hits([(r.doc_id, r.text) for r in three.collect()], bench)}
    assert sorted(r.doc_id for r in four.collect()) == sorted(d for d, n in hits.items() if not n) and four.columns == columns

    five = stages["packing"](spark, four, SF).collect()
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    total = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in four.collect()}
    got = {}
    for r in five:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total

    assert corpus_pipeline.run(spark, SF).count() == len(five)


def test_stages_with_odd_rows(spark):
    """Nulls, repeated rows, long texts, and columns that clash with names inside."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (4, long), (5, f"{long} more"), (6, "x\n" * 50)]
    docs = spark.createDataFrame([(d, t, 1, "s", [1], 0.5, "h", 7) for d, t in rows], "doc_id long, text string, k1 int, spans string, hits array<int>, s double, h string, w int").repartition(4)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert all(kept["quality_classifier"].count(x) in (0, rows.count(x)) for x in rows)
    assert len(kept["line_dedup"]) == len(rows) and kept["line_dedup"].count((1, None)) == 2 and kept["line_dedup"].count((3, "a b c")) == 2
    # one of the wordless, one of each text; 5 differs from 4 by a word in thirty thousand
    assert [d for d, _ in kept["simhash_near_dedup"]] == [1, 3, 4, 6]
    assert kept["benchmark_decontamination"] == sorted(rows, key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 1) == 2 and sum(r.start == 0 for r in packed) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).collect() == []
