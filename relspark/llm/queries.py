"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.chat import format_log, loss_texts, read_back, turn_log
from relspark.llm.common import table
from relspark.llm.decontaminate import contamination
from relspark.llm.licenses import find_licenses
from relspark.llm.linededup import without_repeated_lines
from relspark.llm.merkle import manifest
from relspark.llm.neighbours import nearest
from relspark.llm.packing import pack
from relspark.llm.pii import KINDS, find_pii
from relspark.llm.quality import quality
from relspark.llm.simhash import near_duplicates
from relspark.llm.tokens import token_counts
from relspark.llm.toxicity import toxicity
from relspark.llm.trie import rebuilt, trie, turns_in_order


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    counts = [_count(kind) for kind in (*KINDS, "secret", "generalise", "remove")]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = format_log(turn_log(turns)).withColumn("turns", read_back(F.col("formatted")))
    read = read.withColumn("loss", F.array_join(loss_texts(F.col("turns"), F.col("spans")), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_in_order(table(spark, sf_dir, "conversations"))
    return trie(turns.filter("place = 0").select("conv_id"), rebuilt(turns))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered)


QUERIES = (op1_packing, op2_toxicity, op3_quality, op4_simhash, op5_line_dedup, op6_licenses, op7_pii, op8_nearest, op9_token_counts, op10_decontaminate, op11_chat_format, op12_prefix_trie, op13_merkle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS gram, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (gram) WHERE dw.k = bw.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g')"

OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(7 + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 0 ELSE 13 + length({_ESCAPED.format('role')}) END + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

#: The unsigned CRC-32 of the characters of a number.
_CRC32 = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS b, {_CRC32.format('c')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, place) AS depth, role, text FROM (
    SELECT ids.c, 0 AS own, place, role, text FROM ids JOIN t ON t.c = ids.b WHERE place < h
    UNION ALL SELECT ids.c, 1, place, role, text FROM ids JOIN t ON t.c = ids.c WHERE place >= h)),
p AS (
  SELECT c, depth, text, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS k FROM r
  UNION ALL SELECT c, 0, '', '' FROM ids),
n AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(length(text)) AS chars FROM p GROUP BY depth, k),
x AS (SELECT p.c, p.depth, n.conv_id, n.n_convs, n.chars FROM p JOIN n USING (depth, k)),
m AS (SELECT x.conv_id, x.depth, x.n_convs, (x.n_convs - 1) * x.chars AS own, up.conv_id AS parent_conv_id FROM x LEFT JOIN x up ON up.c = x.c AND up.depth = x.depth - 1 WHERE x.c = x.conv_id),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY ALL),
below AS (SELECT x.conv_id, x.depth, sum(m.own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM m LEFT JOIN kids USING (conv_id, depth) JOIN x ON x.c = m.conv_id AND x.depth <= m.depth GROUP BY ALL),
ends AS (SELECT x.conv_id, x.depth, string_agg(x.c::VARCHAR, ',' ORDER BY x.c) AS cs FROM x JOIN (SELECT c, max(depth) AS depth FROM p GROUP BY c) l USING (c, depth) GROUP BY ALL)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.cs, '')) AS ends_sha256
FROM m JOIN below USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""


def _levels_sql(leaves: str, name: str, levels: int) -> str:
    """Common tables ``{name}0`` ... of (g, place, h, multi, before, after): each level's nodes, and what stands beside them in their run."""
    out = []
    for k in range(levels + 1):
        source = leaves if k == 0 else f"(SELECT g, place // 16 AS place, CASE WHEN any_value(multi) THEN sha256(string_agg(h, '' ORDER BY place)) ELSE any_value(h) END AS h FROM {name}{k - 1} GROUP BY g, place // 16)"
        beside = "coalesce(string_agg(h, '' ORDER BY place) OVER (PARTITION BY g, place // 16 ORDER BY place ROWS BETWEEN {0}), '')"
        out.append(f"{name}{k} AS (SELECT g, place, h, count(*) OVER (PARTITION BY g) > 1 AS multi, {beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, {beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS after FROM {source})")
    return ",\n".join(out)


def _folded_sql(shown: str, names: list[str]) -> str:
    for n in names:
        shown = f"CASE WHEN {n}.multi THEN sha256({n}.before || {shown} || {n}.after) ELSE {shown} END"
    return shown


#: Levels of a source's tree and of the tree over the sources that the SQL follows.
_LOW, _HIGH = 4, 2
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_NODES = [f"l{k}" for k in range(_LOW)] + [f"s{k}" for k in range(_HIGH)]

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, source AS src, {_LEAF.format('text')} AS leaf,
         CASE WHEN {_CRC32.format('doc_id')} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format('text')} END AS shown
  FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY src NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
{_levels_sql('(SELECT g, place, leaf AS h FROM o)', 'l', _LOW)},
{_levels_sql(f'(SELECT 0 AS g, g AS place, h FROM l{_LOW})', 's', _HIGH)},
f AS (
  SELECT doc_id, leaf, l{_LOW}.h AS subroot, s{_HIGH}.h AS root, sha256({" || ".join(f"{n}.before || {n}.after" for n in _NODES)}) AS proof_sha256, {_folded_sql('shown', _NODES)} AS folded_root
  FROM o {" ".join(f"JOIN l{k} ON l{k}.g = o.g AND l{k}.place = o.place // {16**k}" for k in range(_LOW + 1))} {" ".join(f"JOIN s{k} ON s{k}.place = o.g // {16**k}" for k in range(_HIGH + 1))})
SELECT *, folded_root = root AS verified FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_decontaminate": OP10_SQL, "op11_chat_format": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_merkle": OP13_SQL}
