"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before it kept, on whole texts of any length. Null ids and columns
other than ``doc_id`` and ``text`` are carried along, whatever their names; an empty table gives an empty
result in every stage. ``ORACLE_SQL`` is None: the classifier, the
fingerprints and the tokenizer have no SQL; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.common import small_batches, stored, table
from relspark.llm.decontaminate import decontaminated
from relspark.llm.linededup import without_repeated_lines
from relspark.llm.packing import pack
from relspark.llm.quality import accepted
from relspark.llm.queries import vocabulary
from relspark.llm.simhash import deduplicated


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labelled rows, rejects go.

    A null text is scored as an empty one; rows of equal text have equal scores and go or stay together.
    """
    small_batches(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut out of the texts; ``n_chars`` follows.

    Null and empty texts stay as they are; a text cut whole becomes empty and its row stays. The first
    occurrence is that of smallest doc_id, then of smallest text hash; rows of equal doc_id and text are one document.
    """
    small_batches(spark)
    out = without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles of which 0.8 are shared.

    Null, empty and wordless texts are one group. The document of smallest doc_id stays (nulls last, ties by a
    hash); of rows of equal doc_id and text one stays.
    """
    small_batches(spark)
    return deduplicated(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go.

    Null, empty and wordless texts have no hits and stay; rows of equal text go or stay together.
    """
    small_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), mode="document")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048.

    A null or empty text is its end token; repeated rows are packed on their own.
    """
    small_batches(spark)
    # fewer words are remembered than by the query: the stages before have made the executors large
    return pack(docs, vocabulary("word_bpe_49k.json"), words=100_000)


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, simhash_near_dedup, benchmark_decontamination, packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
