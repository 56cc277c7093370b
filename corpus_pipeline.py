"""From raw documents to token ids: the training-data operators in a row, each working on all that its predecessor kept.

Defined results of the stages: a row with a null id is never dropped as a near copy;
null and empty texts pass every stage as they are and have no tokens; equal rows are judged alike, except that rows of
one id go or stay together as near copies, and an id of several raw documents is compared as it comes alone; of ties the
smallest id stays; very long texts are treated whole; an empty table gives an empty table; further columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankeval.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from rankeval.llm.common import settled, staged, table

#: Near copies share this much of their 5-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: A document of which more of the words are benchmark windows goes; others lose those words.
LEAKED_SHARE = 0.5


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars of the texts as they are now, where there is such a column."""
    return docs.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go. The model is fitted on labelled documents of this input."""
    return toxicity.without_toxic(docs, toxicity.model_of(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in several documents stay in the first alone; documents of which no more than blanks is left go."""
    return _sized(line_dedup.dedup_lines(docs, counts=False, emptied=False), docs.columns)


def _unedited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and raw text of the rows whose lines are all lines of the one document that has their id.

    Lines are told by 64-bit hashes, so of docs these alone are shuffled. Ids of several raw documents are left out.
    """
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    several = raw.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    lines = lambda c: F.array_distinct(F.transform(F.split(c, "\n", -1), lambda line: F.xxhash64(line)))
    left = docs.select("doc_id", lines("text").alias("lines")).join(raw.join(several, "doc_id", "left_anti"), "doc_id")
    return left.where(F.size(F.array_except("lines", lines("raw"))) == 0).select("doc_id", F.col("raw").alias("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Documents are compared as they come, and as they were before the stage in front cut the lines that they share: what is
    left of a near copy behind that stage does not resemble its original any more. A text that is not left of the raw
    document with its id (a table of other documents) is compared as it comes alone.
    """
    near = lambda rows: ngram_join.lesser(rows, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    own = settled(lambda: near(docs), "copies")
    raw = settled(lambda: near(settled(lambda: _unedited(spark, docs, sf_dir), "unedited")), "copies")
    gone = own.unionByName(raw).distinct().withColumnRenamed("doc_id", "_gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out; documents that consist of them for the most part go."""
    return _sized(decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), max_share=LEAKED_SHARE), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the token ids with their number and digests."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"), returns=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_level_bpe", tokens),
]

#: A trained score and a tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
