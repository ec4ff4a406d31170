"""Documents to training sequences: quality rules, near-duplicate removal, removal of repeated passages, packing.

Every stage takes an empty table, null keys and texts, repeated rows, ties and further columns with any names, and all but
the last return the columns they got. A null text has no words: the first stage rejects it. A row with a null key is
judged by its text, loses no passage and removes none. Of rows with equal key and text the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join, packing, quality, recompress
from corpusloom.llm.common import forget, parquet, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a rule rejects; cutoffs come from the labels of those that are there. Without labels
    that can certify any, only the base rules reject."""
    return quality.keep_good(docs, parquet(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest key, of each group that links of similarity 0.8 on five-word shingles join;
    of a group of null keys one too."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words of 13-word windows that a document with a smaller id has; n_chars follows the text. A text of which
    nothing is left stays as an empty one."""
    out = recompress.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, mixed by source in the proportions of what is left of the corpus. A null source
    is the source ''."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: Binomial bounds and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next. What a stage wrote goes when the next
    one has read it."""
    docs, last = parquet(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
