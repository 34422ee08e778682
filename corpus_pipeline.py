"""Corpus pipeline over ``documents``: quality rules, line dedup, near duplicates, repeated passages, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each
result is written as Parquet and read again as the next stage's ``docs``. All stages but the last return
the columns of ``docs``; where a stage changes the text, ``n_chars`` follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import read_table, stored
from cohortkit.llm.jaccard_join import jaccard_classes
from cohortkit.llm.line_dedup import line_dedup
from cohortkit.llm.packing import pack
from cohortkit.llm.quality_rules import quality_rules
from cohortkit.llm.suffix_dedup import suffix_dedup


PASSAGE_WORDS = 50  # a passage is this many words in a row that stand elsewhere too
READ = ("doc_id", "text", "source")  # the columns that stages read


def _same_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` leaves of ``docs``, in the columns of ``docs``; ``n_chars`` follows the text. Other columns go through the stage
    under names by their place, so whatever they are called, they meet no name that an operator adds."""
    inside = [c if c in READ else f"column_{i}" for i, c in enumerate(docs.columns)]
    found = stage(docs.toDF(*inside))
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        found = found.withColumn(inside[at], F.length("text").cast(docs.schema[at].dataType))
    return found.select(inside).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed; phrases and separators fail a line by
    their share of it, so a long clean line is not lost for one of them."""
    return _same_columns(docs, lambda d: quality_rules(d, clean=True, by_share=True).where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source, where copies of a document count once: they are
    removed after this stage, and one of them has to keep its text."""
    return _same_columns(docs, lambda d: line_dedup(d, "source", "text", copies_once=True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (5-word shingles, Jaccard 0.8): that of the smallest
    doc_id. Documents without words or without a doc_id stay; equal rows are one document."""
    classes = stored(jaccard_classes(docs.select("doc_id", "text"), 5, 80, 100), "pipeline-classes")
    gone = stored(classes.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-gone")
    left = docs.join(gone, "doc_id", "left_anti")
    twice = stored(classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"),
                   "pipeline-twice")
    if not twice.isEmpty():  # rows that share a doc_id
        left = left.join(twice, "doc_id", "left_anti").unionByName(
            left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return left


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE_WORDS`` words or more that stand elsewhere too, from the first word to the last."""
    return _same_columns(docs, lambda d: suffix_dedup(d, words=PASSAGE_WORDS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left, in length buckets and batches."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", passage_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is stored in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The line rules by their share of a line (quality_rules) need the words beside each separator, which SQL cannot state within
# reason. tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None
