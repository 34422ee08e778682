"""Registered queries of this subpackage: ``QUERIES`` and, where SQL can state them, ``ORACLE``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import language_id as lid
from cohortkit.llm import oracles
from cohortkit.llm.byte_bpe import bpe_digests
from cohortkit.llm.common import read_table
from cohortkit.llm.conversation_trie import conversations_of, prefix_trie
from cohortkit.llm.exact_topk import exact_topk
from cohortkit.llm.html_extraction import extract_pages, fit_weights
from cohortkit.llm.jaccard_join import jaccard_classes
from cohortkit.llm.license_scan import license_scan
from cohortkit.llm.line_dedup import line_dedup
from cohortkit.llm.packing import pack
from cohortkit.llm.pitman_yor import pitman_yor_scores
from cohortkit.llm.quality_rules import quality_rules
from cohortkit.llm.suffix_dedup import suffix_dedup
from cohortkit.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def register(name: str, sql: str | None = None):
    """Register a query, with its DuckDB oracle where there is one."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_line_dedup", oracles.LINE_DEDUP)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source dropped from all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs, "source", "text").select("doc_id", "n_lines", "n_dropped", "text")


@register("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text and their decoding, as digests."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


@register("op3_quality_rules", oracles.QUALITY_RULES)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars",
        "base_failed", "kept")


@register("op4_exact_topk", oracles.EXACT_TOPK)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 best of all vectors for every vector whose id is divisible by 20."""
    # floor() of a non-finite value is a finite long, so these rows go by the raw components
    raw = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.coalesce(F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(True))
    vectors = read_table(spark, sf_dir, "embeddings").where(finite).select(
        F.col("vec_id").alias("id"), F.transform(raw, lambda x: F.floor(F.lit(64.0) * x).cast("double")).alias("vec"))
    found = exact_topk(vectors.where(F.col("id") % 20 == 0), vectors, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


@register("op5_license_scan", oracles.LICENSE_SCAN)
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select(
        "doc_id", F.size("license_sentences").cast("long").alias("n_sentences"),
        F.array_join("license_sentences", ",").alias("license_sentences"),
        F.array_join("licenses", ",").alias("licenses"))


@register("op6_length_buckets", oracles.LENGTH_BUCKETS)
def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequences in optimal length buckets and token-budget batches."""
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op10_jaccard_join", oracles.JACCARD_CLASSES)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by 3-word shingles, linked at a Jaccard similarity of 0.9 or more."""
    return jaccard_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)


PIECE_FILE = "piece_bpe_32k.model"


@register("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; trained on documents outside the held-out third."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    pieces = lid.vocabulary(public_tokenizers.path(PIECE_FILE))
    langs, p = lid.train(docs.where(~F.col("held_out")), pieces)
    return lid.predict(docs.select("doc_id", "held_out", "text"), pieces, langs, p)


@register("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages, fit_weights(pages)).select("page_id", "url", "text", "n_chars")


@register("op9_suffix_dedup", oracles.SUFFIX_DEDUP)
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 400-byte strings starting elsewhere cover, and the text without them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


MAX_SHARED = 9  # shared first turns of op11: crc32 of the id modulo this
FAMILY = 5  # conversations whose ids differ in the rest of a division by this share first turns


@register("op11_conversation_trie", oracles.CONVERSATION_TRIE)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the conversations, each rebuilt with the first turns of its family's first one."""
    own = conversations_of(read_table(spark, sf_dir, "conversations"))
    heads = own.select(F.col("conv_id").alias("head_id"), F.slice("symbols", 1, MAX_SHARED - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_SHARED).cast("int")
    rebuilt = own.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("head_id"), "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), shared),
                            F.slice("symbols", shared + 1, F.size("symbols"))).alias("symbols"))
    empty = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    return prefix_trie(rebuilt).select(
        *[c for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.lower(F.hex(F.coalesce("ends", empty))).alias("ends_sha256"))


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whiten(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@register("op13_lm_scoring")
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by the hierarchical Pitman-Yor model; a tenth is held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return pitman_yor_scores(read_table(spark, sf_dir, "documents"), "doc_id", held_out).withColumnRenamed("id", "doc_id")
