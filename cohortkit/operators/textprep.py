"""Dataset preparation for the page classifier.

X2 is re-aimed: there is no pretrained vocabulary, so job 1 builds a corpus vocabulary (top-V
lower-cased words by count) and job 2 encodes each text to exactly ``max_len`` ids:
``[CLS] + first max_len-2 word ids + [SEP]`` padded with ``[PAD]``, unknown words -> ``[UNK]``.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions import draws as D
from cohortkit.functions.scalars import combine_text
from cohortkit.operators.selection import hash_threshold
from cohortkit.session import materialize

PAD, UNK, CLS, SEP = 0, 1, 2, 3
N_SPECIAL = 4
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def training_rows(samples: DataFrame) -> DataFrame:
    """``(sample_id, text, summary, label)`` from labelled samples."""
    return samples.select("sample_id", F.col("html").alias("text"), "summary", "label")


def combined(rows: DataFrame) -> DataFrame:
    """Model input text ``html + "\\n\\nSummary: " + summary``."""
    return rows.select("sample_id", combine_text(F.col("text"), F.col("summary")).alias("combined"), "label")


def sample_tuples(samples: DataFrame) -> DataFrame:
    """Each sample as the JSON 3-element array ``[html, page_type, summary]`` (file form)."""
    return samples.select("sample_id", F.to_json(F.array("html", "page_type", "summary")).alias("value"))


def unpack_tuples(tuples: DataFrame) -> DataFrame:
    """``[html, page_type, summary]`` JSON arrays back to columns."""
    a = F.from_json("value", "array<string>")
    return tuples.select("sample_id", a.alias("_a")).select(
        "sample_id", F.col("_a")[0].alias("html"), F.col("_a")[1].alias("page_type"), F.col("_a")[2].alias("summary"))


def tokenize(texts: DataFrame) -> DataFrame:
    """``(sample_id, label, toks)``: every text tokenized once and materialized, so the
    vocabulary and the encoding (and the upstream parse) do not run the split twice."""
    from cohortkit.session import materialize
    return materialize(texts.select("sample_id", "label", tokens_of(F.col("combined")).alias("toks")))


def vocabulary_from_tokens(tokens: DataFrame, size: int = 30000) -> DataFrame:
    """Top ``size`` words by (count desc, word asc), ids from 4 on (X2 job 1).

    Word counts are a partial-aggregated groupBy; the top-V cut is a distributed top-k.
    """
    words = tokens.select(F.explode("toks").alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.orderBy(F.desc("cnt"), F.asc("token")).limit(size)
    w = Window.orderBy(F.desc("cnt"), F.asc("token"))
    # `top` holds at most `size` rows (a parameter), so ranking it in one window is bounded.
    return top.select("token", "cnt", (F.row_number().over(w) + (N_SPECIAL - 1)).cast("int").alias("token_id"))


def encode_tokens(tokens: DataFrame, vocab: DataFrame, max_len: int = K.MAX_TOKENS) -> DataFrame:
    """Fixed-length ids and attention mask per text (X2 job 2, X7).

    Only the first ``max_len - 2`` tokens are exploded (truncation is part of the encoding);
    the vocabulary side is at most V rows, a size-bounded broadcast.
    """
    keep = max_len - 2
    toks = tokens.select("sample_id", "label", F.posexplode_outer(F.slice("toks", 1, keep)).alias("pos", "token"))
    ids = toks.join(F.broadcast(vocab.select("token", "token_id")), "token", "left").select(
        "sample_id", "label", "pos", F.when(F.col("pos").isNotNull(), F.coalesce("token_id", F.lit(UNK))).alias("token_id"))
    # texts without a single word keep one row without a position, and get [CLS][SEP] + padding
    per = ids.groupBy("sample_id", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id")))),
                    lambda s: s["token_id"]).alias("ids"))
    body = F.concat(F.array(F.lit(CLS)), F.col("ids"), F.array(F.lit(SEP)))
    n = F.size(body)
    input_ids = F.concat(body, F.array_repeat(F.lit(PAD), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    return per.select("sample_id", "label", input_ids.alias("input_ids"), mask.alias("attention_mask"))


def vocabulary(texts: DataFrame, size: int = 30000) -> DataFrame:
    """Vocabulary straight from ``(sample_id, label, combined)`` texts."""
    return vocabulary_from_tokens(texts.select("sample_id", "label", tokens_of(F.col("combined")).alias("toks")), size)


def encode(texts: DataFrame, vocab: DataFrame, max_len: int = K.MAX_TOKENS) -> DataFrame:
    """Encoding straight from ``(sample_id, label, combined)`` texts."""
    return encode_tokens(texts.select("sample_id", "label", tokens_of(F.col("combined")).alias("toks")), vocab, max_len)


def split_hash(rows: DataFrame, key: str = "sample_id", test_fraction: float = K.TEST_FRACTION, seed=K.SEED) -> DataFrame:
    """Approximate split: test when the keyed 32-bit hash is below fraction x 2^32."""
    h = D.slot(D.key_md5(seed, F.col(key), "split"), 0)
    return rows.select("*", (h < F.lit(test_fraction * D.TWO_32)).alias("is_test"))


def split_exact(rows: DataFrame, key: str = "sample_id", test_fraction: float = K.TEST_FRACTION,
                seed=K.SEED) -> DataFrame:
    """Exact split: in the order of a keyed hash (ties by key), the first ``ceil(fraction·n)`` rows are test.

    The fraction is taken as the decimal that it is written as. The last test row's hash and key are selected by radix, so the rows
    are only compared with them: nothing is ordered, joined or shuffled.
    """
    rows = materialize(rows, of=rows)
    hashed = D.slot(D.key_md5(seed, F.col(key), "split"), 0)
    narrow = rows.select(key, hashed.alias("_h"))
    last = hash_threshold(narrow, "_h", key, math.ceil(Fraction(str(test_fraction)) * rows.count()))
    if last is None:
        return rows.withColumn("is_test", F.lit(False))
    return rows.withColumn("is_test", (hashed < last[0]) | ((hashed == last[0]) & (F.col(key) <= F.lit(last[1]))))
