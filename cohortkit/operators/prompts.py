"""Prompt tables (S3): one receipt prompt per attempt with five sampled catalog items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions import draws as D
from cohortkit.sources.catalog import categories, string_array


def filled_prompt() -> str:
    """The prompt's wording with stores, locations, tax rate and categories of the domains."""
    text = K.RECEIPT_PROMPT
    for mark, value in (("<STORES>", K.STORE_NAMES), ("<LOCATIONS>", K.STORE_LOCATIONS), ("<TAX_RATE>", K.TAX_RATE),
                        ("<CATEGORIES>", categories())):
        text = text.replace(mark, str(value))
    return text


def receipt_prompts(attempts: DataFrame, year: int, seed=K.SEED, n_samples: int = 5) -> DataFrame:
    """``(attempt)`` -> sampled example items and the prompt text. ``year`` is the caller's clock
    (the original reads the current year)."""
    names = string_array([n for _, n, _ in K.CATALOG])
    sample = D.sample_without_replacement(names, F.lit(n_samples), seed, F.col("attempt"), "prompt")
    staged = attempts.select("attempt", sample.alias("sample_items"))
    prompt = F.replace(F.replace(F.lit(filled_prompt()), F.lit("<SAMPLE_ITEMS>"), F.array_join("sample_items", ", ")),
                       F.lit("<YEAR>"), F.lit(str(year)))
    return staged.select("attempt", "sample_items", prompt.alias("prompt"))
