"""Labelled page samples.

The original asks a chat model for ``{html, summary}`` per page type and keeps complete
answers. Here generated responses arrive as a table and are validated in bulk; a template
generator gives pages that honour the prompt's contract per type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.sources.fixtures import TITLE_PATTERN, page_type_draw

# Contract of the page prompt, one pattern per page type (case-insensitive search).
CONTRACT = {
    "informational": [r"(?is)<h[1-6][^>]*>[^<]*\?", r"(?i)<p[ >]"],
    "navigational": [r"(?i)<nav[ >]"],
    "commercial": [r"(?i)(price|\$\s?[0-9])", r"(?i)(<button|buy now|add to cart|order now|shop now)"],
    "transactional": [r"(?i)(<form[ >]|<button|<input[ >])"],
}


def page_prompts(samples: DataFrame, type_col: str = "page_type") -> DataFrame:
    """Prompt text per row from the page prompt wording."""
    return samples.select("*", F.replace(F.lit(K.PAGE_PROMPT), F.lit("<PAGE_TYPE>"), F.col(type_col)).alias("prompt"))


def validate_page_responses(responses: DataFrame) -> DataFrame:
    """``(sample_id, page_type, raw)`` -> reason per sample.

    ``generation_failed``: not exactly one JSON text, or an empty one (``{}``, ``[]``, ``null``, ``""``, ``0``, ``false``:
    the original treats all of these as no result); ``not_an_object``: other JSON that is not an object;
    ``incomplete``: ``html`` or ``summary`` missing or null.
    """
    # wrapped in [...], text after the value or a second value is a parse error or a second element
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit("]"))), "$", "array<variant>")
    parsed = responses.select("sample_id", "page_type", F.when(F.size(wrapped) == 1, F.element_at(wrapped, 1)).alias("_v"))
    obj = F.try_variant_get(F.col("_v"), "$", "map<string,variant>")
    staged = parsed.select("sample_id", "page_type", "_v", obj.alias("_obj"))
    html = F.try_variant_get(F.col("_obj")["html"], "$", "string")
    summary = F.try_variant_get(F.col("_obj")["summary"], "$", "string")
    fields = staged.select("sample_id", "page_type", "_v", "_obj", html.alias("html"), summary.alias("summary"))
    empty = F.coalesce(F.to_json(F.col("_v")).isin("null", "[]", "{}", '""', "0", "0.0", "false"), F.lit(True))
    reason = (F.when(F.col("_v").isNull() | empty, F.lit("generation_failed"))
              .when(F.col("_obj").isNull(), F.lit("not_an_object"))
              .when(F.size("_obj") == 0, F.lit("generation_failed"))
              .when(F.col("html").isNull() | F.col("summary").isNull(), F.lit("incomplete")))
    return fields.select("sample_id", "page_type", reason.alias("reason"),
                         F.col("html"), F.col("summary"))


def page_samples(validated: DataFrame) -> DataFrame:
    """Accepted samples ``(sample_id, html, page_type, summary)``."""
    return validated.filter(F.col("reason").isNull()).select("sample_id", "html", "page_type", "summary")


def label_of(page_type: Column) -> Column:
    """Label id = position in the page-type list; NULL for unknown types."""
    pos = F.array_position(F.array(*[F.lit(t) for t in K.PAGE_TYPES]), page_type)
    return F.when(pos > 0, (pos - 1).cast("int"))


def label_encode(samples: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``label``; unknown page types are routed to ``reason='unknown_page_type'`` or, in
    strict mode, raise like the original."""
    out = samples.withColumn("label", label_of(F.col("page_type")))
    if strict:
        return out.withColumn("label", F.coalesce(F.col("label"), F.raise_error(
            F.concat(F.lit("unknown page type: "), F.col("page_type")))))
    return out.withColumn("reason", F.when(F.col("label").isNull(), F.lit("unknown_page_type")))


def contract_pass(html: Column, page_type: Column) -> Column:
    """Whether the page has every element its type's prompt asks for."""
    expr = F.lit(False)
    for t, pats in CONTRACT.items():
        ok = F.lit(True)
        for p in pats:
            ok = ok & F.regexp_like(html, F.lit(p))
        expr = F.when(page_type == t, ok).otherwise(expr)
    return expr


def contract_audit(samples: DataFrame) -> DataFrame:
    """Pass rate of the page-type contract per type."""
    return samples.groupBy("page_type").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(contract_pass(F.col("html"), F.col("page_type"))).alias("n_pass")).select(
        "page_type", "n_pages", "n_pass", F.round(F.col("n_pass") / F.col("n_pages"), 6).alias("pass_rate"))


def generate_pages(pages: DataFrame, seed=K.SEED) -> DataFrame:
    """Template pages per drawn type that honour the prompt contract, with a summary.

    The subject of each page is the source page's title.
    """
    title = F.regexp_extract("html", TITLE_PATTERN, 1)
    base = pages.select(F.col("page_id").alias("sample_id"),
                        page_type_draw(F.col("page_id"), seed).alias("page_type"), title.alias("subject"))
    s = F.col("subject")
    head = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), s, F.lit("</title></head><body>"))
    body = (F.when(F.col("page_type") == "informational",
                   F.concat(F.lit("<h1>What is "), s, F.lit("?</h1><p>"), s, F.lit(" is explained here.</p>")))
            .when(F.col("page_type") == "navigational",
                  F.concat(F.lit('<nav><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li>'
                                 '<li><a href="/contact">Contact</a></li></ul></nav><p>'), s, F.lit("</p>")))
            .when(F.col("page_type") == "commercial",
                  F.concat(F.lit('<div class="product"><h2>'), s,
                           F.lit('</h2><p class="price">Price: $19.99</p><button>Buy now</button></div>')))
            .otherwise(F.concat(F.lit('<form action="/submit" method="post"><label>'), s,
                                F.lit('</label><input type="email" name="email"><button type="submit">Submit</button></form>'))))
    html = F.concat(head, body, F.lit("</body></html>"))
    summary = F.concat(F.initcap(F.col("page_type")), F.lit(" page about "), s)
    return base.select("sample_id", "page_type", html.alias("html"), summary.alias("summary"))
