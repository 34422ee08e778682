"""Varied labelled pages from a stochastic grammar (G5), as column expressions.

A symbol has weighted productions; a production is text with references to other symbols in braces. Which production a reference takes is a
keyed draw over (seed, page, path of the reference), so a page is the same in any task, and expansion is one native expression
per page without a shuffle. The grammar has no cycles, so expressions are finite.

Each type's core holds what the page prompt asks for; the blocks around it are drawn from one set for all types, which has
prices, forms and questions as well, so a page's type does not follow from a single element.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions import draws as D
from cohortkit.sources.fixtures import TITLE_PATTERN, page_type_draw

# symbol -> (weight, production); {subject} is the page's subject
GRAMMAR: dict[str, list[tuple[int, str]]] = {
    "adjective": [(1, w) for w in "simple modern reliable compact quiet popular careful regional".split()],
    "noun": [(1, w) for w in "guide model service method offer project account season".split()],
    "verb": [(1, w) for w in "shows needs supports replaces explains includes follows improves".split()],
    "digit": [(1, str(d)) for d in range(1, 10)],
    "price": [(1, "${digit}{digit}.99"), (1, "${digit}{digit}{digit}.00")],
    "sentence": [(3, "The {adjective} {noun} {verb} {subject}."), (2, "{subject} {verb} a {adjective} {noun}."),
                 (1, "Every {noun} {verb} one {adjective} {noun}.")],
    "paragraph": [(2, "<p>{sentence}</p>"), (1, "<p>{sentence} {sentence}</p>")],
    "link": [(1, '<a href="/{noun}">{adjective} {noun}</a>'), (1, '<a href="/home">Home</a>')],
    "informational": [(1, "<h2>What is {subject}?</h2>{paragraph}"), (1, "<h1>How does a {adjective} {noun} work?</h1>{paragraph}")],
    "navigational": [(1, "<nav><ul><li>{link}</li><li>{link}</li></ul></nav>"), (1, "<nav>{link} {link}</nav>{paragraph}")],
    "commercial": [(2, '<div class="product"><h2>{subject}</h2><p>Price: {price}</p><button>Buy now</button></div>'),
                   (1, '<section>{paragraph}<b>{price}</b> <a href="/{noun}">Order now</a></section>')],
    "transactional": [(1, '<form action="/{noun}" method="post"><input name="{noun}"><button type="submit">Send</button></form>'),
                      (1, "<div><p>Sign in to your {noun}</p><input type=\"email\"><button>Continue</button></div>")],
    "aside": [(3, ""), (1, "<aside>{link}</aside>"), (1, '<p class="note">from {price}</p>'), (1, '<form action="/search"><input name="q"></form>'),
              (1, "<h3>Why {subject}?</h3>")],
    "summary": [(1, "A {adjective} page about {subject}"), (1, "{subject}: {adjective} {noun}")],
}
PAGE = "<!DOCTYPE html><html><head><title>{subject}</title></head><body>{aside}{paragraph}{core}{paragraph}{aside}</body></html>"
SENTENCE, SITES = "sentence", "_sentences"
REFERENCE = re.compile(r"\{(\w+)\}")


def parts_of(production: str) -> list[tuple[str, str]]:
    """('text', text) and ('symbol', name) in order."""
    pieces = REFERENCE.split(production)
    return [("symbol" if i % 2 else "text", p) for i, p in enumerate(pieces) if p]


def _under(path: str | Column, suffix: str) -> str | Column:
    return path + suffix if isinstance(path, str) else F.concat(path, F.lit(suffix))


def draw_of(key: Column, path: str | Column, total: int, seed) -> Column:
    """Integer in [0, total) for the reference at ``path``."""
    return D.slot(D.key_md5(seed, key, path), 0) % total


def expand(symbol: str, key: Column, path: str | Column, given: dict[str, Column], seed=K.SEED, sites: list[str] | None = None) -> Column:
    """The text of a symbol referenced at ``path``. With ``sites``, a sentence is only noted there, and read from the column of that name."""
    if symbol in given:
        return given[symbol]
    if symbol == SENTENCE and sites is not None:
        sites.append(path)
        return F.element_at(F.col(SITES), F.lit(len(sites)))
    rules = GRAMMAR[symbol]
    if len({w for w, _ in rules}) == 1 and not any(REFERENCE.search(p) for _, p in rules):  # a word list
        return F.element_at(F.array(*[F.lit(p) for _, p in rules]), (draw_of(key, path, len(rules), seed) + 1).cast("int"))
    draw, upto, out = draw_of(key, path, sum(w for w, _ in rules), seed), 0, None
    for i, (weight, production) in enumerate(rules):
        text = render(production, key, _under(path, f".{i}"), given, seed, sites)
        upto += weight
        out = F.when(draw < upto, text) if out is None else out.otherwise(text) if i == len(rules) - 1 else out.when(draw < upto, text)
    return out


def render(production: str, key: Column, path: str | Column, given: dict[str, Column], seed=K.SEED, sites: list[str] | None = None) -> Column:
    """The text of a production at ``path``; its references are numbered."""
    texts = [F.lit(p) if kind == "text" else expand(p, key, _under(path, f"/{i}"), given, seed, sites)
             for i, (kind, p) in enumerate(parts_of(production))]
    return F.concat(*texts) if texts else F.lit("")


def generate_varied_pages(pages: DataFrame, seed=K.SEED) -> DataFrame:
    """(sample_id, page_type, html, summary): a page per row of (page_id, html), about its title."""
    base = pages.select(F.col("page_id").alias("sample_id"), page_type_draw(F.col("page_id"), seed).alias("page_type"),
                        F.coalesce(F.regexp_extract("html", TITLE_PATTERN, 1), F.lit("")).alias("subject"))
    key, given = F.col("sample_id"), {"subject": F.col("subject")}
    core, sites = None, []
    for t in K.PAGE_TYPES:
        text = expand(t, key, "core", given, seed, sites)
        core = F.when(F.col("page_type") == t, text) if core is None else core.when(F.col("page_type") == t, text)
    html = render(PAGE, key, "page", given | {"core": core}, seed, sites)
    # sentences, the bulk of the grammar, are one expression over the places where they stand
    sentences = F.transform(F.array(*[F.lit(p) for p in sites]), lambda p: expand(SENTENCE, key, p, given, seed))
    return base.withColumn(SITES, sentences).select("sample_id", "page_type", html.alias("html"), expand("summary", key, "summary", given, seed).alias("summary"))
