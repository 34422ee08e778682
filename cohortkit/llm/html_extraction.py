"""HTML main text by maximum-scoring subsequence.

A page is a sequence of text runs and tags. Each word scores the weight of its kind (the innermost block
it stands in, or page furniture), each tag a negative weight; a linear scan finds the contiguous region
with the highest sum, and its text outside page furniture is the main text. The weights are log odds
fitted on labelled pages: pages that mark their content (article, main), where words and tags inside it
count as content and all others do not; at most ``MAX_TRAIN_PAGES`` pages, those of the smallest MD5 of
their id. The counts are summed by Spark over a fixed set of kinds, so the driver sees a few hundred
rows at most. Extraction is one pass over the pages, no shuffle.

Furniture: elements that never hold content (menus, asides, forms, scripts, ...), page headers and
footers, and elements whose class, id or role names such a part: each word of the value is a part or says which one or where
("related-posts", but not "related-work", "ad-free", "has-sidebar"); headings are never named a part. Its words score as furniture and are not
returned, also where they stand inside the region. Opening the content element ends furniture that was
never closed.

Text: character references are decoded; white space inside a block becomes one blank; blocks (and line
breaks) are joined by one line end, empty ones are left out; nothing else is dropped.

Defined cases: null or empty html, and pages without words in a positive region, give an empty text;
without labelled pages the fixed default weights hold; ties go to the first region; broken markup is
read as it comes (a lone "<" is text, an unclosed comment or script runs to the end of the page).
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import bound_batches, emptied, stored

MAX_TRAIN_PAGES = 2000
MAX_WEIGHT = 4.0
LEAST_TAG, MOST_TAG = -0.1, -1.0  # a tag scores between these
IN_CONTENT = -0.05  # a word or tag of furniture inside a marked content element: it hardly parts the region
DEFAULT_WORD = 0.7
DEFAULT_TAG = -1.0
FURNITURE_WORD = -4.0

# --- FIXED VALUES: element kinds of HTML and usual names of page parts ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split())
CONTENT = frozenset(["article", "main"])
FURNITURE = frozenset(
    "head nav footer aside form script style noscript template select button textarea iframe svg dialog menu title "
    "canvas object audio video map".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner billboard sponsor sponsored promo promotion "
    "promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars rail aside footer masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments commentlist "
    "disqus respond replies reactions pagination pager widget widgets search searchbox skip skiplink "
    "complementary contentinfo search".split())
# words that say which part it is, or where
PART_QUALIFIERS = frozenset(
    "top bottom left right main primary secondary site page global local inner outer upper lower first second third "
    "container wrapper wrap box bar list block section area item items link links button buttons btn icon icons form "
    "post posts article articles story stories recent latest popular more entry entries header head body panel slot unit "
    "group holder row col column user author mobile desktop sticky fixed floating dropdown collapse toggle google dfp "
    "leaderboard facebook twitter media network networks the on by to js id".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_PARTS = frozenset(["header", "siteheader", "pageheader"])
BLOCK_KINDS = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote pre figcaption dd dt div section article main body".split())
# --- end of fixed values ---

_RAW = re.compile(r"<(script|style|textarea|title|xmp|noembed|noframes)\b", re.IGNORECASE)
_SPECIAL = re.compile("[\"'>]")
_TAG_START = re.compile("</?[A-Za-z]")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_PART = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_BITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


def names_part(bits: list[str]) -> bool:
    """Whether the words of a class, id or role name a page part and nothing else."""
    if bits[:1] == ["skip"] or "".join(bits) in PARTS:
        return True
    return any(b in PARTS for b in bits) and all(b in PARTS or b in PART_QUALIFIERS or b.isdigit() for b in bits)


def is_furniture(name: str, tag: str, in_content: bool) -> bool:
    """Whether an element is page furniture by its name or by its class, id and role."""
    if name in FURNITURE or (name == "header" and not in_content):
        return True
    if name in CONTENT or name in HEADINGS or name in ("html", "body") or "=" not in tag:
        return False
    for found in _PART.findall(tag):
        for value in "".join(found).split():
            bits = [b.lower() for b in _BITS.findall(value)]
            if names_part(bits) or "".join(bits) in HEADER_PARTS and not in_content:
                return True
    return False


def tokens_of(page: str) -> Iterator[tuple[str, str | None]]:
    """(token, name of a raw element or None): comments, raw elements with their text, tags, declarations and text, in order.

    A tag ends at the first ``>`` outside of quotes; if a quote is never closed, at the first ``>`` at all; without one, its ``<`` is text.
    Forward only: where a search has found nothing it is not made again, so the time is linear in the page, however broken.
    """
    last = {c: page.rfind(c) for c in "\"'>"}
    hopeless: set[int] = set()  # quotes that, opened in a tag, lead to no end

    def tag_end(at: int) -> int:
        """Behind the tag's ``>`` outside of quotes, from ``at`` on; -1 if there is none."""
        seen = []
        while (m := _SPECIAL.search(page, at)) is not None:
            if m[0] == ">":
                return m.end()
            opened = m.start()
            if opened in hopeless or opened >= last[m[0]]:
                seen.append(opened)
                break
            seen.append(opened)
            at = page.find(m[0], opened + 1) + 1
        hopeless.update(seen)
        return -1

    at, n, closing = 0, len(page), {}
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield page[at:end], None
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield page[at:end], None
        elif at > last[">"]:  # no tag can end
            end = at + 1
            yield "<", None
        elif (start := _TAG_START.match(page, at)) is not None:
            raw = _RAW.match(page, at)
            end = tag_end(start.end())
            if raw is not None and end > 0:
                name = raw[1].lower()
                close = closing.setdefault(name, re.compile(rf"</{name}\s*>", re.IGNORECASE)).search(page, end)
                end = n if close is None else close.end()
                yield page[at:end], raw[1]
            else:
                end = end if end > 0 else page.find(">", start.end()) + 1
                yield page[at:end], None
        elif page[at + 1] in "!?" and (close := page.find(">", at + 2)) >= 0:
            end = close + 1
            yield page[at:end], None
        else:
            end = at + 1
            yield "<", None
        at = end


def scan(page: str) -> list[tuple]:
    """The page as ('w', kind, furniture, content, text) and ('t', name, furniture, content, breaks)."""
    out = []
    # open elements: name, furniture, content (each or above it), the nearest block; furniture is a stretch at the end
    stack: list[tuple[str, bool, bool, str]] = []
    open_names: Counter = Counter()

    def close() -> str:
        name = stack.pop()[0]
        open_names[name] -= 1
        return name

    for token, name in tokens_of(page):
        furniture, content, block = stack[-1][1:] if stack else (False, False, "none")
        if token[0] != "<" or token == "<":
            if not token.isspace():
                linked = any(e[0] == "a" for e in stack[-4:])
                kind = "furniture" if furniture else "a" if linked else block
                out.append(("w", kind, furniture, content, token))
            else:
                out.append(("s", "", furniture, content, token))
            continue
        if token.startswith("<!--") or token[1] in "!?":
            continue
        if name is not None:  # a raw element with its text
            out.append(("t", name.lower(), True, content, False))
            continue
        name = _NAME.match(token).group(1).lower()
        if token[1] == "/":
            if open_names[name]:
                while close() != name:
                    pass
            out.append(("t", name, furniture, content, name not in INLINE))
            continue
        if name in CONTENT and furniture and not content:
            while stack and stack[-1][1]:  # furniture that was not closed ends here
                close()
            furniture, block = False, stack[-1][3] if stack else "none"
        if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            close()  # their end tags are optional
            block = stack[-1][3] if stack else "none"
        out.append(("t", name, furniture, content, name not in INLINE))
        if name not in VOID and not token.endswith("/>"):
            stack.append((name, furniture or is_furniture(name, token, content), content or name in CONTENT, name if name in BLOCK_KINDS else block))
            open_names[name] += 1
    return out


def kind_of(token: tuple) -> str:
    return ("w:" if token[0] == "w" else "t:") + token[1]


def label_counts(page: str) -> Counter:
    """(kind, inside) counts of a labelled page; nothing for a page that does not mark its content."""
    tokens = scan(page)
    if not any(t[3] for t in tokens):
        return Counter()
    out = Counter()
    for t in tokens:
        if t[0] == "w":
            out[kind_of(t), t[3] and not t[2]] += len(t[4].split())
        elif t[0] == "t":
            out[kind_of(t) if t[1] in BLOCK_KINDS | INLINE | FURNITURE | VOID else "t:other", t[3] and not t[2]] += 1
    return out


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each kind to stand inside the content; tags stay negative."""
    out = {}
    for kind in {k for k, _ in counts}:
        most, least = (MAX_WEIGHT, -MAX_WEIGHT) if kind.startswith("w:") else (LEAST_TAG, MOST_TAG)
        odds = math.log((counts.get((kind, True), 0) + 1) / (counts.get((kind, False), 0) + 1))
        out[kind] = max(least, min(most, odds))
    out["w:furniture"] = min(out.get("w:furniture", FURNITURE_WORD), FURNITURE_WORD)
    return out


def best_region(tokens: list[tuple], weights: dict[str, float]) -> tuple[int, int]:
    """[first, end) of the contiguous tokens with the highest sum; (0, 0) without a positive one."""
    best, region, total, first = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(tokens):
        if t[0] == "s":
            continue
        words = len(t[4].split()) if t[0] == "w" else 1
        if t[2] and t[3]:
            score = IN_CONTENT * words
        elif t[0] == "w":
            score = weights.get(kind_of(t), DEFAULT_WORD) * words
        else:
            score = weights.get(kind_of(t), DEFAULT_TAG)
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, region = total, (first, i + 1)
    return region


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    tokens = scan(page or "")
    first, end = best_region(tokens, weights)
    blocks, parts = [], []
    for kind, _, furniture, _, value in tokens[first:end]:
        if kind == "t":
            if value and parts:
                blocks.append("".join(parts))
                parts = []
        elif not furniture:
            parts.append(html_lib.unescape(value))
    blocks.append("".join(parts))
    return "\n".join(b for b in (_SPACE.sub(" ", b).strip() for b in blocks) if b)


def fit_weights(pages: DataFrame, page_id: str = "page_id", html: str = "html",
                max_pages: int = MAX_TRAIN_PAGES) -> dict[str, float]:
    """Weights from the labelled pages among ``pages``."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("id"), F.col(html).alias("html"))
    chosen = stored(
        rows.where(F.col("id").isNotNull() & F.lower("html").rlike("<(article|main)[ >]")).select("id")
        .orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_pages), "html-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            count = Counter()
            for page in batch.column(0).to_pylist():
                count.update(label_counts(page or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.bool_()),
                 pa.array(list(count.values()), pa.int64())], names=["kind", "inside", "n"])

    counts = rows.join(chosen, "id", "left_semi").select("html").mapInArrow(run, "kind string, inside boolean, n long")
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in counts.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()})


def extract_pages(pages: DataFrame, weights: dict[str, float], html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``; columns of these names are replaced (``hx_html`` is
    reserved and left out)."""
    bound_batches(pages.sparkSession)
    rest = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars", "hx_html")]
    pages = pages.select(F.col(f"`{html}`").alias("hx_html"), *[F.col(f"`{f.name}`") for f in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            texts = [extract(p, weights) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k + 1) for k in range(len(rest))]
                + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[f.name for f in rest] + ["text", "n_chars"])

    return pages.mapInArrow(run, T.StructType(rest + [
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
