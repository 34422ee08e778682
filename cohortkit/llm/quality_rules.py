"""Line-first quality rules.

Every line is judged by three rules; the lines that fail are removed, and a document that loses too
much of its text by that is rejected:

* punctuation: a short line does not end in a closing mark, or marks and symbols make up too much of a line;
* navigation: separators between items, or link words alone on a line;
* boilerplate: wording of notices, forms and page furniture.

Wording in lines of any length: as the SQL of op3 states them, the navigation and boilerplate rules hold for a line
of any length, so one phrase or two separators fail a long paragraph. With ``by_share`` (the pipeline) they have to
make up a share of the line: the phrases ``MIN_SHARE_PERCENT`` of its words, the separators as much together with
the words of the short items beside them; » of a quotation and · inside a Catalan word are no separators then.

Base figures of the whole text (words, symbols, repeated lines, repeated three-word windows) reject a
document before the line rules count. Python over Arrow batches: the figures need the words of a text
in order, which no built-in expression gives without building arrays of windows; there is no shuffle
and nothing is gathered across rows.

Defined cases: null or empty text has no words, so it fails the base rules; lines without a word are
ignored by the rules and kept as they are; repeated rows are judged alike; other columns pass through, but for
columns named as an output (replaced) and ``qr_text`` (reserved, left out).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import binary_texts, bound_batches, emptied

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS_PERCENT = 30  # of the characters in words
SHORT_LINE_WORDS = 10  # a line of fewer words has to end in a closing mark
MAX_MARK_PERCENT = 10  # symbols and exclamation marks against the characters in words of a line

MIN_SHARE_PERCENT = 20  # by share: phrases, or separators and short items beside them, in words of a line
ITEM_WORDS = 4  # a short item between separators has at most so many words

# --- FIXED VALUES of the line rules ---
SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&|<>!{}=~^"
SPACES = b" \t\n\x0b\x0c\r"
CLOSING = (".", "!", "?", '"', "'", "…", ":", ";", ")", "”", "’", "»", "。", "！", "？")
SEPARATORS = (b"|", "»".encode(), "·".encode(), b" > ", "•".encode())
LINK_WORDS = frozenset(
    b"home about contact login logout register menu search next previous back top share tweet print "
    b"more help faq sitemap archive archives tags categories comments reply follow".split())
BOILERPLATE = (
    "cookie policy", "use cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "enable javascript", "javascript is disabled", "click here", "sign up for", "subscribe to our", "lorem ipsum",
    "share this", "follow us on", "powered by", "read more",
)
# --- end of fixed values ---

BOILERPLATE_RE = re.compile("|".join(re.escape(x) for x in BOILERPLATE).encode())
CONTINUATION = bytes(range(0x80, 0xC0))
CLOSING_BYTES = tuple(x.encode() for x in CLOSING)


# between two l of a Catalan word; a quotation with its marks
CATALAN_POINT = re.compile("(?<=[lL])·(?=[lL])".encode())
QUOTED = re.compile("«([^«»]*)»|»([^«»]*)«".encode())
SEPARATOR_RE = re.compile(b"|".join(map(re.escape, SEPARATORS)))


def items_share(line: bytes) -> bool:
    """Whether the line has two separators or more that make up, with the short items beside them, their share of it."""
    items = SEPARATOR_RE.split(QUOTED.sub(rb" \1\2 ", CATALAN_POINT.sub(b"", line)))
    if len(items) < 3:
        return False
    words = [len(x.split()) for x in items]
    marks = len(items) - 1
    return (marks + sum(n for n in words if n <= ITEM_WORDS)) * 100 >= MIN_SHARE_PERCENT * (marks + sum(words))


def phrases_share(lower: bytes, n_words: int) -> bool:
    """Whether boilerplate phrases make up their share of the line's words."""
    return sum(len(x.split()) for x in BOILERPLATE_RE.findall(lower)) * 100 >= MIN_SHARE_PERCENT * n_words


def line_verdict(line: bytes, by_share: bool = False) -> str:
    """'' for a line that passes, else the rule that it fails. The line holds a word."""
    words = line.split()
    chars = sum(map(len, words))
    if len(words) < SHORT_LINE_WORDS and not line.rstrip(SPACES).endswith(CLOSING_BYTES):
        return "punctuation"
    marks = chars - sum(len(w.translate(None, MARKS)) for w in words)
    if marks * 100 > MAX_MARK_PERCENT * chars:
        return "punctuation"
    if sum(map(line.count, SEPARATORS)) >= 2 and (not by_share or items_share(line)):
        return "navigation"
    lower = line.lower()
    if len(words) <= 4 and all(w.strip(b".,:;!?") in LINK_WORDS for w in lower.split()):
        return "navigation"
    if BOILERPLATE_RE.search(lower) and (not by_share or phrases_share(lower, len(words))):
        return "boilerplate"
    return ""


def repeat_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that stands twice or more in the text, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def measure(text: bytes | None, by_share: bool = False) -> dict:
    """The figures and the verdict of one text, and the text without the lines that failed."""
    text = b"" if text is None else text
    words = text.split()  # splits on ASCII white space alone
    in_words = text.translate(None, SPACES)
    out = {
        "n_words": len(words),
        "word_chars": len(in_words.translate(None, CONTINUATION)),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_repeat_words": repeat_words(words),
    }
    seen, dup, lines = set(), 0, text.split(b"\n")
    kept, lost, failed = [], 0, Counter()
    for line in lines:
        bare = line.translate(None, SPACES)
        if not bare:
            kept.append(line)
            continue
        dup += line in seen
        seen.add(line)
        rule = line_verdict(line, by_share)
        if rule:
            failed[rule] += 1
            lost += len(bare.translate(None, CONTINUATION))
        else:
            kept.append(line)
    out["n_dup_lines"] = dup
    out["base_failed"] = out["n_words"] < MIN_WORDS or 100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]
    out["lost_chars"] = lost
    out["kept"] = not out["base_failed"] and 100 * lost <= MAX_LOSS_PERCENT * out["word_chars"]
    out["n_failed_punctuation"] = failed["punctuation"]
    out["n_failed_navigation"] = failed["navigation"]
    out["n_failed_boilerplate"] = failed["boilerplate"]
    out["clean_text"] = b"\n".join(kept) if failed else text
    return out


LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "n_failed_punctuation",
         "n_failed_navigation", "n_failed_boilerplate"]
FLAGS = ["base_failed", "kept"]


def quality_rules(docs: DataFrame, text: str = "text", clean: bool = False, by_share: bool = False) -> DataFrame:
    """``docs`` with the figures, ``base_failed`` and ``kept``; with ``clean``, the column ``text`` holds
    what the line rules left (a null text stays null); ``by_share`` as above. A column of ``docs`` with the name of a figure is
    replaced."""
    bound_batches(docs.sparkSession)
    names = LONGS + FLAGS
    docs = docs.drop(*names, "qr_text")
    if not clean:  # the text itself need not come back from Python
        rest = [c for c in docs.columns if c != text]
        docs = docs.select(F.col(text).alias("qr_text"), *[F.col(f"`{c}`") for c in rest])
    else:
        docs = docs.withColumn("qr_text", F.col(text))
    fields = [f for f in docs.schema.fields if f.name != "qr_text"]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in LONGS]
                          + [T.StructField(n, T.BooleanType()) for n in FLAGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            at = batch.schema.get_field_index("qr_text")
            texts = binary_texts(batch.column(at))
            found = [measure(x, by_share) for x in texts]
            columns, cols = [f.name for f in fields], []
            for name in columns:
                if clean and name == text:
                    cleaned = [None if t is None else f["clean_text"].decode() for t, f in zip(texts, found)]
                    cols.append(pa.array(cleaned, pa.string()))
                else:
                    cols.append(batch.column(batch.schema.get_field_index(name)))
            cols += [pa.array([f[n] for f in found], pa.int64()) for n in LONGS]
            cols += [pa.array([f[n] for f in found], pa.bool_()) for n in FLAGS]
            yield pa.RecordBatch.from_arrays(cols, names=columns + names)

    return docs.mapInArrow(run, schema)
