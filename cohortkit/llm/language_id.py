"""Language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is
the sum over all its segmentations into pieces (forward algorithm); a text's is the product over its
words; the prediction is the language of highest probability, the score its posterior under equal
priors. Words are lower-cased runs of letters, with the combining marks that belong to them, and a word mark before, as in the
vocabulary; a word may have any length. Words up to ``SHORT_WORD`` letters are summed many at once, a matrix per length; longer ones
one at a time in logarithms, by the same recursion.

Training: expectation maximisation of the piece probabilities per language, where the expected counts
come from forward and backward sums over the words of a sample of labelled texts: at most
``MAX_TRAIN_DOCS`` per language, those of the smallest MD5 of their id. The words of the sample are
counted by Spark, every round is a distributed pass over the word counts, and the driver only sees
(language, piece, count) sums: at most languages x vocabulary.

Prediction: one pass over the texts, no shuffle. Distinct words are scored in batches, one matrix per
word length, and kept in a bounded cache of the worker.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first
language by name; words over ``MAX_WORD`` letters count as several words; without any labelled text,
everything is ``und``; other columns pass through (``lang_pred`` and ``score`` are replaced, ``li_text`` is
reserved and left out).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import bound_batches, emptied, stored
from cohortkit.llm.hashing import mix

MAX_TRAIN_DOCS = 1000
ROUNDS = 4
MAX_PIECE = 16
SHORT_WORD = 32
CACHE_WORDS = 300_000
WORDS_AT_ONCE = 8192
UNKNOWN = 1e-7  # probability of a letter that is no piece, the same in every language
SMOOTHING = 0.1
UNDEFINED = "und"
MARK = "▁"

# below U+0300 there are no combining marks, and no numerals that the pattern takes but these
_LATIN_WORD = re.compile(r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters and their marks."""
    text = text.lower()
    return (_LATIN_WORD if text.isascii() or max(text) < "\u0300" else _WORD).findall(text)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that can stand in a lower-cased word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    body = ((p, p.removeprefix(MARK)) for p in pieces)
    return [p for p, b in body if len(p) <= MAX_PIECE and b == b.lower() and (_LETTERS.fullmatch(b) or p == MARK)]


class PieceIndex:
    """Piece numbers of the substrings of many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        size = 1 << max(8, (8 * len(pieces)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.values = np.full(size, -1, np.int32)
        for h, i in zip(hashes.tolist(), range(len(pieces))):
            at = h & (size - 1)
            while self.values[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.values[at] = h, i

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = mix(h + np.uint64(ord(c)))
        return int(h[0])

    def substrings(self, words: list[str]) -> np.ndarray:
        """For words of one length n: number[start, length - 1, word]; n for none, n + 1 for an unknown letter."""
        n = len(words[0]) + 1
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T
        out = np.full((n, min(n, self.longest), len(words)), self.n, np.int32)
        for start in range(n):
            h = np.zeros(len(words), np.uint64)
            for k in range(min(n - start, self.longest)):
                h = mix(h + codes[start + k].astype(np.uint64))
                out[start, k] = self._find(h)
            unknown = out[start, 0] == self.n
            out[start, 0, unknown] = self.n + 1
        return out

    def substrings_of(self, word: str) -> np.ndarray:
        """For one word: number[start, length - 1], as :meth:`substrings`."""
        codes = np.frombuffer((MARK + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes)
        out = np.full((n, min(n, self.longest)), self.n, np.int32)
        h = np.zeros(n, np.uint64)
        for k in range(out.shape[1]):
            h = mix(h[:n - k] + codes[k:])
            out[:n - k, k] = self._find(h)
        out[out[:, 0] == self.n, 0] = self.n + 1
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        found = np.where(self.keys[at] == h, self.values[at], -1)
        todo = np.flatnonzero((self.keys[at] != h) & (self.values[at] >= 0))
        step = at[todo]
        while len(todo):
            step = (step + np.uint64(1)) & self.mask
            hit = self.keys[step] == h[todo]
            found[todo[hit]] = self.values[step[hit]]
            go = ~hit & (self.values[step] >= 0)
            todo, step = todo[go], step[go]
        return np.where(found < 0, self.n, found).astype(np.int32)


def log_forward(number: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over the segmentations of every prefix of one word (prefix, language); the last ``longest`` sums make the next.
    ``logs``: (pieces + 2, language)."""
    n, longest = number.shape
    out = np.zeros((n + 1, logs.shape[1]))
    for end in range(1, n + 1):
        start = np.arange(max(0, end - longest), end)
        each = out[start] + logs[number[start, end - start - 1]]
        top = each.max(axis=0)  # a letter is a piece or unknown, so one is finite
        out[end] = top + np.log(np.exp(each - top).sum(axis=0))
    return out


def log_backward(number: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The same for every suffix of one word, in one language (``logs``: pieces + 2)."""
    n, longest = number.shape
    out = np.zeros(n + 1)
    for start in range(n - 1, -1, -1):
        k = np.arange(min(longest, n - start))
        each = logs[number[start, k]] + out[start + k + 1]
        top = each.max()
        out[start] = top + np.log(np.exp(each - top).sum())
    return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words of equal length up to ``SHORT_WORD``, in batches."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths[lengths <= SHORT_WORD]):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), WORDS_AT_ONCE):
            part = at[k:k + WORDS_AT_ONCE]
            yield part, [words[i] for i in part]


def forward(number: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Sums over the segmentations of every prefix: n + 1 arrays (word, language). p: (pieces + 2, language)."""
    n, longest, m = number.shape
    sums = [np.ones((m, p.shape[1]))]
    for end in range(1, n + 1):
        total = np.zeros((m, p.shape[1]))
        for start in range(max(0, end - longest), end):
            total += sums[start] * p[number[start, end - start - 1]]
        sums.append(total)
    return sums


def expected_counts(index: PieceIndex, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``words`` (each ``counts`` times) under p (pieces + 2)."""
    out = np.zeros(index.n + 2)
    for at, part in by_length(words):
        number = index.substrings(part)
        n, longest, m = number.shape
        ahead = forward(number, p[:, None])
        back = [None] * n + [np.ones(m)]
        for start in range(n - 1, -1, -1):
            back[start] = np.zeros(m)
            for k in range(min(longest, n - start)):
                back[start] = back[start] + p[number[start, k]] * back[start + k + 1]
        share = counts[at] / np.maximum(ahead[n][:, 0], 1e-300)
        for start in range(n):
            for k in range(min(longest, n - start)):
                uses = ahead[start][:, 0] * p[number[start, k]] * back[start + k + 1] * share
                out += np.bincount(number[start, k], uses, minlength=index.n + 2)
    logs = _logs(p)
    for i in (i for i, w in enumerate(words) if len(w) > SHORT_WORD):
        number = index.substrings_of(words[i])
        n, longest = number.shape
        ahead, back = log_forward(number, logs[:, None])[:, 0], log_backward(number, logs)
        for k in range(longest):
            at = np.arange(n - k)
            uses = np.exp(ahead[at] + logs[number[at, k]] + back[at + k + 1] - ahead[n]) * counts[i]
            out += np.bincount(number[at, k], uses, minlength=index.n + 2)
    return out


def _logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def with_specials(p: np.ndarray) -> np.ndarray:
    """Rows for "no piece" (0) and "unknown letter" under the piece probabilities."""
    return np.concatenate([p, np.zeros((1, *p.shape[1:])), np.full((1, *p.shape[1:]), UNKNOWN)])


_INDEX: dict[int, PieceIndex] = {}


def _index(pieces: list[str]) -> PieceIndex:
    key = hash(tuple(pieces))
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = PieceIndex(pieces)
    return _INDEX[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over ``docs`` (lang, text)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            count = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()),
                 pa.array(list(count.values()), pa.int64())], names=["lang", "word", "n"])

    rows = docs.select("lang", "text").where("text IS NOT NULL").mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces: list[str], doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          max_docs: int = MAX_TRAIN_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities (pieces, languages)."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    ids = labelled.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"))
    totals = stored(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("total")), "language-totals")
    # about twice max_docs rows of a language have an MD5 this small, however many it has; the window sees no more
    hashed = ids.withColumn("h", F.md5(F.col("id").cast("string")))
    small = hashed.join(totals, "lang").where(
        F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * F.col("total") < F.lit(2.0**33 * max_docs))
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = stored(small.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_docs).select("id", "lang"),
                    "language-sample")
    texts = labelled.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = stored(word_counts(texts.join(chosen, ["id", "lang"], "left_semi")), "language-words")
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    p = np.full((len(pieces), len(langs)), 1.0 / max(1, len(pieces)))
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((pieces, langs, with_specials(p)))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, langs, table = shared.value
            index = _index(pieces)
            for batch in emptied(batches):
                of = np.array(batch.column(0).to_pylist())
                words = batch.column(1).to_pylist()
                n = np.array(batch.column(2).to_pylist(), float)
                for k, name in enumerate(langs):
                    at = np.flatnonzero(of == name)
                    if len(at):
                        found = expected_counts(index, [words[i] for i in at], n[at], table[:, k])[:index.n]
                        used = np.flatnonzero(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(found[used])],
                            names=["k", "piece", "uses"])

        sums = counts.mapInArrow(expect, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses"))
        p = np.full(p.shape, SMOOTHING)
        for r in sums.collect():
            p[r["piece"], r["k"]] += r["uses"]
        p /= p.sum(axis=0)
        shared.unpersist()
    return langs, p


class Scorer:
    """Log-probabilities of words, with a bounded cache."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.index, self.table = _index(pieces), table
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, table.shape[1]))

    def add(self, words: list[str]) -> None:
        new = np.zeros((len(words), self.table.shape[1]))
        for at, part in by_length(words):
            sums = forward(self.index.substrings(part), self.table)
            new[at] = np.log(sums[-1])
        logs = _logs(self.table)
        for i in (i for i, w in enumerate(words) if len(w) > SHORT_WORD):
            new[i] = log_forward(self.index.substrings_of(words[i]), logs)[-1]
        base = len(self.logs)
        self.known.update((w, base + i) for i, w in enumerate(words))
        self.logs = np.concatenate([self.logs, new])

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Log-probability of each text per language; nan without a word."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.logs = {}, self.logs[:0]
        words = [words_of(t) if t else [] for t in texts]
        if new := {w for ws in words for w in ws if w not in self.known}:
            self.add(list(new))
        out = np.full((len(texts), self.table.shape[1]), np.nan)
        for i, ws in enumerate(words):
            if ws:
                out[i] = self.logs[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        return out


_SCORER: dict[int, Scorer] = {}


def predict(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    bound_batches(spark)
    rest = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score", "li_text")]
    docs = docs.select(F.col(f"`{text}`").alias("li_text"), *[F.col(f"`{f.name}`") for f in rest])
    shared = spark.sparkContext.broadcast((pieces, langs, with_specials(p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, table = shared.value
        key = hash(table.tobytes())
        if langs and key not in _SCORER:
            _SCORER.clear()
            _SCORER[key] = Scorer(pieces, table)
        for batch in emptied(batches):
            names, scores = [UNDEFINED] * batch.num_rows, np.zeros(batch.num_rows)
            if langs:
                logs = _SCORER[key].texts(batch.column(0).to_pylist())
                for i in np.flatnonzero(~np.isnan(logs[:, 0])):
                    best = int(logs[i].argmax())
                    names[i], scores[i] = langs[best], 1.0 / np.exp(logs[i] - logs[i, best]).sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(k + 1) for k in range(len(rest))] + [pa.array(names, pa.string()), pa.array(scores)],
                names=[f.name for f in rest] + ["lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType(rest + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
