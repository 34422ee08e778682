"""Sub-word encoding with a given vocabulary.

Words (runs of letters and digits, every other character alone, lower-cased) are cut into the longest pieces of a public vocabulary, from left to
right: the rest of a word with the end mark if that is a piece, else its longest proper beginning that is one. The
vocabulary is read from a file by the driver and is never trained; its size bounds what is sent to the tasks. Words are split by Spark; a task
walks a trie once per distinct word that it meets, so no text is shuffled.

The file holds every byte as a piece of its own, written as the character of :func:`byte_characters`, with and without the end mark, so no
word is unknown.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit import constants as K

WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
END_MARK = "</w>"
MEMO = 1 << 17  # distinct words whose pieces a task remembers at once


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones are themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> dict[str, int]:
    """Piece -> id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]["vocab"]


def special_ids(vocabulary: dict[str, int]) -> tuple[int, int, int]:
    """(begin, end, padding): the ids behind the vocabulary's."""
    n = max(vocabulary.values()) + 1
    return n, n + 1, n + 2


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


class Trie:
    """The pieces of a vocabulary by their characters; :meth:`cut` gives the ids of a word."""

    def __init__(self, vocabulary: dict[str, int]):
        self.characters = byte_characters()
        self.inner: dict = {}  # pieces inside words
        self.ends = {p[:-len(END_MARK)]: i for p, i in vocabulary.items() if p.endswith(END_MARK)}
        for piece, i in vocabulary.items():
            if not piece.endswith(END_MARK):
                node = reduce(lambda n, c: n.setdefault(c, {}), piece, self.inner)
                node[None] = i
        self.memo: dict[str, list[int]] = {}

    def cut(self, word: str) -> list[int]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = self._cut("".join(self.characters[b] for b in word.encode()))
        return found

    def _cut(self, rest: str) -> list[int]:
        ids, at, n = [], 0, len(rest)
        longest = max(map(len, self.ends), default=0) if n > 64 else n  # no need to slice long words' rests
        while at < n:
            if n - at <= longest and rest[at:] in self.ends:
                ids.append(self.ends[rest[at:]])
                break
            node, best, size = self.inner, None, 0
            for k in range(at, n - 1):  # a proper beginning: the last character needs the end mark
                node = node.get(rest[k])
                if node is None:
                    break
                if None in node:
                    best, size = node[None], k + 1 - at
            if best is None:
                raise ValueError("the vocabulary lacks a single byte")
            ids.append(best)
            at += size
        return ids


def encode_subwords(texts: DataFrame, vocabulary: dict[str, int], key: str = "sample_id", text: str = "combined",
                    max_len: int = K.MAX_TOKENS) -> DataFrame:
    """(key, label, input_ids, attention_mask): begin, the first ``max_len - 2`` pieces, end, padding."""
    begin, end, padding = special_ids(vocabulary)
    keep = max_len - 2
    # a word has a piece at least, so further words cannot count
    words = texts.select(key, "label", F.slice(words_of(F.col(text)), 1, keep).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary)
        for batch in batches:
            ids, masks = [], []
            for row in batch.column(2).to_pylist():
                pieces: list[int] = []
                for w in row or []:
                    pieces += trie.cut(w)
                    if len(pieces) >= keep:
                        break
                body = [begin, *pieces[:keep], end]
                ids.append(body + [padding] * (max_len - len(body)))
                masks.append([1] * len(body) + [0] * (max_len - len(body)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32()))],
                names=[key, "label", "input_ids", "attention_mask"])

    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    return words.mapInArrow(run, f"{key} {kinds[key]}, label {kinds['label']}, input_ids array<int>, attention_mask array<int>")


def piece_counts(texts: DataFrame, vocabulary: dict[str, int], text: str = "combined") -> DataFrame:
    """(piece_id, piece, cnt): how often each piece stands in the whole texts. Words are counted first, map-side combined, and each distinct
    word is cut once."""
    words = texts.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    names = {i: p for p, i in vocabulary.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counts = Trie(vocabulary), dict.fromkeys(names, 0)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in trie.cut(w):
                    counts[i] += n
        used = [i for i, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([names[i] for i in used], pa.string()),
                                          pa.array([counts[i] for i in used], pa.int64())], names=["piece_id", "piece", "cnt"])

    return words.mapInArrow(run, "piece_id int, piece string, cnt long").groupBy("piece_id", "piece").agg(F.sum("cnt").alias("cnt"))
