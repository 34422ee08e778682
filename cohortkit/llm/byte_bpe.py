"""Byte-level BPE encoding and decoding with a rank file.

A text is cut by the vocabulary's pattern; each match is encoded on its own. The distinct new matches of a
group of texts go into padded matrices, one per length bucket: a row is a match, a cell a token id. Every
round, each row merges its leftmost pair of minimum rank; ranks come from an open-addressing hash table
in numpy, only the two pairs beside a merge are looked up again, cells behind the merge move one place
to the left, and rows without a mergeable pair leave the matrix. Rows over ``LONG_ROW`` bytes (a run
without a cut) would need as many rounds as bytes; they merge in the same order with a heap instead.

Python over Arrow batches, no shuffle; a worker keeps the vocabulary (bounded by the rank file) and a
bounded cache of encoded pieces of text. All ids of a group are one flat array; both digests read the stretches
of a flat array, so no id is a Python object.

Defined cases: null text counts as empty; empty text has no ids; special tokens are ordinary text;
repeated rows are encoded alike; other columns pass through (a column named as an output is replaced,
``bpe_in`` is reserved and left out).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import binary_texts, bound_batches, emptied

LENGTH_BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 512)
LONG_ROW = LENGTH_BUCKETS[-1]
CACHE_ENTRIES = 400_000
CACHE_IDS = 8_000_000  # of the pieces in the cache
BLOCK_CELLS = 1 << 16  # of a matrix, so that it stays in a core's cache
GROUP_BYTES = 2 << 20  # of the texts that are encoded together
NO_RANK = np.int32(2**31 - 1)
SHIFT = 20  # ids stay below 2**20, so a pair is one 64-bit key

# The pattern (a fixed value) whose matches never cross from a run of other characters to blanks or line ends behind it, in
# texts without other white space; the white space below, as UTF-8, is all of that.
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ODD_SPACE = re.compile(
    rb"[\t\x0b-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def bounds_of(counts) -> np.ndarray:
    """0 and the running sums of ``counts``."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def ragged(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``values[bounds[r]:bounds[r + 1]]`` of all ``rows``, one after the other, and their bounds."""
    counts = bounds[rows + 1] - bounds[rows]
    at = bounds_of(counts)
    return values[np.repeat(bounds[rows] - at[:-1], counts) + np.arange(at[-1])], at


class PairTable:
    """Rank of a pair of ids, by linear probing over a power-of-two table."""

    def __init__(self, pairs: dict[int, int]):
        size = 1 << max(4, (2 * len(pairs)).bit_length())
        self.mask = np.int64(size - 1)
        self.bits = np.uint64(64 - (size.bit_length() - 1))
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NO_RANK, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):  # place all whose slot is free; of those that share one, the first
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(keys), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            keys, values, at = keys[~take], values[~take], (at[~take] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it does not merge; ids of -1 are padding."""
        keys = (left.astype(np.int64) << SHIFT) | right.astype(np.int64)
        out = np.full(keys.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, key = out.reshape(-1), keys.reshape(-1)
        at = self._slot(key[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == key[todo]
            flat[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.id_of = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        if max(self.bytes_of) >= 1 << SHIFT:
            raise ValueError("ids of 2**20 and above are not supported")
        every = range(max(self.bytes_of) + 1)
        self.bytes_by_id = pa.array([self.bytes_of.get(i) for i in every], pa.large_binary())
        self.decimal_by_id = pa.array([b"%d," % i if i in self.bytes_of else None for i in every], pa.large_binary())
        pairs = {}
        for token, i in self.id_of.items():
            for k in range(1, len(token)):
                a, b = self.id_of.get(token[:k]), self.id_of.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = i
        self.pairs = pairs
        self.table = PairTable(pairs)
        self.byte_ids = np.array([self.id_of[bytes([i])] for i in range(256)], np.int32)
        self.cuttable = pattern == CUTTABLE
        self._forget()

    def merge_rows(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches, one after the other, and where each one's begin (and the last one's end), by rounds
        over length-bucketed padded matrices."""
        lengths = np.fromiter(map(len, matches), np.int64, len(matches))
        known = np.fromiter((self.id_of.get(m, -1) for m in matches), np.int32, len(matches))
        whole = np.flatnonzero(known >= 0)  # a match that is a token needs no merge
        parts = [(whole, np.ones(len(whole), np.int64), known[whole])]
        buckets = np.searchsorted(np.array(LENGTH_BUCKETS), lengths)
        buckets[whole] = -1
        for b, width in enumerate(LENGTH_BUCKETS):
            rows = np.flatnonzero(buckets == b)
            for start in range(0, len(rows), step := max(1, BLOCK_CELLS // width)):
                self._merge_bucket(matches, rows[start:start + step], width, parts)
        for r in np.flatnonzero(buckets == len(LENGTH_BUCKETS)):
            ids = self._merge_long(matches[r])
            parts.append((np.array([r]), np.array([len(ids)]), ids))
        rows, counts, flat = (np.concatenate(x) for x in zip(*parts))
        return ragged(flat, bounds_of(counts), np.argsort(rows, kind="stable"))

    def _merge_bucket(self, matches, rows, width, parts) -> None:
        """Adds (rows, number of ids, ids) of finished rows to ``parts``, round by round."""
        size = np.fromiter((len(matches[r]) for r in rows), np.int64, len(rows))
        joined = b"".join([matches[r].ljust(width, b"\0") for r in rows])
        cells = np.frombuffer(joined, np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[cells], np.int32(-1))
        rank = np.full((len(rows), width), NO_RANK, np.int32)  # rank[:, j]: of cells j and j + 1
        rank[:, :-1] = self.table.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost of the minimum
            merged = rank[np.arange(len(rows)), at]
            go = merged != NO_RANK
            if not go.all():
                done = ids[~go]
                parts.append((rows[~go], size[~go], done[done >= 0]))
                rows, ids, rank, size, at, merged = rows[go], ids[go], rank[go], size[go], at[go], merged[go]
                if not len(rows):
                    break
                width = int(size.max())  # compact the columns too
                ids, rank = ids[:, :width], rank[:, :width]
            line = np.arange(len(rows))
            # a merge has a cell to its right, so the last column is always behind it
            behind = np.arange(width - 1) > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NO_RANK
            ids[line, at] = merged
            size -= 1
            right = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], np.int32(-1))
            left = np.where(at > 0, ids[line, np.maximum(at - 1, 0)], np.int32(-1))
            found = self.table.ranks(np.concatenate([merged, left]), np.concatenate([right, merged]))
            rank[line, at] = found[:len(rows)]
            inner = at > 0
            rank[line[inner], at[inner] - 1] = found[len(rows):][inner]

    def _merge_long(self, match: bytes) -> np.ndarray:
        """The same order of merges (minimum rank, then leftmost) with a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(match, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := pairs.get(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := pairs.get(r << SHIFT | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            p = before[i]
            if p >= 0 and (s := pairs.get(ids[p] << SHIFT | r)) is not None:
                heapq.heappush(heap, (s, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _starts(self, joined: bytes, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin: no match crosses from one into the next, and a piece may hold several matches. A text whose
        white space or pattern does not allow cuts is one piece."""
        if self.cuttable:
            cells = np.frombuffer(joined, np.uint8)
            blank = (cells == 32) | (cells == 10)
            starts = blank.copy()
            starts[1:] &= ~blank[:-1]
            odd = np.fromiter((m.start() for m in _ODD_SPACE.finditer(joined)), np.int64)
            for i in np.unique(np.searchsorted(bounds, odd, side="right") - 1):
                starts[bounds[i]:bounds[i + 1]] = False
        else:
            starts = np.zeros(len(joined), bool)
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(starts)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each (distinct) piece in the cache; new ones are encoded first."""
        if len(self.known) > CACHE_ENTRIES or self.used > CACHE_IDS:
            self._forget()
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            matches = [self.pattern.findall(p.decode()) for p in new]
            index: dict[str, int] = {}
            codes = np.fromiter((index.setdefault(m, len(index)) for ms in matches for m in ms), np.int64)
            flat, bounds = ragged(*self.merge_rows([m.encode() for m in index]), codes)
            ends = bounds[np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))]
            for p in new:
                known[p] = len(known)
            self.stored.append(flat)
            self.ends.append(self.used + ends)
            self.used += len(flat)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.stored, self.ends, self.used = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each one's begin (and the last one's end)."""
        bounds = bounds_of([len(t) for t in texts])
        joined = b"".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        starts = self._starts(joined, bounds)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(joined))), pa.py_buffer(joined)]).dictionary_encode()
        numbers = self._numbers(pieces.dictionary.to_pylist())
        self.stored, self.ends = [np.concatenate(self.stored)], [np.concatenate(self.ends)]
        flat, at = ragged(self.stored[0], self.ends[0], numbers[pieces.indices.to_numpy()])
        return flat, at[np.searchsorted(starts, bounds)]

    def written(self, words: pa.Array, ids: np.ndarray | pa.Array, bounds: np.ndarray) -> list[memoryview]:
        """Per text the concatenation of what ``words`` holds for its ids."""
        found = words.take(pa.array(ids))
        if found.null_count:
            raise ValueError("an id that the vocabulary does not have")
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64, len(found) + 1)[bounds]
        view = memoryview(data) if data is not None else memoryview(b"")
        return [view[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_LOADED: dict[tuple[bytes, str], ByteBpe] = {}


def _loaded(ranks: bytes, pattern: str) -> ByteBpe:
    """One vocabulary per worker process."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(ranks, pattern)
    return _LOADED[key]


def _rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, column: str, added: list[T.StructField], make) -> DataFrame:
    """``df`` without ``column``, with the columns that ``make`` builds from a list of its values."""
    bound_batches(df.sparkSession)
    names = [f.name for f in added]
    rest = [f for f in df.schema.fields if f.name not in (column, "bpe_in", *names)]
    df = df.select(F.col(f"`{column}`").alias("bpe_in"), *[F.col(f"`{f.name}`") for f in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            values = batch.column(batch.schema.get_field_index("bpe_in"))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays(cols + make(values), names=[f.name for f in rest] + names)

    return df.mapInArrow(run, T.StructType(rest + added))


def _in_groups(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Consecutive texts of at most ``GROUP_BYTES`` together, or one longer text; null counts as empty."""
    group, size = [], 0
    for t in texts:
        t = t or b""
        if group and size + len(t) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with the column ``ids`` (array of int) in place of ``text``."""
    ranks = _rank_file(path)

    def make(column: pa.Array) -> list[pa.Array]:
        found = [_loaded(ranks, pattern).encode(g) for g in _in_groups(binary_texts(column))]
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)) for ids, at in found]
        return [pa.concat_arrays(lists)]

    return _mapped(df, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded`` (bytes) in place of ``ids``; null ids count as none."""
    ranks = _rank_file(path)

    def make(column: pa.Array) -> list[pa.Array]:
        bpe = _loaded(ranks, pattern)
        bounds = bounds_of(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        return [pa.array([v.tobytes() for v in bpe.written(bpe.bytes_by_id, pc.list_flatten(column), bounds)], pa.binary())]

    return _mapped(df, ids, [T.StructField("decoded", T.BinaryType())], make)


def bpe_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of ``text``: encoding and decoding in
    one pass, so that the ids stay in the worker."""
    ranks = _rank_file(path)

    def make(column: pa.Array) -> list[pa.Array]:
        bpe = _loaded(ranks, pattern)
        n, of_ids, of_bytes = [], [], []
        for group in _in_groups(binary_texts(column)):
            ids, bounds = bpe.encode(group)
            n += np.diff(bounds).tolist()
            of_ids += [hashlib.sha256(v[:-1]).hexdigest() for v in bpe.written(bpe.decimal_by_id, ids, bounds)]  # without the last comma
            of_bytes += [hashlib.sha256(v).hexdigest() for v in bpe.written(bpe.bytes_by_id, ids, bounds)]
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
             T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, text, added, make)
