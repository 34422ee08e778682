"""Scoring texts by a hierarchical Pitman-Yor language model.

Tokens are words (A-Z lower-cased) and one end per text. The context of a token is the token before it. Every context has a restaurant,
and all restaurants share one parent, whose base measure is diffuse:

    P(w | u) = (c_uw - d1 t_uw + (theta1 + d1 T_u) P(w)) / (theta1 + c_u)
    P(w) = (S_w - d0) / (theta0 + S),  P(a new word) = (theta0 + d0 V) / (theta0 + S)

c counts customers (training tokens), t tables; the tables of a word in all restaurants are its S_w customers in the parent, where the
diffuse base gives each word one table. The probabilities of the V known words and of "a new word" sum to one in each context. Every word is a
context with a restaurant of its own, and so is the beginning of a text. Words that make up a share of at least 1 / ``CONTEXTS`` of the training tokens, so at
most ``CONTEXTS``, have numbers as contexts, and what they need is kept by the driver; all others are told by the hash of the word, and their customers and tables meet by
shuffles. (:func:`fit` can pool these others in one restaurant, if it is asked to.)

Seating is sampled by Gibbs: in a sweep every customer of each word in each restaurant, one after another, leaves its table and is
seated anew given all others, at a table by its customers less d1, or at a new one by (theta1 + d1 T_u) P(w). A chain begins at the expected
number of tables, and a pass goes on with the seating that the one before left. Words are dealt out with their customers in all contexts, so S_w is current at every move;
T_u and S, which all tasks make up, and the S_w of words of a large share are those of the pass before, as in distributed collapsed samplers. ``PASSES`` passes run ``SWEEPS`` sweeps
each; the last ``SAMPLES`` sweeps of the last one are stored, and predictive probabilities are averaged over them. Random numbers are hashes of word, context, customer and move: the same in any
task and attempt. A task holds the customers of one word and context (of one word, if it is of no large share) as an array; their moves run in sequence by their nature. Discounts
are n1 / (n1 + 2 n2) of customers and of tables; the concentrations are parameters. One customer alone has one table and never moves, so pairs of one customer in
a rare word's restaurant are only counted while the others move.

Plan: words are counted per task in numpy, then by key (pass 0), and so are pairs of context and word (pass 1), so copies and frequent pairs cost
one row per task. A word of a large share is spread over a row per numbered context and ``SPREAD`` rows for the others, with its S_w kept by the driver like the T_u of numbers (at most
``CONTEXTS`` numbers per sample). For scoring, texts are not joined token by token: a flush of texts asks once for each of its words (customers, S_w, T_u) and once for each of
its pairs (customers, tables), by bucket of the key; the answers meet the flush's list of pairs and texts. Texts are scored in up to ``ROUNDS`` rounds by a hash of their
id, each in full, and the shuffle files of a round are removed after it.

Defined cases: a null text counts as empty and has its end alone; repeated rows count each; without training texts every token is "a new
word" of probability 1; a null id stays null; an empty table gives no rows; other columns are not read, so their names cannot
clash. A text is hashed in pieces; one text's pairs are held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import binary_texts, bound_batches, emptied, stored
from cohortkit.llm.hashing import BASE, mix, mixed, word_hashes

CONTEXTS = 8192  # at most so many words have numbers
SPREAD = 256  # rows of a frequent word for its own contexts
ROUNDS = 6  # of texts at most, of which one at a time asks for its figures, so that the disk need not hold all questions at once
ROW_PAIRS = 1 << 18  # in a batch of rows, about
FLUSH_TOKENS = 1_000_000
BUCKET_TOKENS = 4_000_000
BLOCK_CUSTOMERS = 1 << 17  # that are moved together
PASSES, SWEEPS, SAMPLES, MOVES = 2, 5, 3, 1
THETA_ROOT, THETA = 1.0, 1.0
SMOOTH = 0.1  # of the base score
START, RARE, FIRST = 0, 1, 2  # context numbers: of a text's beginning, of pooled rare words, of the first frequent word
OWN = np.uint64(1 << 63)  # set in a rare word's hash that stands for the word as a context, so as a whole number it is negative
END = np.uint64(0x9E6D62D06F6A3C51)  # the end of a text, as a word's hash
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
POSTING = "flush long, bucket int, kind int, blob binary"


# --- tokens ---

def flushes(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(batches, sizes, words) of about ``tokens`` tokens; the last column is the text, ``sizes`` has tokens per text."""
    held, sizes, words, n = [], [], [], 0
    for batch in emptied(batches):
        for first in range(0, batch.num_rows, 256):
            piece = batch.slice(first, 256)
            for t in binary_texts(piece.column(piece.num_columns - 1)):
                found = word_hashes(t.lower()) if t else np.empty(0, np.uint64)
                words += [found, np.array([END])]
                sizes.append(len(found) + 1)
                n += sizes[-1]
            held.append(piece.select(range(piece.num_columns - 1)) if piece.num_columns > 1 else piece)
            if n >= tokens:
                yield held, np.array(sizes), np.concatenate(words)
                held, sizes, words, n = [], [], [], 0
    if sizes:
        yield held, np.array(sizes), np.concatenate(words)


def context_numbers(words: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, own: bool = False) -> np.ndarray:
    """The context of each token: a number, or the negative one of a rare word, if these are not pooled."""
    before = np.concatenate([words[:1], words[:-1]])
    out = own_context(before) if own else np.full(len(words), RARE, np.int64)
    at, known = find(before, frequent)
    out[known] = at[known] + FIRST
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = START
    return out


def own_context(words: np.ndarray) -> np.ndarray:
    return (words | OWN).view(np.int64)


def find(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of values in a sorted array."""
    if not len(among):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values in all (sorted) columns begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def counted(words: np.ndarray, ctx: np.ndarray, doc: np.ndarray, n_ctx: int, n_doc: int) -> tuple[np.ndarray, ...]:
    """Distinct (word, context, text) in order and how often each occurs; contexts and texts are numbers below ``n_ctx`` and ``n_doc``. Sorted
    as one number, which a flush keeps far below 2**63."""
    among, of = np.unique(words, return_inverse=True)
    key = np.sort((of * n_ctx + ctx) * n_doc + doc)
    first = runs(key)
    n = np.diff(np.append(first, len(key)))
    key, doc = np.divmod(key[first], n_doc)
    of, ctx = np.divmod(key, n_ctx)
    return among[of], ctx, doc, n


def counted_in(words: np.ndarray, ctx: np.ndarray, doc: np.ndarray, n_doc: int) -> tuple[np.ndarray, ...]:
    """:func:`counted` with contexts of any numbers."""
    among, of = np.unique(ctx, return_inverse=True)
    w, c, d, n = counted(words, of, doc, len(among), n_doc)
    return w, among[c], d, n


def spreads(words: np.ndarray, ctx: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The row of a word that holds a context: one for a word of no large share, else one per numbered context and ``SPREAD`` for the others."""
    at = np.where(ctx < 0, FIRST + len(frequent) + ctx % SPREAD, ctx)
    return np.where(find(words, frequent)[1], at + 1, 0)


# --- blobs ---

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in as few bytes as their largest needs, others as they are, by byte of the numbers; hashes in order as differences."""
    out = []
    for a in arrays:
        if a.dtype == np.int64:
            a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        kind = a.dtype.str
        if a.dtype == np.uint64 and (a[1:] >= a[:-1]).all():
            a, kind = np.diff(a, prepend=np.uint64(0)), kind + "d"
        out.append(len(a).to_bytes(8, "little") + kind.encode().ljust(4) + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, out, at = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), [], 0
    while at < len(raw):
        n, name = int.from_bytes(raw[at:at + 8], "little"), raw[at + 8:at + 12].strip().decode()
        kind = np.dtype(name.removesuffix("d"))
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(np.cumsum(a, dtype=kind) if name.endswith("d") else a)
        at += 12 + n * kind.itemsize
    return out


def shares(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in order), for buckets that have keys: ranges of keys, which are mixed."""
    by = np.argsort(keys, kind="stable")
    cuts = np.searchsorted((keys[by] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), by[cuts[b]:cuts[b + 1]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["flush", "bucket", "kind", "blob"])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def kept(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored`; the shuffle files that led to it are removed, as nothing else reads them."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        return stored(df, name)
    finally:
        spark.conf.set(cleanup, was)


# --- the fit ---

@dataclass
class Model:
    """What tasks need of the fit besides the words' own rows; sizes are bounded by ``CONTEXTS``."""
    tokens: int = 0  # N
    words: int = 0  # V
    frequent: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    frequent_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    customers: np.ndarray | None = None  # c_u
    discounts: tuple[float, float] = (0.5, 0.5)  # d0, d1
    tables: np.ndarray | None = None  # samples x contexts: T_u
    shared: np.ndarray | None = None  # samples x frequent words: S_w
    thetas: tuple[float, float] = (THETA_ROOT, THETA)
    own: bool = False  # whether rare words have restaurants of their own,
    other: np.ndarray | None = None  # with so many tables in all, per sample
    rest: tuple[DataFrame, DataFrame] | None = None  # these restaurants, and the pairs of one customer in them: as large as the input, so not sent to tasks

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def root_total(self) -> np.ndarray:
        return self.tables.sum(axis=1) + (0 if self.other is None else self.other)

    def new_word(self) -> np.ndarray:
        """P(a new word) per sample."""
        total = self.thetas[0] + self.root_total()
        return (self.thetas[0] + self.discounts[0] * self.words) / total if self.words else np.ones(len(total))

    def root(self, s: np.ndarray) -> np.ndarray:
        """P(w) of words with ``s`` customers (samples x words) in the parent."""
        return (s - self.discounts[0]) / (self.thetas[0] + self.root_total())[:, None]

    def back_off(self, ctx: np.ndarray) -> np.ndarray:
        """What a restaurant of a number leaves to its parent (samples x contexts)."""
        return self.left(self.customers[ctx], self.tables[:, ctx])

    def left(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What restaurants of ``c`` customers and ``t`` tables (samples x restaurants) leave to their parent."""
        return (self.thetas[1] + self.discounts[1] * t) / (self.thetas[1] + c)

    def base(self, n: np.ndarray) -> np.ndarray:
        """log10 of the base probability of words with ``n`` training tokens."""
        return np.log10((n + SMOOTH) / (self.tokens + SMOOTH * (self.words + 1)))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words in flushes(batches, FLUSH_TOKENS):
            w, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(w)), pa.array(n, pa.int64())], names=["word", "n"])

    return train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def seats(train: DataFrame, frequent: np.ndarray, own: bool, buckets: int) -> DataFrame:
    """(word, spread, ctx, n, alone, single): each word with its contexts and its customers there, a frequent word in several rows. Rare
    words' own contexts where it has one customer are in ``single``, ``alone`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (_, sizes, words) in enumerate(flushes(batches, FLUSH_TOKENS)):
            w, c, _, n = counted_in(words, context_numbers(words, sizes, frequent, own), np.zeros(len(words), np.int64), 1)
            for b, at in shares(word_key(w, spreads(w, c, frequent)), buckets):
                first = runs(w[at])
                yield _batch([((TaskContext.get().partitionId() << 32) + number, b, 0, pack(w[at[first]], np.diff(np.append(first, len(at))), _unsigned(c[at]), n[at]))])

    def rows(blobs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word = np.concatenate([np.repeat(w, per) for w, per, _, _ in blobs])
        ctx, n = np.concatenate([c for _, _, c, _ in blobs]).view(np.int64), np.concatenate([x for *_, x in blobs]).astype(np.int64)
        key = word_key(word, spreads(word, ctx, frequent))
        by = np.lexsort((ctx, key))
        key, ctx = key[by], ctx[by]
        first = runs(key, ctx)
        n, key, ctx, word = np.add.reduceat(n[by], first), key[first], ctx[first], word[by[first]]
        single = (ctx < 0) & (n == 1)
        start = runs(key)
        cuts = start[np.unique(np.searchsorted(start, np.arange(0, len(key), ROW_PAIRS)).clip(max=len(start) - 1))]  # whole rows
        for low, high in zip(cuts, np.append(cuts[1:], len(key))):
            at = start[(start >= low) & (start < high)]
            of = np.repeat(np.arange(len(at)), np.diff(np.append(at, high)))
            some, few = ~single[low:high], single[low:high]
            lists = [(x[low:high][mask], np.bincount(of[mask], minlength=len(at))) for x, mask in ((ctx, some), (n, some), (ctx, few))]
            made = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(x, pa.int64())) for x, k in lists]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(word[at])), pa.array(spreads(word[at], ctx[at], frequent), pa.int32()), *made[:2],
                                              pa.array(lists[2][1], pa.int64()), made[2]], names=["word", "spread", "ctx", "n", "alone", "single"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in emptied(batches):
            for _, bucket, _, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != current and blobs:
                    yield from rows(blobs)
                    blobs = []
                current = bucket
                blobs.append(unpack(blob))
        if blobs:
            yield from rows(blobs)

    pairs = train.select("text").mapInArrow(run, POSTING).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "flush")
    return pairs.mapInArrow(gather, "word long, spread int, ctx array<long>, n array<long>, alone long, single array<long>")


class Seats:
    """The rows of a batch of :func:`seats` as arrays by pair of word and context (those of ``alone`` are no pairs here)."""

    def __init__(self, batch: pa.RecordBatch, frequent: np.ndarray):
        self.word = batch.column(0).to_numpy().view(np.uint64)
        self.spread = batch.column(1).to_numpy()
        lengths = batch.column(2).value_lengths().to_numpy()
        self.of = np.repeat(np.arange(len(self.word)), lengths)
        self.ctx = batch.column(2).flatten().to_numpy().astype(np.int64)
        self.n = batch.column(3).flatten().to_numpy().astype(np.int64)
        self.key = word_key(self.word, self.spread)
        self.pair = pair_key(self.key[self.of], self.ctx)
        self.place, self.hot = find(self.word, frequent)

        def more(name: str) -> np.ndarray | None:
            if name not in batch.schema.names:
                return None
            column = batch.column(name)
            return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy().astype(np.int64)

        alone = more("alone")
        self.alone = np.zeros(len(self.word), np.int64) if alone is None else alone
        tables = more("tables")
        self.tables = None if tables is None else tables.reshape(len(self.n), -1).T  # samples x pairs
        self.seating = more("seating")  # customers of each table of pairs with several customers, one pair after another
        self.own = np.zeros(len(self.n), np.int64)  # T_u of own contexts of such pairs
        if (own := more("own")) is not None:
            self.own[(self.ctx < 0) & (self.n > 1)] = own

    def per_word(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, t, len(self.word)) + self.alone


def own_key(ctx: np.ndarray) -> np.ndarray:
    """The key of words by their numbers as contexts of their own."""
    return mix(_unsigned(ctx))


def word_key(word: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return mix(word * BASE + spread.astype(np.uint64))


def pair_key(key: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(key * BASE + ctx.astype(np.uint64) + np.uint64(1))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number in [0, 1) per key and draw."""
    x = mixed(keys + np.uint64(draw * int(GOLDEN) % (1 << 64)))
    x >>= np.uint64(11)
    out = x.astype(float)
    out *= 2.0 ** -53
    return out


def expected_tables(c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """Tables of ``c`` customers where a new one opens with weight ``new``, about as many as expected."""
    t, n = np.ones(len(c)), np.ones(len(c))
    while (left := n < c).any():
        to = np.minimum(c, np.maximum(n + 1, np.floor(n * 1.2)))
        t = np.where(left, t + (to - n) * new / (n - d * t + new), t)
        n = to
    return np.clip(np.rint(t), 1, c).astype(np.int64)


def seated(c: np.ndarray, tables: np.ndarray, first: np.ndarray) -> np.ndarray:
    """An arbitrary seating of ``c`` customers at ``tables`` tables, of sizes like 1, 1/2, 1/3, ...: the place of a member of each
    customer's table. ``first``: the place of each pair's first customer."""
    start = np.cumsum(tables) - tables
    slot = np.arange(int(tables.sum())) - np.repeat(start, tables)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, tables.max() + 1))])
    size = 1 + np.floor(np.repeat((c - tables) / harmonic[tables], tables) / (slot + 1)).astype(np.int64)
    size[start] += c - np.add.reduceat(size, start)
    return np.repeat(np.repeat(first - (np.cumsum(size) - size)[start], tables) + np.cumsum(size) - size, size)


@dataclass
class Customers:
    """All customers of some pairs, each pair's in a row and the pairs of a word one after another. What a customer needs is made for a block at a time."""
    c: np.ndarray  # per pair: customers,
    word: np.ndarray  # the word's number,
    mine: np.ndarray  # theta1 + d1 T_u
    key: np.ndarray  # and the pair's key of the random numbers

    def __post_init__(self):
        self.first = np.cumsum(self.c) - self.c
        self.only = None

    def block(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        """(customer, pair, first and number of the others, word, key) of customers; kept for the next sweep if these are all."""
        if self.only is None:
            p, q = np.searchsorted(self.first, [low, high - 1], side="right") - [1, 0]
            size = np.minimum(self.first[p:q] + self.c[p:q], high) - np.maximum(self.first[p:q], low)
            me, pair = np.arange(low, high), np.repeat(np.arange(p, q), size)
            start = self.first[pair]
            out = me, pair, start, (self.c - 1)[pair], self.word[pair], mix(self.key[pair] + (me - start).astype(np.uint64) * BASE)
            if high - low < self.first[-1] + self.c[-1]:
                return out
            self.only = out
        return self.only


def sweep(held: Customers, table: np.ndarray, parent: np.ndarray, fixed: np.ndarray, total: float, d0: float, d1: float, draw: int) -> np.ndarray:
    """Every customer once, in order, leaves its table and is seated anew given where all others sit then. ``table``: the place of a member
    of each customer's table, before; returned: after. ``parent`` (by word): its tables before, which follow the moves unless ``fixed``.

    Customers move in blocks of ``BLOCK_CUSTOMERS``: what is kept of each is its table, whether it is the last that sat there before and the first
    that sits there now, and these two per table; all else is held for one block.
    """
    n = len(table)
    last_old, first_new = np.full(2 * n, -1, table.dtype), np.full(2 * n, n, table.dtype)
    every = np.arange(n, dtype=table.dtype)
    last_old[table] = every  # numpy keeps the last of equal places
    last, first = last_old.take(table) == every, np.zeros(n, bool)
    del every
    table, parent = table.copy(), parent.astype(float)
    for low in range(0, n, BLOCK_CUSTOMERS):
        _move(held, low, min(n, low + BLOCK_CUSTOMERS), table, last_old, first_new, last, first, parent, fixed, total, d0, d1, draw)
    return first_new.take(table)


def _move(held: Customers, low: int, high: int, table: np.ndarray, last_old: np.ndarray, first_new: np.ndarray, last: np.ndarray, first: np.ndarray,
          parent: np.ndarray, fixed: np.ndarray, total: float, d0: float, d1: float, draw: int) -> None:
    """The moves of a block of customers; ``table``, ``first_new``, ``first`` and ``parent`` follow.

    A customer opens a table by its weight, else draws another customer and joins that one's table; one customer per table, its head (the last that has not
    moved yet, else the first that has), is refused by the discount, and the draw repeated, so a table counts its customers less d1. A drawn customer's table is found by following draws
    back. What a move depends on besides its draws is the moves before it: all moves are made from a guess of these, and again
    from what that gave, until nothing changes; then each is the move that one after the other would give. Words that no longer change are done.
    """
    n = len(table)
    me, pair, start, others, word, keys = held.block(low, high)
    whole = start[0] == low  # no pair has moved in part
    followed = not fixed[word[np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])]].all()  # a parent follows

    def share(mine: np.ndarray, tables: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The chance of a new table."""
        weight = mine * np.maximum(tables - d0, 1 - d0) / total
        return weight / (others + weight)

    chance = uniform(keys, draw)
    other = start + (uniform(keys, draw + 1) * others).astype(np.int64)
    other += other >= me
    pairs = slice(pair[0], pair[-1] + 1)
    as_before = chance < share(held.mine[pairs], parent[held.word[pairs]], held.c[pairs] - 1).take(pair - pair[0])  # opens if the parent stays as it is
    back = other < me
    ahead = last.take(other) & ~back  # draws a head that has not moved yet
    now = np.empty(high - low, table.dtype)
    leaving = np.flatnonzero(last[low:high])  # nobody sits there that has not moved yet
    opens, src = as_before, other  # the guess: nobody is refused
    while True:
        inside = np.flatnonzero((src < me) & (src >= low) & ~opens)
        seat = table.take(src).astype(np.int64)
        made = np.flatnonzero(opens)
        seat[made] = n + me[made]
        to = np.arange(len(me))
        to[inside] += src[inside] - me[inside]
        left = inside
        while len(left):
            here = to.take(left)
            further = to.take(here)
            moved = further != here
            left = left[moved]
            to[left] = further[moved]
        seat[inside] = seat.take(to.take(inside))
        now[me - low] = seat
        if whole:
            fresh = slice(None)
            first_new[seat[::-1]] = me[::-1]
        else:
            fresh = np.flatnonzero(first_new.take(seat) >= low)
            first_new[seat[fresh][::-1]] = me[fresh][::-1]
        first[me] = first_new.take(seat) == me
        gone = first_new.take(table.take(me[leaving])) >= me[leaving]
        change = opens.astype(np.int64)
        change[leaving] -= gone
        if followed:
            before = np.cumsum(change) - change
            new = runs(word)
            tables = before - np.repeat(before[new], np.diff(np.append(new, len(me))))
            tables[fixed[word]] = 0
        else:
            tables = np.zeros(len(me), np.int64)
        tables[leaving] -= gone

        def share_now(of: np.ndarray) -> np.ndarray:
            return share(held.mine[pair[of]], parent[word[of]] + tables[of], others[of])

        opens_now, src_now = as_before.copy(), other.copy()
        changed = np.flatnonzero(tables)
        opens_now[changed] = chance[changed] < share_now(changed)

        def heads(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.where(j > i, last.take(j), first.take(j))
            at = np.flatnonzero(out & (j < i))
            i, j = i.take(at), j.take(at)
            where = np.where(j >= low, now.take(j - low, mode="clip"), table.take(j))
            out[at] = last_old.take(where) <= i
            return np.flatnonzero(out)

        again, turn = np.flatnonzero((ahead | (back & first.take(other))) & ~opens_now), draw + 2
        again = again.take(heads(me.take(again), other.take(again)))
        them = again, me.take(again), keys.take(again), start.take(again), others.take(again), share_now(again)
        while len(them[0]):
            refused = np.flatnonzero(uniform(them[2], turn) < d1)
            again, i, drawn, begin, number, chance_now = them = tuple(x.take(refused) for x in them)
            made = uniform(drawn, turn + 1) < chance_now
            j = (uniform(drawn, turn + 2) * number).astype(np.int64) + begin
            j += j >= i
            opens_now[again], src_now[again] = made, j
            joins = np.flatnonzero(~made)
            at, turn = joins.take(heads(i.take(joins), j.take(joins))), turn + 3
            them = tuple(x.take(at) for x in them)
        differs = (opens_now != opens) | ((src_now != src) & ~opens_now)
        keep = np.zeros(len(parent), bool)
        keep[word[differs]] = True
        open_ = keep.take(word)
        going = np.count_nonzero(open_)
        if 0 < len(me) - going < len(me) // 4:  # few are done: they stay, with the same moves again
            open_[:], going = True, len(me)
        done = np.flatnonzero(~open_)
        table[me[done]] = seat[done]
        if followed:
            parent += np.where(fixed, 0, np.bincount(word[done], change[done], len(parent)))
        if not going:
            return
        opens, src = opens_now, src_now
        again_fresh = np.zeros(len(me), bool)
        again_fresh[fresh] = True
        first_new[seat[again_fresh & open_]] = n
        if len(done):
            at = np.flatnonzero(open_)
            me, pair, start, others, word, keys, chance, other, as_before, back, ahead, opens, src = (
                x.take(at) for x in (me, pair, start, others, word, keys, chance, other, as_before, back, ahead, opens, src))
            leaving = np.flatnonzero(last.take(me))


def gibbs(s: Seats, model: Model, run: int, sweeps: int = SWEEPS, moves: int = MOVES, ends: list | None = None) -> Iterator[np.ndarray]:
    """The tables of each pair after every sweep; each customer moves ``moves`` times in one. The model has one sample, that of the pass before,
    whose seating the chain goes on with, if it is known. ``ends`` gets the last seating: the customers of each table."""
    (d0, d1), (_, theta) = model.discounts, model.thetas
    total = model.thetas[0] + model.root_total()[0]
    out = np.ones((sweeps, len(s.n)), np.int64)
    alone_all = np.bincount(s.of[s.n == 1], minlength=len(s.word)) + s.alone
    several, last = np.flatnonzero(s.n > 1), []
    if s.seating is not None:
        sits = several[np.searchsorted(np.cumsum(s.n[several]), np.cumsum(s.seating))]  # the pair of each table
    groups = []  # whole words, those of a fixed parent apart; one customer has one table
    for many in (np.flatnonzero((s.n > 1) & (s.hot[s.of] == kind)) for kind in (False, True)):
        words = np.concatenate([[0], np.cumsum(np.bincount(s.of[many], s.n[many], len(s.word)))])
        cuts = np.unique(np.searchsorted(words, np.arange(0, words[-1], BLOCK_CUSTOMERS), side="left"))
        groups += [(many, low, high) for low, high in zip(cuts, np.append(cuts[1:], len(s.word)))]
    for many, low, high in groups:
        pairs = many[np.searchsorted(s.of[many], low):np.searchsorted(s.of[many], high)]
        if not len(pairs):
            continue
        c, ctx = s.n[pairs], s.ctx[pairs]
        word, hot = s.of[pairs] - low, s.hot[low:high]
        alone = alone_all[low:high]
        shared = model.shared[0][s.place[low:high]] if len(model.shared[0]) else np.zeros(high - low)
        mine = theta + d1 * np.where(ctx < 0, s.own[pairs], model.tables[0][np.maximum(ctx, 0)])

        def in_parent(tables: np.ndarray) -> np.ndarray:
            return np.where(hot, shared, alone + np.bincount(word, tables, high - low))

        first = np.cumsum(c) - c
        if s.seating is None:
            tables = expected_tables(c, mine * np.maximum(in_parent(np.ones(len(c)))[word] - d0, 1 - d0) / total, d1)
            table = seated(c, tables, first)
        else:
            here = np.zeros(len(s.n), bool)
            here[pairs] = True
            size = s.seating[here[sits]]
            tables = np.bincount(sits[here[sits]], minlength=len(s.n))[pairs]
            table = np.repeat(np.cumsum(size) - size, size)
        held, table = Customers(c, word, mine, s.pair[pairs]), table.astype(np.int32 if len(table) < 1 << 30 else np.int64)
        for k in range(sweeps):
            for m in range(moves):
                table = sweep(held, table, in_parent(tables), hot, total, d0, d1, ((run * sweeps + k) * moves + m) << 16)
                tables = np.add.reduceat(table == np.arange(len(table), dtype=table.dtype), first, dtype=np.int64)
            out[k, pairs] = tables
        if ends is not None:
            size = np.bincount(table)
            last.append((np.repeat(pairs, tables), size[size > 0]))
    if ends is not None and last:
        of, size = (np.concatenate(x) for x in zip(*last))
        ends.append(size[np.argsort(of, kind="stable")])
    yield from out


def sampled(s: Seats, model: Model, run: int, samples: int) -> np.ndarray:
    """Tables (samples x pairs) of the last sweeps."""
    return np.array(list(gibbs(s, model, run))[-samples:])


def with_tables(table: DataFrame, model: Model, run_number: int, samples: int, last: bool) -> DataFrame:
    """:func:`seats` with the tables of the last sweeps of a pass, a pair's samples in a row, and what the pass began with; if it is not
    the last one, with its last seating instead."""
    began = [c for c in ("own", "seating") if c in table.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            s, ends = Seats(batch, model.frequent), []
            t = np.array(list(gibbs(s, model, run_number, ends=None if last else ends))[-samples:])
            counts = [len(s.word), *([] if last else [0])]
            lists = [(np.bincount(s.of, minlength=counts[0]) * samples, t.T.reshape(-1))]
            if not last:
                in_row = np.bincount(s.of, np.where(s.n > 1, t[-1], 0), counts[0]).astype(np.int64)
                lists.append((in_row, ends[0] if ends else np.empty(0, np.int64)))
            made = [pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int64()), pa.array(x, pa.int64())) for n, x in lists]
            kept = [batch.column(c) for c in columns[:len(columns) - len(made)]]
            yield pa.RecordBatch.from_arrays([*kept, *(x.cast(pa.list_(pa.int64())) for x in made)], names=columns)

    columns = ["word", "spread", "ctx", "n", "alone", *(began if last else []), "tables", *([] if last else ["seating"])]
    kinds = {"word": "long", "spread": "int", "alone": "long"}
    return table.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'array<long>')}" for c in columns))


def own_contexts(single: DataFrame, table: DataFrame, samples: int) -> DataFrame:
    """(ctx, t0, t1, ...): the tables T_u of rare words' restaurants per sample, those of the pairs that :func:`alone_in` counts and of all others."""
    names = [f"t{k}" for k in range(samples)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            s = Seats(batch, np.empty(0, np.uint64))
            at = np.flatnonzero(s.ctx < 0)
            among, of = np.unique(s.ctx[at], return_inverse=True)
            t = [np.ones(len(at)) if s.tables is None else s.tables[k][at] for k in range(samples)]
            yield pa.RecordBatch.from_arrays([pa.array(among), *(pa.array(np.bincount(of, x, len(among)).astype(np.int64)) for x in t)], names=["ctx", *names])

    several = table.mapInArrow(run, ", ".join(["ctx long", *(f"{x} long" for x in names)]))
    both = several.unionByName(single.select("ctx", *[F.col("n").alias(x) for x in names]))
    return both.groupBy("ctx").agg(*[F.sum(x).alias(x) for x in names])


def alone_in(table: DataFrame) -> DataFrame:
    """(ctx, n): the words that have one customer in a rare word's restaurant."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            among, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(among, pa.int64()), pa.array(n, pa.int64())], names=["ctx", "n"])

    return table.select("single").mapInArrow(run, "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("n"))


def with_own(table: DataFrame, contexts: DataFrame) -> DataFrame:
    """``table`` with T_u of rare words' restaurants (``t0`` of ``contexts``) for the pairs that move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            s = Seats(batch, np.empty(0, np.uint64))
            at = np.flatnonzero((s.ctx < 0) & (s.n > 1))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(s.word[s.of[at]])), pa.array(s.spread[s.of[at]]), pa.array(s.ctx[at])], names=["word", "spread", "ctx"])

    asked = table.mapInArrow(run, "word long, spread int, ctx long")
    found = asked.join(contexts.select("ctx", "t0"), "ctx").groupBy("word", "spread").agg(F.sort_array(F.collect_list(F.struct("ctx", "t0"))).alias("own"))
    return table.drop("single").join(found.select("word", "spread", F.transform("own", lambda x: x["t0"]).alias("own")), ["word", "spread"], "left")


def totals(table: DataFrame, n_ctx: int, frequent: np.ndarray, tables_of, samples: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(T_u, S_w of frequent words, counts) per sample: ``tables_of`` gives the tables of the rows of a batch. Rows by numbered contexts, not
    words; ``counts["other"]`` has the tables in all other contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_ctx, by_word = np.zeros((samples, n_ctx), np.int64), np.zeros((samples, len(frequent)), np.int64)
        customers, ones, other = np.zeros(n_ctx, np.int64), np.zeros(4, np.int64), np.zeros(samples, np.int64)
        for batch in emptied(batches):
            s = Seats(batch, frequent)
            at = np.flatnonzero(s.ctx >= 0)
            customers += np.bincount(s.ctx[at], s.n[at], n_ctx).astype(np.int64)
            ones[:2] += [(s.n == 1).sum() + s.alone.sum(), (s.n == 2).sum()]
            for k, t in enumerate(tables_of(s)):
                by_ctx[k] += np.bincount(s.ctx[at], t[at], n_ctx).astype(np.int64)
                other[k] += t[s.ctx < 0].sum() + s.alone.sum()
                have = s.per_word(t)
                by_word[k] += np.bincount(s.place[s.hot], have[s.hot], len(frequent)).astype(np.int64)
                if k == samples - 1:
                    ones[2:] += [(have[~s.hot] == j).sum() for j in (1, 2)]
        parts = [(0, by_ctx.reshape(-1)), (1, by_word.reshape(-1)), (2, customers), (3, ones), (4, other)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(x), k) for k, x in parts]), pa.int32()),
             pa.array(np.concatenate([np.arange(len(x)) for _, x in parts]), pa.int64()),
             pa.array(np.concatenate([x for _, x in parts]), pa.int64())], names=["kind", "at", "n"])

    out = {0: np.zeros(samples * n_ctx, np.int64), 1: np.zeros(samples * len(frequent), np.int64), 2: np.zeros(n_ctx, np.int64), 3: np.zeros(4, np.int64), 4: np.zeros(samples, np.int64)}
    for r in table.mapInArrow(run, "kind int, at long, n long").where("n <> 0").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        out[r["kind"]][r["at"]] = r["n"]
    return out[0].reshape(samples, -1), out[1].reshape(samples, -1), {"customers": out[2], "ones": out[3], "other": out[4]}


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


def buckets_of(docs: DataFrame, tokens: int) -> int:
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // BUCKET_TOKENS))


def fit(train: DataFrame, contexts: int | None = None, passes: int = PASSES, samples: int = SAMPLES) -> tuple[Model, Model, DataFrame]:
    """(the fit, the state that its last pass began with, the words' seats and tables) from ``text`` of ``train``. Every word is a context; if
    ``contexts`` is given, words of a share below 1 / ``contexts`` share a restaurant instead."""
    own, most = contexts is None, contexts or CONTEXTS
    words = kept(word_counts(train), "pitman-yor-words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = sorted((r["word"] % (1 << 64), r["n"]) for r in words.where(F.col("n") * most >= n).collect())  # at most ``most``
    frequent, counts = np.array([w for w, _ in often], np.uint64), np.array([c for _, c in often], np.int64)
    all_seats = table = kept(seats(train, frequent, own, buckets_of(train, n)), "pitman-yor-seats")
    single = kept(alone_in(table), "pitman-yor-single") if own else None
    n_ctx = FIRST + len(often)
    # the first state: a table for every word in every context
    tables, shared, first = totals(table, n_ctx, frequent, lambda s: [np.ones(len(s.n), np.int64)], 1)
    ones = first["ones"]
    discounts = (_discount(int(ones[2]), int(ones[3])), _discount(int(ones[0]), int(ones[1])))
    model = Model(n, v, frequent, counts, first["customers"], discounts, tables, shared, own=own, other=first["other"])
    restaurants = kept(own_contexts(single, table, 1), "pitman-yor-contexts") if own else None
    for k in range(passes):
        before, last = model, k == passes - 1
        many = samples if last else 1
        table = kept(with_tables(with_own(table, restaurants) if own else table, before, k, many, last), "pitman-yor-tables")
        tables, shared, found = totals(table, n_ctx, frequent, lambda s: s.tables, many)
        model = Model(n, v, frequent, counts, before.customers, discounts, tables, shared, own=own, other=found["other"])
        if own:
            restaurants = kept(own_contexts(single, table, many), "pitman-yor-contexts")
    model.rest = (restaurants, all_seats.select("word", "spread", "single")) if own else None
    return model, before, table


# --- scoring ---

WORD, PAIR, SINGLE, CONTEXT, ASK_WORDS, ASK_PAIRS, HOME = range(7)  # kinds of blobs


def postings(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Per flush its texts (ids, flags, sizes; distinct words; pairs of word and context, with the texts that hold them) and per bucket
    the words and pairs whose figures it asks for, each once. ``docs``: (id, flag, text)."""
    frequent, n_ctx = model.frequent, FIRST + len(model.frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (held, sizes, words) in enumerate(flushes(batches, FLUSH_TOKENS)):
            part = TaskContext.get().partitionId()
            flush = (part << 32) + number
            table = pa.Table.from_batches(held)
            ids, flags = table.column(0), table.column(1)
            w, c, doc, n = counted_in(words, context_numbers(words, sizes, frequent, model.own), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
            first = runs(w, c)
            px, py = w[first], c[first]
            among = np.unique(w)
            per_word = np.diff(np.append(np.searchsorted(px, among), len(px)))
            own = own_context(among)  # contexts of rare words are written as the word's place
            by = np.argsort(own)
            code = np.where(py < 0, n_ctx + by[find(py, own[by])[0]], py)
            yield _batch([(flush, (part + number) % buckets, HOME, pack(ids.is_null().to_numpy().astype(np.uint8), ids.fill_null(0).to_numpy().view(np.uint64),
                                                                       flags.to_numpy().astype(np.uint8), sizes.astype(np.int64), among, per_word, code,
                                                                       np.diff(np.append(first, len(w))), doc, n))])
            keys, _ = asked(among, per_word, py, frequent)
            for kind, x in zip((ASK_WORDS, ASK_PAIRS), keys):
                yield _batch([(flush, b, kind, pack(x[at])) for b, at in shares(x, buckets)])

    return docs.mapInArrow(run, POSTING)


def asked(among: np.ndarray, per_word: np.ndarray, ctx: np.ndarray, frequent: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((keys of the words that the model itself does not hold, keys of the pairs), places of those words)."""
    rare = np.flatnonzero(~find(among, frequent)[1])
    word = np.repeat(among, per_word)
    return (own_key(own_context(among[rare])), pair_key(word_key(word, spreads(word, ctx, frequent)), ctx)), rare


def figures(table: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Blobs per bucket of what the fit knows: words' customers and tables, pairs' customers and tables, pairs of one customer, tables of rare words' restaurants."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            s = Seats(batch, model.frequent)
            rare = np.flatnonzero(~s.hot)
            key, n = own_key(own_context(s.word[rare])), s.per_word(s.n)[rare].astype(np.int64)
            have = [s.per_word(t)[rare].astype(np.int64) for t in s.tables]
            yield _batch([(0, b, WORD, pack(key[at], n[at], *(x[at] for x in have))) for b, at in shares(key, buckets)])
            yield _batch([(0, b, PAIR, pack(s.pair[at], s.n[at], *(t[at] for t in s.tables))) for b, at in shares(s.pair, buckets)])

    def run_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            lists = batch.column(2)
            row = np.repeat(word_key(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()), lists.value_lengths().to_numpy())
            key = pair_key(row, lists.flatten().to_numpy())
            yield _batch([(0, b, SINGLE, pack(key[at])) for b, at in shares(key, buckets)])

    def run_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            ctx, *t = (c.to_numpy() for c in batch.columns)
            key = own_key(ctx)
            yield _batch([(0, b, CONTEXT, pack(key[at], *(x[at] for x in t))) for b, at in shares(key, buckets)])

    out = table.mapInArrow(run, POSTING)
    if model.rest is None:
        return out
    restaurants, single = model.rest
    return out.unionByName(single.mapInArrow(run_single, POSTING)).unionByName(restaurants.mapInArrow(run_contexts, POSTING))


class Lookup:
    """The figures of a bucket by key."""

    def __init__(self, blobs: dict[int, list[list[np.ndarray]]], samples: int):
        words, pairs, single, contexts = (
            [np.concatenate([b[k] for b in blobs[kind]]) if blobs.get(kind) else np.empty(0, np.uint64 if k == 0 else np.int64) for k in range(n)]
            for kind, n in ((WORD, 2 + samples), (PAIR, 2 + samples), (SINGLE, 1), (CONTEXT, 1 + samples)))
        ones = np.ones(len(single[0]), np.int64)
        self.by = [self._sorted(x) for x in (words, contexts, [np.concatenate([p, o]) for p, o in zip(pairs, [single[0], *[ones] * (1 + samples)])])]

    @staticmethod
    def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
        by = np.argsort(columns[0])
        return [columns[0][by], *(c[by].astype(np.int64) for c in columns[1:])]

    @staticmethod
    def _get(keys: np.ndarray, among: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        at, there = find(keys, among)
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        for x, c in zip(out, columns):
            x[there] = c[at[there]]
        return out

    def answer(self, kind: int, keys: np.ndarray) -> list[np.ndarray]:
        """Per sample: words' training tokens, tables and tables in their own restaurants; pairs' customers and tables. Zeros are unknown."""
        return self._get(keys, *self.by[2]) if kind == ASK_PAIRS else self._get(keys, *self.by[0]) + self._get(keys, *self.by[1])


def text_scores(home: list[np.ndarray], answers: dict[tuple[int, int], list[np.ndarray]], model: Model, buckets: int) -> pa.RecordBatch:
    """The rows of a flush's texts. ``answers``: by kind and bucket."""
    missing, ids, flags, sizes, among, per_word, code, per_pair, doc, count = home
    frequent, n_ctx, samples = model.frequent, FIRST + len(model.frequent), len(model.tables)
    of = np.repeat(np.arange(len(among)), per_word)
    code = code.astype(np.int64)
    own, u = code >= n_ctx, np.maximum(code - n_ctx, 0)  # which contexts are rare words, and these words' places
    ctx = np.where(own, own_context(among)[u], code)
    keys, rare = asked(among, per_word, ctx, frequent)

    def told(kind: int, x: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((columns, len(x)), np.int64)
        for b, at in shares(x, buckets):
            out[:, at] = answers[kind, b]
        return out

    word = np.zeros((1 + 2 * samples, len(among)), np.int64)
    word[:, rare] = told(ASK_WORDS, keys[0], len(word))
    hot, is_hot = find(among, frequent)
    word[0, is_hot], word[1:1 + samples, is_hot] = model.frequent_counts[hot[is_hot]], model.shared[:, hot[is_hot]]
    n_word, have, tables = word[0], word[1:1 + samples], word[1 + samples:]
    root = np.where(n_word > 0, model.root(have), model.new_word()[:, None])
    n, *t = told(ASK_PAIRS, keys[1], 1 + samples)
    numbered = np.where(own, 0, code)
    customers = np.where(own, n_word[u], model.customers[numbered])
    value = np.zeros(len(of))
    for k in range(samples):
        left = model.left(customers, np.where(own, tables[k][u], model.tables[k][numbered]))
        value += (n - model.discounts[1] * t[k]) / (model.thetas[1] + customers) + left * root[k][of]
    value = np.log10(value / samples)
    pair = np.repeat(np.arange(len(of)), per_pair)
    total = [np.bincount(doc, x[pair] * count, len(sizes)) for x in (value, model.base(n_word)[of], (n_word > 0)[of].astype(float))]
    return pa.RecordBatch.from_arrays(
        [pa.array(_signed(ids), pa.int64(), mask=missing.astype(bool)), pa.array(flags.astype(bool)), pa.array(sizes, pa.int64()),
         pa.array(total[2].astype(np.int64)), pa.array(total[1]), pa.array(total[0])],
        names=["id", "flag", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model, before: Model, table: DataFrame) -> DataFrame:
    """(id, flag, n_tokens, n_known, base_score, score) of every row of ``docs``: (id, flag, text). The other arguments are what
    :func:`fit` returns; ``before`` is not read, as the tables are stored."""
    samples, buckets = len(model.tables), buckets_of(docs, model.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, known = None, {}, None
        for batch in emptied(batches):
            for flush, bucket, kind, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != current:
                    current, blobs, known = bucket, {}, None
                if kind < ASK_WORDS:
                    blobs.setdefault(kind, []).append(unpack(blob))
                elif kind == HOME:
                    yield _batch([(flush, -1, HOME, blob)])
                else:
                    if known is None:
                        known, blobs = Lookup(blobs, samples), {}
                    yield _batch([(flush, bucket, kind, pack(*known.answer(kind, *unpack(blob))))])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, told = None, {}
        for batch in emptied(batches):
            for _, bucket, kind, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket < 0:
                    if home is not None:
                        yield text_scores(home, told, model, buckets)
                    home, told = unpack(blob), {}
                else:
                    told[kind, bucket] = unpack(blob)
        if home is not None:
            yield text_scores(home, told, model, buckets)

    out = None
    rounds = max(1, min(ROUNDS, -(-model.tokens // BUCKET_TOKENS)))
    for k in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
        dealt = figures(table, model, buckets).unionByName(postings(part, model, buckets)).repartitionById(buckets, "bucket")
        answers = dealt.sortWithinPartitions("bucket", "kind", "flush").mapInArrow(run, POSTING)
        scores = kept(answers.repartition("flush").sortWithinPartitions("flush", "bucket", "kind").mapInArrow(
            collect, "id long, flag boolean, n_tokens long, n_known long, base_score double, score double"), "pitman-yor-scores")
        out = scores if out is None else out.unionByName(scores)
    return out


def pitman_yor_scores(docs: DataFrame, id: str, held_out, text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row; the model learns from the rows
    where ``held_out`` (a Column) is false."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("flag"), F.col(f"`{text}`").alias("text"))
    model, before, table = fit(rows.where(~F.col("flag")))
    found = score(rows, model, before, table)
    return found.select("id", F.col("flag").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
