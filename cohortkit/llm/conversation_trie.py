"""Prefix trie of conversations: union-find over sorted neighbours' common prefixes, partition by partition.

A conversation is a sequence of turns; a turn is a symbol of 24 bytes, the MD5 of role and text and the text's bytes as a number,
so texts leave the plan with the first projection. A trie node is a distinct sequence of first turns.

1. Distinct sequences are counted, combined map-side (copies of a conversation are one row from there on), with the smallest id and the
   digest of all ids of each.
2. The distinct sequences are dealt out by range and sorted. Inside a part, neighbours are edges weighted by their common prefix; edges
   are taken in descending depth, and union-find joins the two components of an edge: a component is the set of sequences
   below a node, and every merge creates (or widens) a branching node at the edge's depth. Chains of nodes with one child come out
   when their component is lifted to the depth of its next merge.
3. A node whose component reaches an end of its part, no deeper than the common prefix with the neighbouring part, is open: other
   parts hold more of it. Each part's forest is contracted to these open nodes, at most a path to either side, and open nodes are merged across
   the boundaries by the hash of their prefix. A node's own bytes, and it as a child, count in the first part that holds it, so
   members, children, leaves and saved bytes simply add up.

Nothing but one part's sequences is held in a task; the driver sees two numbers per part. A node that most conversations
pass is one contracted row per part.

A digest over the ids of a third of all conversations is one SHA-256, which only runs in sequence: its ids are sorted over all
tasks, each part writes its stretch as one text, and one task feeds these texts in order, without holding them.

Defined cases: null role or text counts as empty; turns are ordered by number (null first), ties by their symbol, repeated rows are turns of their
own; rows without a conv_id belong to no conversation; a conversation without turns ends at the root; an empty table has no node;
other columns are not read, so their names cannot clash. One conversation's symbols are one value, like a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import bound_batches, emptied, stored

SYMBOL = 24  # bytes: 16 of the hash, 8 of the text's size
BATCH_ROWS = 20_000


def conversations_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """(conv_id, symbols): the turns of every conversation in order, as symbols."""
    who, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    size = F.unhex(F.lpad(F.hex(F.octet_length(said).cast("long")), 16, "0"))
    rows = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                        F.concat(key, size).alias("symbol")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "symbol"))).alias("s")).select(
        "conv_id", F.transform("s", lambda x: x["symbol"]).alias("symbols"))


def common_symbols(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two sequences."""
    n = min(len(a), len(b)) // SYMBOL
    x, y = (np.frombuffer(s, np.uint8, n * SYMBOL).reshape(n, SYMBOL) for s in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """The hash of every prefix up to ``depth``."""
    h, out = hashlib.md5(), []
    for d in range(depth + 1):
        out.append(h.copy().digest())
        h.update(seq[d * SYMBOL:(d + 1) * SYMBOL])
    return out


class Forest:
    """The nodes of the sorted distinct sequences of one part, by union-find.

    ``left`` and ``right`` are the common prefixes with the neighbouring parts' sequences, -1 without a neighbour. ``rows`` collects
    (key, parent_key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends) of the finished nodes; ``key`` marks open ones.
    """

    def __init__(self, seqs: list[bytes], n: list[int], least: list[int], ends: list[bytes], left: int, right: int):
        self.left, self.right, self.last = left, right, len(seqs) - 1
        self.sizes = [np.frombuffer(s, [("key", "V16"), ("size", ">i8")])["size"].tolist() for s in seqs]
        self.common = [common_symbols(a, b) for a, b in zip(seqs, seqs[1:])]
        self.first_keys, self.last_keys = prefix_keys(seqs[0], max(left, 0)), prefix_keys(seqs[-1], max(right, 0))
        self.rows: list[tuple] = []
        self.parent = list(range(len(seqs)))
        after = self.common + [right]
        # per component: lo, hi, depth, n, least, children, leaves, all bytes below, distinct bytes below, ends, rows that wait for this node
        self.top = [[i, i, len(z), n[i], least[i], 0, int(after[i] < len(z)), 0, 0, ends[i], []] for i, z in enumerate(self.sizes)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def elsewhere(self, lo: int, depth: int) -> bool:
        """Whether an earlier part holds the node too."""
        return lo == 0 and depth <= self.left

    def key(self, lo: int, hi: int, depth: int) -> bytes | None:
        """The key of an open node."""
        if lo == 0 and depth <= self.left:
            return self.first_keys[depth]
        return self.last_keys[depth] if hi == self.last and depth <= self.right else None

    def finish(self, c: list) -> None:
        """Write the component's node; it then waits for its parent."""
        lo, hi, depth, n, least, children, leaves, spent, distinct, ends, waiting = c
        size = self.sizes[lo][depth - 1] if depth else 0
        c[7], c[8] = spent + n * size, distinct + (0 if self.elsewhere(lo, depth) else size)
        key = self.key(lo, hi, depth)
        for row in waiting:  # a child's parent is known by its id, or by its key while other parts hold some of it
            self.rows.append((row[0], key, *row[1:3], None if key else least, *row[3:]))
        c[10] = [(key, least, depth, n, children, leaves, c[7] - c[8], ends)]

    def lift(self, c: list, depth: int) -> None:
        """Write the nodes of the chain above the component, up to the child of ``depth``, and begin the node there."""
        while c[2] > depth:
            self.finish(c)
            child = 0 if self.elsewhere(c[0], c[2]) else 1
            c[2], c[5], c[9] = c[2] - 1, child, None

    def build(self) -> list[tuple]:
        for at in sorted(range(len(self.common)), key=lambda i: -self.common[i]):
            depth = self.common[at]
            a, b = self.find(at), self.find(at + 1)
            x, y = self.top[a], self.top[b]
            self.lift(x, depth)
            self.lift(y, depth)
            self.parent[b] = a
            ends = x[9] if x[9] is not None else y[9]
            small, big = sorted((x[10], y[10]), key=len)
            big.extend(small)
            self.top[a] = [x[0], y[1], depth, x[3] + y[3], min(x[4], y[4]), *(x[k] + y[k] for k in (5, 6, 7, 8)), ends, big]
            self.top[b] = None
        root = self.top[self.find(0)]
        self.lift(root, 0)
        self.finish(root)
        key, least, depth, *rest = root[10][0]
        self.rows.append((key, None, least, depth, None, *rest))
        return self.rows


NODE = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends binary")
KINDS = [pa.binary(), pa.binary()] + [pa.int64()] * 7 + [pa.binary()]
NAMES = [c.split()[0] for c in NODE.split(", ")]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(value, rows) of each run of equal values in the first column."""
    current, held = None, []
    for batch in emptied(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[0] != current:
                yield current, held
                held = []
            current = row[0]
            held.append(row[1:])
    if held:
        yield current, held


def id_digests(sequences: DataFrame) -> DataFrame:
    """(skey, ends): SHA-256 of the ascending ids, joined by commas, of each ``skey`` of (skey, conv_id)."""
    dealt = sequences.select("skey", "conv_id").repartitionByRange("skey", "conv_id").sortWithinPartitions("skey", "conv_id")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first, waiting = True, None

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary()))],
                                              names=["skey", "low", "ids", "ends"])

        for skey, rows in _by_group(batches):  # the ids of a key in this part, whose size is bounded
            if waiting is not None:
                out.append(waiting if first else (waiting[0], None, None, hashlib.sha256(waiting[2]).digest()))
                first = False
            waiting = (skey, rows[0][0], b",".join(b"%d" % r[0] for r in rows), None)
            if len(out) >= BATCH_ROWS:
                yield batch_of()
                out.clear()
        if waiting is not None:  # the last key may go on in the next part, the first one may have begun before
            out.append(waiting)
        if out:
            yield batch_of()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, h = None, None
        for batch in emptied(batches):
            for skey, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if skey == current:
                    h.update(b",")
                else:
                    if h is not None:
                        out.append((current, h.digest()))
                    current, h = skey, hashlib.sha256()
                h.update(ids)
        if h is not None:
            out.append((current, h.digest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], names=["skey", "ends"])

    found = stored(dealt.mapInArrow(stretches, "skey binary, low long, ids binary, ends binary"), "trie-ids")
    cut = found.where("ids IS NOT NULL").repartition("skey").sortWithinPartitions("skey", "low").select("skey", "ids")
    return found.where("ids IS NULL").select("skey", "ends").unionByName(cut.mapInArrow(joined, "skey binary, ends binary"))


def boundaries(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """(left, right) of every part: the common prefix with the sequences of the parts beside it."""
    parts = dealt.groupBy("part").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    beside = Window.orderBy("part")  # a row per part
    pairs = parts.select("part", "lo", F.lag("hi").over(beside).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            depth = [-1 if b is None else common_symbols(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth, pa.int64())], names=["part", "left"])

    left = sorted((r["part"], r["left"]) for r in pairs.mapInArrow(run, "part int, left long").collect())
    return {p: (depth, left[i + 1][1] if i + 1 < len(left) else -1) for i, (p, depth) in enumerate(left)}


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends) of every node of the trie over (conv_id, symbols);
    ``ends`` is the SHA-256 of the ids that end there. Ids are distinct."""
    spark = sequences.sparkSession
    bound_batches(spark)
    seq = F.unhex(F.array_join(F.transform("symbols", F.hex), ""))
    listed = stored(sequences.select("conv_id", seq.alias("seq")).withColumn("skey", F.unhex(F.md5("seq"))), "trie-sequences")
    copies = listed.groupBy("skey").agg(F.first("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    distinct = copies.join(id_digests(listed), "skey").select("seq", "n", "least", "ends")
    dealt = stored(distinct.repartitionByRange("seq").withColumn("part", F.spark_partition_id()), "trie-dealt")
    beside = boundaries(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_group(batches):
            nodes = Forest(*map(list, zip(*rows)), *beside[part]).build()
            for at in range(0, len(nodes), BATCH_ROWS):
                cut = nodes[at:at + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in cut], KINDS[k]) for k in range(len(KINDS))], names=NAMES)

    of_part = dealt.repartition("part").sortWithinPartitions("part", "seq").select("part", "seq", "n", "least", "ends")
    nodes = stored(of_part.mapInArrow(run, NODE), "trie-nodes")
    opened = stored(nodes.where("key IS NOT NULL").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends")), "trie-open")
    merged = nodes.where("key IS NULL").select("parent_key", *NAMES[2:]).unionByName(
        opened.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent_key", *NAMES[2:]))
    parents = opened.select(F.col("key").alias("of"), F.col("conv_id").alias("of_conv"))  # parts times the depth of what they share
    return merged.join(parents, F.col("parent_key") == F.col("of"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "of_conv")).select(*NAMES[2:])
