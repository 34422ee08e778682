"""Exact n-gram Jaccard join and its classes, with signature trees.

Two documents link when |A & B| / |A | B| of their word-shingle sets reaches num / den.

1. Every text becomes a sorted set of 64-bit shingle hashes. Equal sets are one node (its id: the
   smallest doc_id), so copies cost one row per task and are never paired.
2. Candidates, without loss: with slack = n - ceil(n num / den) and l(n) = max(1, ceil(n / EXTRA)), the
   slack + l lowest hashes of two linked sets have min(l) or more in common. A node with fewer tokens
   of document frequency 2 or more among them, l of the smallest possible partner, has no link. Of the
   shared tokens, the most frequent l - 1 can be left out too; what is left (rarest first) ties nodes
   into candidate classes, through the smallest node of each token: no pairs are made.
3. A candidate class is cut by size (classes of ratio num / den, so links stay within neighbouring
   ones) and, where a size class is large, into blocks by hash. Only pairs of blocks that may hold a
   link are made. A task joins a pair of blocks by signature trees: leaves are bitmaps of the tokens,
   inner nodes OR their children and keep the range of sizes; a dual traversal drops a pair of nodes
   if its largest possible overlap (common bits + tokens that share bits) misses the least overlap that
   its sizes need. What reaches the leaves is verified exactly, unless already connected.
4. Links are contracted to classes.

No step gathers a token, a class or a set of copies in one task; what a task holds is two blocks.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a null doc_id links
with nothing (its component is null); rows with the same doc_id are one document of several texts;
only doc_id and the text are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import binary_texts, bound_batches, emptied, stored
from cohortkit.llm.components import components
from cohortkit.llm.hashing import mix, shingle_set

EXTRA = 10
BLOCK_ROWS = 192
FANOUT = 8
PAIRS_AT_ONCE = 1 << 15


# --- the tree join of two blocks (numpy, inside a task) ---

def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per set; about four bits a token of the largest set."""
    bits = 1 << max(9, min(16, (4 * max(len(s) for s in sets)).bit_length()))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        at = (mix(s) >> np.uint64(7)) & np.uint64(bits - 1)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def signature_tree(bits: np.ndarray, size: np.ndarray) -> list[dict]:
    """Levels from the sets up to one root; a node ORs the bitmaps of FANOUT children."""
    spare = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # tokens that share a bit
    levels = [{"bits": bits, "low": size, "high": size, "spare": spare}]
    while len(levels[-1]["low"]) > 1:
        x = levels[-1]
        at = np.arange(0, len(x["low"]), FANOUT)
        levels.append({
            "bits": np.bitwise_or.reduceat(x["bits"], at, axis=0), "low": np.minimum.reduceat(x["low"], at),
            "high": np.maximum.reduceat(x["high"], at), "spare": np.maximum.reduceat(x["spare"], at)})
    return levels


def may_link(x: dict, y: dict, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets below node a of x and node b of y can reach the threshold."""
    low_a, low_b, high_a, high_b = x["low"][a], y["low"][b], x["high"][a], y["high"][b]
    ok = (den * high_a >= num * low_b) & (den * high_b >= num * low_a)
    at = np.flatnonzero(ok)
    common = np.bitwise_count(x["bits"][a[at]] & y["bits"][b[at]]).sum(axis=1).astype(np.int64)
    most = np.minimum(common + np.minimum(x["spare"][a[at]], y["spare"][b[at]]), np.minimum(high_a[at], high_b[at]))
    ok[at] = most * (num + den) >= num * (low_a[at] + low_b[at])
    return ok


def dual_traversal(x: list[dict], y: list[dict], same: bool, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may link, in batches; ``same``: x is y, each pair once."""
    while len(x) < len(y):
        x = x + [x[-1]]  # a root above the root, to level the heights
    while len(y) < len(x):
        y = y + [y[-1]]
    zero = np.zeros(1, np.int64)
    stack = [(len(x) - 1, zero, zero)]
    child = np.arange(FANOUT)
    while stack:
        level, a, b = stack.pop()
        keep = may_link(x[level], y[level], a, b, num, den)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            if same:
                a, b = a[a < b], b[a < b]
            yield a, b
            continue
        below = []
        for tree, node in ((x, a), (y, b)):
            if tree[level] is tree[level - 1]:
                below.append(node[:, None])
            else:
                below.append(node[:, None] * FANOUT + child)
        i, j = np.broadcast_arrays(below[0][:, :, None], below[1][:, None, :])
        i, j = i.reshape(-1), j.reshape(-1)
        inside = (i < len(x[level - 1]["low"])) & (j < len(y[level - 1]["low"]))
        if same:
            inside &= i <= j
        i, j = i[inside], j[inside]
        stack += [(level - 1, i[k:k + PAIRS_AT_ONCE], j[k:k + PAIRS_AT_ONCE]) for k in range(0, len(i), PAIRS_AT_ONCE)]


def join_blocks(ids: list[int], sets: list[np.ndarray], right: np.ndarray, same: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a pair of blocks (a spanning forest of its link graph).

    ``right`` marks the rows of the second block; with ``same``, the pair is one block with itself.
    """
    size = np.array([len(s) for s in sets], np.int64)
    bits = bitmaps(sets)
    # similar sets beside each other, so that inner bitmaps stay sparse: by size, then lowest token
    order = np.lexsort((np.array([s[0] for s in sets]), size))
    one, two = (order, order) if same else (order[~right[order]], order[right[order]])
    if not len(one) or not len(two):
        return []
    x = signature_tree(bits[one], size[one])
    y = x if same else signature_tree(bits[two], size[two])
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for a, b in dual_traversal(x, y, same, num, den):
        for i, j in zip(one[a].tolist(), two[b].tolist()):
            p, q = root(i), root(j)
            if p == q:
                continue
            overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if overlap * (num + den) >= num * (size[i] + size[j]):
                parent[q] = p
                links.append((ids[i], ids[j]))
    return links


# --- Spark ---

def least_extra(n, num: int, den: int):
    """Tokens that a node of n must share: l of the smallest set that can link with it (a Column)."""
    smallest = F.floor((n * num + (den - 1)) / den)
    return F.greatest(F.lit(1), F.floor((smallest + (EXTRA - 1)) / EXTRA))


def shingled(docs: DataFrame, words: int, num: int, den: int, whole: bool, rest: list[str]) -> DataFrame:
    """``rest`` columns with n, digest and the lowest slack + l hashes, or (``whole``) all hashes as bytes."""
    bound_batches(docs.sparkSession)
    docs = docs.select(*rest, F.col("text").alias("jj_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    kinds = [f.name for f in docs.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            sets = [shingle_set(t, words) for t in binary_texts(batch.column(len(kinds)))]
            cols = [batch.column(i) for i in range(len(kinds))]
            if whole:
                cols.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=kinds + ["tokens"])
                continue
            n = [len(s) for s in sets]
            low = [s[:k - -(-k * num // den) + max(1, -(-k // EXTRA))].view(np.int64) for s, k in zip(sets, n)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            cols += [pa.array(n, pa.int64()), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(low), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=kinds + ["n", "digest", "low"])

    added = "tokens binary" if whole else "n long, digest binary, low array<long>"
    return docs.mapInArrow(run, f"{fields}, {added}")


def candidate_classes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, cls) of the nodes that may have a link; ``sets``: (doc_id, n, digest, low)."""
    tokens = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.explode("low").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_doc = (
        tokens.join(shared, "token").groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    )
    spare = F.size("common") - least_extra(F.col("n"), num, den) + 1
    nodes = stored(
        sets.select("doc_id", "n", "digest").join(per_doc, "doc_id").where(spare > 0)
        .select("doc_id", "n", "digest", F.slice("common", F.lit(1), spare.cast("int"))["token"].alias("rare"))
        .groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("rare").alias("rare")),
        "jaccard-nodes")
    rare = nodes.select("node", F.explode("rare").alias("token"))
    heads = rare.groupBy("token").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    edges = rare.join(heads, "token").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return components(edges, "jaccard-candidates").join(nodes.select("node", "n"), "node").select(
        "node", "n", F.col("component").alias("cls"))


def block_pairs(found: DataFrame, num: int, den: int) -> DataFrame:
    """(node, cls, pairs): the pairs of blocks that each node of ``found`` (node, n, cls) takes part in."""
    width = math.log(den / num) * (1 + 1e-9)
    found = found.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
    counts = stored(
        found.groupBy("cls", "step").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")),
        "jaccard-blocks")

    def at(step, blocks: str) -> DataFrame:
        return counts.select("cls", step.alias("step"), F.col("blocks").alias(blocks))

    found = (
        found.join(at(F.col("step"), "own"), ["cls", "step"])
        .join(at(F.col("step") - 1, "above"), ["cls", "step"], "left")
        .join(at(F.col("step") + 1, "below"), ["cls", "step"], "left")
    )
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("own")).cast("int")
    none = F.array().cast("array<struct<step:int,i:int,up:int,j:int,second:boolean>>")

    def entry(step, i, up, j, second):
        return F.struct(step.cast("int").alias("step"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), second.alias("second"))

    def each(count, make):
        return F.when(count.isNotNull() & (count > 0), F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(none)

    found = found.withColumn("mine", mine)
    me = F.col("mine")
    pairs = F.concat(
        each(F.col("own"), lambda j: entry(F.col("step"), F.least(me, j), 0, F.greatest(me, j), me > j)),
        each(F.col("above"), lambda j: entry(F.col("step"), me, 1, j, F.lit(False))),
        each(F.col("below"), lambda j: entry(F.col("step") - 1, j, 1, me, F.lit(True))),
    )
    return found.select("node", "cls", pairs.alias("pairs"))


def linked(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links of all pairs of blocks, found by the tree join; ``members``: (node, cls, pairs, tokens)."""
    keys = ["cls", "step", "i", "up", "j"]
    rows = members.where(F.length("tokens") > 0).select("cls", "node", "tokens", F.inline("pairs")).select(
        *keys, ((F.col("up") == 0) & (F.col("i") == F.col("j"))).alias("same"), "second", "node", "tokens")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, right, same = None, [], [], [], False

        def flush() -> list[tuple[int, int]]:
            return join_blocks(ids, sets, np.array(right), same, num, den) if len(ids) > 1 else []

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in emptied(batches):
            cols = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for row in zip(*cols):
                if row[:5] != key:
                    if links := flush():
                        yield out(links)
                    key, ids, sets, right, same = row[:5], [], [], [], row[5]
                ids.append(row[7])
                right.append(row[6])
                sets.append(np.frombuffer(row[8], np.uint64))
        if links := flush():
            yield out(links)

    return rows.mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(shingled(docs, words, num, den, False, ["doc_id"]), "jaccard-sets")
    found = stored(candidate_classes(sets, num, den), "jaccard-candidates")
    digests = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"))
    # the texts of candidates, read again: all shingles of all texts would be a multiple of the input. Always a
    # shuffle join, which is the plan that the size of a large corpus needs.
    planned = stored(block_pairs(found, num, den).withColumnRenamed("node", "doc_id"), "jaccard-pairs")
    texts = docs.join(planned.hint("merge"), "doc_id")
    members = shingled(texts, words, num, den, True, ["doc_id", "cls", "pairs"]).withColumnRenamed("doc_id", "node")
    links = components(linked(members, num, den), "jaccard-links")
    labels = digests.join(links, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (
        sets.select("doc_id", "n", "digest").join(labels, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
                .otherwise(F.coalesce("component", "doc_id")).alias("component_id"))
    )
