"""The trie against a brute-force version, and on the awkward cases."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from cohortkit.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def brute(sequences):
    """Node rows of {conv_id: [(role, text), ...]}, by sets of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).digest() if p in ends else None) for p, m in members.items())


def found(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in (r[c] for c in COLUMNS)) for r in df.collect()), key=lambda r: r[:2])


def test_against_sets_over_many_partitions(spark):
    rnd = random.Random(3)
    sequences = {}
    for c in range(400):
        kind = rnd.random()
        if kind < 0.3:  # copies of one conversation, a third of all
            s = [("user", "hello"), ("assistant", "hi"), ("user", "é" * 5)]
        else:
            s = [("user", "hello")] * (kind < 0.7) + [(rnd.choice("ab"), rnd.choice(["x", "yy", "zzz"])) for _ in range(rnd.randint(1, 7))]
        sequences[c * 3 - 200] = s
    sequences[5000] = [("user", f"turn {k % 7}") for k in range(120)]
    sequences[5001] = sequences[5000][:90] + [("user", "other")]
    rows = [(c, k, r, t) for c, s in sequences.items() for k, (r, t) in enumerate(s)]
    rnd.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.lit("clash")).withColumn("a.b", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert found(ct.prefix_trie(ct.conversations_of(turns))) == brute(sequences)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before[0])
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_awkward_rows(spark):
    rows = [(1, 1, "user", "b"), (1, None, "user", "a"), (1, 2, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "a"),
            (3, 0, "us", "era"), (4, 7, "user", "a")]
    sequences = {1: [("user", "a"), ("user", "b"), ("", "")], 2: [("user", "a")] * 2, 3: [("us", "era")], 4: [("user", "a")]}
    got = found(ct.prefix_trie(ct.conversations_of(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(sequences)
    assert ct.prefix_trie(ct.conversations_of(spark.createDataFrame([], SCHEMA))).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    df = spark.createDataFrame([(3, []), (1, []), (2, [b"k" * 16 + bytes([0] * 7 + [9])])], "conv_id long, symbols array<binary>")
    none = hashlib.sha256(b"1,3").digest()
    assert found(ct.prefix_trie(df)) == [(1, 0, None, 3, 1, 1, 0, none), (2, 1, 1, 1, 0, 1, 0, hashlib.sha256(b"2").digest())]


def test_open_nodes_of_one_part_meet():
    """Any cut of the sorted sequences gives the same totals of open and closed nodes."""
    rnd = random.Random(4)
    seqs = sorted({b"".join(bytes([rnd.randint(0, 1)]) * 16 + (rnd.randint(0, 1) + 1).to_bytes(8, "big") for _ in range(rnd.randint(0, 5)))
                   for _ in range(60)})
    whole = ct.Forest(seqs, [1] * len(seqs), list(range(len(seqs))), [b"e"] * len(seqs), -1, -1).build()
    for cut in range(1, len(seqs)):
        between = ct.common_symbols(seqs[cut - 1], seqs[cut])
        parts = []
        for part, at, left, right in ((seqs[:cut], 0, -1, between), (seqs[cut:], cut, between, -1)):
            parts += ct.Forest(part, [1] * len(part), list(range(at, at + len(part))), [b"e"] * len(part), left, right).build()
        total = [sum(r[k] for r in parts) for k in (5, 6, 7, 8)]
        closed = [r for r in parts if r[0] is None]
        opened = defaultdict(list)
        for r in parts:
            if r[0] is not None:
                opened[r[0]].append(r)
        assert len(closed) + len(opened) == len(whole)
        assert total == [sum(r[k] for r in whole) for k in (5, 6, 7, 8)]
