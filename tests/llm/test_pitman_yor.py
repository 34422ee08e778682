"""The Pitman-Yor model against a plain version of its formulas, its sampler against enumeration, and the awkward cases."""

import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import pitman_yor as py
from cohortkit.llm.hashing import word_hashes

SCHEMA = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(30)]


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(WORDS[:rnd.choice([2, 8, 30])]) if rnd.random() < 0.9 else f"rare{rnd.randint(0, 200)}" for _ in range(rnd.randint(0, 40))]
        out.append((i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words)))
    return out


def tokens(text):
    return [*(text or "").lower().split(), None]


def token_hash(token):
    return py.END if token is None else word_hashes(token.encode())[0]


@pytest.mark.parametrize("parts,contexts", [(1, 8192), (7, 12)])
def test_scores_equal_the_formulas(spark, monkeypatch, parts, contexts):
    monkeypatch.setattr(py, "FLUSH_TOKENS", 300)
    monkeypatch.setattr(py, "BUCKET_TOKENS", 500)
    data = corpus(150, 1) + [(1000 + i, "w0 w1") for i in range(75)]  # a word pair that a third of the texts hold
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    held = F.col("id") % 10 == 0
    rows = df.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10 == 0).alias("flag"), "text")
    model, before, table = py.fit(rows.where(~F.col("flag")), contexts)
    got = {r["id"]: r for r in py.score(rows, model, before, table).collect()}
    assert len(got) == len(data)

    train = [tokens(t) for i, t in data if i % 10]
    count = Counter(x for t in train for x in t)
    total = sum(count.values())
    assert (model.tokens, model.words) == (total, len(count))
    frequent = {x for x, n in count.items() if n * contexts >= total}

    def pairs(t):
        before = ["<"] + [x if x in frequent else "?" for x in t[:-1]]
        return list(zip(before, t))

    customers = Counter(p for t in train for p in pairs(t))
    number = {"<": py.START, "?": py.RARE} | {x: int(np.searchsorted(model.frequent, token_hash(x))) + py.FIRST for x in frequent}
    # the same seating from the rows of one batch
    seats = table.toArrow().combine_chunks().to_batches()[0]
    s = py.Seats(seats, model.frequent)
    t = py.sampled(s, before, py.PASSES - 1, py.SAMPLES)
    name = {int(token_hash(x)): x for x in count}
    by_number = {v: k for k, v in number.items()}
    place = {(by_number[int(c)], name[int(s.word[w])]): k for k, (w, c) in enumerate(zip(s.of, s.ctx))}
    assert {p: int(s.n[k]) for p, k in place.items()} == customers
    d0, d1 = model.discounts

    def probability(u, w):
        each = []
        for k in range(py.SAMPLES):
            tables = {p: int(t[k][i]) for p, i in place.items()}
            in_u = [p for p in place if p[0] == u]
            t_u, c_u = sum(tables[p] for p in in_u), sum(customers[p] for p in in_u)
            s_all, s_w = sum(tables.values()), sum(tables[p] for p in place if p[1] == w)
            root = (s_w - d0) / (1 + s_all) if w in count else (1 + d0 * len(count)) / (1 + s_all)
            each.append((customers.get((u, w), 0) - d1 * tables.get((u, w), 0) + (1 + d1 * t_u) * root) / (1 + c_u))
        return sum(each) / len(each)

    known = {}
    for u in list(number)[:4]:
        assert abs(sum(probability(u, w) for w in [*count, "never"]) - 1) < 1e-9
    for i, text in data[:40] + data[-1:]:
        p = pairs(tokens(text))
        for x in p:
            if x not in known:
                known[x] = math.log10(probability(*x))
        assert abs(got[i]["score"] - sum(known[x] for x in p)) < 1e-8
        assert abs(got[i]["base_score"] - sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for _, w in p)) < 1e-8
        assert got[i]["n_tokens"] == len(p) and got[i]["n_known"] == sum(w in count for _, w in p) and got[i]["flag"] == (i % 10 == 0)
    out = [r for r in got.values() if r["flag"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_sampler_has_the_seating_distribution():
    """Mean number of tables of 5 customers where new tables open with a fixed weight, against all partitions."""
    n, c, d, a = 20000, 5, 0.6, 1.3
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([0], pa.int32()), pa.array([list(range(n))], pa.list_(pa.int32())),
                                        pa.array([[c] * n], pa.list_(pa.int64()))], names=["word", "spread", "ctx", "n"])
    s = py.Seats(batch, np.array([7], np.uint64))
    big = 10 ** 9  # the word's customers in the parent are fixed and many, so the weight is a
    model = py.Model(1, 1, np.array([7], np.uint64), np.array([1]), None, (0.0, d), np.zeros((1, n)), np.array([[big]]), (big / a, 1.0))
    t = list(py.gibbs(s, model, 0, sweeps=30, moves=5))[-1]

    def weight(sizes):
        out = a ** len(sizes)
        for k in sizes:
            for j in range(1, k):
                out *= j - d
        return out

    weights = defaultdict(float)
    for labels in itertools.product(range(c), repeat=c):
        seen = []
        if all(x in seen or (x == len(seen) and not seen.append(x)) for x in labels):  # each partition once
            weights[len(seen)] += weight(list(Counter(labels).values()))
    want = {k: w / sum(weights.values()) for k, w in weights.items()}
    for k in range(1, c + 1):
        assert abs((t == k).mean() - want[k]) < 0.02


def one_by_one(s, model, sweeps):
    """Tables after each sweep in which every customer moves by itself, with the sampler's random numbers."""
    (d0, d1), total = model.discounts, model.thetas[0] + model.root_total()[0]
    out = np.ones((sweeps, len(s.n)), np.int64)
    for w in range(len(s.word)):
        pairs = [p for p in np.flatnonzero(s.of == w) if s.n[p] > 1]
        shared = model.shared[0][s.place[w]] if s.hot[w] else None
        parent = int((s.of == w).sum()) if shared is None else shared
        mine = {p: model.thetas[1] + d1 * model.tables[0][s.ctx[p]] for p in pairs}
        sits = {}
        for p in pairs:
            t = py.expected_tables(s.n[p:p + 1], np.array([mine[p] * max(parent - d0, 1 - d0) / total]), d1)
            sits[p] = [int(x) for x in py.seated(s.n[p:p + 1], t, np.array([0]))]
        for k in range(sweeps):
            for p in pairs:
                at, n = sits[p], len(sits[p])
                keys = py.mix(np.repeat(s.pair[p], n) + np.arange(n).astype(np.uint64) * py.BASE)
                for i in range(n):
                    left, at[i] = at[i], None
                    if shared is None:
                        own = int(((s.of == w) & (s.n == 1)).sum()) + sum(len(set(x) - {None}) for x in sits.values())
                    else:
                        own = shared - (left not in at)
                    weight, turn = mine[p] * max(own - d0, 1 - d0) / total, k << 16
                    while True:
                        opens = py.uniform(keys[i:i + 1], turn)[0] * (n - 1 + weight) < weight
                        j = int(py.uniform(keys[i:i + 1], turn + 1)[0] * (n - 1))
                        j += j >= i
                        there = [x for x in range(n) if at[x] == at[j]]
                        head = max([x for x in there if x > i], default=there[0])
                        turn += 2
                        if opens or j != head or py.uniform(keys[i:i + 1], turn)[0] >= d1:
                            break
                        turn += 1
                    at[i] = f"new {k} {i}" if opens else at[j]
                out[k, p] = len(set(at))
    return out


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_every_customer_moves_in_a_sweep(monkeypatch, block):
    monkeypatch.setattr(py, "BLOCK_CUSTOMERS", block)
    rnd = random.Random(3)
    rows = [(w, sorted(rnd.sample(range(20), rnd.randint(1, 5)))) for w in range(1, 40)]
    n = [[1 + int(rnd.paretovariate(0.7)) % 60 - rnd.randint(0, 1) or 1 for _ in ctx] for _, ctx in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.int32())),
                                        pa.array(n, pa.list_(pa.int64()))], names=["word", "spread", "ctx", "n"])
    frequent = np.array([3, 7], np.uint64)
    s = py.Seats(batch, frequent)
    model = py.Model(1, 40, frequent, np.array([5, 5]), None, (0.6, 0.7), np.arange(2, 22)[None], np.array([[9, 5]]), (1.0, 1.0))
    got = np.array(list(py.gibbs(s, model, 0, sweeps=4)))
    assert (got == one_by_one(s, model, 4)).all() and (np.diff(got, axis=0) != 0).any()


def test_customers_of_one_block_are_prepared_once(monkeypatch):
    """Further sweeps hash no customer's key again."""
    calls, mix = [], py.mix
    batch = pa.RecordBatch.from_arrays([pa.array([5, 7]), pa.array([0, 0], pa.int32()), pa.array([[1, 2], [1]], pa.list_(pa.int32())),
                                        pa.array([[30, 4], [9]], pa.list_(pa.int64()))], names=["word", "spread", "ctx", "n"])
    s = py.Seats(batch, np.array([7], np.uint64))
    model = py.Model(1, 2, np.array([7], np.uint64), np.array([9]), None, (0.6, 0.7), np.array([[3, 4, 5]]), np.array([[6]]), (1.0, 1.0))
    monkeypatch.setattr(py, "mix", lambda x: calls.append(len(x)) or mix(x))
    hashed = []
    for sweeps in (1, 4):
        calls.clear()
        list(py.gibbs(s, model, 0, sweeps=sweeps))
        hashed.append(sum(calls))
    assert hashed == [43, 43]


def test_counted_equals_counting():
    rnd = np.random.default_rng(2)
    words, ctx, doc = rnd.integers(0, 9, 500).astype(np.uint64) << np.uint64(60), rnd.integers(0, 7, 500), np.sort(rnd.integers(0, 11, 500))
    want = sorted(Counter(zip(words.tolist(), ctx.tolist(), doc.tolist())).items())
    assert [((a, b, c), n) for a, b, c, n in zip(*(x.tolist() for x in py.counted(words, ctx, doc, 7, 11)))] == want
    assert [len(x) for x in py.counted(words[:0], ctx[:0], doc[:0], 7, 11)] == [0] * 4


def test_a_sweep_holds_little_per_customer():
    """A word and context of many customers: what is held of each does not grow with the arrays that a block needs."""
    n, many = 600_000, np.array([7], np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([2], pa.int32()), pa.array([[1]], pa.list_(pa.int32())), pa.array([[n]], pa.list_(pa.int64()))],
                                       names=["word", "spread", "ctx", "n"])
    model = py.Model(n, 1, many, np.array([n]), None, (0.6, 0.7), np.array([[3, 5000]]), np.array([[900]]), (1.0, 1.0))
    tracemalloc.start()
    t = list(py.gibbs(py.Seats(batch, many), model, 0, sweeps=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1 < t[0][0] < n and peak < 80 * n


def test_awkward_rows(spark):
    rows = [(1, "one two two"), (1, "one two two"), (2, None), (3, ""), (None, " \n\t"), (20, "never seen"), (30, "x " * 50000), (4, "two")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("flag", F.lit(1)).withColumn("a.b", F.lit(1))
    got = py.pitman_yor_scores(df, "doc_id", F.col("doc_id") % 10 == 0).collect()
    assert sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=repr) == sorted(
        [(1, False, 4, 4, 13)] * 2 + [(2, False, 1, 1, 13), (3, False, 1, 1, 13), (None, False, 1, 1, 13), (20, True, 3, 1, 13),
                                      (30, True, 50001, 1, 13), (4, False, 2, 2, 13)], key=repr)
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(10, "a b"), (20, None)], SCHEMA)
    got = py.pitman_yor_scores(df, "doc_id", F.lit(True)).collect()
    assert sorted((r["id"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(10, 0, 0, 0.0, 0.0), (20, 0, 0, 0.0, 0.0)]
    assert py.pitman_yor_scores(df.where("false"), "doc_id", F.lit(False)).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_every_word_is_a_context(spark, monkeypatch, parts):
    """No word shares a restaurant with others, however rare it is; only a few have numbers."""
    monkeypatch.setattr(py, "FLUSH_TOKENS", 300)
    monkeypatch.setattr(py, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(py, "CONTEXTS", 12)
    monkeypatch.setattr(py, "SPREAD", 3)
    data = corpus(150, 1) + [(1000 + i, "rare1 rare2 w0") for i in range(4)] + [(2000, None), (2010, "never1 never2 w0 never1")]
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    rows = df.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10 == 0).alias("flag"), "text")
    model, before, table = py.fit(rows.where("not flag"))
    got = {r["id"]: r for r in py.score(rows, model, before, table).collect()}
    assert len(got) == len(data) and 0 < len(model.frequent) < 12

    def pairs(t):
        return list(zip(["<", *t[:-1]], t))

    train = [tokens(t) for i, t in data if i % 10]
    count, customers = Counter(x for t in train for x in t), Counter(p for t in train for p in pairs(t))
    words = {int(token_hash(x)): x for x in count}
    number = {py.START: "<"} | {int(np.searchsorted(model.frequent, token_hash(x))) + py.FIRST: x for x in count if token_hash(x) in model.frequent}
    number |= {int(py.own_context(np.array([token_hash(x)]))[0]): x for x in count if token_hash(x) not in model.frequent}
    n, tables = {}, {}
    for r in table.collect():
        for k, (c, many) in enumerate(zip(r["ctx"], r["n"])):
            p = number[c], words[r["word"] % (1 << 64)]
            n[p], tables[p] = many, r["tables"][k * py.SAMPLES:(k + 1) * py.SAMPLES]
    for r in model.rest[1].collect():
        for c in r["single"]:
            p = number[c], words[r["word"] % (1 << 64)]
            n[p], tables[p] = 1, [1] * py.SAMPLES
    assert n == customers and all(1 <= t <= n[p] for p in n for t in tables[p])
    d0, d1 = model.discounts

    def probability(u, w):
        each = []
        for k in range(py.SAMPLES):
            t_u, c_u = sum(t[k] for p, t in tables.items() if p[0] == u), sum(c for p, c in n.items() if p[0] == u)
            s_all, s_w = sum(t[k] for t in tables.values()), sum(t[k] for p, t in tables.items() if p[1] == w)
            root = (s_w - d0) / (1 + s_all) if w in count else (1 + d0 * len(count)) / (1 + s_all)
            own = n[u, w] - d1 * tables[u, w][k] if (u, w) in n else 0
            each.append((own + (1 + d1 * t_u) * root) / (1 + c_u))
        return sum(each) / len(each)

    assert abs(sum(probability("rare1", w) for w in [*count, "never"]) - 1) < 1e-9 and probability("rare1", "rare2") > 5 * probability("w0", "rare2")
    for i, text in data[:30] + data[-6:]:
        assert abs(got[i]["score"] - sum(math.log10(probability(*p)) for p in pairs(tokens(text)))) < 1e-8
        assert got[i]["n_known"] == sum(w in count for w in tokens(text))
    # the last pass moves the customers from where the pass before left them
    s = py.Seats(table.toArrow().combine_chunks().to_batches()[0], model.frequent)
    assert (py.sampled(s, before, py.PASSES - 1, py.SAMPLES) == s.tables).all()


def test_a_pass_goes_on_with_the_seating_of_the_one_before(monkeypatch):
    names = ["word", "spread", "ctx", "n", "alone", "own", "seating"]
    u = int(py.own_context(np.array([9], np.uint64))[0])
    batch = pa.RecordBatch.from_arrays([pa.array([5, 7, 8]), pa.array([0, 2, 0], pa.int32()), pa.array([[u, 1, 2], [1], [1]]), pa.array([[4, 1, 6], [5], [3]]), pa.array([2, 0, 0]),
                                        pa.array([[11], [], []]), pa.array([[3, 1, 2, 2, 2], [5], [1, 1, 1]])], names=names)
    s = py.Seats(batch, np.array([7], np.uint64))
    model = py.Model(20, 4, np.array([7], np.uint64), np.array([5]), None, (0.6, 0.7), np.array([[3, 4, 5]]), np.array([[6]]), (1.0, 1.0), True, np.array([3]))
    assert s.own.tolist() == [11, 0, 0, 0, 0] and s.per_word(np.ones(5)).tolist() == [5, 1, 1] and model.root_total().tolist() == [15]
    ends, sweep, mine = [], py.sweep, []
    monkeypatch.setattr(py, "sweep", lambda held, table, *_: mine.extend(held.mine) or table)
    assert list(py.gibbs(s, model, 1, sweeps=1, ends=ends))[0].tolist() == [2, 1, 3, 1, 3]
    assert ends[0].tolist() == [3, 1, 2, 2, 2, 5, 1, 1, 1] and mine[0] == 1 + 0.7 * 11
    monkeypatch.setattr(py, "sweep", sweep)
    ends.clear()
    tables = list(py.gibbs(s, model, 1, sweeps=3, ends=ends))[-1]
    at = np.cumsum(tables[s.n > 1])
    assert [int(x.sum()) for x in np.split(ends[0], at[:-1])] == s.n[s.n > 1].tolist() and tables[1] == 1
