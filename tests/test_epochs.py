"""Sub-word encoding and the classifier in epochs against plain versions."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.operators import epochs as EP
from cohortkit.operators import subword as SW
from cohortkit.session import scratch_path


@pytest.fixture(scope="module")
def vocabulary():
    return SW.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def longest(word, vocabulary):
    chars = SW.byte_characters()
    rest, out = "".join(chars[b] for b in word.encode()), []
    while rest:
        for n in range(len(rest), 0, -1):
            piece = rest[:n] + (SW.END_MARK if n == len(rest) else "")
            if piece in vocabulary:
                out.append(vocabulary[piece])
                rest = rest[n:]
                break
    return out


def test_encoding_is_longest_match(spark, vocabulary):
    rnd = random.Random(2)
    words = ["internationalisation", "éléphants", "日本語", "a", "<", "</w>", "x" * 300, "don", "🙂", "strasse"]
    words += ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 14))) for _ in range(200)]
    trie = SW.Trie(vocabulary)
    for w in words:
        assert trie.cut(w) == longest(w, vocabulary)
    texts = [(1, 0, "Ab, cd!  It's\nÉtÉ 42 abc123"), (2, 1, None), (3, None, ""), (4, 2, "word " * 600), (5, 3, "zqxjkvw" * 400)]
    df = spark.createDataFrame(texts, "sample_id long, label int, combined string")
    got = {r["sample_id"]: r for r in SW.encode_subwords(df, vocabulary).collect()}
    begin, end, padding = SW.special_ids(vocabulary)
    for i, label, text in texts:
        import regex
        ids = [x for w in regex.findall(SW.WORD, (text or "").lower()) for x in longest(w, vocabulary)][:K.MAX_TOKENS - 2]
        want = [begin, *ids, end]
        assert got[i]["input_ids"] == want + [padding] * (K.MAX_TOKENS - len(want)) and got[i]["label"] == label
        assert got[i]["attention_mask"] == [1] * len(want) + [0] * (K.MAX_TOKENS - len(want))


N_PIECES = 40


def rows_of(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        label = rnd.randint(0, 2)
        ids = [rnd.choice(range(label * 10, label * 10 + 14)) for _ in range(rnd.randint(0, 20))]
        out.append((i, label if i % 17 else None, i % 5 == 0, [N_PIECES, *ids, N_PIECES + 1] + [N_PIECES + 2] * 3))
    return out


SCHEMA = "sample_id long, label int, is_test boolean, input_ids array<int>"


def plain(rows, step_of, epochs, steps):
    """Losses by epoch and final weights of the same descent, row by row."""
    def vector(ids):
        x = np.zeros(N_PIECES + 1)
        for i in ids:
            if i < N_PIECES:
                x[i] += 1
        x = np.sqrt(x)
        if x.any():
            x /= np.sqrt((x ** 2).sum())
        x[-1] = 1
        return x

    def softmax(x, w):
        z = np.exp(x @ w - (x @ w).max())
        return z / z.sum()

    w = np.zeros((N_PIECES + 1, 3))
    m, v, t, report = np.zeros_like(w), np.zeros_like(w), 0, []
    for epoch in range(1, epochs + 1):
        losses = []
        for k, step in enumerate(EP.step_order(epoch, steps)):
            grads = []
            for i, label, is_test, ids in rows:
                if label is None or is_test or step_of[i] != step:
                    continue
                x = vector(ids)
                p = softmax(x, w)
                losses.append(-np.log(p[label]))
                grads.append(np.outer(x, p - np.eye(3)[label]))
            if grads:
                g = sum(grads) / len(grads)
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                decayed = w * 0.01
                decayed[-1] = 0
                w = w - EP.learning_rate((epoch - 1) * steps + k, epochs * steps) * (m / (1 - 0.9 ** t) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8) + decayed)
        test = [(label, softmax(vector(ids), w)) for _, label, is_test, ids in rows if is_test and label is not None]
        report.append((np.mean(losses), np.mean([-np.log(p[y]) for y, p in test]), np.mean([p.argmax() == y for y, p in test])))
    return report, w


def test_epochs_equal_a_plain_descent(spark):
    rows = rows_of(160, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    steps = 3
    path = EP.deal(df, steps)
    dealt = spark.read.parquet(path)
    assert {r["step"] for r in dealt.select("step").distinct().collect()} == {-1, 0, 1, 2}
    from cohortkit.functions import draws as D
    step_of = {r["sample_id"]: r["s"] for r in df.select("sample_id", (D.slot(D.key_md5(K.SEED, F.col("sample_id"), "step"), 0) % steps).alias("s")).collect()}
    out = scratch_path(spark, "test-epochs")
    # stopped after the first epoch, then gone on with
    EP.fit_epochs(spark, path, out, N_PIECES, 3, epochs=3, steps=steps, until=1)
    report = {r["epoch"]: r for r in EP.fit_epochs(spark, path, out, N_PIECES, 3, epochs=3, steps=steps).collect()}
    want, w = plain(rows, step_of, 3, steps)
    assert sorted(report) == [1, 2, 3]
    for k, (train, test, accuracy) in enumerate(want, 1):
        r = report[k]
        assert abs(r["train_loss"] - train) < 1e-9 and abs(r["eval_loss"] - test) < 1e-9 and abs(r["accuracy"] - accuracy) < 1e-12
    best = min(range(3), key=lambda k: want[k][1]) + 1
    assert [k for k, r in report.items() if r["is_best"]] == [best]
    assert np.abs(EP.load_state(spark, out, 3).weights - w).max() < 1e-9
    state = EP.load_state(spark, out, best)
    assert EP.evaluate(dealt.where("step = -1").select("label", "ids"), state)["loss"] == pytest.approx(report[best]["eval_loss"], abs=1e-12)
    said = {r["sample_id"]: r["predicted"] for r in EP.predict(df, state).collect()}
    assert len(said) == 160
    hits = [said[i] == label for i, label, is_test, _ in rows if is_test and label is not None]
    assert np.mean(hits) == pytest.approx(report[best]["accuracy"])


def test_no_rows(spark):
    path = EP.deal(spark.createDataFrame([], SCHEMA).unionByName(spark.createDataFrame(rows_of(3, 2)[:1], SCHEMA)), 2)
    report = EP.fit_epochs(spark, path, scratch_path(spark, "test-epochs"), N_PIECES, 3, epochs=1, steps=2).collect()
    assert [(r["epoch"], r["n_train"], r["n_test"]) for r in report] == [(1, 0, 0)]
