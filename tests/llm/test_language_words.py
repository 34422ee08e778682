"""Words of any length and script: forward sums, expected counts and predictions against plain versions."""

import math
import random
from collections import Counter

import numpy as np

from cohortkit.llm import language_id as lid


def test_words_keep_their_letters_and_marks():
    assert lid.words_of("हिन्दी भाषा, x² 1a2b m_n É") == ["हिन्दी", "भाषा", "x", "a", "b", "m", "n", "é"]
    assert lid.words_of("Ärger²³ und Ñandú_a1") == ["ärger", "und", "ñandú", "a"]
    assert lid.words_of("語" * 70) == ["語" * 70]
    assert lid.words_of("été 123 ٣") == ["été"]


def plain_log(word, p):
    """Log of the sum over all segmentations, with scaled sums of Python floats."""
    text, sums, log = lid.MARK + word, [1.0], 0.0
    for end in range(1, len(text) + 1):
        sums.append(sum(sums[end - k] * p.get(text[end - k:end], lid.UNKNOWN if k == 1 and text[end - 1] not in p else 0.0) for k in range(1, min(end, 6) + 1)))
        if sums[-1] < 1e-200:
            sums = sums[:-6] + [x * 1e200 for x in sums[-6:]]  # the last six make the next ones
            log -= 200 * math.log(10)
    return math.log(sums[-1]) + log


def test_long_words_equal_plain_sums():
    rnd = random.Random(3)
    pieces = sorted({lid.MARK, *("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(40)), "▁a", "▁bc"})
    weights = np.array([rnd.random() + 0.01 for _ in pieces])
    weights /= weights.sum()
    p = dict(zip(pieces, weights))
    index, table = lid.PieceIndex(pieces), lid.with_specials(weights)
    words = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (1, 5, 31, 32, 33, 34, 70, 300, 2000)]
    two = np.stack([table, table[::1]], axis=1)
    scorer = lid.Scorer(pieces, two)
    scorer.add(words)
    for i, w in enumerate(words):
        want = plain_log(w, p)
        assert abs(scorer.logs[i, 0] - want) < 1e-9 * max(1, abs(want)) and scorer.logs[i, 0] == scorer.logs[i, 1]
    # both ways agree on words of any length, and expected uses cover each letter once
    for w in words[:6]:
        number = index.substrings([w])[:, :, 0]
        assert (number == index.substrings_of(w)).all()
        assert abs(lid.log_forward(number, lid._logs(table)[:, None])[-1, 0] - plain_log(w, p)) < 1e-9
    for w in words:
        uses = lid.expected_counts(index, [w], np.array([2.0]), table)
        letters = sum(u * len(x) for u, x in zip(uses, pieces)) + uses[-1]
        assert abs(letters - 2 * (len(w) + 1)) < 1e-6 * len(w)
    # the uses of a long word are the derivative of its log sum
    w, k = words[5], pieces.index("▁a") if words[5][0] == "a" else 0
    step = 1e-6
    up = dict(p) | {pieces[k]: p[pieces[k]] * (1 + step)}
    slope = (plain_log(w, up) - plain_log(w, p)) / step
    assert abs(lid.expected_counts(index, [w], np.array([1.0]), table)[k] - slope) < 1e-4


def test_prediction_equals_plain_sums(spark):
    """Two rounds of training and the prediction against sums over all segmentations, word by word."""
    rnd = random.Random(5)
    alphabets = {"x": "aab", "y": "abb"}
    docs = [(i, "".join(rnd.choice(alphabets[lang]) for _ in range(rnd.choice([4, 50]))) + " " + "".join(rnd.choice(alphabets[lang]) for _ in range(5)), lang)
            for i in range(24) for lang in [rnd.choice("xy")]]
    pieces = [lid.MARK, "▁a", "a", "b", "ab", "ba", "aab"]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, table = lid.train(df, pieces, rounds=2)
    assert langs == ["x", "y"]
    for k, lang in enumerate(langs):
        counts = Counter(w for _, t, la in docs if la == lang for w in t.split())
        p = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(2):
            uses = dict.fromkeys(pieces, 0.0)
            for w, n in counts.items():
                base = plain_log(w, p)
                for piece in pieces:  # expected uses by the slope of the log sum, exact for a product of logs
                    step = 1e-7
                    uses[piece] += n * (plain_log(w, p | {piece: p[piece] * math.exp(step)}) - base) / step
            total = sum(uses.values()) + lid.SMOOTHING * len(pieces)
            p = {x: (u + lid.SMOOTHING) / total for x, u in uses.items()}
        assert np.abs(table[:, k] - np.array([p[x] for x in pieces])).max() < 1e-4
    tables = [dict(zip(pieces, table[:, k])) for k in range(2)]
    got = {r["doc_id"]: r for r in lid.predict(df.select("doc_id", "text"), pieces, langs, table).collect()}
    for i, t, _ in docs:
        logs = [sum(plain_log(w, p) for w in t.split()) for p in tables]
        best = int(np.argmax(logs))
        assert got[i]["lang_pred"] == langs[best]
        assert abs(got[i]["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-9
