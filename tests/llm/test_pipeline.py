"""The pipeline against a brute-force version, and on the awkward cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from test_operators import brute_classes

import corpus_pipeline as cp
from cohortkit.llm import line_dedup as ld
from cohortkit.llm import packing as pk
from cohortkit.llm import quality_rules as qr

DATA = "/root/testdata/sf0.001"


def brute(docs):
    """Texts by doc_id after all stages but the last; ``docs`` is a list of (doc_id, text, source)."""
    kept = [(i, m["clean_text"].decode(), s) for i, t, s in docs if (m := qr.measure(t.encode()))["kept"]]
    total = Counter(s for _, _, s in kept)
    on = Counter((s, x) for _, t, s in kept for x in {y.strip(" ") for y in t.split("\n")} if x)
    bad = {k for k, n in on.items() if n >= ld.MIN_PAGES and n > ld.RATIO * total[k[0]]}
    kept = [(i, "\n".join(x for x in t.split("\n") if not x.strip(" ") or (s, x.strip(" ")) not in bad)) for i, t, s in kept]
    kept.sort()  # so the first of a class is that of the smallest id
    classes = brute_classes([t for _, t in kept], 5, 80, 100)
    kept = [x for x, (place, _, first) in zip(kept, classes) if place == first]
    return {i: t for (i, _), t in zip(kept, brute_passages([t for _, t in kept], 50))}


def brute_passages(texts, n):
    """Texts without the words of ``n``-word strings that stand elsewhere too, and what is between them."""
    words = [list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", t)) for t in texts]
    strings = [[tuple(w.group() for w in ws[k:k + n]) for k in range(len(ws) - n + 1)] for ws in words]
    counts = Counter(x for s in strings for x in s)
    out = []
    for t, ws, found in zip(texts, words, strings):
        gone = [False] * len(ws)
        for k, x in enumerate(found):
            if counts[x] > 1:
                gone[k:k + n] = [True] * n
        kept, at = "", 0
        for k, w in enumerate(ws):
            if gone[k] and (k == 0 or not gone[k - 1]):
                kept += t[at:w.start()]
            if gone[k]:
                at = w.end()
        out.append(kept + t[at:])
    return out


def test_pipeline_brute(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()])
    for name, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = cp.stored(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
    got = {r["doc_id"]: r for r in docs.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    packed = cp.run(spark, DATA).collect()
    lengths = Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == Counter({i: n for i, t in want.items() if (n := len(t.encode().split()))})
    hist = Counter(r["length"] for r in packed)
    assert sorted({r["bucket"] for r in packed}) == pk.optimal_bounds(hist)


CLASHES = ["n_words", "spans", "kept", "n_bytes", "sd_key", "sd_text", "sd_of", "qr_text", "ld_x", "ld_host", "n_lines", "a.b", "column_0", "sd key"]


def test_stages_on_awkward_rows(spark):
    text = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text + " more words here.", "en", "s", 1),
            (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, " ".join(f"other{i}" for i in range(20000)) + ".", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name in CLASHES:
            docs = docs.withColumn(name, F.lit(f"own {name}"))
        for name, stage in cp.STAGES[:-1]:
            columns = docs.columns
            docs = cp.stored(stage(spark, docs, DATA), f"test-{name}")
            assert docs.columns == columns, name
            got = docs.collect()
            assert all(r[c] == f"own {c}" for r in got for c in CLASHES), name
            if data and name == "near_duplicates":
                assert sorted((r["doc_id"] for r in got), key=repr) == [1, 5, None]
        cp.STAGES[-1][1](spark, docs, DATA).collect()


def test_passages_of_over_fifty_words_go(spark):
    """Whatever their bytes; shorter ones and clean texts stay."""
    rnd = random.Random(8)

    def words(n, most):
        return ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, most))) for _ in range(n)]

    passages = [words(51, 4), words(51, 9), words(60, 5), words(49, 9), words(400, 6)]
    sizes = [len(" ".join(p).encode()) for p in passages]
    assert sizes[0] < 200 and sizes[1] < 400
    texts = []
    for k in range(40):
        body = words(rnd.randint(5, 200), 12)
        at = rnd.randint(0, len(body))
        passage = passages[k % len(passages)] if k < 30 else []
        texts.append(" ".join(body[:at]) + rnd.choice([" ", "\n", " \t"]) + rnd.choice([" ", "\n"]).join(passage) + "\n" + " ".join(body[at:]))
    texts.append(" ".join(["again"] * 60))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in cp.passage_stage(spark, docs, DATA).collect()}
    assert got == dict(enumerate(brute_passages(texts, 50)))
    for k in range(40):
        words_left = got[k].split()
        if k < 30 and k % 5 != 3:
            assert passages[k % 5][25] not in words_left or len(words_left) < len(texts[k].split())
        else:
            assert got[k] == texts[k]


def test_copied_documents_keep_their_text(spark):
    """Copies and near copies of a document, each a third of a source, are no boilerplate of it; its menu is."""
    def line(name):
        return " ".join(f"{name}{i}" for i in range(12)) + "."

    body = [line(f"copied{k}x") for k in range(8)]
    near = [line(f"near{k}x") for k in range(12)]
    texts = ["\n".join(body)] * 20
    texts += ["\n".join([*near[:k % 12], f"{near[k % 12]} Edit {k}.", *near[k % 12 + 1:], line("menu")]) for k in range(20)]
    texts += ["\n".join([line(f"own{k}x"), line(f"more{k}x"), line("menu")]) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = cp.stored(cp.line_stage(spark, docs, DATA), "test-copies-lines")
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x != line("menu")) for i, t in enumerate(texts)}
    left = {r["doc_id"] for r in cp.near_duplicate_stage(spark, found, DATA).collect()}
    assert left == {0, 20, *range(40, 60)}


def test_five_copies_in_a_small_source(spark):
    rows = [(i, "one text\nof two lines" if i < 5 else f"text {i}\nof its own {i}", None) for i in range(49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in cp.line_stage(spark, docs, DATA).collect()} == {i: t for i, t, _ in rows}


LONG = " ".join(f"word{i}" for i in range(60))
CLEAN_LINES = [
    f"{LONG}, as one could read more about in a book that was powered by nothing.",
    f"{LONG}; terms of use were never read.",
    f"Il a dit « bonjour » et puis « bonsoir » avant de partir, {LONG}.",
    f"Она сказала «да», а он ответил «нет», {LONG}.",
    f"La col·lecció i la intel·ligència, el col·legi, {LONG}.",
    f"{LONG} | {LONG.replace('word', 'more')} | {LONG.replace('word', 'other')}.",
    f"»Ja«, sagte sie, »nein« sagte er, {LONG}.",
]
FURNITURE_LINES = [
    "Home | About | Contact us | Imprint and more | Legal notes of ours | Help for all.",
    "Start » News » Sports » Football results of the last week and all before it.",
    "Start · News · Sports · Football results of the last week and the next.",
    "We use cookies on this site, see our privacy policy and our terms of use.",
    "All rights reserved.", "Click here to sign up for the letter that we send each week.",
    f"Home | {' | '.join(f'item{i}' for i in range(14))} | {LONG}.",
]


def test_long_clean_lines_stay(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(CLEAN_LINES)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in cp.quality_stage(spark, docs, DATA).collect()} == dict(enumerate(CLEAN_LINES))


def test_furniture_lines_go(spark):
    body = "\n".join(f"{' '.join(f'{c}{i}' for i in range(40))}." for c in "abcdefghijkl")
    docs = spark.createDataFrame([(i, f"{x}\n{body}") for i, x in enumerate(FURNITURE_LINES)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in cp.quality_stage(spark, docs, DATA).collect()} == dict.fromkeys(range(len(FURNITURE_LINES)), body)
