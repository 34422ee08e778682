"""The operators on small tables with the awkward cases, against brute-force versions."""

import base64
import hashlib
import itertools
import random
import textwrap
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortkit.llm import byte_bpe as bpe
from cohortkit.llm import exact_topk as tk
from cohortkit.llm import html_extraction as hx
from cohortkit.llm import jaccard_join as jj
from cohortkit.llm import language_id as lid
from cohortkit.llm import license_scan as lic
from cohortkit.llm import line_dedup as ld
from cohortkit.llm import packing as pk
from cohortkit.llm import quality_rules as qr
from cohortkit.llm import suffix_dedup as sd
from cohortkit.llm.components import components

DOCS = "doc_id long, text string, source string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- 1 line dedup ---

def test_line_dedup_brute(spark):
    rnd = random.Random(1)
    data = [(i, "\n".join(rnd.choice(["menu", " menu ", "", "tail", f"own {i}", f"line {rnd.randint(0, 9)}"])
                          for _ in range(rnd.randint(1, 6))), rnd.choice(["a", "a", "b", None])) for i in range(120)]
    data += [(500, None, "a"), (501, "", "a"), (502, "menu\nmenu", "a"), (502, "menu\nmenu", "a"), (503, "x\n" * 20000, "c")]
    df = spark.createDataFrame(data, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("ld_host", F.lit(1))
    got = rows(ld.line_dedup(df, "source", "text", 0.2, 3), "doc_id", "source", "n_lines", "n_dropped", "text")
    total = Counter(s for _, _, s in data)
    on = Counter((s, x) for _, t, s in data if t is not None for x in {y.strip(" ") for y in t.split("\n")} if x)
    bad = {k for k, n in on.items() if n >= 3 and n > 0.2 * total[k[0]]}
    want = []
    for i, t, s in data:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or (s, x.strip(" ")) not in bad]
        want.append((i, s, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    assert got == sorted(want, key=repr)
    assert any(w[3] for w in want)


def test_line_dedup_empty(spark):
    assert ld.line_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_url_host(spark):
    df = spark.createDataFrame([("http://A.example.com/x?y=1",), ("https://u@b.org:80",), ("no url",), (None,)], "u string")
    assert [r[0] for r in df.select(ld.url_host(F.col("u"))).collect()] == ["a.example.com", "b.org", None, None]


# --- 2 byte-level BPE ---

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts():
    rnd = random.Random(2)
    out = ["", "  ", " a  b\n\n c\t\td \x1c x\x1f\x85y  z", "a" * 3000, "don't we'll I'D", "​ 　 x", "naïve 漢字 😀 123 ", "<|endoftext|>"]
    out += ["".join(rnd.choice("ab \n\t'sé漢1😀\x1c  .!-") for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    return out + ["".join(rnd.choice("abcdeghtsin") for _ in range(rnd.randint(300, 2500))) for _ in range(10)]


def test_bpe_equals_library_and_round_trips(spark, reference):
    texts = awkward_texts() + [None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bpe_in string")
    enc = bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN)
    for r in bpe.bpe_decode(enc.withColumn("copy", F.col("ids")), PATH, public_tokenizers.PATTERN).collect():
        want = texts[r["doc_id"]] or ""
        assert r["copy"] == reference.encode_ordinary(want), repr(want[:60])
        assert bytes(r["decoded"]) == want.encode()
    for r in bpe.bpe_digests(df, PATH, public_tokenizers.PATTERN).collect():
        want = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(want)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_bpe_whole_lines_as_matches(spark, reference):
    lines = r"[^\n]+|\n+"  # matches hold blanks, so texts may not be cut at them
    other = tiktoken.Encoding("lines", pat_str=lines, mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    texts = ["two words and  more\n\nlines ", " a b\tc", "", "x" * 600 + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.bpe_encode(df, PATH, lines).collect():
        assert r["ids"] == other.encode_ordinary(texts[r["doc_id"]])


def test_bpe_groups_and_a_full_cache(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_BYTES", 40)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    with open(PATH, "rb") as f:
        coder = bpe.ByteBpe(f.read(), public_tokenizers.PATTERN)
    texts = [t.encode() for t in awkward_texts()]
    got = []
    for group in bpe._in_groups(texts):
        ids, at = coder.encode(group)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [reference.encode_ordinary(t.decode()) for t in texts]


def test_bpe_empty(spark):
    assert bpe.bpe_digests(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).collect() == []


# --- 3 quality rules ---

def brute_repeat(words):
    windows = list(zip(words, words[1:], words[2:]))
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_quality_rules(spark):
    rnd = random.Random(3)
    good = "\n".join(" ".join(f"word{rnd.randint(0, 999)}" for _ in range(9)) + "." for _ in range(12))
    data = [(1, good, "s"), (2, None, "s"), (3, "", "s"), (4, "short text.", "s"), (5, good + "\nHome | About | Contact | Help", "s"),
            (6, "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(30)), "s"), (7, "one two three " * 60 + ".", "s"),
            (8, good, "s"), (8, good, "s"), (9, "word " * 200000 + "end.", None), (10, " é\x1c " * 60 + ".", "s")]
    data += [(100 + i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 90))), "s") for i in range(40)]
    df = spark.createDataFrame(data, DOCS).withColumn("kept", F.lit("clash")).withColumn("qr_text", F.lit(1))
    got = qr.quality_rules(df, clean=True).collect()
    assert len(got) == len(data)
    texts = dict((i, t) for i, t, _ in data)
    for r in got:
        words = (texts[r["doc_id"]] or "").encode().split()
        assert r["n_words"] == len(words) and r["n_repeat_words"] == brute_repeat(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * brute_repeat(words) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    by = {r["doc_id"]: r for r in got}
    assert by[1]["kept"] and by[1]["text"] == good
    assert by[5]["kept"] and by[5]["text"] == good and by[5]["n_failed_punctuation"] + by[5]["n_failed_navigation"] == 1
    assert not by[6]["kept"] and not by[6]["base_failed"]
    assert by[7]["base_failed"] and by[2]["text"] is None and by[3]["text"] == ""
    assert qr.quality_rules(df.limit(0)).collect() == []


# --- 4 exact top-k ---

def brute_topk(data, k):
    usable = [(i, v) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    usable = sorted({(i, tuple(v)) for i, v in usable})
    out = []
    for q, v in usable:
        if q % 3 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_exact_topk(spark):
    rnd = np.random.default_rng(4)
    data = [(int(i), [float(x) for x in rnd.integers(-9, 10, 20)]) for i in range(300)]
    data += [(i, data[0][1]) for i in range(300, 340)] + [(3, data[3][1])]  # many equal vectors, a repeated row
    data += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (None, data[1][1]), (906, [1.0, 2.0]), (909, [])]
    df = spark.createDataFrame(data, "id long, vec array<double>")
    got = tk.exact_topk(df.where("id % 3 = 0"), df, 7, block_rows=50, query_block_rows=20, block_dims=6)
    assert rows(got, "query_id", "rank", "id", "score") == sorted(brute_topk(data, 7), key=repr)
    assert tk.exact_topk(df.limit(0), df.limit(0), 3).collect() == []


# --- 5 licence scan ---

def test_license_scan(spark):
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\n"
              "You may obtain a copy of the License at\n http://www.apache.org/licenses/LICENSE-2.0")
    data = [(1, "Text.\nReleased under the MIT License.", ""), (2, apache, ""), (3, None, ""), (4, "", ""),
            (5, "All rights reserved. Other. Released under the MIT License. Released under the MIT License!", ""),
            (6, "The license of a bird.", ""), (7, "x" * 500000 + ".\nLICENSED UNDER CC BY-NC 4.0.", ""), (7, "This was released under the MIT License.", "")]
    df = spark.createDataFrame(data, DOCS).withColumn("licenses", F.lit("clash"))
    got = {(r["doc_id"], tuple(r["licenses"])) for r in lic.license_scan(df).collect()}
    assert got == {(1, ("MIT",)), (2, ("Apache-2.0",)), (3, ()), (4, ()), (5, ("LicenseRef-all-rights-reserved", "MIT")), (6, ()),
                   (7, ("CC-BY-NC-4.0",)), (7, ())}
    assert lic.license_scan(df.limit(0)).collect() == []


GPL = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License "
       "as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty."
MIT = ["Copyright (c) 2020 Somebody", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
       'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
       "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
       "whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission "
       "notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS".']
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
       "conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
       "following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
       "the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of "
       "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
       "without specific prior written permission."]
NOTICES = [
    ([GPL.format(":", ",", 3), WARRANTY], ["GPL-3.0-or-later"]),
    ([GPL.format(";", ";", 2), WARRANTY], ["GPL-2.0-or-later"]),
    (["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
      "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."], ["MPL-2.0"]),
    (MIT, ["MIT"]), (BSD, ["BSD-3-Clause"]), (BSD[:3], ["BSD-2-Clause"]),
    (["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
      "provided that the above copyright notice and this permission notice appear in all copies."], ["ISC"]),
    (['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
      "You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0"], ["Apache-2.0"]),
    # a heading, a blank line and a text of its own are no sentence
    (["Permission to use, copy", "modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
      "that the above copyright notice and this permission notice appear in all copies."], []),
    (["Not all rights", "reserved seats were taken."], []),
]


def test_license_scan_whole_notices(spark):
    data, want = [], {}
    for paragraphs, licences in NOTICES:
        for width in (10000, 72, 30, 1):
            for mark, end in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), (";; ", "\n")):
                wrapped = [[mark + x for x in textwrap.wrap(p, width, break_long_words=False)] for p in paragraphs]
                text = (end + mark.rstrip() + end).join(end.join(x) for x in wrapped)
                want[len(data)] = licences
                data.append((len(data), text, ""))
    got = {r["doc_id"]: r["licenses"] for r in lic.license_scan(spark.createDataFrame(data, DOCS)).collect()}
    assert [(i, got[i], want[i], data[i][1][:80]) for i in want if got[i] != want[i]] == []
    marks = spark.createDataFrame([(1, "All rights\x02reserved. \x01All rights reserved\x01.", ""), (2, "Some rights. All\nrights reserved", "")], DOCS)
    assert [r["license_sentences"] for r in lic.license_scan(marks).orderBy("doc_id").collect()] == [["Reserved"] * 2, ["Reserved"]]


# --- 6 packing ---

def brute_bounds(hist, k):
    lengths = sorted(hist)
    best = None
    for n in range(1, min(k, len(lengths)) + 1):
        for inner in itertools.combinations(lengths[:-1], n - 1):
            bounds = [*inner, lengths[-1]]
            pad = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist.items())
            best = pad if best is None else min(best, pad)
    return best


def test_optimal_bounds():
    rnd = random.Random(6)
    for _ in range(60):
        hist = {rnd.randint(1, 40): rnd.randint(1, 20) for _ in range(rnd.randint(1, 10))}
        k = rnd.randint(1, 4)
        bounds = pk.optimal_bounds(hist, k)
        assert len(bounds) <= k and bounds[-1] == max(hist)
        assert sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist.items()) == brute_bounds(hist, k)
    assert pk.optimal_bounds({}, 3) == []


def test_pack(spark):
    data = [(i, "w " * (i % 37), "s") for i in range(200)] + [(1, "w", "s"), (None, "w w", "s"), (7000, None, "s"), (7001, "w " * 100000, "s")]
    df = spark.createDataFrame(data, DOCS).withColumn("length", F.lit("clash"))
    got = pk.pack(df, context=64, n_buckets=4, token_budget=256, rows_per_shard=10).collect()
    total = sum(len((t or "").split()) for _, t, _ in data)
    assert sum(r["length"] for r in got) == total
    places = Counter((r["bucket"], r["batch"], r["slot"]) for r in got)
    assert max(places.values()) == 1
    for bucket in {r["bucket"] for r in got}:
        size = 256 // bucket
        of = [r for r in got if r["bucket"] == bucket]
        assert sorted(r["batch"] * size + r["slot"] for r in of) == list(range(len(of)))
    assert all(0 < r["length"] <= r["bucket"] and r["padding"] == r["bucket"] - r["length"] for r in got)
    assert pk.pack(df.limit(0)).collect() == []


# --- 7 language ID ---

def segmentations(word, p):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        q = p.get(word[:k], lid.UNKNOWN if k == 1 else 0.0)
        if q:
            total += q * segmentations(word[k:], p)
    return total


def test_forward_sums_all_segmentations():
    rnd = random.Random(7)
    pieces = sorted({lid.MARK, *("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(30)), "▁a", "▁bc"})
    p = np.array([rnd.random() for _ in pieces])
    index = lid.PieceIndex(pieces)
    words = ["".join(rnd.choice("abcd") for _ in range(5)) for _ in range(50)]
    got = lid.forward(index.substrings(words), lid.with_specials(p)[:, None])[-1][:, 0]
    want = [segmentations(lid.MARK + w, dict(zip(pieces, p))) for w in words]
    assert np.allclose(got, want, rtol=1e-12)
    uses = lid.expected_counts(index, words, np.ones(len(words)), lid.with_specials(p))
    sizes = np.array([len(x) for x in pieces] + [0, 1])
    assert np.isclose((uses * sizes).sum(), sum(len(w) + 1 for w in words))  # every letter is in one piece


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    pieces = lid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    langs, p = lid.train(docs.where(~held), pieces)
    got = lid.predict(docs.where(held), pieces, langs, p).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²³ !"), (4, "the " * 100000), (4, "x" * 5000)], "doc_id long, text string")
    odd = lid.predict(odd.withColumn("score", F.lit("clash")), pieces, langs, p).collect()
    assert [r["lang_pred"] == "und" for r in sorted(odd, key=lambda r: r["doc_id"])] == [True, True, True, False, False]
    assert all(0 <= r["score"] <= 1 for r in odd)
    langs, p = lid.train(docs.limit(0), pieces)
    assert {r["lang_pred"] for r in lid.predict(docs.limit(3), pieces, langs, p).collect()} == {"und"}


# --- 8 HTML extraction ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<aside class="sidebar"><p>Side text</p></aside><article><h1>Title &eacute;&amp;</h1><p>Para  one &lt;x&gt; is <b>bold</b>er
text.</p><div class="ad">Buy now</div><form>Name <input name=q></form><!-- no --><p>Para two.<br>Line</p><p></p>
<section class="comments"><p>Nice post</p></section></article><footer>&copy; foot</footer></body></html>"""


def test_html_extraction(spark):
    data = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "no tags at all"), (5, "u", "<p>a < b <unclosed"),
            (6, "u", "<article><p>" + "long word " * 200000 + "</p>"), (1, "u", PAGE)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    weights = hx.fit_weights(df)
    got = {r["page_id"]: r for r in hx.extract_pages(df, weights).collect()}
    assert got[1]["text"] == "Title é&\nPara one <x> is bolder text.\nPara two.\nLine"
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "no tags at all"
    assert got[6]["n_chars"] == len("long word " * 200000) - 1
    assert hx.extract_pages(df.limit(0), hx.fit_weights(df.limit(0))).collect() == []


def test_html_names_that_hold_a_part_word():
    body = " ".join(f"word{i}" for i in range(40))
    inside = ('<h2 id="related-work">Related work</h2><p>One.</p><section id="social-impact"><p>Two.</p></section>'
              '<div class="ad-free"><p>Three.</p></div><h3 id="comments" class="search">On comments</h3>'
              '<div class="related-posts"><p>Gone.</p></div><div class="ad"><p>Gone.</p></div><div id="siteNav">Gone.</div>'
              '<div class="sidebar-left widget_2">Gone.</div><a class="skip-to-content">Gone.</a><div id="cookie-banner">Gone.</div>')
    weights = {f"t:{t}": -0.01 for t in "p div h2 h3 section article body a".split()} | {"w:furniture": -0.01}
    want = f"{body}\nRelated work\nOne.\nTwo.\nThree.\nOn comments"
    assert hx.extract(f"<body><article><p>{body}</p>{inside}</article></body>", weights) == want
    for name in ("content has-sidebar", "no-sidebar", "content-sidebar-wrap", "with-sidebar", "hasSidebar"):
        page = f'<body><div class="{name}"><p>{body}</p>{inside}</div></body>'
        assert hx.extract(page, weights) == want, name


def test_best_region_is_maximal():
    rnd = random.Random(8)
    for _ in range(50):
        tokens = [("w", rnd.choice("pq"), False, False, "x " * rnd.randint(1, 3)) if rnd.random() < .5 else ("t", rnd.choice("ab"), False, False, True)
                  for _ in range(rnd.randint(0, 14))]
        weights = {"w:p": 1.5, "w:q": -1.0, "t:a": -0.5, "t:b": -2.0}
        score = [weights[hx.kind_of(t)] * (len(t[4].split()) if t[0] == "w" else 1) for t in tokens]
        best = max([0.0] + [sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)])
        i, j = hx.best_region(tokens, weights)
        assert abs(sum(score[i:j]) - best) < 1e-9


# --- 9 repeated passages ---

def brute_flags(texts, length):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


def passages(seed, n=60):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdefgh é") for _ in range(k))
    shared = [word(rnd.randint(30, 120)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rnd.choice(shared)[rnd.randint(0, 9):] if rnd.random() < .5 else word(rnd.randint(0, 90)) for _ in range(rnd.randint(1, 5))]
        out.append("".join(parts))
    base = word(300)
    for _ in range(25):  # near copies
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        out.append("".join(t))
    return out + [out[0], out[0], "a" * 500, "ab" * 200, None, ""]


@pytest.mark.parametrize("group_rows", [1, 4, 256])
def test_suffix_dedup_brute(spark, group_rows):
    """Few, some and all anchors over the limit of the gathered groups: the same result."""
    length = 40
    texts = passages(9)
    df = spark.createDataFrame([(i if i % 7 else None, t, "s") for i, t in enumerate(texts)], DOCS).withColumn("n_bytes", F.lit("clash"))
    df = df.withColumn("place", F.col("doc_id")).withColumn("spans", F.lit(1))
    got = sd.suffix_dedup(df, length=length, group_rows=group_rows, collection_rows=16).collect()
    data = [(t or "").encode() for t in texts]
    want = []
    for t, gone in zip(data, brute_flags(data, length)):
        left = bytes(b for b, g in zip(t, gone) if not g)
        n = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        want.append((len(t), int(gone.sum()), n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["text"] or "") for r in got) == sorted(want)
    assert 0 < sum(w[1] for w in want) < sum(map(len, data))


def test_matching_windows_brute():
    rnd = random.Random(13)
    for _ in range(60):
        length = rnd.randint(2, 9)
        pieces, at = [], []
        core = "".join(rnd.choice("ab") for _ in range(30))
        for _ in range(rnd.randint(1, 14)):  # aligned at the start of the core
            left, right = rnd.randint(0, 8), rnd.randint(length, 20)
            t = list("".join(rnd.choice("ab") for _ in range(left)) + core[:right])
            if rnd.random() < .4:
                t[rnd.randrange(len(t))] = "c"
            pieces.append(np.frombuffer("".join(t).encode(), np.uint8))
            at.append(left)
        at = np.array(at)
        shift = at.max() - at
        count = Counter((int(shift[k]) + i, p[i:i + length].tobytes()) for k, p in enumerate(pieces) for i in range(len(p) - length + 1))
        for k, (p, found) in enumerate(zip(pieces, sd.matching_windows(pieces, at, length))):
            for i in range(len(p)):
                same = i + length <= len(p) and count[int(shift[k]) + i, p[i:i + length].tobytes()] > 1
                assert found[i] == same


def test_suffix_dedup_empty(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], DOCS)).collect() == []


# --- 10 Jaccard join ---

def brute_classes(texts, words, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


def near_copies(seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(14):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([1, 3, 8, 20, 60, 150]))]
        for _ in range(rnd.randint(1, 14)):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 30))):
                t[rnd.randrange(len(t))] = f"z{rnd.randint(0, 50)}"
            out.append(" ".join(t[:len(t) - rnd.randint(0, 2)]).upper() if rnd.random() < .3 else "\t".join(t))
    common = " ".join(f"c{i}" for i in range(40))  # a passage that many texts share
    out += [common + " " + " ".join(f"u{rnd.random()}" for _ in range(rnd.randint(5, 90))) for _ in range(30)]
    return out + [out[0]] * 5 + [None, "", " \n ", "Word", "word", "two words", "two  WORDS"]


@pytest.mark.parametrize("words,num,den,block", [(3, 90, 100, 192), (3, 90, 100, 3), (5, 80, 100, 5), (1, 50, 100, 4)])
def test_jaccard_brute(spark, monkeypatch, words, num, den, block):
    monkeypatch.setattr(jj, "BLOCK_ROWS", block)
    texts = near_copies(10)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    got = rows(jj.jaccard_classes(df, words, num, den), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_classes(texts, words, num, den), key=repr)


def test_jaccard_odd_rows(spark):
    data = [(None, "a b c d e", ""), (5, "a b c d e", ""), (5, "a b c d e", ""), (7, "A b c d e", ""), (9, "", "")]
    got = rows(jj.jaccard_classes(spark.createDataFrame(data, DOCS), 3, 90, 100), "doc_id", "component_id")
    assert got == sorted([(None, None), (5, 5), (5, 5), (7, 5), (9, 9)], key=repr)
    assert jj.jaccard_classes(spark.createDataFrame([], DOCS), 3, 90, 100).collect() == []


def test_tree_join_finds_all_links():
    rnd = np.random.default_rng(11)
    base = [np.unique(rnd.integers(0, 2**60, rnd.integers(5, 120)).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rnd.random(len(b)) > .06], rnd.integers(0, 2**60, rnd.integers(0, 4)).astype(np.uint64), b[:1]])) for b in base for _ in range(12)]
    want = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        o = len(np.intersect1d(sets[i], sets[j]))
        if 10 * o >= 8 * (len(sets[i]) + len(sets[j]) - o):
            want.add((i, j))
    links = jj.join_blocks(list(range(len(sets))), sets, np.zeros(len(sets), bool), True, 8, 10)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    assert {tuple(sorted(x)) for x in links} <= want
    for a, b in links:
        parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in want)


def test_components(spark):
    rnd = random.Random(12)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    label = {}
    for a, b in edges:
        label.setdefault(a, {a}), label.setdefault(b, {b})
        if label[a] is not label[b]:
            label[a] |= label[b]
            for x in list(label[b]):
                label[x] = label[a]
    got = rows(components(spark.createDataFrame(edges, "a long, b long"), "test"), "node", "component")
    assert got == sorted(((k, min(v)) for k, v in label.items() if len(v) > 1), key=repr)
