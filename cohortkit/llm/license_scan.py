"""Licence scan by sentence rules (DataFrame functions only).

Texts are cut into pieces at line ends and closing marks, each piece is normalised (lower case, runs of other
characters than letters and digits become one blank), and every run of consecutive pieces of one paragraph that
makes up a sentence of a fixed table of known licence sentences gives its identifier. So a sentence may be wrapped at
any word, behind comment marks too, and may hold marks of its own ("free software: you can", "v. 2.0"); lines
without a letter or digit end a paragraph. The identifiers found form a sequence, against which ordered rules are matched: a rule names the
identifiers that must follow each other, and a match consumes them, so a rule of a whole notice goes
before the rule of its first sentence.

Plan: one projection, no shuffle. The pieces stand in one string between marks, and one pattern of all known
sentences, the longest first, finds the runs. Pieces are only built for texts that hold one of the trigger
words; each known sentence holds one (checked at import), so no text is missed.

Defined cases: null or empty text has no sentence and no licence; a sentence that is not in the table
does not break a sequence (it is skipped); a licence found twice is listed once, at its first place; repeated
rows are scanned alike; other columns pass through, those named as an output are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- FIXED VALUES: known licence sentences (public licence texts and notices), normalised form ---
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "ApacheLic2",
    "licensed under the apache license version 2 0 the license": "ApacheLic2",
    "released under the apache license version 2 0": "ApacheLic2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitPerm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscPerm",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdPerm",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Plus",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "licensed under the mozilla public license version 2 0": "Mpl2Ref",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by nc sa 4 0": "CcByNcSa4",
    "licensed under cc by nd 4 0": "CcByNd4",
    "licensed under cc0 1 0": "Cc0",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "all rights reserved": "Reserved",
}

# Ordered rules: a licence and the identifiers that must follow each other.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["ApacheLic2", "ApacheUse", "ApacheCopy", "ApacheUrl"]),
    ("Apache-2.0", ["ApacheLic2", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheLic2"]),
    ("MIT", ["MitRef", "MitPerm", "MitNotice"]),
    ("MIT", ["MitPerm", "MitNotice"]),
    ("MIT", ["MitRef"]),
    ("ISC", ["IscPerm"]),
    ("BSD-3-Clause", ["BsdPerm", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdPerm", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["Gpl3Plus"]),
    ("GPL-2.0-or-later", ["Gpl2Plus"]),
    ("GPL-3.0", ["Gpl3Ref"]),
    ("GPL-2.0", ["Gpl2Ref"]),
    ("LGPL-3.0", ["Lgpl3Ref"]),
    ("AGPL-3.0", ["Agpl3Ref"]),
    ("MPL-2.0", ["Mpl2Ref"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa4"]),
    ("CC-BY-ND-4.0", ["CcByNd4"]),
    ("CC0-1.0", ["Cc0"]),
    ("LicenseRef-all-rights-reserved", ["Reserved"]),
]

# Every known sentence holds one of these, as a part of a word.
TRIGGERS = "licen|copyright|permi|redistribut|rights reserved"
# A sentence ends at a line end, or at one of these marks before white space or the end.
SENTENCE_END = r"[.!?;:]+[ \t\r\n]+|[.!?;:]+$|\n"
# --- end of fixed values ---

assert all(re.search(TRIGGERS, s) for s in SENTENCES), "a known sentence without a trigger word"

CUT, BREAK = "\x02", "\x01"  # stand between pieces and between paragraphs
# a line end and the lines after it that hold no letter or digit
PARAGRAPH_END = r"\n(?:[^a-z0-9\n]*\n)+"
KNOWN = CUT + "(" + "|".join(
    s.replace(" ", f"[ {CUT}]") for s in sorted(SENTENCES, key=len, reverse=True)) + f")(?={CUT})"


def pieces(text: Column) -> Column:
    """The normalised pieces of ``text`` as one string: each stands between two ``CUT``, paragraphs are parted by
    ``BREAK``."""
    own = F.regexp_replace(F.lower(text), f"[{CUT}{BREAK}]", "_")
    cut = F.regexp_replace(F.regexp_replace(own, PARAGRAPH_END, f"\n{BREAK}"), SENTENCE_END, CUT)
    words = F.regexp_replace(cut, f"[^a-z0-9{CUT}{BREAK}]+", " ")
    merged = F.regexp_replace(F.concat(F.lit(CUT), words, F.lit(CUT)), f" *{CUT}[ {CUT}]*", CUT)
    return F.regexp_replace(merged, f"[ {CUT}]*{BREAK}[ {CUT}{BREAK}]*", CUT + BREAK + CUT)


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of ``text``, in order."""
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    runs = F.regexp_extract_all(pieces(text), F.lit(KNOWN), F.lit(1))
    known = F.transform(runs, lambda s: F.try_element_at(table, F.translate(s, CUT, " ")))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.lower(text).rlike(TRIGGERS), known), none)


def match_rules(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """The licences whose rule matches the identifier sequence, in order of their first match."""
    # each identifier stands between two blanks of its own, so a literal replacement matches whole ones
    marked = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    for licence, wanted in rules:
        marked = F.replace(marked, F.lit(" " + "  ".join(wanted) + " "), F.lit(f" ={licence} "))
    found = F.filter(F.split(F.trim(marked), " +"), lambda x: x.startswith("="))
    return F.array_distinct(F.transform(found, lambda x: F.substr(x, F.lit(2))))


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``license_sentences`` (identifiers in order) and ``licenses`` (distinct, in order)."""
    return docs.withColumn("license_sentences", sentence_ids(F.col(text))).withColumn(
        "licenses", match_rules(F.col("license_sentences")))
