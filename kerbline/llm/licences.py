"""Licence scan by canonical digest lookup.

Texts are brought to a canonical form (case, punctuation, copyright notices, equivalent spellings), hashed, and
hash-joined to the digests of known licence texts. Whole documents are looked up, and so are whole lines, which
finds short licence notices inside other documents.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import SPACE, let, literal_table

# Spellings that licence matching guidelines treat as equal, as (variant, canonical).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "wilfull"), ("noncommercial", "non commercial"), ("percent", "per cent"), ("copyright owner", "copyright holder"),
    ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("authorise", "authorize"),
]

# Known licence texts, and the short notices that name a licence.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", "MIT License\n" + _MIT), ("MIT", _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License\n" + _ISC), ("ISC", _ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]

#: Further notices, as lines.
HEADERS = [("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')]
#: Digests of the canonical forms of full texts and standard headers (``licence, digest``).
FULL_TEXTS = Path(__file__).with_name("known_licences.csv")

# A notice is copyright with a sign, a year or a holder, and ends with its line or where a licence phrase begins; words of
# licence texts that a line may begin with by its wrapping ("copyright notice", "COPYRIGHT HOLDERS", "(c) You must") are none.
_WORDS = r"notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|treaty|treaties|protection|infringement|and|or|in|is|to|of|for|with|under|that"
_PHRASE = r"\b(?i:(?:re)?licen[cs]ed (?:under|to)|released (?:under|to)|(?:re)?distributed under|(?:provided|available) under|this (?:work|software|program|file|project|library)\b|permission (?:is|to)\b|redistribution and\b|spdx-license)"
_NOTICE = (
    r"(?m)^[^\S\n]*(?:(?:(?i:copyright)[:,]?[^\S\n]*(?:(?i:\(c\)|by\b)|©|[\[<{]?(?:\d{4}\b|(?i:yyyy|year)\b))"
    rf"|(?i:copyright)[^\S\n]+(?!(?i:{_WORDS})\b)\p{{Lu}}|(?i:\(c\))[^\S\n]*(?:\d{{4}}\b|(?i:copyright)\b)|©)"
    rf"[^\n]*?(?={_PHRASE}|$)|(?i:all rights reserved)\b[.!]?)"
)


def canonical(text: Column) -> Column:
    """Copyright notices go; lower case; whatever is no letter or digit becomes one space; spellings unified."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _NOTICE, " ")
    t = F.btrim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))
    variants = F.create_map(*[F.lit(x) for v, c in SPELLINGS if " " not in v for x in (v, c)])
    phrases = [(v, c) for v, c in SPELLINGS if " " in v]
    # few texts hold a variant: only those pay for the replacement word by word
    some = r"\b(" + "|".join(v for v, _ in SPELLINGS if " " not in v) + r")\b"
    t = let(t, lambda x: F.when(x.rlike(some), F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(variants[w], w)), " ")).otherwise(x))
    for v, c in phrases:
        t = F.regexp_replace(t, rf"\b{v}\b", c)
    return t


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, in lower-case hexadecimal."""
    return F.sha2(canonical(text), 256)


def known_table(spark: SparkSession, known: list[tuple[str, str]] = KNOWN + HEADERS) -> DataFrame:
    """``digest, licence`` of the given texts and of the full texts; texts that agree in canonical form have to
    name the same licence."""
    t = literal_table(spark, known, "licence string, text string").select(digest(F.col("text")).alias("digest"), "licence")
    with FULL_TEXTS.open(newline="") as f:
        full = literal_table(spark, [(r["digest"], r["licence"]) for r in csv.DictReader(f)], "digest string, licence string")
    return t.union(full).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, licence, notices`` for every document (doc_id, text).

    ``licence`` is that of the whole text, null for none; ``notices`` are the sorted distinct licences that whole
    lines name. A null text is an empty one; texts or lines without letters or digits match nothing. Repeated rows
    get the same answer, once each. Lines meet the known digests in a hash join before anything is shuffled, and
    only lines that match go on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k = known.where(F.col("digest") != F.sha2(F.lit(""), 256))
    lines = docs.select(F.md5(text).alias("text_md5"), F.explode(F.split(text, "\n")).alias("line")).where(F.btrim("line", F.lit(SPACE)) != "")
    found = lines.select("text_md5", digest(F.col("line")).alias("digest")).join(k, "digest").groupBy("text_md5").agg(F.sort_array(F.collect_set("licence")).alias("notices"))
    d = docs.select("doc_id", F.md5(text).alias("text_md5"), digest(F.col("text")).alias("text_sha256"))
    j = d.join(k, d.text_sha256 == k.digest, "left").join(found, "text_md5", "left")
    return j.select("doc_id", "text_sha256", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
