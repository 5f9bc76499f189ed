"""Licence scans: canonical digests of whole texts, and of their lines, joined to known licences.

A text is brought to canonical form (lower case, no copyright lines, no punctuation, single spaces,
one spelling for words that count as the same) and hashed; licences become known by the same
digest. Only DataFrame functions are used. The join is on the digest, so the number of licences
doesn't matter.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.once import once

# Spellings that count as the same (fixed values, after the public SPDX matching guidelines).
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright holder": "copyright owner", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "sub licence": "sublicense",
    "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Known notices and licences (fixed values: their public wording).
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["SPDX-License-Identifier: ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
}

_COPYRIGHT = "(?mi)^\\W*(?:copyright\\b|\\(c\\)|©|all rights reserved).*$"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null stays null. The costlier steps run only where they find something."""
    lowered = F.lower(text)
    without = F.when(lowered.rlike("copyright|\\(c\\)|©|all rights reserved"), F.regexp_replace(lowered, _COPYRIGHT, " ")).otherwise(lowered)
    plain = F.trim(F.regexp_replace(without, "[^\\p{L}\\p{N}]+", " "))
    spelled = F.concat(F.lit(" "), plain, F.lit(" "))
    for other, one in EQUIVALENT.items():
        spelled = F.replace(spelled, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.when(plain.rlike(rf"\b(?:{'|'.join(EQUIVALENT)})\b"), F.trim(spelled)).otherwise(plain)


def known_texts() -> list[tuple[str, str]]:
    """Licence and text of the notices above and of the full public texts in ``licence_texts``, named by licence."""
    folder = resources.files("tilespark.llm") / "licence_texts"
    full = sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))
    return [(k, t) for k, ts in NOTICES.items() for t in ts] + full


def known_licences(spark: SparkSession) -> DataFrame:
    """``licence, text`` of all known texts."""
    return spark.createDataFrame(known_texts(), "licence string, text string")


def licence_digests(known: DataFrame) -> DataFrame:
    """``digest, licence``: of each text; the first licence by name where texts are canonically alike."""
    form = known.select(F.col("licence"), canonical(F.col("text")).alias("form")).filter(F.col("form") != "")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_digest, whole_licence, licences, n_notices`` per row of ``docs``.

    ``text_digest`` is the canonical digest of the entire text and ``whole_licence`` the licence that it
    is; ``licences`` (sorted) and ``n_notices`` come from its distinct lines, each looked up like a
    text. Null and empty texts have the digest of the empty text and no licence. Repeated rows
    are scanned one by one. An empty table gives no rows; no known licences, no findings. Other
    columns are not read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{doc_id}`").alias("doc_id"), body.alias("body"))
    lines = F.filter(F.array_distinct(F.split("body", "[\\r\\n]+")), lambda x: F.length(F.trim(x)) > 0)
    units = F.concat(F.array(F.col("body")), F.when(F.instr("body", "\n") > 0, lines).otherwise(F.array().cast("array<string>")))
    units = rows.select("_row", "doc_id", F.posexplode(units).alias("_at", "unit"))
    units = once(units, "form", canonical(F.col("unit"))).select("_row", "doc_id", "_at", F.sha2("form", 256).alias("digest"))
    names = licence_digests(known).select(F.col("digest").alias("_digest"), "licence")
    found = units.join(names, F.col("digest") == F.col("_digest"), "left")
    line = F.col("_at") > 0
    whole = F.col("_at") == 0
    return found.groupBy("_row").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.when(whole, F.col("digest"))).alias("text_digest"), F.max(F.when(whole, F.col("licence"))).alias("whole_licence"),
        F.array_sort(F.collect_set("licence")).alias("licences"), F.count(F.when(line, F.col("licence"))).alias("n_notices")).drop("_row")
