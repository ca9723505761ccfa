"""Licence scan by digests of canonical texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, applied in this order to lower-case words.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("merchantable", "merchantability"), ("favour", "favor"), ("honour", "honor"), ("programme", "program"),
    ("judgement", "judgment"), ("noncommercial", "non commercial"), ("copyleft", "copy left"), ("https", "http"),
)

# Known licence texts and notices.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)

COPYRIGHT = r"(?m)^[ \t]*(?:copyright[ \t]+(?:\(c\)|\x{00A9}|[0-9])|(?:\(c\)|\x{00A9})[ \t]*[^ \t\n]).*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, only words (ASCII letters, digits, all that is not ASCII), one spelling, single spaces."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    plain = F.regexp_replace(bare, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    respelt = plain
    for other, usual in SPELLINGS:
        respelt = F.regexp_replace(respelt, rf"\b{other}\b", usual)
    return F.trim(F.when(plain.rlike("|".join(other for other, _ in SPELLINGS)), respelt).otherwise(plain))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``license, digest`` of the known texts: one row per digest (of licences that share one, the first by name)."""
    rows = spark.createDataFrame(list(known), "license string, known string")
    digested = rows.select("license", F.sha2(canonical(F.col("known")), 256).alias("digest"))
    return digested.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known=KNOWN) -> DataFrame:
    """Per row of ``docs``: ``doc_id, whole_license, notices, n_notices``.

    The texts that are looked up are the document as a whole and each of its lines that is no copyright
    line. ``whole_license`` is the licence that the document as a whole is (null: none), ``notices`` the
    sorted distinct licences of its lines, ``n_notices`` the number of lines that are one. Null and empty
    texts have none. Lines are looked up where they are read - the digests are as many as the known texts
    and are broadcast - and only the found ones, with one row per document, are brought together, so a
    notice in a third of all documents costs no more than any other. Repeated rows each get a result.
    """
    row = F.monotonically_increasing_id().alias("_row")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row, "doc_id", text.alias("_text"))
    units = rows.select(
        "_row", "doc_id", F.posexplode(F.concat(F.array("_text"), F.split("_text", "\n"))).alias("_at", "_unit")
    )
    digests = units.select("_row", "doc_id", "_at", F.sha2(canonical(F.col("_unit")), 256).alias("digest"))
    found = digests.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest", "left")
    line = F.when(F.col("_at") > 0, F.col("license"))
    return (
        found.groupBy("_row", "doc_id")
        .agg(
            F.max(F.when(F.col("_at") == 0, F.col("license"))).alias("whole_license"),
            F.array_sort(F.collect_set(line)).alias("notices"),
            F.count(line).alias("n_notices"),
        )
        .drop("_row")
    )
