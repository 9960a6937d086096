"""Licence scan by canonical digests.

A text is brought to a canonical form (case, equivalent spellings, copyright lines,
punctuation and white space no longer count) and its SHA-256 is joined to a table of
known digests. The unit is an entire text: the whole document, and each line as a
text of its own, which finds notices inside other prose. Built-in functions only.

Edge cases: a null or blank text has the digest of the empty text and no licence;
blank lines are no units; the line number counts from 1 in the original text;
repeated rows are reported each; two names for one digest both match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Known texts and notices, in their published wording.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
)

# Spellings that count as one; applied in order to lower-case text.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("https:", "http:"),
    ("&", " and "),
)
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t]+(?:\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©).*$"
OTHER_SIGNS = r"[^\p{L}\p{N}\n]+"
BROADCAST_DIGESTS = 100_000


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, one for each original line (blank: empty)."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.transform(F.split(F.regexp_replace(out, OTHER_SIGNS, " "), "\n"), lambda x: F.trim(x))


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """license, digest and canonical length of the known texts."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    canon = rows.select("license", whole(canonical_lines(F.col("text"))).alias("canon"))
    return canon.select("license", F.sha2("canon", 256).alias("digest"), F.length("canon").alias("length")).distinct()


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, scope, line, digest, license: a row per document (scope ``text``, line 0,
    null licence if unknown) and a row per known line (scope ``line``)."""
    table = known.select("digest", "license", "length")
    n = table.count()
    # A line can only match if its canonical length is a known one.
    lengths = [r[0] for r in table.select("length").distinct().orderBy("length").collect()] if n <= BROADCAST_DIGESTS else None
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))

    def unit(scope: str, line: Column, text: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), line.cast("int").alias("line"), F.sha2(text, 256).alias("digest"))

    numbered = F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def likely(u: Column) -> Column:
        filled = u["x"] != ""
        return filled & F.length(u["x"]).isin(lengths) if lengths else filled

    units = F.concat(
        F.array(unit("text", F.lit(0), whole(F.col("lines")))),
        F.transform(F.filter(numbered, likely), lambda u: unit("line", u["i"] + 1, u["x"])),
    )
    rows = lines.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")
    names = table.select(F.col("digest").alias("_digest"), "license")
    names = F.broadcast(names) if n <= BROADCAST_DIGESTS else names
    found = rows.join(names, F.col("digest") == F.col("_digest"), "left")
    return found.where((F.col("scope") == "text") | F.col("license").isNotNull()).select(
        "doc_id", "scope", "line", "digest", "license"
    )
