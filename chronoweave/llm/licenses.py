"""Licence scans by canonical digests (operator 8); DataFrame functions only.

A text's canonical form: lower case; lines that state a copyright are dropped;
ASCII and common typographic signs become spaces; equivalent spellings become
one; white space collapses. Known licence texts and notices are put in the same
form. SHA-256 digests are then joined by hash: a whole document with a known
text, and each of its lines with a known notice (a licence line is an entire
text too). The known table is small and fixed (KNOWN and the digests of full texts,
header lines and identifier lines in license_digests.csv), so it is a literal of
the plan: whole texts and lines are met where they are scanned.

Null texts and texts whose canonical form is empty match nothing and have a null
digest. Repeated rows are reported each. Only id and text columns are read.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, left to right.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor",
    "favourite": "favorite", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "noncommercial": "non commercial",
}
#: Licence notices and short licences, by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Known texts that a plan holds as literals; more are joined.
LITERAL = 10_000
COPYRIGHT = r"(^|\n)[ \t]*(copyright\b|\(c\)|©)[^\n]*"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r\x0b\x0c“”‘’–—•©"


def _any_spelling() -> str:
    """One pattern for all other spellings, branching on the first letter so that most words fail at once."""
    by: dict[str, list[str]] = {}
    for word in SPELLINGS:
        by.setdefault(word[0], []).append(word[1:])
    return r"\b(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + r")\b"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks kept."""

    def states(low: Column) -> Column:
        return F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))

    def spell(plain: Column) -> Column:
        usual = plain
        for other, word in SPELLINGS.items():
            usual = F.regexp_replace(usual, rf"\b{other}\b", word)
        return F.when(plain.rlike(_any_spelling()), usual).otherwise(plain)

    stated = _let(F.lower(text), lambda low: F.when(states(low), F.regexp_replace(low, COPYRIGHT, "$1")).otherwise(low))
    return _let(F.translate(stated, SIGNS, " " * len(SIGNS)), spell)


def _digest(text: Column) -> Column:
    """SHA-256 of a canonical form with its white space collapsed; null if nothing is left."""
    return _let(F.trim(F.regexp_replace(text, " {2,}", " ")), lambda t: F.when(t != "", F.sha2(t, 256)))


def known(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``digest, license_id``: canonical digests of licence texts; equal forms under the least id."""
    rows = spark.createDataFrame(texts, "license_id string, text string")
    return rows.select(_digest(F.translate(canonical_lines(F.col("text")), "\n", " ")).alias("digest"), "license_id").filter("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, whole_license, license_lines, licenses`` for every row.

    ``licenses``: ``digest, license_id`` of known texts, a digest once. Up to LITERAL
    of them are part of the plan as a hashed set, and nothing is shuffled; more are
    joined, and what travels then is a row per line that may match.
    """

    def digests(body: Column) -> Column:
        return F.struct(_digest(F.translate(body, "\n", " ")).alias("whole"), F.transform(F.split(body, "\n"), _digest).alias("lines"))

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), _let(canonical_lines(F.col(text_col).cast("string")), digests).alias("d"))
    known_ones = [(r["digest"], r["license_id"]) for r in licenses.limit(LITERAL + 1).collect()]
    if len(known_ones) <= LITERAL:
        met = _literal(rows, known_ones)
    else:
        met = _joined(rows, licenses)
    return met.select("doc_id", "digest", "whole_license", F.size("of_lines").cast("long").alias("license_lines"), F.concat_ws(",", F.array_distinct(F.array_sort(F.concat("of_lines", F.array_compact(F.array("whole_license")))))).alias("licenses"))


def _literal(rows: DataFrame, known_ones: list[tuple[str, str]]) -> DataFrame:
    """Digests met with a set of literals; the few that are in it are looked up."""
    if not known_ones:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", F.col("d.whole").alias("digest"), none.alias("whole_license"), F.array().cast("array<string>").alias("of_lines"))
    names = F.create_map(*(F.lit(x) for pair in known_ones for x in pair))
    one_of = lambda d: d.isin([digest for digest, _ in known_ones])
    of_lines = F.coalesce(F.transform(F.filter("d.lines", one_of), lambda d: F.element_at(names, d)), F.array().cast("array<string>"))
    whole = F.when(one_of(F.col("d.whole")), F.element_at(names, F.col("d.whole")))
    return rows.select("doc_id", F.col("d.whole").alias("digest"), whole.alias("whole_license"), of_lines.alias("of_lines"))


def _joined(rows: DataFrame, licenses: DataFrame) -> DataFrame:
    """Digests met by joins."""
    lines = rows.select("uid", F.explode("d.lines").alias("digest")).join(licenses, "digest")
    of_lines = lines.groupBy("uid").agg(F.collect_list("license_id").alias("of_lines"))
    whole = licenses.select("digest", F.col("license_id").alias("whole_license"))
    out = rows.select("uid", "doc_id", F.col("d.whole").alias("digest")).join(whole, "digest", "left").join(of_lines, "uid", "left")
    return out.withColumn("of_lines", F.coalesce("of_lines", F.array().cast("array<string>")))


def shipped(spark: SparkSession) -> DataFrame:
    """``digest, license_id`` of the package's data file."""
    with Path(__file__).with_name("license_digests.csv").open(newline="") as f:
        rows = [(r["digest"], r["license_id"]) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "digest string, license_id string")


def op8_licenses(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    every = known(spark).unionByName(shipped(spark)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return scan(docs, every)


def oracle() -> str:
    """The same in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        low = f"regexp_replace(lower({text}), {q(COPYRIGHT)}, '\\1', 'g')"
        plain = f"translate({low}, {q(SIGNS)}, {q(' ' * len(SIGNS))})"
        for other, usual in SPELLINGS.items():
            plain = f"regexp_replace({plain}, {q(rf'\b{other}\b')}, {q(usual)}, 'g')"
        return plain

    def digest(text: str) -> str:
        tidy = f"trim(regexp_replace({text}, ' {{2,}}', ' ', 'g'))"
        return f"CASE WHEN {tidy} <> '' THEN sha256({tidy}) END"

    values = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    return f"""
WITH kn(license_id, text) AS (VALUES {values}),
kb AS (SELECT license_id, {form("text")} AS body FROM kn),
k AS (SELECT {digest("replace(body, chr(10), ' ')")} AS digest, min(license_id) AS license_id FROM kb GROUP BY 1),
d AS (SELECT row_number() OVER () AS uid, doc_id, {form("text")} AS body FROM documents),
dd AS (SELECT uid, doc_id, {digest("replace(body, chr(10), ' ')")} AS digest, body FROM d),
l0 AS (SELECT uid, unnest(string_split(body, chr(10))) AS line FROM d),
l AS (SELECT uid, {digest("line")} AS line_digest FROM l0),
f AS (SELECT uid, license_id FROM l JOIN k ON l.line_digest = k.digest),
n AS (SELECT uid, count(*) AS license_lines FROM f GROUP BY 1),
e AS (SELECT uid, license_id FROM f UNION SELECT uid, license_id FROM dd JOIN k USING (digest)),
s AS (SELECT uid, string_agg(license_id, ',' ORDER BY license_id) AS licenses FROM e GROUP BY 1)
SELECT doc_id, digest, license_id AS whole_license, coalesce(license_lines, 0) AS license_lines, coalesce(licenses, '') AS licenses
FROM dd LEFT JOIN k USING (digest) LEFT JOIN n USING (uid) LEFT JOIN s USING (uid)"""
