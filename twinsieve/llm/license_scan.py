"""Known licences by the digest of their canonical text (operator 9).

A text is brought into a canonical form: lower case, copyright lines dropped, equivalent
spellings unified, every run of other characters than letters and digits a space. Its
digest is joined to the digests of known licences, which went through the same. So a whole
text, or one line of it (a licence statement), is found whatever its case, punctuation,
holder and spelling are.

Built-in functions only: texts are read once, the join is on digests, and the table of known
licences is joined as Catalyst finds best by its size.

Null and empty texts have the digest of the empty text and match nothing, as do lines
without letters and digits. Known licences that come out empty are ignored. A licence given
twice is reported once; several names for one digest are reported together.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.columns import keyed, same, stored

# Spellings that count as the same, longer ones first.
SPELLINGS = {
    "copyright holders": "copyright holder",
    "copyright owner": "copyright holder",
    "organisation": "organization",
    "non-commercial": "noncommercial",
    "sub-license": "sublicense",
    "licence": "license",
    "licencs": "licens",
    "behaviour": "behavior",
    "favour": "favor",
    "honour": "honor",
    "programme": "program",
    "per cent": "percent",
    "http://": "https://",
}
# Lines that only name a holder.
COPYRIGHT_LINE = r"(?md)^[^\p{L}\p{N}\n(©]*(?:copyright\b[^\n]*[0-9]{4}|copyright (?:\(c\)|©)|\(c\)|©|all rights reserved)[^\n]*$"  # noqa: E501


def canonical(text: Column, keep_lines: bool = False) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for spelling, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    if keep_lines:
        out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
        return F.regexp_replace(out, r" *\n *", "\n")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(licenses: DataFrame) -> DataFrame:
    """(_digest, _name) of (license, text); names of one digest joined by ' OR '."""
    texts = licenses.select(F.col("license").alias("_name"), canonical(F.col("text")).alias("_canonical"))
    texts = texts.filter("_canonical != '' and _name is not null")
    digests = texts.groupBy(F.md5("_canonical").alias("_digest"))
    return digests.agg(F.array_join(F.array_sort(F.collect_set("_name")), " OR ").alias("_name"))


def license_scan(
    docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(_id, digest, license, n_license_lines, line_licenses) of every row.

    license: of the whole text, or null. line_licenses: of single lines, sorted and
    joined by commas; n_license_lines: how many different lines those are.
    """
    known = stored(known_digests(licenses), "license-known")
    rows = keyed(docs, key, text)
    # Lines first: the text is their concatenation, so that it is brought into form once.
    formed = rows.select("_id", "_fp", canonical(F.coalesce("_text", F.lit("")), keep_lines=True).alias("_c"))
    whole = F.md5(F.trim(F.regexp_replace("_c", "[ \n]+", " ")))
    lines = F.array_distinct(F.split(F.trim("_c"), "\n"))
    formed = stored(
        formed.select("_id", "_fp", whole.alias("digest"), F.transform(lines, lambda x: F.md5(F.trim(x))).alias("_lines")),
        "license-digests",
    )
    hits = formed.select("_id", "_fp", F.explode("_lines").alias("_digest")).join(known, "_digest")
    hits = hits.groupBy("_id", "_fp").agg(
        F.count_distinct("_digest").alias("_n"),
        F.array_join(F.array_sort(F.collect_set("_name")), ",").alias("_names"),
    )
    hits = stored(hits, "license-lines")
    found = formed.join(hits, same(formed, hits, "_id", "_fp"), "left").select(
        formed["_id"], "digest", "_n", "_names"
    )
    found = found.join(known, found["digest"] == known["_digest"], "left")
    return found.select(
        "_id", "digest", F.col("_name").alias("license"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_license_lines"),
        F.coalesce("_names", F.lit("")).alias("line_licenses"),
    )


# Public licence texts and usual statements.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""  # noqa: E501
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""  # noqa: E501
LICENSES = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def usual_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENSES, "license string, text string")
