"""Licence scans by canonical digests.

A text is normalised (case, punctuation, blanks, copyright lines, equivalent spellings), hashed whole,
and hash-joined with the digests of known licence texts, normalised alike. The same digests, taken
line by line, find one-line notices. Only built-in column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm.common import join_small, written

# Spellings that count as one (after normalising), in the order in which they are replaced
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"),
    ("copyright holder", "copyright owner"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("http ", "https "),
)

# Licence texts and one-line notices
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("BSD-2-Clause", _BSD_START + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

# Licences whose complete texts are long, by the digest of the canonical text; see catalogue()
DIGESTS = (
    ("Apache-2.0", "a1299c9b9de23b00ccea4d3bf75e90110953f7e4ed1b84818f617ad01246122a"),
    ("Artistic-1.0-Perl", "495aba19bfedb25e137dc0dc9dde107c0da8c1f5123cded10d771d367a8aef37"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "dc0a69dd77c36ecefaab939fe6f1fe20d430b27b4bba90820623760aadc9d0be"),
    ("GFDL-1.3", "f63115b17c1c179670bd2984927f637d14545c9ad5ef5b33ab30f5073f67a635"),
    ("GPL-1.0", "88c0d32b6685976f91edcbb228c50498a7324b47880b82b90b4b86377ca82e38"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "0aaa86fd25a52aa4d43fba9feecd7c73f21a0b232037da11fedeabd5babb7cd7"),
    ("LGPL-2.0", "b193ad3e0908ce27a234020cc38efba99fefb131c150be86b368fbcf068dc04a"),
    ("LGPL-2.1", "7d096c8ec643b008f56673cda2c781b4fc87127b9c731830f73f13a9f5a84a88"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
)

COPYRIGHT = r"^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
OTHER = r"[^\p{L}\p{N}\n]+"
#: In a wrapped licence text a line can begin with 'copyright' without being a notice.
PROSE = r"(?![^\p{L}\p{N}\n]*(?:$|(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|and|or|in|of|to|is|as)\b))"
NOTICE = COPYRIGHT.replace("(copyright|", "(copyright" + PROSE + "|")


def _spelled(t: Column) -> Column:
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def plain_lines(text: Column) -> Column:
    """The text without case, punctuation and notices, its lines kept apart by line feeds; null counts
    as empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    owned = F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")) | F.contains(t, F.lit("all rights reserved"))
    t = F.when(owned, F.regexp_replace(t, "(?md)" + NOTICE, "")).otherwise(t)
    return F.regexp_replace(t, OTHER, " ")


def canonical(lines: Column) -> Column:
    """The whole of plain_lines() on one line; lines are joined before spellings are replaced, so that
    it does not matter where they wrap."""
    return F.trim(_spelled(F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit(" ")), "  +", " ")))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """license_id and text of a folder of licence texts, one a file, named by its licence."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1).alias("license_id"), F.col("value").alias("text"))


def digests(texts: DataFrame) -> DataFrame:
    """license_id, digest and number of characters of known ``texts`` (license_id, text), one row per digest."""
    text = canonical(plain_lines(F.col("text")))
    return texts.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length(text)).alias("n"))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, more: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, canonical_sha256, license_id, notices.

    license_id: the licence whose text the whole document is, else null: one of ``known``, of DIGESTS or
    of ``more``, a catalogue() of any size. notices: ids of the licences of ``known`` whose text single
    lines are, distinct, sorted, comma-joined; empty if none. Null and empty texts have the digest of an
    empty text, texts of any length are digested whole. Of licences with equal texts the least id counts.
    Rows with equal or null ids are kept, repeated ones a row each; an empty table gives an empty result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    table = digests(spark.createDataFrame(list(known), "license_id string, text string"))
    found = table.collect()  # of the fixed list that was given
    every = table.select("digest", "license_id").unionByName(spark.createDataFrame([(d, i) for i, d in DIGESTS], "digest string, license_id string"))
    if more is not None:
        every = every.unionByName(digests(more).select("digest", "license_id"))
    every = written(every.groupBy(F.col("digest").alias("canonical_sha256")).agg(F.min("license_id").alias("license_id")), "licenses")
    by_digest = F.create_map(*[F.lit(x) for r in found for x in (r["digest"], r["license_id"])])
    sizes = F.array(*[F.lit(n) for n in sorted({r["n"] for r in found})])
    lines = F.filter(F.transform(F.split(_spelled(F.col("_lines")), "\n", -1), lambda x: F.trim(x)), lambda x: F.array_contains(sizes, F.length(x)))
    ids = F.filter(F.transform(lines, lambda x: F.element_at(by_digest, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = docs.select("doc_id", plain_lines(F.col("text")).alias("_lines"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("_lines")), 256).alias("canonical_sha256"), F.array_join(F.array_sort(F.array_distinct(ids)), ",").alias("notices"))
    out = join_small(rows, every, ["canonical_sha256"], F.monotonically_increasing_id())
    return out.select("doc_id", "canonical_sha256", "license_id", "notices")


def scan_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The scan as SQL over ``documents``."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        x = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), {quoted('(?m)' + COPYRIGHT)}, '', 'g'), {quoted(OTHER)}, ' ', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {quoted(a)}, {quoted(b)})"
        return x

    one = lambda x: f"trim(regexp_replace(replace({x}, chr(10), ' '), '  +', ' ', 'g'))"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    long = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(id) AS license_id FROM (SELECT sha256({one(lines('t'))}) AS digest, id FROM (VALUES {values}) k(id, t)
  UNION ALL SELECT digest, id FROM (VALUES {long}) k(id, digest)) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {lines('text')} AS l FROM documents),
notes AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT r, sha256(trim(x)) AS d FROM (SELECT r, unnest(string_split(l, chr(10))) AS x FROM docs) WHERE trim(x) <> '') JOIN known ON d = digest GROUP BY r)
SELECT doc_id, canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM (SELECT r, doc_id, sha256({one('l')}) AS canonical_sha256 FROM docs) d
LEFT JOIN known ON digest = canonical_sha256 LEFT JOIN notes USING (r)"""
