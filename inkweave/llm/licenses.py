"""Licence scans by canonical digest.

A text is brought to a canonical form - lower case, no copyright lines, no punctuation, one
spelling for words and phrases that are written in several ways, single spaces - and the digest
of the whole form is joined with those of known licence texts. Lines that are a known text by
themselves, such as notices, are found likewise. Built from SQL functions only.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import SPACES, whole_text
from inkweave.session import read_table

#: Equivalent spellings of whole words, and then of phrases, in lower case and without punctuation.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "licencee": "licensee", "licencor": "licensor", "sublicence": "sublicense", "organisation": "organization", "favour": "favor",
    "fulfil": "fulfill", "acknowledgement": "acknowledgment", "analogue": "analog", "whilst": "while", "https": "http", "authorised": "authorized", "centre": "center", "programme": "program", "recognise": "recognize",
}
PHRASES = (
    ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("gnu general public license", "gpl"),
    ("creative commons attribution noncommercial", "cc by nc"), ("creative commons attribution sharealike", "cc by sa"), ("creative commons attribution", "cc by"),
)
#: After lower-casing: a line that says who holds the copyright, not one that goes on about notices.
COPYRIGHT_LINE = (
    rf"(?m)^[{SPACES}#*/;%!.-]*(?:copyright[\x20\x09:]+(?:\(c\)|©|[0-9]{{4}}|by\b|[^\n]{{1,80}}\b(?:19|20)[0-9]{{2}}\b)|\(c\)[\x20\x09]*(?:copyright|[0-9]{{4}})|©|all rights reserved)[^\n]*$"
)
#: What every known line has; other lines aren't looked up.
LINE_HINT = "licen[cs]e|released under"
#: Known texts that are broadcast at most; more are joined by a shuffle.
BROADCAST_KNOWN = 100_000
#: Where the terms of a long text end; what follows says how to apply them.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TAIL = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Public licence texts, without their titles and copyright lines, and the notices by which texts name a licence.
KNOWN = (
    ("MIT", MIT), ("MIT", f"MIT License\n\n{MIT}"), ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("ISC", f"{ISC_HEAD}, provided that the above copyright notice and this permission notice appear in all copies.{ISC_TAIL}"), ("0BSD", f"{ISC_HEAD}.{ISC_TAIL}"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
)


def full_texts() -> list[tuple[str, str]]:
    """(license id, text) of the texts in the folder texts, whole, and up to the end of their terms where a guide follows."""
    out = []
    for f in sorted(resources.files("inkweave.llm").joinpath("texts").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            text = f.read_text(encoding="utf-8")
            cut = text.find(END_OF_TERMS)
            out += [(f.name[:-4], text)] + ([(f.name[:-4], text[: cut + len(END_OF_TERMS)]), (f.name[:-4], text[:cut])] if cut > 0 else [])
    return out


def all_known() -> list[tuple[str, str]]:
    return [*KNOWN, *full_texts()]


def canonical(text: Column) -> Column:
    """The canonical form of a text; two texts with one form have the same words of licence.

    Words stand two blanks apart while phrases are replaced, so neighbours share none.
    """
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    words = F.filter(F.split(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    one = lambda w: F.when(w.rlike("^v[0-9]+$"), F.concat(F.lit("version  "), F.substr(w, F.lit(2)))).otherwise(F.coalesce(F.try_element_at(same, w), w))
    out = F.concat(F.lit(" "), F.array_join(F.transform(words, one), "  "), F.lit(" "))
    for old, new in PHRASES:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, n, license_id) of known (license id, text) pairs; of two with one form the least id stays.

    A null or empty text has the empty form, so it makes every empty document a hit: leave it out. An
    empty list gives an empty table.
    """
    given = spark.createDataFrame(list(all_known() if known is None else known), "license_id string, text string").select("license_id", canonical(F.col("text")).alias("form"))
    return given.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("n")).agg(F.min("license_id").alias("license_id"))


def license_units(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: bool = True, hint: str | None = LINE_HINT) -> DataFrame:
    """(id, unit, digest, license_id): for each row of docs its whole text as unit 0, with a licence or null,
    and with lines each of its lines that is a known text by itself as unit 1, 2 and on.

    known has (digest, n, license_id), n the length of the form; it is broadcast up to
    BROADCAST_KNOWN rows, so no text's digest moves, and joined by a shuffle beyond that. Lines of
    any other length can't match, and those without hint (a pattern, in lower case) aren't looked
    up. Null counts as an empty text; rows without an id and repeated rows stay as they are. An
    empty table gives an empty one. Texts are read whole.
    """
    sizes = [r[0] for r in known.select("n").distinct().limit(BROADCAST_KNOWN).collect()]  # of the known texts alone
    rows = docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text"))
    found = rows.select("id", F.lit(0).alias("unit"), canonical(F.col("text")).alias("form"))
    if lines and sizes:
        given = rows.where(F.lower("text").rlike(hint)) if hint else rows
        parts = given.select("id", F.posexplode(F.split("text", "\n", -1)).alias("unit", "line"))
        parts = parts.where(F.lower("line").rlike(hint)) if hint else parts
        forms = parts.select("id", F.col("unit") + 1, canonical(F.col("line")).alias("form"))
        found = found.union(forms.where(F.length("form").isin(sizes)) if len(sizes) < BROADCAST_KNOWN else forms)
    found = found.select("id", "unit", F.sha2("form", 256).alias("digest"))
    known = known.select(F.col("digest").alias("known_digest"), "license_id")
    joined = found.join(F.broadcast(known) if known.count() <= BROADCAST_KNOWN else known, F.col("digest") == F.col("known_digest"), "left")
    return joined.where("unit = 0 or license_id is not null").select("id", "unit", "digest", "license_id")


def op5_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_units(read_table(spark, sf_dir, "documents"), known_digests(spark))
    return found.select(F.col("id").alias("doc_id"), "unit", "digest", "license_id")


def _sql_canonical(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    same = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items())
    one = f"CASE WHEN regexp_matches(w, '^v[0-9]+$') THEN 'version  ' || substr(w, 2) ELSE CASE w {same} ELSE w END END"
    out = f"' ' || array_to_string(list_transform({words}, lambda w: {one}), '  ') || ' '"
    for old, new in PHRASES:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in all_known())
    return f"""
WITH known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) v(license_id, text) GROUP BY 1),
parts AS (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1))::INTEGER AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS part FROM documents),
units AS (SELECT doc_id, 0 AS unit, coalesce(text, '') AS part FROM documents UNION ALL SELECT * FROM parts WHERE regexp_matches(lower(part), '{LINE_HINT}')),
digests AS (SELECT doc_id, unit, sha256({_sql_canonical("part")}) AS digest FROM units)
SELECT doc_id, unit, digests.digest, license_id FROM digests LEFT JOIN known USING (digest) WHERE unit = 0 OR license_id IS NOT NULL
"""


SQL = _sql()
QUERIES = {"op5_license_digest": op5_license_digest}
ORACLES = {"op5_license_digest": SQL}
