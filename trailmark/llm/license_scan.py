"""License scans: canonical digests of entire texts, hash-joined to digests of known licences.

Canonical form, in this order: lower case; copyright lines go; equivalent spellings become
one; everything but letters and digits becomes one space; trimmed. A copyright line begins with
 - the word, then a mark or a year, or a holder: not one of ``NOT_HOLDERS``, and with a mark or
   year further on, or at most eight words in all ("Copyright Alice Smith");
 - "(c)", then a year or the word, or with a year or "all rights reserved" at its end; any other
   line that begins with "(c)" is a clause of a list and stays;
 - the mark ©, or "all rights reserved".
A text matches a licence if the canonical forms are equal, whatever their case, punctuation,
line breaks and copyright holders. The same form of every line finds licence statements that
stand on a line of their own within a document.

Defined results: a null, empty or letterless text has no digest and no licence; repeated rows
each get a row; very long texts are read whole; a licence listed twice counts once (the least
id); an empty table has no rows; extra columns are not carried, whatever their names.
Only DataFrame functions run here.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Equivalent spellings after lower-casing, as whole words: (pattern, replacement), in order. Fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sub-license", "sublicense"),
    ("sub-licensable", "sublicensable"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("per cent", "percent"),
    ("organisation", "organization"),
    ("utilisation", "utilization"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("v2", "version 2"),
    ("v3", "version 3"),
]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "THIS SOFTWARE IS",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS",
    1,
)
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known licence texts and statements: (licence id, text). Fixed values.
LICENSES = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_3),
    ("Apache-2.0", APACHE_NOTICE),
    ("GPL-3.0-or-later", GPL_NOTICE),
    ("Zlib", ZLIB),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "Licensed under the GNU General Public License, Version 3."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software under the GNU General Public License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
#: Whole licences, in files of this package: (licence id, file, where its terms end if a guide to their use follows). Fixed values.
FULL_TEXTS = [
    ("Apache-2.0", "Apache-2.0", "END OF TERMS AND CONDITIONS"),
    ("GPL-2.0", "GPL-2", "END OF TERMS AND CONDITIONS"),
    ("GPL-3.0", "GPL-3", "END OF TERMS AND CONDITIONS"),
    ("LGPL-2.1", "LGPL-2.1", "END OF TERMS AND CONDITIONS"),
    ("LGPL-3.0", "LGPL-3", None),
    ("MPL-2.0", "MPL-2.0", None),
    ("CC0-1.0", "CC0-1.0", None),
]
#: Identifiers that a line may state. Fixed values.
SPDX = [
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "Zlib",
]


def known_licenses() -> list[tuple[str, str]]:
    """All texts and statements that are looked up: the list's, whole licences with and without what follows their terms, identifiers."""
    found = list(LICENSES)
    for name, file, end in FULL_TEXTS:
        text = resources.files(__package__).joinpath("licenses", f"{file}.txt").read_text(encoding="utf-8")
        found.append((name, text))
        if end and end in text:
            found.append((name, text.partition(end)[0] + end))
            found.append((name, text.partition(end)[0]))
    return found + [(x, f"SPDX-License-Identifier: {x}") for x in SPDX]

#: Words that don't begin a holder's name: what follows "copyright" in licences' own sentences. Fixed values.
NOT_HOLDERS = [
    "and", "are", "as", "by law", "claims?", "disclaimers?", "for", "holders?", "in", "infringement", "interests?", "is", "laws?", "licen[cs]es?",
    "may", "material", "notices?", "of", "on", "or", "owners?", "patents?", "permission", "protection", "shall", "statements?", "to", "under",
]
_SENTENCE = rf"(?:{'|'.join(NOT_HOLDERS)})"
_MARK = r"(?:\(c\)|©|[0-9]{4})"
_GAP = r"[^\p{L}\p{N}\n,;.)]+"


def _copyright_line(holder: str) -> str:
    """The pattern of a copyright line without its line mode; holder is how a name's first character is told."""
    named = rf"{_GAP}{holder}(?:[^\n]*{_MARK}[^\n]*|[^ \t\n]*(?:[ \t]+[^ \t\n]+){{0,7}}[ \t]*)"
    # a line that ends with the year: its holder, a short line, is the next one
    bare = rf"(?:[^\p{{L}}\p{{N}}\n]*{_MARK})+[^\p{{L}}\p{{N}}\n]*\n[^\p{{L}}\p{{N}}\n]*[\p{{L}}\p{{N}}][^ \t\n]*(?:[ \t]+[^ \t\n]+){{0,7}}[ \t]*"
    marked = rf"[^\p{{L}}\p{{N}}\n]*{_MARK}[^\n]*"
    short = r"\(c\)(?:[ \t]*(?:copyright|[0-9]{4})[^\n]*|[^\n]*(?:all rights reserved|[0-9]{4})[ \t.]*)"
    return rf"^[^\p{{L}}\p{{N}}\n]*(?:copyright(?:{bare}|{marked}|{named})|{short}|©[^\n]*|all rights reserved[^\n]*)$"


COPYRIGHT_LINE = "(?md)" + _copyright_line(rf"(?!{_SENTENCE}(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}]")
#: Only lines that say so can be a licence statement of the list.
HINT = r"licen[sc]e|free software|spdx|permission"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _apart(spelling: str) -> str:
    """A spelling as it stands among words that are two spaces apart."""
    return " " + spelling.replace(" ", "  ") + " "


def canonical(text: Column) -> Column:
    """The form that digests are taken of."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "\r\n?", "\n"), COPYRIGHT_LINE, "")
    # two spaces between words, so that each of two neighbours has its own on either side
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}-]+", "  "), F.lit(" "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(_apart(spelling)), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of a list of licence texts; as many rows as texts, whatever the input."""
    rows = F.array(*(F.struct(F.lit(a).alias("license_id"), F.lit(b).alias("text")) for a, b in licenses or known_licenses()))
    listed = spark.range(1).select(F.inline(rows))
    return listed.select(digest(F.col("text")).alias("digest"), "license_id").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, digest, license_id, line_licenses).

    license_id: of the licence whose text the entire text is, else null. line_licenses: sorted
    ids of licences whose canonical form is that of a line, none: empty. The licences are a
    list in the program, which bounds the side that is broadcast. Digests are worked out once
    and written; texts and lines are then looked up by hash joins.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    known = scratch.save(known_digests(docs.sparkSession, licenses), "known")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r\n|[\r\n]"), lambda x: F.lower(x).rlike(HINT))
    told = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest"), F.transform(lines, digest).alias("lines"))
    told = scratch.save(told, "digests")
    hits = told.select("row", F.explode("lines").alias("digest")).join(F.broadcast(known), "digest").groupBy("row").agg(F.sort_array(F.collect_set("license_id")).alias("line_licenses"))
    found = told.select("doc_id", "row", "digest").join(F.broadcast(known), "digest", "left").join(hits, "row", "left")
    return found.select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document; line_licenses as comma-separated text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).withColumn("line_licenses", F.array_join("line_licenses", ","))


def _sql_form(text: str) -> str:
    out = rf"regexp_replace(lower({text}), '\r\n?', chr(10), 'g')"
    # this dialect can't look ahead: a mark is put before words that begin no holder's name
    out = rf"regexp_replace({out}, '(?m)^([^\p{{L}}\p{{N}}\n]*copyright{_GAP})({_SENTENCE}(?:[^\p{{L}}\p{{N}}]|$))', '\1,\2', 'g')"
    line = _copyright_line(r"[\p{L}\p{N}]")
    out = f"regexp_replace({out}, '(?m){line}', '', 'g')"
    out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}-]+', '  ', 'g') || ' '"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, '{_apart(spelling)}', ' {one} ')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    """The same in DuckDB SQL."""
    listed = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_licenses())
    return f"""
    WITH listed(license_id, text) AS (VALUES {listed}),
    known AS (SELECT sha256(form) AS digest, min(license_id) AS license_id
              FROM (SELECT license_id, {_sql_form("text")} AS form FROM listed) WHERE form <> '' GROUP BY 1),
    forms AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest
              FROM (SELECT doc_id, {_sql_form("text")} AS form FROM documents)),
    lines AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\r\\n]')) AS line FROM documents),
    hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
             FROM (SELECT doc_id, sha256({_sql_form("line")}) AS digest FROM lines
                   WHERE regexp_matches(lower(line), '{HINT}')) JOIN known USING (digest) GROUP BY 1)
    SELECT f.doc_id, f.digest, k.license_id, coalesce(h.line_licenses, '') AS line_licenses
    FROM forms f LEFT JOIN known k USING (digest) LEFT JOIN hits h ON h.doc_id = f.doc_id
    """
