"""Licence scan by canonical digests.

A text, and each of its lines, is brought to a canonical form: A-Z lower-cased, punctuation
taken as spaces, equivalent spellings replaced, runs of spaces joined, copyright lines and the
licence's title left out of the whole text. The digest of the form is joined with the digests of known licence texts and
notices, brought to the same form. All of it is DataFrame functions; the known side is a fixed
list, so the join is a broadcast of a few dozen digests and nothing is shuffled.

Defined results: null and empty texts, and texts without letters or digits, match nothing;
repeated rows are reported each; a licence that stands as the whole text and also as its only
line is reported for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import FULL

#: Characters taken as spaces.
PUNCTUATION = ".,;:!?\"'()[]{}<>*#/\\|_=+~`^&%$@-\t\r\x0b\x0c ‘’“”–—"
#: Spellings that count as the same (left: found, right: canonical), after punctuation went.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("judgement", "judgment"), ("organisation", "organization"),
    ("organise", "organize"), ("merchantibility", "merchantability"), ("whilst", "while"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
    ("http www", "www"), ("https www", "www"), ("fulfil ", "fulfill "), ("per se", "perse"), ("redistribution s", "redistributions"),
    ("https ", "http "),
]
def _other_word(words: list[str]) -> str:
    """Pattern of a word, with the end behind it, that is none of ``words``; without look-ahead, which not every engine has."""
    def rest(tails: list[str], first: bool) -> str:
        heads = sorted({t[0] for t in tails if t})
        if not heads:
            return "[^ ]+"
        ways = [f"[^ {''.join(heads)}][^ ]*", *[h + rest([t[1:] for t in tails if t[:1] == h], False) for h in heads]]
        return f"({'|'.join(ways)})" + ("" if first or "" in tails else "?")
    return rest(words, True) + "( .*)?$"


#: Words behind which "copyright", or "(c)", at a line's start is part of a sentence.
_PROSE = ("also and are as disclaimer doctrine doctrines for holder holders if in interest interests is law laws license licenses like line "
          "notice notices of on or owner owners ownership patent permission protection statement statements those to treaty").split()
_ITEM = "a accompany all an any each for if in on prohibiting such the this to under when you".split()
#: Canonical lines that name the licence or its publisher's address.
_TITLE = ("^(the )?((mit|mit x11|x11|expat|isc|zlib|zlib libpng|0bsd|bsd|bsd zero clause|zero clause bsd|bsd [023] clause|[23] clause bsd|new bsd|"
          "revised bsd|modified bsd|simplified bsd|bsd 3 clause new or revised|bsd 2 clause simplified|apache|gnu|gnu (lesser |affero )?general public) )?"
          "license( mit| expat| isc| zlib| 0bsd| bsd)?$|^(mit|isc|zlib|0bsd)$|^apache license version 2 0( january 2004)?$|^version 2 0 january 2004$|"
          "^(http )?www apache org licenses$|^(gnu (lesser |affero )?general public license )?version (2 june 1991|2 1 february 1999|3 29 june 2007)$|"
          "^mozilla public license (version )?2 0$|^(51 franklin|59 temple|675 mass) .* usa$")
#: Canonical lines that state a copyright, or only name the licence, and are left out of whole texts.
COPYRIGHT_LINE = (f"^(©|c )? ?(copyright|copr)( c| ©| by)? ?([0-9]|year|yyyy|name|the author).*$|^(©|c) ?[0-9]{{4}}.*$|^all rights reserved$|"
                  f"^(©|c )? ?(copyright|copr) {_other_word(_PROSE)}|^© ?[^ ].*$|^c {_other_word(_ITEM)}|{_TITLE}")

# Known notices and licence texts, as their publishers word them.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of
this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution."""),
    *FULL,
]


def canonical(line: Column) -> Column:
    """The canonical form of a text without line breaks."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    c = F.translate(line, upper + PUNCTUATION, lower + " " * len(PUNCTUATION))
    c = F.trim(F.regexp_replace(c, " +", " "))
    for found, same in SPELLINGS:
        c = F.replace(c, F.lit(found), F.lit(same))
    return c


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical)


def whole_form(lines: Column) -> Column:
    """Canonical form of the whole text: its canonical lines without copyright lines."""
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE)), " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(known, "licence string, text string")
    rows = rows.select("licence", whole_form(canonical_lines(F.col("text"))).alias("form"))
    return rows.where(F.col("form") != "").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] | None = None, text: str = "text",
                  key: str = "doc_id") -> DataFrame:
    """One row per match: key, unit ('text' or 'line'), line (from 0; -1 for the text) and licence."""
    digests = known_digests(docs.sparkSession, KNOWN if known is None else known)
    lines = docs.select(key, canonical_lines(F.col(text)).alias("_lines"))
    units = lines.select(key, F.posexplode(F.concat(F.array(whole_form(F.col("_lines"))), F.col("_lines"))).alias("_at", "_form"))
    hits = units.where(F.col("_form") != "").withColumn("digest", F.sha2("_form", 256)).join(F.broadcast(digests), "digest")
    return hits.select(key, F.when(F.col("_at") == 0, "text").otherwise("line").alias("unit"),
                       (F.col("_at") - 1).cast("long").alias("line"), "licence")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    def form(x: str) -> str:
        up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        marks = " || ".join(_quoted(c) if c.isprintable() and c != " " else f"chr({ord(c)})" for c in PUNCTUATION)
        c = f"trim(regexp_replace(translate({x}, {_quoted(up)} || {marks}, {_quoted(low + ' ' * len(PUNCTUATION))}), ' +', ' ', 'g'), ' ')"
        for found, same in SPELLINGS:
            c = f"replace({c}, {_quoted(found)}, {_quoted(same)})"
        return c

    def forms(table: str, cols: str) -> str:
        return (f"SELECT {cols}, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {form('x')}) AS lines FROM {table}")

    whole = (f"array_to_string(list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(COPYRIGHT_LINE)})), ' ')")
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in (KNOWN if known is None else known))
    return f"""
WITH known(licence, text) AS (VALUES {values}),
digests AS (SELECT sha256({whole}) AS digest, min(licence) AS licence FROM ({forms('known', 'licence')}) WHERE {whole} <> '' GROUP BY 1),
docs AS (SELECT *, row_number() OVER () AS rid FROM ({forms('documents', 'doc_id')})),
units AS (SELECT doc_id, 'text' AS unit, -1 AS line, {whole} AS form FROM docs
  UNION ALL SELECT doc_id, 'line', line, form FROM
    (SELECT doc_id, unnest(lines) AS form, unnest(range(len(lines))) AS line FROM docs))
SELECT doc_id, unit, CAST(line AS BIGINT) AS line, licence FROM units JOIN digests ON sha256(form) = digest WHERE form <> ''
"""
