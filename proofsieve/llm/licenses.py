"""Licence scan by canonical digests, in DataFrame functions alone.

A text and each of its lines are brought to a canonical form: A-Z in lower case, punctuation to spaces, spaces collapsed, lines of copyright
holders dropped, the lines of a text joined, and then equivalent spellings unified, so that line breaks don't matter. The SHA-256 of an entire canonical text, or of
an entire line, is hash-joined to the digests of the known licences and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, the second taken; applied in this order to canonical words.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("authorise", "authorize"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"), ("favour", "favor"), ("judgement", "judgment"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ©‘’“”–—", "abcdefghijklmnopqrstuvwxyzC      "
#: Everything but ASCII letters, digits and non-ASCII characters. The C stands for the copyright sign.
PUNCTUATION = r"[^a-zC0-9\x{80}-\x{10FFFF}]+"
#: A canonical line that names a copyright holder.
HOLDER = r"^(copyright( [cC])?( by)?|[cC]) ([0-9]{4}|yyyy|year)( .*)?$|^copyright ([cC]|by) .*$|^C .*$|^all rights reserved$"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Names as people write them, for notices.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "the MIT license (MIT)"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPLv3"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "GPLv2"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "ISC": ["the ISC License"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
}
NOTICES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This project is licensed under {}.", "This file is licensed under {}."]
TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("0BSD", ZERO_BSD), ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_HEAD + BSD_TAIL), ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL), ("Zlib", ZLIB),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD.replace("copyright holder", "University") + BSD_TAIL.replace("COPYRIGHT HOLDERS", "REGENTS").replace("COPYRIGHT HOLDER", "REGENTS")),
    ("Apache-2.0", APACHE_HEADER), ("GPL-3.0", GPL_HEADER.format(v=3)), ("GPL-2.0", GPL_HEADER.format(v=2)),
]


#: Canonical digests and lengths of long licences as they are published; twice where the terms are also copied without
#: what follows "END OF TERMS AND CONDITIONS".
LONG = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", 9887),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64", 8843),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", 19583),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", 22018),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", 9387),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", 14455),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", 30940),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", 22249),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", 23337),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", 22447),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d", 14342),
]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): whole texts, headers, notices by every name, and SPDX lines."""
    notices = [(license, form.format(name)) for license, names in NAMES.items() for name in names for form in NOTICES]
    return [*TEXTS, *notices, *((license, f"SPDX-License-Identifier: {license}") for license in NAMES)]


def plain_line(line: Column) -> Column:
    """A line's words, empty if it names a copyright holder."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), PUNCTUATION, " ")), HOLDER, "")


def spelled(words: Column) -> Column:
    """Words with equivalent spellings unified."""
    for other, one in SPELLINGS:
        words = F.replace(words, F.lit(other), F.lit(one))
    return words


def canonical(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``lines``, the canonical lines, and of the entire text ``digest`` and ``size``, that of its canonical form and its length."""
    plain = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), plain_line)
    whole = spelled(F.array_join(F.filter("plain", lambda x: x != ""), " "))
    return df.withColumn("plain", plain).withColumns({"lines": F.transform("plain", spelled), "digest": F.sha2(whole, 256), "size": F.length(whole)}).drop("plain")


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None, long: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(digest, license, size) of the known texts, each digest once; ``size`` is the length of the canonical text. ``long`` has such rows ready."""
    given = canonical(spark.createDataFrame(texts if texts is not None else known_texts(), "license string, text string"), "text")
    ready = spark.createDataFrame(long if long is not None else LONG if texts is None else [], "license string, digest string, size int")
    rows = given.select("license", "digest", "size").union(ready)
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("size").alias("size"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest, license (of the entire text, or null), n_notices (lines that are entirely a known text) and notices
    (their licences, distinct and sorted, joined by commas) for each row of ``docs``.

    Null texts count as empty; empty texts, and texts of nothing but punctuation, have the digest of the empty text and no licence. Repeated rows
    have equal results; null ids stay; an empty table gives an empty one; other columns are ignored. ``known``
    is sent to all tasks; it is a list of licences, fixed in size by its author, not by the corpus. Texts are brought to canonical form
    once: the digest of the whole is looked up as one more line.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    sizes = sorted({r.size for r in known.select("size").collect()} - {0})
    rows = canonical(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    # A line of another length than all known texts has no known digest.
    fits = F.filter("lines", lambda x: F.length(x).isin(sizes)) if sizes else F.array().cast("array<string>")
    asked = F.concat(F.array("digest"), F.transform(fits, lambda x: F.sha2(x, 256)))
    found = rows.select("doc_id", "row", F.posexplode(asked).alias("pos", "digest")).join(F.broadcast(known.select("digest", "license")), "digest", "left")
    whole, hit = F.col("pos") == 0, F.col("license").isNotNull()
    each = found.groupBy("doc_id", "row").agg(
        F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("license"))).alias("license"), F.sum(whole.cast("int")).alias("times"),
        F.sum((~whole & hit).cast("bigint")).alias("n"), F.collect_set(F.when(~whole, F.col("license"))).alias("names"),
    )
    # Equal rows were counted together.
    again = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("again")
    return each.select("doc_id", "digest", "license", F.expr("n div times").alias("n_notices"), F.array_join(F.array_sort("names"), ",").alias("notices"), again).drop("again")


def _sql_plain(line: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"regexp_replace(trim(regexp_replace(translate({line}, {quoted(UPPER)}, {quoted(LOWER)}), {quoted(PUNCTUATION)}, ' ', 'g')), {quoted(HOLDER)}, '')"


def _sql_spelled(words: str) -> str:
    for other, one in SPELLINGS:
        words = f"replace({words}, '{other}', '{one}')"
    return words


def oracle_sql() -> str:
    """DuckDB SQL for ``scan`` over the view documents."""
    values = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in known_texts())
    long = ", ".join(f"('{license}', '{digest}')" for license, digest, _ in LONG)
    lines = lambda text: f"list_transform(string_split({text}, chr(10)), lambda x: {_sql_plain('x')})"
    digest = lambda lines: f"sha256({_sql_spelled(f"array_to_string(list_filter({lines}, lambda y: y <> ''), ' ')")})"
    return f"""
WITH texts(license, text) AS (VALUES {values}), long(license, digest) AS (VALUES {long}),
known AS (SELECT digest, min(license) AS license FROM (SELECT {digest(lines('text'))} AS digest, license FROM texts UNION ALL SELECT digest, license FROM long) GROUP BY 1),
rows AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM (SELECT doc_id, {_sql_spelled('line')} AS line FROM (SELECT doc_id, unnest(lines) AS line FROM rows)) JOIN known ON digest = sha256(line) WHERE line <> '' GROUP BY doc_id),
digests AS (SELECT doc_id, {digest('lines')} AS digest FROM rows)
SELECT d.doc_id, d.digest, k.license, coalesce(h.n, 0) AS n_notices, coalesce(h.names, '') AS notices
FROM digests d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN hits h ON h.doc_id = d.doc_id"""
