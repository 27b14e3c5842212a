"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text unit (the whole text, and each of its lines) is brought to a canonical form: lower case, lines that state a copyright dropped (a line ends at a line feed;
a carriage return before it is part of it), everything but letters and digits made one space, equivalent
spellings made one word by word. Its SHA-256 is joined with the digests of known licences and notices
in the same form. The known list is small and checked (MOST_KNOWN), so it is broadcast and the documents aren't shuffled.

Null or empty text has no unit that matches. Repeated rows each give their matches; columns other than doc_id and text are ignored; an empty table gives
an empty result. A unit matches only if it is equal to a known text as a whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_KNOWN = 10_000

# Equivalent spellings, each written as the second.
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "favour": "favor",
    "fulfil": "fulfill",
    "judgement": "judgment",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "programme": "program",
    "recognised": "recognized",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "v1": "version 1",
    "v2": "version 2",
    "v3": "version 3",
}

# Known notices and licence texts, by SPDX name.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    (
        "MIT",
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
]


# Licence, characters, first word and SHA-256 of the canonical forms of whole public licence texts, as GNU, Apache, Mozilla, Creative Commons and the
# University of California publish them (the files that Debian's base-files installs).
DIGESTS = [
    ("Apache-2.0", 9701, "apache", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Artistic-1.0-Perl", 5653, "the", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915"),
    ("CC0-1.0", 6692, "creative", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19515, "gnu", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3", 21884, "gnu", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0", 11702, "gnu", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", 17053, "gnu", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", 33207, "gnu", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("LGPL-2.0", 23936, "gnu", "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d"),
    ("LGPL-2.1", 25023, "gnu", "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e"),
    ("LGPL-3.0", 7104, "gnu", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22340, "mozilla", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 14271, "mozilla", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("BSD-3-Clause", 1381, "all", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
]


def _spelt(plain: Column) -> Column:
    """The words of a text (one space between, before and after) in one spelling. Two spaces stand between words meanwhile, so that neighbours share none."""
    out = F.replace(plain, F.lit(" "), F.lit("  "))
    for was, now in sorted(SPELLINGS.items()):
        out = F.replace(out, F.lit(f" {was.replace(' ', '  ')} "), F.lit(f" {now.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical(rows: DataFrame, text: str, lengths: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """rows with a column `canonical` of the column named by text. lengths: the least and greatest length of known texts by their first word. Then the form is null where the first
    word is none of these nor the start of a spelling, or the length is out of reach (spellings at most double or halve it): such a unit is no known text whatever its spelling."""
    others = [c for c in rows.columns if c != text]
    rows = rows.select(*others, F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    stated = F.contains("_low", F.lit("copyright")) | F.contains("_low", F.lit("(c)")) | F.contains("_low", F.lit("\u00a9"))
    rows = rows.select(*others, F.when(stated, F.regexp_replace("_low", r"(?md)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|\u00a9)[^\n]*+$", " ")).otherwise(F.col("_low")).alias("_kept"))
    rows = rows.select(*others, F.concat(F.lit(" "), F.trim(F.regexp_replace("_kept", r"[^\p{L}\p{N}]++", " ")), F.lit(" ")).alias("_plain"))
    if lengths is None:
        return rows.select(*others, _spelt(F.col("_plain")).alias("canonical"))
    every = (min((a for a, _ in lengths.values()), default=0), max((b for _, b in lengths.values()), default=0))
    words = sorted({*lengths, *(was.split(" ")[0] for was in SPELLINGS)})
    spelling = {x.split(" ")[0] for pair in SPELLINGS.items() for x in pair}
    least, most = zip(*((a // 2, 2 * b + 2) for a, b in (every if w in spelling else lengths[w] for w in words)), strict=True)
    rows = rows.select(*others, "_plain", F.char_length("_plain").alias("_n"), F.array_position(F.lit(words), F.substring_index(F.ltrim("_plain"), " ", 1)).cast("int").alias("_at"))
    able = (F.col("_at") > 0) & F.col("_n").between(F.get(F.lit(list(least)), F.col("_at") - 1), F.get(F.lit(list(most)), F.col("_at") - 1))
    return rows.select(*others, F.when(able, _spelt(F.col("_plain"))).alias("canonical"))


def digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, licence, chars and first word (of the canonical form) of the known texts: KNOWN's and those of DIGESTS, or of another list."""
    texts = F.from_json(F.lit(json.dumps(KNOWN if known is None else known)), "array<array<string>>")
    rows = canonical(spark.range(1, numPartitions=1).select(F.explode(texts).alias("x")).select(F.get("x", F.lit(0)).alias("licence"), F.get("x", F.lit(1)).alias("text")), "text")
    out = rows.select(F.sha2("canonical", 256).alias("digest"), "licence", F.char_length("canonical").alias("chars"), F.substring_index("canonical", " ", 1).alias("first")).where("chars > 0")
    if known is None:
        more = F.explode(F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(k).alias("licence"), F.lit(n).alias("chars"), F.lit(w).alias("first")) for k, n, w, d in DIGESTS)))
        out = out.unionByName(spark.range(1, numPartitions=1).select(more.alias("x")).select("x.*"))
    return out.distinct()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, line (-1: the whole text; else from 0), licence, digest of every unit that is a known text."""
    known = digests(docs.sparkSession) if known is None else known.select("digest", "licence", "chars", "first")
    n = known.count()
    lengths = {r["first"]: (r["a"], r["b"]) for r in known.groupBy("first").agg(F.min("chars").alias("a"), F.max("chars").alias("b")).collect()} if n <= MOST_KNOWN else None
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("unit")))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
    units = docs.select("doc_id", F.explode(F.concat(whole, lines)).alias("u")).select("doc_id", "u.line", "u.unit")
    hashed = canonical(units, "unit", lengths).where("canonical is not null").select("doc_id", "line", F.sha2("canonical", 256).alias("digest"))
    known = known.select("digest", "licence")
    return hashed.join(F.broadcast(known) if n <= MOST_KNOWN else known, "digest").select("doc_id", "line", "licence", "digest")


def oracle_sql() -> str:
    """The scan as DuckDB SQL; spellings by a look-up of each word in a list, then those of two words."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    one = {was: now for was, now in SPELLINGS.items() if " " not in was}
    words = f"array_to_string([case w {' '.join(f'when {quoted(a)} then {quoted(b)}' for a, b in one.items())} else w end for w in string_split(plain, ' ')], ' ')"
    for was, now in sorted(SPELLINGS.items()):
        if " " in was:
            words = rf"regexp_replace({words}, '\b{was}\b', '{now}', 'g')"
    return rf"""
        with known(licence, unit) as (values {", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in KNOWN)}),
        units as (
            select null as doc_id, null as line, licence, unit from known
            union all select doc_id, -1, null, text from documents
            union all select doc_id, unnest(range(len(string_split(text, chr(10))))), null, unnest(string_split(text, chr(10))) from documents
        ),
        kept as (select doc_id, line, licence, regexp_replace(lower(coalesce(unit, '')), '(?m)^[^\p{{L}}\p{{N}}\n]*(copyright\b|\(c\)|{chr(0xA9)})[^\n]*$', ' ', 'g') as kept from units),
        flat as (select doc_id, line, licence, trim(regexp_replace(kept, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as plain from kept),
        forms as (select doc_id, line, licence, {words} as canonical from flat),
        digests as (
            select distinct licence, sha256(canonical) as digest from forms where licence is not null and canonical <> ''
            union values {", ".join(f"({quoted(k)}, {quoted(d)})" for k, _, _, d in DIGESTS)}
        )
        select f.doc_id, f.line::int as line, d.licence, d.digest
        from forms f join digests d on sha256(f.canonical) = d.digest where f.licence is null
    """
