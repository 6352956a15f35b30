"""Licence scans: canonical digests of entire texts, hash-joined to the digests of known licences.

A text is reduced to a canonical form (case, copyright lines, equivalent
spellings, punctuation, white space) and its SHA-256 is looked up in a table of
known licences. The same lookup runs over each entire line and each entire block
between blank lines, which finds notices that stand inside a longer document,
and over each run of blocks that begins like a known text of several blocks and
has as many. The prefilter, which spares most texts their digests, has a word of
each known text.
The known table is built from parameters and its size is checked before it is
broadcast; documents' texts are never shuffled.

Defined results: a null or empty text has the digest of the empty form and no
licence; a document lists each licence once, in order of its id; repeated rows
each get a row, with the notices of all rows of that id.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import ascii_lower, table
from sluice.llm.license_digests import DIGESTS

#: (pattern, replacement), applied in order to lower-case text. Written for both Java's and RE2's syntax.
SPELLINGS = (
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-commercial", "noncommercial"),
    (r"organisation", "organization"),
    (r"whilst", "while"),
    (r"http://", "https://"),
    (r"version ([0-9]+)\.0\b", r"version \1"),
)
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"
#: The same where only \n ends a line, which Java has to be told.
_COPYRIGHT_LINE = COPYRIGHT_LINE.replace("(?m)", "(?md)", 1)
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: What the SQL's known texts hold; ``marks`` derives the same for any known texts.
MARK = r"(?i)licen[sc]|rights reserved|public domain|permission to"
#: Bound of the known table for its broadcast.
MAX_KNOWN = 10_000

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _creative_commons() -> list[tuple[str, str]]:
    out = []
    for terms in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            out += [(f"CC-{terms}-{v}", f"{head} CC {terms} {v}.") for head in ("Licensed under", "Released under", "This work is licensed under")]
    return out


#: (id, text). Several texts may name one id.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "This work is dedicated to the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC),
    *_creative_commons(),
)


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n\n"
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
    "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Whole texts besides those that the SQL knows.
WHOLE = (
    *((i, t.split("\n\n", 1)[1]) for i, t in KNOWN if "\n\n" in t and t.split("\n\n", 1)[0] in ("MIT License", "ISC License")),
    *((i, head + _BSD + more + _BSD_AS_IS) for i, more in (("BSD-2-Clause", ""), ("BSD-3-Clause", _BSD_3)) for head in ("", f"BSD {i[4]}-Clause License\n\n")),
    *(("Unlicense", _UNLICENSE + end) for end in ("", "\n\nFor more information, please refer to <https://unlicense.org>", "\n\nFor more information, please refer to <https://unlicense.org/>")),
)
#: Of a known text: its id, digest, canonical first block and number of blocks that are not empty.
KNOWN_NAMES = ("license", "digest", "first", "blocks")
#: Ends a block: lines without letters and digits.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: Words that SPELLINGS write in several ways, so a known text's mark has none of them.
_SPELLED = ("sublicense", "noncommercial", "organization", "while", "http", "version")


def canonical(text: Column) -> Column:
    t = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _COPYRIGHT_LINE, "")
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to.replace("\\1", "$1"))
    return F.btrim(F.regexp_replace(t, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def blocks(text: Column) -> Column:
    """The blocks of a text whose canonical form is not empty."""
    return F.filter(F.split(text, BLANK, -1), lambda x: F.regexp_replace(ascii_lower(x), _COPYRIGHT_LINE, "").rlike(r"[\p{L}\p{N}]"))


def known_texts(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> list[tuple[str, str, str, int]]:
    """Rows of KNOWN_NAMES, one per digest; of equal digests the least id stays."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"{len(known)} known texts; the table is broadcast and may have {MAX_KNOWN}")
    pairs = F.array(*(F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in known)).cast("array<struct<license:string,text:string>>")
    rows = spark.range(1).select(F.inline(pairs))
    rows = rows.where(canonical(F.col("text")) != "").select("license", digest(F.col("text")).alias("digest"), blocks(F.col("text")).alias("b"))
    found = rows.groupBy("digest").agg(F.min_by(F.struct("license", canonical(F.col("b")[0]).alias("first"), F.size("b").alias("blocks")), "license").alias("t"))
    return [tuple(r) for r in found.select("t.license", "digest", "t.first", "t.blocks").collect()]


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN + WHOLE) -> DataFrame:
    """(digest, license), one row per digest; of equal digests the least id stays."""
    return _literal(spark, known_texts(spark, known)).select("digest", "license")


def _literal(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> DataFrame:
    """The rows as constants of the plan, which no Python worker has to pass on."""
    structs = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, KNOWN_NAMES, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(structs.cast("array<struct<license:string,digest:string,first:string,blocks:int>>")))


def marks(firsts: set[str]) -> str:
    """A pattern that each text with one of these canonical beginnings matches."""
    words = set()
    for first in firsts:
        plain = [w for w in first.split() if re.fullmatch("[a-z]+", w) and not any(x in w for x in _SPELLED)]
        if not plain and "license" not in first:
            return "(?s)"
        words.add("licen[sc]e" if "license" in first else max(plain, key=lambda w: (len(w), w)))
    return "(?i)" + "|".join(sorted(words)) if words else r"\z."


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", known: tuple[tuple[str, str], ...] = KNOWN + WHOLE) -> DataFrame:
    """(id, digest, license, notices): the whole text's licence or null, and the sorted ids of licences found as entire lines, blocks or runs of blocks."""
    spark = docs.sparkSession
    rows = known_texts(spark, known)
    if known == KNOWN + WHOLE:
        rows += [r for r in DIGESTS if r[1] not in {x[1] for x in rows}]
    all_known = _literal(spark, rows)
    table_ = F.broadcast(all_known.select("digest", "license"))
    runs = F.broadcast(all_known.where("blocks > 1").select(F.col("first").alias("__first"), F.col("blocks").alias("__blocks"), F.col("digest").alias("__digest"), F.col("license").alias("__license")))
    # The piece of a text of one block holds all of it, and a run begins with its first block.
    mark = marks({r[2] for r in rows})
    t = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), digest(t).alias("digest")).join(table_, "digest", "left")
    marked = lambda xs: F.filter(xs, lambda x: x.rlike(mark))
    pieces = F.array_distinct(F.concat(marked(F.split(t, r"\n", -1)), marked(F.split(t, r"\n[ \t]*\n", -1))))
    # Texts without a mark have no piece and are dropped before the generator.
    with_mark = docs.where(t.rlike(mark)).select(F.col(id_col).alias("id"), t.alias("t"))
    found = docs.where(t.rlike(mark)).select(F.col(id_col).alias("id"), F.explode(pieces).alias("piece"))
    single = found.select("id", digest(F.col("piece")).alias("digest")).join(table_, "digest").select("id", "license")
    firsts = sorted({r[2] for r in rows if r[3] > 1})
    begins = F.filter(F.transform(F.col("b"), lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(mark), canonical(x)).alias("first"))), lambda x: x["first"].isin(firsts))
    starts = with_mark.select("id", blocks(F.col("t")).alias("b")).withColumn("begins", begins).where(F.size("begins") > 0)
    starts = starts.select("id", "b", F.explode("begins").alias("s")).join(runs, F.col("s.first") == F.col("__first"))
    run = F.array_join(F.slice("b", F.col("s.i") + 1, F.col("__blocks")), "\n\n")
    longer = starts.where(F.size("b") - F.col("s.i") >= F.col("__blocks")).where(digest(run) == F.col("__digest")).select("id", F.col("__license").alias("license"))
    notices = single.unionAll(longer).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    both = whole.withColumnRenamed("id", "__id").join(notices, F.col("__id").eqNullSafe(F.col("id")), "left")
    return both.select(F.col("__id").alias(id_col), "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_canonical(t: str) -> str:
    out = f"regexp_replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{COPYRIGHT_LINE}', '', 'g')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'))"


def _known_values() -> str:
    return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)


OP4_SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical('text')}) AS digest, min(license) AS license FROM (VALUES {_known_values()}) AS v(license, text) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
piece AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS p FROM d UNION ALL SELECT doc_id, unnest(string_split_regex(t, '\\n[ \\t]*\\n')) AS p FROM d)
  WHERE regexp_matches(p, '{MARK}')),
n AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM (
    SELECT DISTINCT doc_id, license FROM (SELECT doc_id, sha256({_sql_canonical('p')}) AS digest FROM piece) JOIN known USING (digest)) GROUP BY doc_id)
SELECT w.doc_id, w.digest, known.license, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, sha256({_sql_canonical('t')}) AS digest FROM d) w LEFT JOIN known USING (digest) LEFT JOIN n ON n.doc_id = w.doc_id"""


def sha256_hex(s: str) -> str:
    """For tests: the digest of an already canonical string."""
    return hashlib.sha256(s.encode()).hexdigest()
