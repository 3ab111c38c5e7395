"""Licence scans by canonical digests, with DataFrame operations only.

A text is brought to a canonical form: letters A-Z lower-cased, lines with a copyright notice dropped, equivalent spellings
made one, and everything but letters and digits turned into single spaces. The digest of that form is joined with
the digests of known licence texts, which go through the same steps. A match is of entire texts; besides a whole
document, each of its lines is looked up as a text, since notices stand on lines of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.llm.url_filter import LOWER, UPPER

# Spellings that count as one (whole words), and known licence texts and notices.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("authorised", "authorized"), ("favour", "favor"), ("honour", "honor"), ("fulfil", "fulfill"), ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"), ("per cent", "percent"), ("https", "http"), ("version 2 0", "v2"), ("version 3", "v3"), ("version 4 0", "v4"),
)
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    'publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, '
    'subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or '
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    'NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR '
    'COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, '
    'OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
ISC = (
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the '
    'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
    'WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
    'LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
    'WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS '
    'SOFTWARE.'
)
BSD_OPENING = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions '
    'are met:'
)
BSD_CONDITIONS = (
    'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.',
    'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the '
    'documentation and/or other materials provided with the distribution.',
    'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this '
    'software without specific prior written permission.',
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    'LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE '
    'COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
    '(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) '
    'HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) '
    'ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    'arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial '
    'applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must '
    'not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an '
    'acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked '
    'as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source '
    'distribution.'
)
UNLICENSE = (
    'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or '
    'distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any '
    'means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in '
    'the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and '
    'successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this '
    'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE '
    'LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN '
    'CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>'
)


def _bsd(conditions: int, title: str, numbered: bool) -> str:
    marks = [f"{i + 1}. " if numbered else "* " for i in range(conditions)]
    return " ".join([title, BSD_OPENING, *(m + c for m, c in zip(marks, BSD_CONDITIONS)), BSD_DISCLAIMER])


KNOWN = (
    *(("BSD-2-Clause", _bsd(2, title, numbered)) for title in ("", "BSD 2-Clause License") for numbered in (True, False)),
    *(("BSD-3-Clause", _bsd(3, title, numbered)) for title in ("", "BSD 3-Clause License") for numbered in (True, False)),
    ("Zlib", ZLIB), ("Zlib", "zlib License " + ZLIB), ("Unlicense", UNLICENSE), ("Unlicense", "The Unlicense " + UNLICENSE),
    ("MIT", "MIT License " + MIT), ("MIT", MIT), ("ISC", "ISC License " + ISC), ("ISC", ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)

#: A line that begins with a copyright notice.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*"
NO_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


#: Texts without any of these need no replacement.
ANY_SPELLING = "|".join(other for other, _ in SPELLINGS)


def canonical(text: Column) -> Column:
    """The canonical form; empty for texts without words."""
    low = F.translate(text, UPPER, LOWER)
    plain = F.trim(F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, "\n"), NO_WORD, " "))
    # Words stand between two spaces each, so that neighbours don't share one.
    out = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} ".replace(" ", "  ")[1:-1]), F.lit(f" {one} "))
    return F.when(plain.rlike(ANY_SPELLING), F.trim(F.replace(out, F.lit("  "), F.lit(" ")))).otherwise(plain)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``digest`` and ``license`` of the known texts; each digest once."""
    table = spark.createDataFrame(list(known), "license string, text string")
    return table.select(F.md5(canonical(F.col("text")).cast("binary")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(documents: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row ``id``, ``digest`` (of its canonical form), ``license`` (if its entire text is known; else null),
    ``line_licenses`` (those of its lines, sorted, joined by commas; empty if none).

    A null text counts as empty; texts without words have an empty form, which no known text has. Each row is looked
    up, whether its id repeats or is null. An empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    digests = known_digests(spark, known)
    # The known digests are a fixed list, so one map value holds them.
    table = {r.digest: r.license for r in digests.collect()}
    lookup = F.create_map([F.lit(x) for pair in sorted(table.items()) for x in pair])
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike(_hint(known)))
    of_lines = F.transform(lines, lambda x: F.element_at(lookup, F.md5(canonical(x).cast("binary"))))
    found = F.array_sort(F.array_distinct(F.filter(of_lines, lambda x: x.isNotNull())))
    digest = F.md5(canonical(F.col("text")).cast("binary"))
    scanned = rows.select("id", digest.alias("digest"), F.array_join(found, ",").alias("line_licenses"))
    # The known texts are a fixed list, so their digests may be sent to all tasks.
    return scanned.join(F.broadcast(digests), "digest", "left").select("id", "digest", "license", "line_licenses")


def _hint(known: tuple[tuple[str, str], ...]) -> str:
    """A pattern that every line with a known text matches: cheap words, so that few lines need a digest."""
    words = ("license", "licence", "licensed", "licenced", "released", "permission", "redistribution")
    assert all(any(w in text.lower() for w in words) for _, text in known)
    return "|".join(words)
