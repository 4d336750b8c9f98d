"""License scan by canonical digest: texts, brought to one spelling, are hash-joined to known license digests.

``scan_licenses`` compares a text as a whole, ``find_licenses`` also its lines and its runs of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of common licenses, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _bsd(items: int, mark: str) -> str:
    """The license with its first ``items`` conditions, numbered by ``mark``."""
    listed = [mark.format(i) + x for i, x in enumerate(BSD_ITEMS[:items], 1)]
    return "\n\n".join([BSD_OPENING, *listed, BSD_END])


KNOWN = {
    "BSD-2-Clause": tuple(title + _bsd(2, mark) for title in ("", "BSD 2-Clause License\n") for mark in ("{}. ", "* ")),
    "BSD-3-Clause": tuple(title + _bsd(3, mark) for title in ("", "BSD 3-Clause License\n") for mark in ("{}. ", "* ")),
    "Unlicense": (UNLICENSE, UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    "MIT": (MIT, "The MIT License (MIT)\n" + MIT, "MIT License\n" + MIT, "Released under the MIT License."),
    "ISC": (ISC, "ISC License\n" + ISC),
    "0BSD": (ZERO_BSD, "BSD Zero Clause License\n" + ZERO_BSD),
    "Zlib": (ZLIB, "zlib License\n" + ZLIB),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
}
# Full texts of longer licenses by license, canonical first block, number of blocks between blank lines, and
# digest of the canonical text; first with what follows the end of its terms, then up to that line. See ``long_entries``.
LONG = (
    ("Apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses", 32, "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses", 27, "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("GPL-1.0", "gnu general public license version 1 february 1989", 50, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "gnu general public license version 1 february 1989", 35, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "gnu general public license version 2 june 1991", 59, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "gnu general public license version 2 june 1991", 44, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007", 122, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007", 109, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991", 83, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991", 71, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999", 85, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999", 73, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007", 37, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license version 1 1", 73, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "mozilla public license version 2 0", 83, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", "creative commons legal code", 13, "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
)
# Spellings that count as the same word, after lower-casing and without punctuation.
SPELLINGS = (
    ("licence", "license"), ("sublicence", "sublicense"), ("licences", "licenses"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("judgement", "judgment"), ("programme", "program"), ("copyright owner", "copyright holder"), ("https", "http"),
)
# How the name of a holder begins, and the words by which the license goes on behind it on the same line.
HOLDER = r"(?:copyright[^a-z0-9\n]*(?:\(c\)|\x{a9}|(?:19|20)[0-9][0-9])|\(c\)[^a-z0-9\n]*(?:copyright|(?:19|20)[0-9][0-9])|\x{a9})"
OPENING = (
    r"(?:permission (?:is hereby granted|to use)|redistribution and use|this (?:software|work|program) is|this is free and unencumbered|(?:licen[sc]ed|released) under"
    r"|the mit licen[sc]e|(?:mit|isc|zlib|bsd zero clause) licen[sc]e)"
)
# Lines that name a holder, up to their end or to the license; the same behind a title on one line; a block that is one
# line 'copyright' and a name. Other lines that begin with 'copyright' or '(c)' belong to the license.
HOLDER_LINES = (
    (rf"(?m)^[^a-z0-9\n]*{HOLDER}[^\n]*?(?={OPENING}|$)", " "),
    (rf"(?m)^([^\n]{{0,80}}?){HOLDER}[^\n]*?(?={OPENING})", "$1 "),
    (rf"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(?={OPENING}|$)", " "),
    (r"(\A|\n[^\S\n]*\n)[^a-z0-9\n]*copyright [^\n]*(?=\n[^\S\n]*(?:\n|\z)|\z)", "$1 "),
)


def _without_holders(text: Column) -> Column:
    """Lower case, one sign for line ends, and no copyright lines. NULL counts as empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"\r\n|[\r\x0B\x0C\x85  ]", "\n")
    for pattern, kept in HOLDER_LINES:
        out = F.regexp_replace(out, pattern, kept)
    return out


def _spelt(text: Column) -> Column:
    for other, name in SPELLINGS:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {name} "))
    return F.trim(text)


def canonical(text: Column) -> Column:
    """One spelling of a text: lower case, no copyright lines, runs of anything but a-z and 0-9 as one space.

    NULL counts as empty.
    """
    return _spelt(F.concat(F.lit(" "), F.trim(F.regexp_replace(_without_holders(text), r"[^a-z0-9]+", " ")), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known: dict[str, tuple[str, ...]] = KNOWN, long: Sequence[tuple[str, str, int, str]] = LONG) -> DataFrame:
    """``digest, license`` of the known texts; texts that agree in their canonical form must name the same license."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    # Constants, so that the planner knows how few they are and need not shuffle the texts for them.
    row = F.explode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in rows]))
    found = spark.range(1).select(row.alias("row")).select(digest(F.col("row.text")).alias("digest"), "row.license")
    if long:
        entry = F.explode(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(name).alias("license")) for name, _, _, d in long]))
        found = found.union(spark.range(1).select(entry.alias("row")).select("row.*"))
    return found.distinct()


def scan_licenses(df: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` and ``digest, license`` (replaced if there): the license that the whole text is, else NULL.

    Every row is kept, as often as it comes. ``known`` has one row per digest.
    """
    names = [c for c in df.columns if c not in ("digest", "license")]
    marked = df.select(*[f"`{c}`" for c in names], digest(F.col(f"`{text}`")).alias("digest"))
    return marked.join(known.select("digest", "license"), "digest", "left").select(*[f"`{c}`" for c in names], "digest", "license")


def _lines(text: Column) -> Column:
    """Canonical forms of the lines of a text."""
    # Line ends stand apart as words, so that one pass spells all lines.
    out = F.replace(F.regexp_replace(_without_holders(text), r"[^a-z0-9\n]+", " "), F.lit("\n"), F.lit(" \n "))
    return F.transform(F.split(_spelt(F.concat(F.lit(" "), out, F.lit(" "))), "\n"), lambda x: F.trim(x))


def _blocks(lines: Column) -> Column:
    """Lines joined to blocks between empty ones."""
    blocks = F.transform(F.split(F.array_join(lines, "\n"), r"\n\n+"), lambda b: F.trim(F.replace(b, F.lit("\n"), F.lit(" "))))
    return F.filter(blocks, lambda b: b != "")


def long_entries(df: DataFrame, license: str = "license", text: str = "text") -> DataFrame:
    """``license, first, blocks, digest`` of full license texts, as in ``LONG``. Rows without a block are left out."""
    of = df.select(F.col(license).alias("license"), F.col(text).alias("_t"), _blocks(_lines(F.col(text))).alias("_b")).where(F.size("_b") > 0)
    return of.select("license", F.col("_b")[0].alias("first"), F.size("_b").alias("blocks"), digest(F.col("_t")).alias("digest"))


def _units(text: Column, run: int, long: Sequence[tuple[str, str, int, str]] = ()) -> Column:
    """Distinct canonical forms of a text, its lines, its runs of 1 to ``run`` blocks between blank lines, and the runs
    that begin like one of the ``long`` licenses and are as many blocks."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    pairs = [x for x in SPELLINGS if " " in x[0]]

    def joined(words: Column) -> Column:
        """Words of several lines, where a spelling of two words may span two of them."""
        words = F.concat(F.lit(" "), words, F.lit(" "))
        for other, name in pairs:
            words = F.replace(words, F.lit(f" {other} "), F.lit(f" {name} "))
        return F.trim(words)

    # Sizes of the long licenses by their first block.
    sizes: dict[str, set[int]] = {}
    for _, first, size, _ in long:
        sizes.setdefault(first, set()).add(size)
    starts = [x for first, of in sizes.items() for x in (F.lit(first), F.array(*[F.lit(n) for n in sorted(of)]))]

    def of_blocks(blocks: Column) -> Column:
        cut = lambda i, n: joined(F.array_join(F.slice(blocks, i + 1, n), " "))
        of = lambda n: lambda _, i: cut(i, n)
        runs = [F.transform(blocks, of(n)) for n in range(1, run + 1)]
        if starts:
            sized = lambda b: F.coalesce(F.create_map(*starts)[b], F.array().cast("array<int>"))
            runs.append(F.flatten(F.transform(blocks, lambda b, i: F.transform(sized(b), lambda n: cut(i, n)))))
        return F.concat(F.array(joined(F.array_join(blocks, " "))), *runs)

    def of_lines(lines: Column) -> Column:
        return F.concat(lines, let(_blocks(lines), of_blocks))

    units = let(_lines(text), of_lines)
    return F.array_distinct(F.filter(units, lambda x: x != ""))


def find_licenses(df: DataFrame, known: DataFrame, text: str = "text", run: int = 5, long: Sequence[tuple[str, str, int, str]] = LONG) -> DataFrame:
    """All columns of ``df`` and ``licenses`` (replaced if there): the licenses found in the text, sorted, each once.

    A license is found where the text as a whole, one of its lines, or blocks in a row are a known text: up to ``run`` of
    them, and for the ``long`` licenses as many as they have, from each block that is their first. The texts of ``KNOWN``
    have at most five blocks (six with a title, which is not needed), also with a blank line before each item. Every row
    is kept, as often as it comes, with an empty array if nothing is found. Only digests are joined, and only what is
    found is gathered, once per distinct text.
    """
    names = [c for c in df.columns if c != "licenses"]
    key = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("_text_key")
    units = df.select(key, F.explode(_units(F.col(f"`{text}`"), run, long)).alias("_unit"))
    hits = units.select("_text_key", F.sha2("_unit", 256).alias("digest")).join(known.select("digest", "license"), "digest")
    found = hits.groupBy("_text_key").agg(F.array_sort(F.collect_set("license")).alias("licenses"))
    none = F.array().cast("array<string>")
    return df.select(*[f"`{c}`" for c in names], key).join(found, "_text_key", "left").select(*[f"`{c}`" for c in names], F.coalesce("licenses", none).alias("licenses"))
