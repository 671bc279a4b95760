"""Licence scan: word-bigram Dice coefficient against licence templates.

A text is normalised: A-Z folded, everything but a-z and 0-9 read as one space.
Templates are compared with the sets of distinct word bigrams of two kinds of
pieces: units (the lines, the paragraphs and the whole text) and windows of the
whole text, as many words long as the template (shorter only at the text's end)
and beginning with one of its bigrams. So a notice is found in a file of its
own, in a paragraph, and inside a longer line.

``dice = 2 |A & B| / (|A| + |B|)`` reaches ``t`` only if ``t / (2 - t) * |B| <=
|A| <= (2 - t) / t * |B|``, and, since the common bigrams are at most |A|, only
with at least ``t / (2 - t) * |B|`` common ones. The bounds prune in this order:
all pieces of a text consist of the whole text's bigrams, so a template of which
it has too few is not compared at all; units are compared by size; windows only
begin where enough of the template's bigrams lie within their length.

Everything is DataFrame code over one scan of the texts; there is no shuffle.
The templates are a short list of literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

#: Public licence texts and the notices by which texts state their licence.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_APACHE_FIRST = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""


def _gnu(thing: str, license: str, version: str) -> tuple[str, str]:
    """The first paragraph of the GNU notices, and all of it."""
    first = (f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {license} as "
             f"published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.")
    return first, (f"{first} This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                   "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
                   f"GNU {license} for more details. You should have received a copy of the GNU {license} along with this {thing}.")


TEMPLATES = {
    "0BSD": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_DISCLAIMER}",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",
                 *_gnu("program", "Affero General Public License", "3")),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE_FIRST, f"{_APACHE_FIRST} {_APACHE_REST}"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",
                "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "https://www.boost.org/LICENSE_1_0.txt)"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.",
                "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
                "this software to the public domain worldwide. This software is distributed without any warranty."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                *_gnu("program", "General Public License", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                *_gnu("program", "General Public License", "3")),
    "ISC": ("Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            f"provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 *_gnu("library", "Lesser General Public License", "2.1")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",
                 *_gnu("library", "Lesser General Public License", "3")),
    "MIT": ("Released under the MIT License.", _MIT_GRANT, f"{_MIT_GRANT} {_MIT_REST}"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",
                  "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
             "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software. 3. This notice may not be removed or altered from any source distribution.",),
}


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.translate({i: i + 32 for i in range(65, 91)})).strip(" ").split(" ")


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def normal_form(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def bounds(size: int, t: float) -> tuple[int, int]:
    """The least and largest set size that can reach Dice ``t`` against ``size``."""
    eps = 1e-9
    return -int(-(t / (2 - t) * size - eps) // 1), int((2 - t) / t * size + eps)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                  templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id_col, license, dice, n_matches), one row per row of ``docs``.

    license is the template name with the greatest Dice coefficient over all
    units and windows (ties: the first name), null if none reaches
    ``threshold``; dice its coefficient rounded to 6 digits (null likewise);
    n_matches the number of templates that some unit or window reaches.

    A null, empty or very long text is a text like any other; a text of fewer
    than two words has no bigrams and matches nothing. Rows are judged one by
    one, so null ids, ties and repeated rows stay; other columns are ignored.
    """
    prepare(docs.sparkSession)
    listed = [(name, template_bigrams(t), len(template_words(t)) - 1) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts]
    listed = [x for x in listed if x[1]]
    known = sorted({gram for _, grams, _ in listed for gram in grams})
    sizes = [bounds(len(grams), threshold) for _, grams, _ in listed]
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def bigrams(unit: Column) -> Column:
        return _with(F.split(unit, " "), lambda w: F.zip_with(
            F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    def units(text: Column, whole: Column) -> Column:
        """The bigram sets of lines, paragraphs and the whole text."""
        parts = F.array_union(F.split(text, r"\n"), F.split(text, r"\n[ \t\r]*\n"))
        return F.transform(F.array_distinct(F.array_append(F.transform(parts, normal_form), whole)), lambda u: F.array_distinct(bigrams(u)))

    # Places (from 1) of the whole text's bigrams that some template has, and these bigrams.
    whole = base.select("id", "text", normal_form(F.col("text")).alias("whole"))
    paired = whole.select("*", bigrams(F.col("whole")).alias("pairs"))
    placed = paired.select("*", F.filter(F.sequence(F.lit(1), F.greatest(F.size("pairs"), F.lit(1))),
                                         lambda i: F.get("pairs", i - 1).isin(known)).alias("places"))
    found = placed.select("*", F.array_distinct(F.transform("places", lambda i: F.get("pairs", i - 1))).alias("found"))

    # The templates as one literal, so that the plan does not grow with them.
    literal = F.expr("array({})".format(", ".join(
        f"named_struct('name', {name!r}, 'grams', array({', '.join(map(repr, grams))}), 'span', {span}, 'low', {low}, 'high', {high})"
        for (name, grams, span), (low, high) in zip(listed, sizes, strict=True))))
    able = F.filter(literal, lambda t: (F.size("found") >= t["low"]) & (F.size(F.array_intersect("found", t["grams"])) >= t["low"]))
    judged = found.select("id", "text", "whole", "pairs", "places", able.alias("able"))
    cut = judged.select("*", F.when(F.size("able") > 0, units(F.col("text"), F.col("whole"))).alias("units"))

    def windows(t: Column) -> Column:
        """The sets of the windows that have the least number of bigrams or more, repeats counted."""
        def starts(h: Column) -> Column:
            return F.filter(F.transform(h, lambda p, j: F.when(F.get(h, j + t["low"] - 1) < p + t["span"], p)), lambda p: p.isNotNull())

        own = F.filter("places", lambda i: F.array_contains(t["grams"], F.get("pairs", i - 1)))
        return F.transform(_with(own, starts), lambda p: F.array_distinct(F.slice("pairs", p, t["span"])))

    def score(t: Column) -> Column:
        def dice(g: Column) -> Column:
            return (2.0 * F.size(F.array_intersect(g, t["grams"]))) / (F.size(g) + F.size(t["grams"]))

        pieces = F.filter(F.concat("units", windows(t)), lambda g: F.size(g).between(t["low"], t["high"]))
        return F.struct((-F.array_max(F.transform(pieces, dice))).alias("order"), t["name"].alias("name"))

    hits = cut.select("id", F.when(F.size("able") > 0, F.filter(F.transform("able", score), lambda x: x["order"] <= -threshold)).alias("hits"))
    return hits.select(F.col("id").alias(id_col), F.array_min("hits")["name"].alias("license"),
                       F.round(-F.array_min("hits")["order"], 6).alias("dice"),
                       F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_matches"))
