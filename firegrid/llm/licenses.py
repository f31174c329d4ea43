"""Licence scan by canonical digests: texts are normalised, digested whole, and hash-joined with known licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: pairs of spellings that count as equal
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("https", "http"),
    ("creative commons", "cc"),
    ("gnu gpl", "gnu general public license"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)

_WARRANTY_MIT = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# fixed values: full texts of short licences, and the one-sentence notices that stand for longer ones
KNOWN = (
    ("MIT", f"MIT License\n\n{_GRANT_MIT}\n\n{_WARRANTY_MIT}"),
    ("MIT", f"{_GRANT_MIT}\n\n{_WARRANTY_MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"ISC License\n\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)

#: Every known licence holds one of these, in any spelling; a text without them is not looked at further.
ANCHORS = ("licen", "permission")

#: A line that only says who holds the copyright.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, punctuation as one blank, one spelling of equivalent words."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    # every word between two blanks of its own, so that neighbours can both be replaced
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    t = F.replace(t, F.lit(" "), F.lit("  "))
    spelled = reduce(lambda c, e: F.replace(c, F.lit(f" {e[0].replace(' ', '  ')} "), F.lit(f" {e[1].replace(' ', '  ')} ")), EQUIVALENT, t)
    return F.trim(F.replace(spelled, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, scope, license, n_hits, first_line``: a row per document, scope and licence found.

    ``scope`` is ``document`` where the whole text is a licence, ``line`` where an entire line is one (``first_line``
    counts from 0; -1 for whole texts). NULL and empty texts, and units that are empty once normalised, match nothing.
    Repeated rows of one document add up. Documents with a NULL id give rows of NULL id. The known digests are
    a constant of the call and are broadcast. Texts and lines without any of ``ANCHORS`` are left out first, which loses
    nothing while every known licence holds one; with other licences all are normalised.
    """
    table = docs.sparkSession.createDataFrame(sorted(set(known)), "license string, body string")
    table = table.select("license", canonical(F.col("body")).alias("body")).where("body <> ''").select("license", digest(F.col("body")).alias("digest")).distinct()
    may = lambda t: reduce(lambda a, b: a | b, [F.lower(t).contains(a) for a in ANCHORS]) if all(any(a in b.lower() for a in ANCHORS) for _, b in known) else F.lit(True)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).where(may(F.col("_text")))
    unit = lambda scope, line, t: F.struct(F.lit(scope).alias("scope"), line.alias("line"), t.alias("unit"))
    lines = F.transform(F.split("_text", "\n"), lambda t, i: unit("line", i, t))
    units = rows.select(key, F.explode(F.concat(F.array(unit("document", F.lit(-1), F.col("_text"))), lines)).alias("u")).select(key, "u.*").where(may(F.col("unit")))
    units = units.select(key, "scope", "line", canonical(F.col("unit")).alias("unit"))
    hits = units.where("unit <> ''").select(key, "scope", "line", digest(F.col("unit")).alias("digest")).join(F.broadcast(table), "digest")
    return hits.groupBy(key, "scope", "license").agg(F.count("*").alias("n_hits"), F.min("line").cast("long").alias("first_line"))
