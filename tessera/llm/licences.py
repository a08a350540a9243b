"""Licence scan: TF-IDF cosine of headers and licence files to templates, and inheritance from the nearest directory above.

Statements are windows of lines, cut at ends of sentences, of every file (one, and 2, 4 to 32 of them, so that wrapped headers
are whole) and the file itself. Terms are weighted by their frequency and the logarithm of their rarity over all files, and a statement
is compared with full licence texts, standard headers, titles and SPDX tags; a short template's licence must be named.
No line needs a cue: a statement is left out only if it has none of the terms without which no template's cosine can be
high enough. Licence files give their licence to their directory; a file without a statement of its own takes that of the
nearest directory above it. Distinct directories are resolved by joins on the paths above them. DataFrame expressions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import numbered_columns, table, text_or_empty, written

# SPDX identifiers, licence texts, headers and titles; the terms that a statement must have (all of them) for a short one.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NO_ENDORSEMENT = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. "
    "You should have received a copy of the GNU {name} General Public License along with this program. If not, see http://www.gnu.org/licenses/."
)
TEXTS = (
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "MIT License", "mit license"),
    ("MIT", _MIT + _MIT_WARRANTY, ""),
    ("MIT", _MIT, ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache 2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    *[
        (identifier, text.format(name=name, version=version).replace("GNU  ", "GNU "), f"{name} general public {version}".lower().strip())
        for identifier, name, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))
        for text in ("This work is licensed under the GNU {name} General Public License, version {version}.", "GNU {name} General Public License Version {version}", _GNU)
    ],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "eclipse"),
    ("EPL-2.0", "Eclipse Public License 2.0", "eclipse 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2-clause"),
    ("BSD-2-Clause", _BSD, ""),
    ("BSD-2-Clause", _BSD + _WARRANTY, ""),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3-clause"),
    ("BSD-3-Clause", _BSD + _NO_ENDORSEMENT, "endorse"),
    ("BSD-3-Clause", _BSD + _NO_ENDORSEMENT + _WARRANTY, "endorse"),
    ("ISC", "ISC License", "isc"),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "",
    ),
    ("BSL-1.0", "Boost Software License - Version 1.0", "boost 1.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "boost 1.0"),
    ("Unlicense", "The Unlicense", "unlicense"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered",
    ),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication.", "cc0"),
    ("CC0-1.0", "CC0 1.0 Universal", "cc0"),
    *[
        (f"CC-{kind.upper()}-4.0", text, names)
        for kind, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"))
        for text, names in ((f"Licensed under CC {kind.upper()} 4.0.", f"cc {kind} 4.0"), (f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"creative commons {long.lower()} 4.0"))
    ],
)
#: Identifier, text and the terms that must be there.
TEMPLATES = tuple((i, t, tuple(n.split())) for i, t, n in TEXTS) + tuple((i.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {i}", ("spdx-license-identifier", i.lower())) for i in SPDX)
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a statement and a template.
LEAST = 0.6
#: Where lines are cut, and numbers of lines of a window; wider ones than 4 lines begin at every fourth of their width.
CUT = r"\n|(?<=[.!?])\s+"
WIDTHS = (1, 2, 4, 8, 16, 32)


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def terms_of(text: Column) -> Column:
    """The terms of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def norms(weights: dict[str, float]) -> list[float]:
    """The templates' norms: how much a match of each explains."""
    return [math.sqrt(sum((n * weights[t]) ** 2 for t, n in Counter(_terms(text)).items())) for _, text, _ in TEMPLATES]


def vectors(weights: dict[str, float]) -> list[dict[str, float]]:
    """The templates' terms with their weights, each of norm 1."""
    out = []
    for (_, template, _), norm in zip(TEMPLATES, norms(weights), strict=True):
        own = {t: n * weights[t] for t, n in Counter(_terms(template)).items()}
        out.append({t: w / norm for t, w in own.items()})
    return out


def needed_terms(weights: dict[str, float], least: float = LEAST) -> list[str]:
    """Terms of which a statement has at least one if its cosine to any template is `least`.

    Of a template with names, the rarest of them; of another, the rarest terms without which the rest is too light to reach `least`.
    """
    out: set[str] = set()
    for (_, _, names), vector in zip(TEMPLATES, vectors(weights), strict=True):
        if names:
            out.add(max(names, key=lambda t: (weights[t], t)))
            continue
        rest = 1.0
        for t in sorted(vector, key=lambda t: (-weights[t], t)):
            if rest < (least - 1e-6) ** 2:
                break
            out.add(t)
            rest -= vector[t] ** 2
    return sorted(out)


def _may_match(terms: Column, weights: dict[str, float], lightest: float, least: float) -> Column:
    """Whether the templates' terms have enough of a statement's norm for a cosine of `least`, if all others had the least weight of any."""
    scales = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(w))])
    known = F.transform(F.array_intersect(terms, F.array(*[F.lit(t) for t in weights])), lambda t: F.struct(F.size(F.filter(terms, lambda x: x == t)).alias("n"), F.element_at(scales, t).alias("w")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("square"))
    total = F.aggregate(known, start, lambda a, k: F.struct((a["n"] + k["n"]).alias("n"), (a["square"] + F.pow(k["n"] * k["w"], F.lit(2.0))).alias("square")))
    fits = F.transform(F.array(total), lambda s: s["square"] * (1 - least**2) >= (F.size(terms) - s["n"]) * (least * lightest) ** 2)
    return F.get(fits, F.lit(0))


def windows(lines: Column) -> Column:
    """The statements of a file's lines (arrays of terms): an array of struct(unit, terms). The last unit is the whole file."""

    def of_width(kind: int, width: int, step: int) -> Column:
        last = F.floor((F.size(lines) - 1 - width // 2) / step).cast("int")  # the others are in windows of half the width
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct((i.cast("bigint") * 8 + kind).alias("unit"), F.flatten(F.slice(lines, i * step + 1, F.lit(width))).alias("terms")))

    parts = [of_width(kind, width, max(1, width // 4)) for kind, width in enumerate(WIDTHS)]
    parts.append(F.array(F.struct(F.lit(7).cast("bigint").alias("unit"), F.flatten(lines).alias("terms"))))
    return F.concat(*parts)


def scored(files: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """files, without the column of texts, with own_licence and own_score: the best template's identifier and cosine over all statements (null: none at `least`).

    The document frequencies are those of all terms over all files. Of the templates with a cosine of `least`, the one that explains
    most (by its cosine times its norm) counts, so that a text isn't taken for the shorter one it begins with; equal ones
    go to the template that stands first. A null or empty text has no licence; whole texts are read; rows (repeated ones too) and columns are kept, those two
    replaced, whatever their names; an empty table gives no rows.

    Statements without a needed term are left out as they are made, and those in which the templates' terms have too little weight
    beside the others (at the least weight that any has); of the rest, those that are too far from every template even if
    all other terms had weight 1 are left out before the weights are joined. None of these can be near enough.
    """
    kept = [c for c in files.columns if c not in (text, "own_licence", "own_score")]
    own = numbered_columns(files.select(*kept, F.col(text).alias("text"))).withColumnRenamed(f"c{len(kept)}", "text")
    names = [f"c{i}" for i in range(len(kept))]
    found = terms_of(text_or_empty())
    counts = own.select(F.explode(F.array_distinct(found)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = own.count()
    counts = written(counts.select("term", "n", (F.log(F.lit(1.0 + total) / (F.col("n") + 1)) + 1).alias("w")), "frequencies")
    vocabulary = sorted({t for _, template, _ in TEMPLATES for t in _terms(template)})
    having = {r.term: r.n for r in counts.where(F.col("term").isin(vocabulary)).collect()}  # as many as the templates have
    weights = {t: math.log((1 + total) / (1 + having.get(t, 0))) + 1 for t in vocabulary}
    needed = F.array(*[F.lit(t) for t in needed_terms(weights, least)])
    lines = F.transform(F.split(text_or_empty(), CUT), terms_of)
    told = own.select(*names, F.when(F.arrays_overlap(found, needed), lines).alias("lines"), F.monotonically_increasing_id().alias("row"))
    told = written(told, "told")
    units = told.where("lines IS NOT NULL").select("row", F.explode(windows(F.col("lines"))).alias("u")).where(F.arrays_overlap("u.terms", needed)).select("row", "u.unit", "u.terms")
    lightest = counts.where(~F.col("term").isin(vocabulary)).agg(F.min("w")).first()[0] or 1.0
    units = units.where(_may_match(F.col("terms"), weights, lightest, least - 1e-6))

    spark = files.sparkSession
    entries = [(t, i, v, t in TEMPLATES[i][2]) for i, vector in enumerate(vectors(weights)) for t, v in vector.items()]
    templates = F.broadcast(spark.createDataFrame(entries, "term string, template int, v double, named boolean"))
    known = F.broadcast(spark.createDataFrame(list(weights.items()), "term string, w double"))
    sizes = [(i, len(n), identifier, norm) for i, ((identifier, _, n), norm) in enumerate(zip(TEMPLATES, norms(weights), strict=True))]
    sizes = F.broadcast(spark.createDataFrame(sizes, "template int, names int, licence string, norm double"))

    def counted(of: DataFrame) -> DataFrame:
        return of.select("row", "unit", F.explode("terms").alias("term")).groupBy("row", "unit", "term").agg(F.count("*").cast("double").alias("n"))

    both = counted(units).join(known, "term", "left")
    light = both.groupBy("row", "unit").agg(F.sum(F.pow(F.col("n") * F.coalesce("w", F.lit(1.0)), F.lit(2.0))).alias("light"), F.sum(F.when(F.col("w").isNotNull(), F.pow(F.col("n") * F.col("w"), F.lit(2.0))).otherwise(0.0)).alias("squares"))
    dots = both.where("w IS NOT NULL").join(templates, "term").groupBy("row", "unit", "template").agg(F.sum(F.col("n") * F.col("w") * F.col("v")).alias("dot"), F.count_if("named").alias("have"))
    near = dots.join(sizes, "template").where(F.col("have") == F.col("names")).join(light, ["row", "unit"]).where(F.col("dot") >= (least - 1e-6) * F.sqrt("light"))
    near = written(near.select("row", "unit", "template", "licence", "norm", "dot", "squares"), "near")

    # terms in one row of a thousand or more are attached map-side (of a row's terms, a thousand rows' worth at most); the others have few rows each
    others = counted(units.join(near.select("row", "unit").distinct(), ["row", "unit"], "left_semi")).join(known, "term", "left_anti")
    common = F.col("n") * 1000 >= total
    first = others.withColumnRenamed("n", "times").join(F.broadcast(counts.where(common).select("term", "w")), "term", "left")
    seldom = first.where("w IS NULL").drop("w").join(counts.where(~common).select("term", "w"), "term")
    rest = first.where("w IS NOT NULL").unionByName(seldom).groupBy("row", "unit").agg(F.sum(F.pow(F.col("times") * F.col("w"), F.lit(2.0))).alias("rest"))
    score = F.round(F.col("dot") / F.sqrt(F.col("squares") + F.coalesce("rest", F.lit(0.0))), 6)
    scores = near.join(rest, ["row", "unit"], "left").withColumn("score", score).where(F.col("score") >= least)
    best = scores.groupBy("row").agg(F.max(F.struct(F.round(F.col("score") * F.col("norm"), 6), "score", -F.col("template"), "licence")).alias("s"))
    return told.join(best, "row", "left").select(*names, "s.licence", "s.score").toDF(*kept, "own_licence", "own_score")


def directory(path: Column) -> Column:
    """The path of the directory of a file; '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherited(files: DataFrame, path: str = "path", licence_file: Column | None = None) -> DataFrame:
    """files (with path, own_licence and own_score) with licence and licence_from: its own, or that of the nearest directory above.

    A licence file (by its name, or where `licence_file` holds) gives its directory its licence; of several (or of repeated
    rows of one) the best score counts, then the first path. licence_from is 'own', the directory's path, or null. Null
    paths inherit nothing; rows and columns are kept, those two replaced, whatever the names of the others; an empty table gives no rows.
    """
    is_file = F.col(path).rlike(LICENCE_FILE) if licence_file is None else licence_file
    kept = [c for c in files.columns if c not in ("licence", "licence_from")]
    own = files.select(*kept, is_file.alias("is_file"), F.col("own_licence").alias("own_licence_"), F.col("own_score").alias("own_score_"), F.col(path).alias("path_"))
    own = own.toDF(*[f"c{i}" for i in range(len(kept))], "is_file", "own_licence", "own_score", "path").withColumn("dir", directory(F.col("path")))
    given = (
        own.where(F.col("is_file") & F.col("own_licence").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.col("dir").alias("above"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_licence").alias("licence"))).alias("best"))
        .select("above", F.col("best.licence").alias("given"))
    )
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    places = own.select("dir").where(F.col("dir").isNotNull()).distinct().select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = places.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    own_too = F.col("own_licence").isNotNull()
    joined = own.join(nearest, "dir", "left").select(*[f"c{i}" for i in range(len(kept))], F.coalesce("own_licence", "near.given"), F.when(own_too, F.lit("own")).otherwise(F.col("near.above")))
    return joined.toDF(*kept, "licence", "licence_from")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of all documents.

    Documents have no paths: their source is the top directory, their language one below it, and the first hexadecimal
    digit of their id's CRC one below that (a null source or language is the directory '-', so that no row moves up); of
    the documents of a directory that have a statement, the one with the smallest id (all its rows, if it repeats) stands
    for its licence file. A document without id has a null path and inherits nothing.
    """
    digit = F.lower(F.substring(F.lpad(F.hex(F.crc32(F.col("doc_id").cast("string"))), 8, "0"), 1, 1))
    path = F.concat(F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), digit, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    found = written(scored(docs), "licences")
    first = found.where("own_licence IS NOT NULL").groupBy(directory(F.col("path")).alias("of")).agg(F.min("doc_id").alias("first"))
    found = found.join(first, (directory(F.col("path")) == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    return inherited(found.drop("of"), licence_file=F.col("first").isNotNull()).select("doc_id", "path", "own_licence", "own_score", "licence", "licence_from")
