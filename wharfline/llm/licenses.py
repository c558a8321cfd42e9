"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Texts are cut into sentences twice: line by line, and over the lines of a paragraph with comment marks taken
off, so that wrapped headers are seen whole. A sentence and a template are vectors of terms weighted by
frequency and by inverse document frequency; the frequencies of the templates' terms are counted over all
documents, any other term counts as the rarest. A sentence is looked at if it holds one of the anchors: of each
template the rarest terms, so many that what is left of it is too short for the cosine asked for. That loses
no sentence, whatever its words. Sentences that are equal after folding are weighed once, and a cosine sums over
shared terms only, in a join with the templates' terms.

A file has the licence of its best sentence, of those that one licence has alone if there are any. A file is a licence file of its directory if at least ``file_share`` of its words lie
in licensed sentences, or if it has a licence and the name of such a file (LICENSE, COPYING and the like); a file without a licence of its own inherits that of the nearest
directory above it that has one, found by joining the ancestors of each directory.

Everything is DataFrame code; what the driver sees is bounded by the templates' terms. Cases: a null text has no
sentences; a null path is in no directory and inherits nothing; ties of a file go to the higher cosine, then the
alphabetically first licence, those of a directory also to the smallest id; rows are told apart by a number
of their own, so that equal ids and paths keep their own licences; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm.workdir import materialize

_WARRANTY = (
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services;",
    "loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
)
_GPL = (
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "You should have received a copy of the GNU General Public License along with this program.",
)
#: Licence texts and headers, sentence by sentence, by name (fixed values). With a star: sentences that several licences
#: share, which name a file's licence only if no other sentence does.
TEMPLATES = {
    "MIT*": _WARRANTY,
    "BSD-2-Clause*": _BSD,
    "GPL*": _GPL,
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "GNU General Public License Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU General Public License Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "GPL-3.0": (
        "GNU General Public License Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "GNU Lesser General Public License Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": ("Released under the 2-clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "Released under the 3-clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC", "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.',
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    "Zlib": (
        "SPDX-License-Identifier: Zlib", "This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "BSL-1.0": ("SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Proprietary*": ("All rights reserved.",),
}
SIMILARITY, FILE_SHARE = 0.6, 0.8
#: Names of files that hold a licence, whatever share of their words the templates know.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]es?|copying|copyright)([.-][^/]*)?$"
_SENTENCE = r"(?<=[.!?;:])\s+"
_TERM = r"[^\p{L}\p{N}.+-]+|[.-]+(?=\s|$)"
_COMMENT = r"(?m)^[ \t]*(?://+|/?\*+/?|#+|--+|;+|<!--|%+|>+|\"{3})?[ \t]*"


def terms(text: Column) -> Column:
    """The terms of a text in order, folded to lower case; empty strings stand between some."""
    return F.split(F.lower(text), _TERM)


@dataclass(frozen=True)
class Weights:
    """Weights of the templates: inverse document frequencies, unit vectors by template, anchors."""

    idf: dict[str, float]
    rarest: float
    vectors: list[tuple[int, str, str, float]]  # template, licence, term, weight in the unit vector
    anchors: list[str]


def split_templates(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> list[tuple[int, str, dict[str, int]]]:
    """Number, licence and terms (with their frequencies) of each template, cut as texts are."""
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, texts in templates.items() for t in texts)]
    found = spark.createDataFrame(rows, "template int, licence string, text string").select("template", "licence", terms(F.col("text")).alias("terms"))
    return [(r.template, r.licence, {t: r.terms.count(t) for t in r.terms if t}) for r in found.orderBy("template").collect()]


def weights(docs: DataFrame, least: float = SIMILARITY, templates: dict[str, tuple[str, ...]] | None = None) -> Weights:
    """Weights by the share of all documents that hold a term; the driver gets one count for each term of a template."""
    known = split_templates(docs.sparkSession, templates or TEMPLATES)
    vocabulary = sorted({t for _, _, found in known for t in found})
    held = F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = {r.term: r.n for r in docs.select(F.explode(F.array_append(F.coalesce(held, F.array().cast("array<string>")), "")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    total = counts.pop("", 0)  # each document has an empty term
    idf = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    vectors, anchors = [], set()
    for number, name, found in known:
        w = {t: n * idf[t] for t, n in found.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors += [(number, name, t, x / norm) for t, x in w.items()]
        left = 1.0
        for t in sorted(w, key=lambda t: (-w[t], t)):
            if left < least * least * (1 - 1e-9):
                break
            anchors.add(t)
            left -= (w[t] / norm) ** 2
    return Weights(idf, math.log(1 + total) + 1, vectors, sorted(anchors))


def passages(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """row, total (words of the text), passage (folded terms) and its words, for the sentences with an anchor."""
    marks = F.array(*map(F.lit, anchors))
    rows = docs.select("row", "text").filter(F.arrays_overlap(terms(F.col("text")), marks))
    lines = F.split("text", "\n")
    joined = F.transform(F.split(F.regexp_replace("text", _COMMENT, ""), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\s*\n\s*", " "))
    sentences = lambda parts: F.flatten(F.transform(parts, lambda p: F.split(p, _SENTENCE)))
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    rows = rows.select("row", words.alias("total"), F.explode(F.array_distinct(F.concat(sentences(lines), sentences(joined)))).alias("part"))
    rows = rows.filter(F.arrays_overlap(terms(F.col("part")), marks))
    folded = F.array_join(F.filter(terms(F.col("part")), lambda x: x != ""), " ")
    return rows.select("row", "total", folded.alias("passage"), F.regexp_count("part", F.lit(r"\S+")).alias("words"))


def similarities(spark: SparkSession, found: DataFrame, model: Weights, least: float = SIMILARITY) -> DataFrame:
    """passage, licence, score: the best template of each distinct ``passage``, if similar enough."""
    idf = F.broadcast(spark.createDataFrame(list(model.idf.items()), "term string, idf double"))  # terms of the templates
    theirs = F.broadcast(spark.createDataFrame(model.vectors, "template int, licence string, term string, t double"))  # likewise
    words = found.select("passage", F.explode(F.split("passage", " ")).alias("term")).groupBy("passage", "term").agg(F.count("*").alias("tf"))
    ours = words.join(idf, "term", "left").select("passage", "term", (F.col("tf") * F.coalesce("idf", F.lit(model.rarest))).alias("w"))
    norm = ours.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = ours.join(theirs, "term").groupBy("passage", "template", "licence").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(norm, "passage").select("passage", "licence", (F.col("dot") / F.col("norm")).alias("score"))
    order = F.struct((-F.round("score", 12)).alias("s"), F.col("licence").endswith("*").alias("shared"), "licence")
    best = scored.filter(F.col("score") >= least).groupBy("passage").agg(F.min(order).alias("b"))
    return best.select("passage", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licences(docs: DataFrame, least: float = SIMILARITY, file_share: float = FILE_SHARE, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, path, own licence and score, licence (own or inherited), inherited_from: for each document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "path", "text", F.monotonically_increasing_id().alias("row"))
    model = weights(docs, least, templates)
    rows = materialize(spark, passages(docs, model.anchors), "licences")
    best = materialize(spark, similarities(spark, rows.select("passage").distinct(), model, least), "licences")
    # a sentence found both ways counts its words once
    owned = rows.join(best, "passage").groupBy("row", "passage").agg(F.max("total").alias("total"), F.max("words").alias("words"), F.min(F.struct(F.col("licence").endswith("*").alias("shared"), (-F.col("score")).alias("s"), F.rtrim("licence", F.lit("*")).alias("licence"))).alias("b"))
    owned = owned.groupBy("row").agg(F.min("b").alias("b"), (F.sum("words") / F.max("total")).alias("share"))
    owned = owned.select("row", F.col("b.licence").alias("own"), (-F.col("b.s")).alias("score"), "share")
    numbered = docs.select("row", "doc_id", "path", _directory(F.col("path")).alias("directory"))
    owned = materialize(spark, numbered.join(owned, "row", "left"), "licences")
    # the text of a long licence is known by its title and its header; its name says that it is one
    files = owned.filter(((F.col("share") >= file_share) | F.col("path").rlike(FILE_NAME)) & F.col("own").isNotNull() & F.col("path").isNotNull())
    rules = files.groupBy(F.col("directory").alias("ancestor")).agg(F.min(F.struct((-F.col("score")).alias("s"), "own", "doc_id")).alias("b")).select("ancestor", F.col("b.own").alias("rule"))
    # each directory once: its ancestors, itself first, by the number of their parts
    directories = owned.select("directory").filter("directory IS NOT NULL").distinct()
    above = directories.select("directory", F.explode(F.sequence(F.lit(0), F.size(F.split("directory", "/")))).alias("depth"))
    above = above.select("directory", "depth", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/").alias("ancestor"))
    nearest = above.join(rules, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "rule", "ancestor")).alias("b")).select("directory", F.col("b.rule").alias("rule"), F.col("b.ancestor").alias("ancestor"))
    nearest = materialize(spark, nearest, "licences")
    inherits = F.col("own").isNull() & F.col("rule").isNotNull()
    return owned.join(nearest, "directory", "left").select("doc_id", "path", "own", "score", F.coalesce("own", "rule").alias("licence"), F.when(inherits, F.col("ancestor")).alias("inherited_from"))


def with_path(docs: DataFrame) -> DataFrame:
    """The corpus as files: source, language and id are the parts of a path."""
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def licence_report(docs: DataFrame) -> DataFrame:
    return scan_licences(with_path(docs.select("doc_id", "text", "source", "lang"))).withColumn("score", F.round("score", 6))
