"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Only DataFrame functions are used. A text's passages (its lines, two and three adjoining lines, paragraphs, their
sentences, and the whole) are exploded to terms and joined to the sparse vectors of the templates: titles, statements,
standard headers, identifiers and whole texts of licences, a table whose size is fixed by the templates. A file's licence
is that of its best passage. A file named like a licence file covers its directory: its licence is joined to all files
below by their ancestor paths, and each file without a licence of its own takes the one with the longest path.

Passages that can't match are left out first: a cosine is at most the norm of the template's part that the passage has
terms of. Words of everyday use are set aside as long as no template has ``THRESHOLD`` of its norm in them; a passage
without any of the other terms can't reach the threshold. Nor can one whose words outside the templates, at the largest
weight there is, make it too long for those within.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import Scratch, text_of

THRESHOLD = 0.6
#: Terms of a template that a passage has at least.
TERMS = 2
#: A statement that names none of the licences below.
OTHER_LICENCE = "LicenseRef-other"
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_WARRANTY = "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."


def _gnu(name: str, version: str, date: str, identifier: str) -> list[str]:
    program = "library" if "Lesser" in name else "program"
    return [
        f"GNU {name} Version {version}, {date}",
        f"This work is licensed under the GNU {name}, version {version}.",
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"SPDX-License-Identifier: {identifier}-only",
        f"SPDX-License-Identifier: {identifier}-or-later",
    ]


def _creative(name: str, short: str, identifier: str) -> list[str]:
    return [f"Licensed under {short}.", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"SPDX-License-Identifier: {identifier}"]


#: Licence texts by identifier: titles, statements, headers, identifiers and whole texts. Fixed values.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["The MIT License (MIT)", "Released under the MIT License.", "SPDX-License-Identifier: MIT", _GRANT, f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}"],
    "Apache-2.0": [
        "Apache License, Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": _gnu("General Public License", "2", "June 1991", "GPL-2.0"),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007", "GPL-3.0"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "February 1999", "LGPL-2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "29 June 2007", "LGPL-3.0"),
    "AGPL-3.0": _gnu("Affero General Public License", "3", "19 November 2007", "AGPL-3.0"),
    "CC-BY-4.0": _creative("Attribution", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC0-1.0": ["CC0 1.0 Universal", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "SPDX-License-Identifier: BSD-2-Clause", _BSD, f"{_BSD} {_BSD_WARRANTY}"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", _BSD_THIRD, f"{_BSD} {_BSD_THIRD} {_BSD_WARRANTY}"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    OTHER_LICENCE: ["SPDX-License-Identifier:", "This work is licensed under the License.", "Released under the License."],
}
#: Names of files whose licence holds for their directory, in lower case and without extension.
NAMES = ("license", "licence", "copying", "unlicense")
#: Words that say little about a text.
EVERYDAY = ("the", "of", "and", "to", "in", "is", "this", "or", "for", "a", "with", "that", "by", "as", "on", "be", "are", "an", "not", "if", "it", "at", "any", "may", "was", "you", "can", "all", "no", "from", "its", "but", "out", "so", "into", "either", "other", "such", "following", "use", "see", "even", "only", "1", "2", "0", "4")
_TERM = "[a-z0-9]+"
_SENTENCE, _PARAGRAPH = "[.!?;] +", "\n[ \t\r]*\n"


def vectors() -> list[tuple[int, str, str, float, float]]:
    """``template, licence, term, weight, idf``: the templates' unit TF-IDF vectors, with one plus the logarithm of counts and smoothed inverse frequencies among them."""
    texts = [(k, Counter(re.findall(_TERM, v.lower()))) for k, vs in TEMPLATES.items() for v in vs]
    seen = Counter(t for _, c in texts for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in seen.items()}
    out = []
    for i, (k, c) in enumerate(texts):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        out += [(i, k, t, round(w[t] / size, 12), round(idf[t], 12)) for t in sorted(w)]
    return out


#: The idf of a term that no template has.
OTHER = math.log(1 + sum(map(len, TEMPLATES.values()))) + 1


def telling(threshold: float = THRESHOLD) -> list[str]:
    """Terms of which a passage at ``threshold`` has one: all but the everyday ones, which together hold less of any template's norm."""
    rows = vectors()
    idf, left = {t: i for _, _, t, _, i in rows}, Counter()
    common: set[str] = set()
    for t in EVERYDAY:
        with_t = left + Counter({i: w * w for i, _, term, w, _ in rows if term == t})
        if max(with_t.values()) >= (threshold - 1e-6) ** 2:
            continue
        left, common = with_t, common | {t}
    return sorted(idf.keys() - common)


def as_files(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text``: documents as files of a tree by source, language and id (a number), for tables without paths.

    A thousand ids share a directory and a hundred a subdirectory of it. Ids that are multiples of a thousand are the
    LICENSE file of the first, other multiples of a hundred that of the second.
    """
    i = F.col("doc_id").cast("long")
    top = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(i / 1000).cast("string"))
    sub = F.concat_ws("/", top, F.floor(i / 100).cast("string"))
    path = F.when(i % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(i % 100 == 0, F.concat(sub, F.lit("/LICENSE"))).otherwise(F.concat(sub, F.lit("/"), i.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def reachable(words: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a passage of these words can be at ``threshold`` to any template.

    A cosine is at most the share of the passage's length in template terms. A term that occurs n times weighs
    (1 + ln n)^2 < 1.48 n in its square, and words outside the templates weigh ``OTHER`` squared, each once at least.
    """
    idf = {t: i for _, _, t, _, i in vectors()}
    slight = [t for t, i in idf.items() if i <= OTHER / 2]
    inside, light = F.size(F.filter(words, lambda w: w.isin(*idf))), F.size(F.filter(words, lambda w: w.isin(*slight)))
    outside = F.size(F.array_distinct(F.filter(words, lambda w: ~w.isin(*idf))))
    return (inside - 0.75 * light) * (1.48 * (1 / (threshold - 1e-6) ** 2 - 1)) >= outside


def shares(words: Column) -> Column:
    """Of the words that templates have: an array of the template and the squared weight there, for each of both."""
    of: dict[str, list[Column]] = {}
    for i, _, t, w, _ in vectors():
        of.setdefault(t, []).append(F.struct(F.lit(i).alias("i"), F.lit(w * w).alias("w")))
    table = F.create_map(*[x for t, rows in of.items() for x in (F.lit(t), F.array(*rows))])
    return F.flatten(F.transform(F.array_intersect(words, F.array(*map(F.lit, of))), lambda t: F.element_at(table, t)))


def meets(shares: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a text holds ``TERMS`` terms of a template and ``threshold`` of its norm: a cosine is at most that share."""
    mine = lambda i: F.filter(shares, lambda h: h["i"] == i)
    whole = lambda i: F.aggregate(mine(i), F.lit(0.0), lambda total, h: total + h["w"]) >= (threshold - 1e-6) ** 2
    return F.exists(F.array_distinct(F.transform(shares, lambda h: h["i"])), lambda i: (F.size(mine(i)) >= TERMS) & whole(i))


def passages(files: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, passage``: the passages of each whole text that can match, in lower case."""
    terms = telling(threshold)
    words = lambda x: F.regexp_extract_all(x, F.lit(f"({_TERM})"), F.lit(1))
    tells = lambda x: F.exists(x, lambda w: w.isin(*terms))
    # Where a passage holds enough of a template, so does the whole text. Exploded structs are taken out once, however often they are used.
    once = lambda df, *cols: df.select(key, F.explode(F.array(F.struct(*cols))).alias("t")).select(key, "t.*")
    texts = once(files.select(key, F.lower(text_of()).alias("text")), F.col("text"), words("text").alias("words")).filter(tells(F.col("words")))
    texts = once(texts, F.col("text"), shares(F.col("words")).alias("shares")).filter(meets(F.col("shares"), threshold))
    lines = F.split("text", "\n")
    near = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(lines, i, n), " "))
    paragraphs = F.transform(F.split("text", _PARAGRAPH), lambda p: F.translate(p, "\n", " "))
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, _SENTENCE)))
    found = F.array_distinct(F.concat(lines, near(2), near(3), paragraphs, sentences, F.array(F.translate("text", "\n", " "))))
    # Exploded together, so that the words are taken out once.
    cut = texts.select(key, F.explode(F.transform(found, lambda p: F.struct(p.alias("passage"), words(p).alias("words")))).alias("p")).select(key, "p.*")
    return cut.filter(tells(F.col("words")) & reachable(F.col("words"), threshold)).select(key, "passage")


def match(candidates: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, licence, similarity``: the licence of the template with the largest cosine to one of the key's passages, at ``threshold`` or above."""
    spark = candidates.sparkSession
    templates = F.broadcast(spark.createDataFrame(vectors(), "template int, licence string, term string, weight double, idf double"))  # fixed by TEMPLATES
    idf = templates.select("term", "idf").distinct()
    words = F.regexp_extract_all("passage", F.lit(f"({_TERM})"), F.lit(1))
    # Passages recur; each distinct one is compared once, under a digest that stands for it.
    candidates = candidates.withColumn("id", F.md5(F.encode("passage", "UTF-8")))
    distinct = candidates.select("id", "passage").dropDuplicates(["id"])
    tf = distinct.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    weighed = tf.join(F.broadcast(idf), "term", "left").select("id", "term", ((1 + F.log("n")) * F.coalesce("idf", F.lit(round(OTHER, 12)))).alias("w"))
    size = weighed.groupBy("id").agg(F.sqrt(F.sum(F.round(F.col("w") * F.col("w"), 9))).alias("size"))
    dot = weighed.join(templates, "term").groupBy("id", "template", "licence").agg(F.sum(F.round(F.col("w") * F.col("weight"), 9)).alias("dot"), F.count("*").alias("terms")).filter(F.col("terms") >= TERMS)
    similar = dot.join(size, "id").select("id", "licence", F.round(F.col("dot") / F.col("size"), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    order = F.struct("similarity", F.col("licence").alias("name"))
    best = similar.groupBy("id").agg(F.max(order).alias("best"))
    return candidates.select(key, "id").join(best, "id").groupBy(key).agg(F.max("best").alias("best")).select(key, F.col("best.name").alias("licence"), F.col("best.similarity").alias("similarity"))


def scan(files: DataFrame, key: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """``key, path, own_licence, similarity, licence, inherited_from`` for each file (columns ``key``, ``path``, ``text``).

    ``key`` names a file; rows that share it share the best licence of their texts, and stay repeated. A statement that
    names none of the templates' licences is ``LicenseRef-other``. Of several licence files of a directory the most similar counts (ties: the later name). A file without a licence in its whole
    text takes that of the nearest directory on its path that has one, ``inherited_from``; none gives nulls. Null and
    empty texts have no licence of their own; a null path has no directories; a null key is never matched.
    """
    candidates = Scratch(files.sparkSession, "licences").table(passages(files, key, threshold), "passages")  # read twice, found once
    own = match(candidates, key, threshold)
    rows = files.select(key, "path").join(own, key, "left").withColumnRenamed("licence", "own_licence")
    cut = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    name = F.lower(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\..*$", ""))
    covers = rows.filter(name.isin(*NAMES) & F.col("own_licence").isNotNull())
    directories = covers.groupBy(cut("path").alias("directory")).agg(F.max(F.struct("similarity", "own_licence")).alias("best")).select("directory", F.col("best.own_licence").alias("directory_licence"))
    # All ancestors of the distinct directories, not of the files: a directory's files share what they inherit.
    parts = F.split("home", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    homes = rows.filter("own_licence is null and path is not null").select(cut("path").alias("home")).distinct()
    above = homes.select("home", F.explode(ancestors).alias("directory")).join(directories, "directory")
    nearest = above.groupBy("home").agg(F.max_by(F.struct("directory", "directory_licence"), F.length("directory")).alias("from"))
    joined = rows.withColumn("home", cut("path")).join(nearest, "home", "left")
    takes = F.col("own_licence").isNull()
    return joined.select(key, "path", "own_licence", "similarity", F.coalesce("own_licence", "from.directory_licence").alias("licence"), F.when(takes, F.col("from.directory")).alias("inherited_from"))


def sql() -> str:
    """The same for documents as files, as DuckDB SQL; no passage is left out beforehand."""
    rows = ", ".join(f"({i}, '{k}', '{t}', {w!r}::DOUBLE, {f!r}::DOUBLE)" for i, k, t, w, f in vectors())
    names = ", ".join(f"'{x}'" for x in NAMES)
    return f"""
    WITH tpl(template, licence, term, weight, idf) AS (VALUES {rows}),
    idf AS (SELECT DISTINCT term, idf FROM tpl),
    base AS (SELECT doc_id, lower(coalesce(text, '')) AS text, '/' || coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR) AS top FROM documents),
    files AS (SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN top || '/LICENSE' ELSE top || '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) || CASE WHEN doc_id % 100 = 0 THEN '/LICENSE' ELSE '/' || CAST(doc_id AS VARCHAR) || '.txt' END END AS path FROM base),
    cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda p: replace(p, chr(10), ' ')) AS ps FROM files),
    cand AS (SELECT DISTINCT doc_id, unnest(list_concat(ls, list_transform(range(1, len(ls)), lambda i: array_to_string(ls[i:i+1], ' ')), list_transform(range(1, greatest(len(ls) - 1, 1)), lambda i: array_to_string(ls[i:i+2], ' ')),
             ps, flatten(list_transform(ps, lambda p: regexp_split_to_array(p, '{_SENTENCE}'))), [replace(text, chr(10), ' ')])) AS passage FROM cut),
    tf AS (SELECT passage, term, count(*) AS n FROM (SELECT passage, unnest(regexp_extract_all(passage, '{_TERM}')) AS term FROM (SELECT DISTINCT passage FROM cand)) GROUP BY ALL),
    wt AS (SELECT passage, tf.term, (1 + ln(n)) * coalesce(idf, {round(OTHER, 12)!r}::DOUBLE) AS w FROM tf LEFT JOIN idf ON tf.term = idf.term),
    sz AS (SELECT passage, sqrt(sum(round(w * w, 9))) AS size FROM wt GROUP BY passage),
    dt AS (SELECT passage, template, licence, sum(round(w * weight, 9)) AS dot FROM wt JOIN tpl ON wt.term = tpl.term GROUP BY ALL HAVING count(*) >= {TERMS}),
    sim AS (SELECT dt.passage, licence, round(dot / size, 6) AS similarity FROM dt JOIN sz ON dt.passage = sz.passage WHERE round(dot / size, 6) >= {THRESHOLD}),
    best AS (SELECT doc_id, licence, similarity FROM cand JOIN sim ON cand.passage = sim.passage QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, licence DESC) = 1),
    own AS (SELECT files.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS home, licence AS own_licence, similarity FROM files LEFT JOIN best ON files.doc_id = best.doc_id),
    dirs AS (SELECT home AS directory, own_licence AS directory_licence FROM own WHERE own_licence IS NOT NULL AND lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\..*$', '')) IN ({names})
             QUALIFY row_number() OVER (PARTITION BY home ORDER BY similarity DESC, own_licence DESC) = 1),
    near AS (SELECT home, directory, directory_licence FROM (SELECT DISTINCT home FROM own) JOIN dirs ON home = directory OR starts_with(home, directory || '/')
             QUALIFY row_number() OVER (PARTITION BY home ORDER BY length(directory) DESC) = 1)
    SELECT doc_id, path, own_licence, similarity, coalesce(own_licence, directory_licence) AS licence, CASE WHEN own_licence IS NULL THEN directory END AS inherited_from
    FROM own LEFT JOIN near ON own.home = near.home"""
