"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line, paragraph and whole text of a file is a unit. A unit's vector has (1 + ln tf) * idf for
each of its words; idf comes from the document frequencies of the template words over all files, and
a word of no template counts as unseen. A template counts from a cosine of `THRESHOLD`, if the unit has
the words that tell its licence from its relatives (one of each group of `MARKS`: version, affero, sa) and
none of those that tell a relative. A unit whose two best licences are less than `MARGIN` apart is
ambiguous. The best unambiguous unit gives the file's own licence; a file with ambiguous ones only is
`unknown`. Paragraphs that refuse a licence (`REFUSAL`) are left out before. Licence files (by name) pass
theirs to their directory; a file without its own takes that of the nearest ancestor directory that has one.

Only files with an anchor word are split into units: a template's anchors are its heaviest words, so
many that the rest of its vector is shorter than the threshold; a unit without any of them cannot
reach it (Cauchy-Schwarz), so nothing is lost. Nor can a unit whose part in template words is too short
beside its other words: no cosine exceeds the share of that part in the length of the unit. Only the
units that pass both bounds are taken apart into terms. Templates are a fixed set and their vectors
are broadcast.

Main path: built-in expressions, grouped aggregates and equi-joins. Directories, not files, walk up
their ancestors.

Edge cases: null and empty texts have no own licence; a null path is a file at the root; equal cosines
of several units go to the licence first in the alphabet, equal licence files of a directory likewise;
`unknown` is not passed on, but keeps a file from inheriting; rows that repeat a path and a text are
scanned once and all labelled; several texts of one path share the best licence; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, let, materialize

THRESHOLD = 0.6
LICENCE_FILE = "(?i)^(un)?(licen[sc]e|copying|notice)([.-].*)?$"

MARGIN = 0.02
UNKNOWN = "unknown"
#: A paragraph with this is no notice.
REFUSAL = "(?i)not\\s+(hereby\\s+|be\\s+|been\\s+)?(granted|licensed)|no\\s+(permission|licen[sc]e)\\s+(is|are)\\s+(hereby\\s+)?granted"

#: The elements of Creative Commons licences and the words that name them.
CC_ELEMENTS = {"BY": ("attribution",), "NC": ("nc", "noncommercial", "commercial"), "ND": ("nd", "noderivatives", "noderivs", "derivatives"), "SA": ("sa", "sharealike", "alike")}
CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "3.0": "Unported", "4.0": "International"}

#: The GNU licences, the words that tell their names, and their versions with the dates of their texts.
GNU = {
    "GPL": ("GNU General Public License", {"2.0": "June 1991", "3.0": "29 June 2007"}),
    "LGPL": ("GNU Lesser General Public License", {"2.1": "February 1999", "3.0": "29 June 2007"}),
    "AGPL": ("GNU Affero General Public License", {"3.0": "19 November 2007"}),
}

#: Usual notices of public licences, in headers and as the start of licence files.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]


def _gnu_templates() -> list[tuple[str, str]]:
    out = []
    for short, (name, versions) in GNU.items():
        for version, date in versions.items():
            v, code = version.removesuffix(".0"), f"{short}-{version}"
            subject = "library" if short == "LGPL" else "program"
            out += [
                (code, f"This work is licensed under the {name}, version {v}."),
                (code, f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."),
                (code, f"{name} Version {v}, {date}"),
                (code, f"Licensed under the {short} {version}"),
            ]
    return out


def _cc_templates() -> list[tuple[str, str]]:
    out = []
    for version, scope in CC_VERSIONS.items():
        for elements, name in CC_NAMES.items():
            notices = (f"Licensed under CC {elements} {version}.", f"This work is licensed under a Creative Commons {name} {version} {scope} License.", f"http://creativecommons.org/licenses/{elements.lower()}/{version}/")
            out += [(f"CC-{elements}-{version}", notice) for notice in notices]
    return out


def _templates() -> list[tuple[str, str]]:
    named = NOTICES + _gnu_templates() + _cc_templates()
    return sorted({*named, *[(code, f"SPDX-License-Identifier: {code}") for code, _ in named]})


def _marks(code: str) -> tuple[list[tuple[str, ...]], tuple[str, ...]]:
    """Groups of words of which a notice of the licence has one each, and words it has none of."""
    family, _, version = code.rpartition("-")
    if family.startswith("CC-"):
        have = family.split("-")[1:]
        groups = [("cc", "creative", "creativecommons"), *[CC_ELEMENTS[e] for e in have if e != "BY"], (version[0],), *([("0",)] if version == "2.0" else [])]
        return groups, tuple(w for e, words in CC_ELEMENTS.items() if e not in have for w in words)
    if family in GNU:
        others = {"GPL": ("lesser", "affero", "lgpl", "agpl"), "LGPL": ("affero", "agpl"), "AGPL": ("lesser", "lgpl")}[family]
        return [("gnu", family.lower()), *({"LGPL": [("lesser", "lgpl")], "AGPL": [("affero", "agpl")]}.get(family, [])), (version[0],), *([("1",)] if version == "2.1" else [])], others
    own = {
        "Apache-2.0": [("apache",), ("2",)], "Artistic-2.0": [("artistic",), ("2",)], "BSL-1.0": [("boost", "bsl"), ("1",)], "CC0-1.0": [("cc0",)],
        "EPL-1.0": [("eclipse", "epl"), ("1", "v1", "v10")], "EPL-2.0": [("eclipse", "epl"), ("2", "v2", "v20")], "ISC": [("isc", "permission")], "MIT": [("mit", "permission")],
        "MPL-1.1": [("mozilla", "mpl"), ("1",)], "MPL-2.0": [("mozilla", "mpl"), ("2",)], "Unlicense": [("unlicense", "unencumbered")], "Zlib": [("zlib", "redistribute")],
        "BSD-2-Clause": [("2", "redistributions")], "BSD-3-Clause": [("3", "endorse", "style")],
    }
    return own[code], {"BSD-2-Clause": ("endorse", "3"), "Unlicense": ("cc0",), "ISC": ("charge",), "MIT": ("fee",)}.get(code, ())


TEMPLATES = _templates()
MARKS = {code: _marks(code) for code, _ in TEMPLATES}
MARK_WORDS = sorted({w for groups, none in MARKS.values() for words in (*groups, none) for w in words})


def mask_of(words: tuple[str, ...]) -> int:
    """The words as bits, by their places in MARK_WORDS."""
    return sum(1 << MARK_WORDS.index(w) for w in words)


def _template_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


VOCABULARY = sorted({w for _, text in TEMPLATES for w in _template_words(text)})


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; may start or end with an empty word."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")


def inverse_frequencies(files: DataFrame) -> tuple[dict[str, float], float]:
    """idf of each template word over all files, and that of a word seen nowhere."""
    known = F.array_intersect(words(F.col("text")), F.array(*[F.lit(w) for w in VOCABULARY]))
    # an empty name counts the files themselves
    counts = {r.w: r.n for r in files.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    idf = lambda df: math.log((total + 1) / (df + 1)) + 1
    return {w: idf(counts.get(w, 0)) for w in VOCABULARY}, idf(0)


def template_vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for _, text in TEMPLATES:
        vector = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(_template_words(text)).items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        out.append({w: x / norm for w, x in vector.items()})
    return out


def anchors(vectors: list[dict[str, float]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which any unit that reaches `threshold` with some template has at least one."""
    out: set[str] = set()
    for vector in vectors:
        rest = 1.0
        for w, x in sorted(vector.items(), key=lambda e: (-e[1], e[0])):
            if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def may_reach(unit: Column, idf: dict[str, float], unseen: float, threshold: float) -> Column:
    """Whether the template words of a unit are heavy enough for a cosine of `threshold`; never wrongly false."""
    weight = F.create_map(*[x for w, v in sorted(idf.items()) for x in (F.lit(w), F.lit(v))])

    def bound(known: Column, n_words: Column) -> Column:
        kinds = F.array_distinct(known)
        square = lambda w: F.pow((1 + F.log(F.size(F.filter(known, lambda x: x == w)))) * weight[w], 2)
        inside = F.aggregate(F.transform(kinds, square), F.lit(0.0), lambda a, x: a + x)
        outside = (n_words - F.size(kinds)) * (unseen * unseen)  # any other word weighs this much at least
        return let(inside, lambda a: (a > 0) & (a >= (threshold - 1e-5) ** 2 * (a + outside)))

    return let(words(unit), lambda w: let(F.filter(w, lambda x: x.isin(*VOCABULARY)), lambda known: bound(known, F.size(F.array_distinct(F.array_remove(w, ""))))))


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(path, license, cosine) of every path that carries a notice."""
    spark = files.sparkSession
    idf, unseen = inverse_frequencies(files)
    vectors = template_vectors(idf)
    weights = F.broadcast(spark.createDataFrame([(w, k, TEMPLATES[k][0], x) for k, v in enumerate(vectors) for w, x in sorted(v.items())], "word string, template int, license string, x double"))
    known = F.broadcast(spark.createDataFrame([(w, x, mask_of((w,)) if w in MARK_WORDS else 0) for w, x in sorted({**dict.fromkeys(MARK_WORDS, unseen), **idf}.items())], "word string, idf double, mark long"))
    told = F.broadcast(spark.createDataFrame([(code, [mask_of(g) for g in groups], mask_of(none)) for code, (groups, none) in MARKS.items()], "license string, groups array<long>, others long"))
    some = F.arrays_overlap(words(F.col("text")), F.array(*[F.lit(w) for w in anchors(vectors, threshold)]))
    pattern = "|".join(anchors(vectors, threshold))
    texts = files.where(F.lower("text").rlike(pattern)).where(some).select("path", "text").distinct()
    willing = F.when(F.col("text").rlike(REFUSAL), F.array_join(F.filter(F.split("text", "\n{2,}"), lambda p: ~p.rlike(REFUSAL)), "\n\n")).otherwise(F.col("text"))
    whole = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"), F.col("said").alias("unit")))
    split = lambda sign, kind: F.transform(F.split("said", sign), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("unit")))
    said = texts.select("path", F.xxhash64("text").alias("of"), willing.alias("said"))
    units = said.select("path", "of", F.inline(F.concat(whole, split("\n", 0), split("\n{2,}", 1)))).where(F.lower("unit").rlike(pattern)).where(may_reach(F.col("unit"), idf, unseen, threshold))
    unit = ["path", "of", "kind", "at"]
    terms = units.select(*unit, F.explode(words(F.col("unit"))).alias("word")).where("word <> ''").groupBy(*unit, "word").agg(F.count("*").alias("n"))
    weighed = materialize(terms.join(known, "word", "left").select(*unit, "word", F.coalesce("mark", F.lit(0)).alias("mark"), ((1 + F.log("n")) * F.coalesce("idf", F.lit(unseen))).alias("y")), "license-terms")
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"), F.bit_or("mark").alias("marks"))
    dots = weighed.join(weights, "word").groupBy(*unit, "template", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norms, unit).select(*unit, "license", "marks", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    fitting = scored.join(told, "license").where((F.col("marks").bitwiseAND(F.col("others")) == 0) & F.forall("groups", lambda g: F.col("marks").bitwiseAND(g) != 0))
    best = fitting.groupBy(*unit, "license").agg(F.max("cosine").alias("cosine"))
    # the two best licences of a unit: the best, and the best of those that are another
    first = best.groupBy(*unit).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("one"))
    second = best.join(first, unit).where(F.col("license") != F.col("one.license")).groupBy(*unit).agg(F.max("cosine").alias("next"))
    clear = -F.col("one.c") - F.coalesce("next", F.lit(0.0)) >= margin
    judged = first.join(second, unit, "left").select("path", F.when(clear, F.col("one.license")).otherwise(UNKNOWN).alias("license"), F.col("one.c").alias("c"))
    least = judged.groupBy("path").agg(F.min(F.struct((F.col("license") == UNKNOWN).alias("last"), "c", "license")).alias("least"))
    return least.select("path", F.col("least.license").alias("license"), (-F.col("least.c")).alias("cosine"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`files` (with `path` and `text`) and own_license, cosine, license, origin.

    origin: `own`, `directory` (inherited) or `none`. Columns of these names are replaced.
    """
    own = materialize(own_licenses(files.select(F.coalesce("path", F.lit("")).alias("path"), "text"), threshold), "own-licenses")
    folder = lambda path: F.regexp_replace(path, "/?[^/]*$", "")
    granted = own.where(F.col("license") != UNKNOWN).where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)).select(folder(F.col("path")).alias("above"), F.struct((-F.col("cosine")).alias("c"), "license").alias("grant"))
    granted = granted.groupBy("above").agg(F.min("grant")["license"].alias("granted"))
    folders = files.select(folder(F.coalesce("path", F.lit(""))).alias("folder")).distinct()
    steps = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(steps))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("above")))
    inherited = folders.select("folder", F.inline(ancestors)).join(granted, "above").groupBy("folder").agg(F.max_by("granted", "depth").alias("granted"))
    inherited = checked_broadcast(materialize(inherited, "folders"))
    mine = checked_broadcast(own)
    path = F.coalesce(files["path"], F.lit(""))
    joined = files.join(mine, path == mine["path"], "left").join(inherited, folder(path) == inherited["folder"], "left")
    origin = F.when(mine["license"].isNotNull(), "own").when(inherited["granted"].isNotNull(), "directory").otherwise("none")
    made = {"own_license": mine["license"], "cosine": mine["cosine"], "license": F.coalesce(mine["license"], inherited["granted"]), "origin": origin}
    return joined.select(*[files[c] for c in files.columns if c not in made], *[c.alias(name) for name, c in made.items()])
