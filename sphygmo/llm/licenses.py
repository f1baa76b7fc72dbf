"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.llm.common import table, written

#: Public licences by SPDX name, as titles, notices, standard file headers, short licences in full and the first
#: paragraphs of long ones; and the words that a match must have (| between alternatives) and must not have (behind !): the
#: names and versions that tell licences apart.
TEMPLATES = [
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "affero|agpl 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.", "affero|agpl 3"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.", "affero copyleft"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache 2"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache 2"),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. \"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.", "licensor entity|sections"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions !endorse"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", "bsd 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd style"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistributions endorse"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.", "cc|creative 4 !nc !noncommercial !sa !sharealike !nd !noderivatives"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc|creative 4 !nc !noncommercial !sa !sharealike !nd !noderivatives"),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\").", "cc|creative 4 !nc !noncommercial !sa !sharealike !nd !noderivatives"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc|creative nc|noncommercial 4 !sa !sharealike !nd !noderivatives"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc|creative nc|noncommercial 4 !sa !sharealike !nd !noderivatives"),
    ("CC-BY-NC-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License (\"Public License\").", "cc|creative nc|noncommercial 4 !sa !sharealike !nd !noderivatives"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License, CC BY-NC-ND 4.0.", "cc|creative nc|noncommercial nd|noderivatives 4 !sa !sharealike"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc|creative nc|noncommercial nd|noderivatives 4 !sa !sharealike"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License, CC BY-NC-SA 4.0.", "cc|creative nc|noncommercial sa|sharealike 4 !nd !noderivatives"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc|creative nc|noncommercial sa|sharealike 4 !nd !noderivatives"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License, CC BY-ND 4.0.", "cc|creative nd|noderivatives 4 !nc !noncommercial !sa !sharealike"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc|creative nd|noderivatives 4 !nc !noncommercial !sa !sharealike"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0.", "cc|creative sa|sharealike 4 !nc !noncommercial !nd !noderivatives"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc|creative sa|sharealike 4 !nc !noncommercial !nd !noderivatives"),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\").", "cc|creative sa|sharealike 4 !nc !noncommercial !nd !noderivatives"),
    ("CC0-1.0", "Released under CC0 1.0, no rights reserved, dedicated to the public domain.", "cc0"),
    ("CC0-1.0", "CC0 1.0 Universal", "cc0"),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.", "waiving worldwide"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gpl|general 2 !lesser !lgpl !affero !agpl !3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gpl|general 2 !lesser !lgpl !affero !agpl !3"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", "gpl|general 2 !lesser !lgpl !affero !agpl !3"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.", "general contrast|freedom !practical !copyleft !lesser !affero"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gpl|general 3 !lesser !lgpl !affero !agpl"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", "gpl|general 3 !lesser !lgpl !affero !agpl"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "gpl|general 3 !lesser !lgpl !affero !agpl"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too.", "general copyleft|practical|versions !lesser !affero"),
    ("ISC", "ISC License", "isc"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "granted copy modify distribute !charge"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1.", "lesser|lgpl 2 1 !affero"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "lesser|lgpl 2 1 !affero"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", "lesser|lgpl 2 1 !affero"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "lesser|lgpl 3 !affero"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", "lesser|lgpl 3 !affero"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "lesser|lgpl 3 !affero"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", "lesser|lgpl 3 !affero"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "MIT License", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", "granted charge"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "granted charge"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla|mpl 2"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla|mpl 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla|mpl 2"),
    ("MPL-2.0", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.", "contributor covered|contribution"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "altered|redistribute"),
]
#: A tag that names its licence itself, in a header of any wording: one identifier, or an expression of several.
SPDX = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)*)"
#: What says in an identifier which versions may be chosen, not which licence it is.
CHOICE = r"^([A-Za-z0-9.-]*[A-Za-z0-9])(-only|-or-later|\+)$"
#: A header takes the licence of the most similar template from here on.
SIMILAR = 0.6
#: Words, but for function words, that it must share with the template: "Mit." in German prose is no MIT licence.
SHARED = 2
#: Headers of several sentences are also compared in windows of so many sentences, half a window apart.
WINDOWS = [2, 4, 8, 16, 32, 64]
TOKEN = r"[a-z0-9]+"
#: Function words, which have no weight.
STOP_WORDS = (
    "a all an and any are as at be been but by can could do does for from had has have he her his i if in into is it its may me "
    "more my no nor not of on one or other our out she should so such than that the their them then there these they this those to "
    "under up upon was we were what when where which who whom whose will with within without would you your"
).split()
#: Sentences end at line breaks and where a full stop precedes a capital.
STOP, BREAK = r"([.!?])[ \t]+([A-Z])", r"[\r\n]+"


def _weights() -> tuple[dict[str, float], list[dict[str, float]], float]:
    """Inverse frequency of each template word, each template's weights, and the frequency weight of all other words.

    Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), with n and df over the templates: whether a file is like a
    template does not depend on the other files.
    """
    counts = [Counter(t for t in re.findall(TOKEN, text.lower()) if t not in STOP_WORDS) for _, text, _ in TEMPLATES]
    seen = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + d)) + 1 for t, d in seen.items()}
    return idf, [{t: (1 + math.log(k)) * idf[t] for t, k in c.items()} for c in counts], math.log(1 + len(counts)) + 1


def _anchors() -> list[str]:
    """Words of which every text with cosine :data:`SIMILAR` to some template has at least one.

    Without a template's anchors, the cosine is at most the norm of its other words' share: numbers and the
    commonest words are left out while that stays below SIMILAR.
    """
    idf, templates, _ = _weights()
    found = set()
    for v in templates:
        left = SIMILAR**2 * sum(w * w for w in v.values()) * (1 - 1e-9)
        for t in sorted(v, key=lambda t: (not t.isdigit(), idf[t], len(t), t)):
            left -= v[t] ** 2
            if left <= 0:
                found.add(t)
    return sorted(found | {"spdx"})


ANCHORS = _anchors()


def _needs() -> list[tuple[int, str, int, bool]]:
    """(ord, token, bit, barred): the words that count for a template's agreement; each group of alternatives has a bit."""
    out = []
    for k, (_, _, told) in enumerate(TEMPLATES):
        bit = 1
        for group in told.split():
            if group.startswith("!"):
                out.append((k, group[1:], 0, True))
            else:
                out += [(k, t, bit, False) for t in group.split("|")]
                bit *= 2
    return out


def _whole(k: int) -> int:
    """All bits of a template."""
    return (1 << sum(not g.startswith("!") for g in TEMPLATES[k][2].split())) - 1


def tagged(text: Column) -> Column:
    """The licence that an SPDX tag names, null without one; parentheses go, and so does the choice of versions of a single one."""
    named = F.regexp_replace(F.regexp_extract(text, SPDX, 1), r"[()]", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(named, CHOICE, "$1"), r"[ \t]+", " "), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def header_runs(text: str) -> Column:
    """The distinct headers of a text: runs of sentences that each hold an anchor word, joined by line feeds. The whole text
    is looked at; sentences without letters a-z and digits are passed over. A licence file is one run or a few."""
    sentences = F.filter(F.split(F.regexp_replace(text, STOP, "$1\n$2"), BREAK), lambda s: F.lower(s).rlike(TOKEN))
    marked = F.transform(sentences, lambda s: F.when(F.arrays_overlap(_tokens(s), F.lit(ANCHORS)), s).otherwise("\r"))
    runs = F.split(F.array_join(marked, "\n"), "\n?\r[\r\n]*")
    return F.filter(F.array_distinct(runs), lambda r: r != "")


def units(found: DataFrame) -> DataFrame:
    """(path, unit, text) of what is compared: each sentence of a header, windows of several, and the whole header.
    ``unit`` is the text's digest."""
    parts, size = F.split("run", "\n"), F.size(F.split("run", "\n"))
    windows = [
        F.when(size > w, F.transform(F.sequence(F.lit(1), size, F.lit(w // 2)), lambda s, w=w: F.array_join(F.slice(parts, s, w), "\n")))
        for w in WINDOWS
    ]
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(parts, F.array("run"), *[F.coalesce(w, none) for w in windows]))
    out = found.select("path", F.explode(F.array_distinct(every)).alias("text"))
    return out.select("path", F.md5(F.col("text").cast("binary")).alias("unit"), "text")


def matched(compared: DataFrame) -> DataFrame:
    """(unit, license, similarity) of each different unit that is like a template or has a tag that names its licence.

    Units are told apart first, so one notice in a third of all files is one row here. A unit's vector has all its words; a
    template counts only if the unit has the words that tell its licence from others, and none that speak against it. A
    tag is a template of its own licence, and like it to the full. The templates' words are a fixed handful and are
    broadcast; after units are dealt by digest nothing is shuffled.
    """
    spark = compared.sparkSession
    idf, templates, other = _weights()
    vocabulary = spark.createDataFrame(sorted(idf.items()), "token string, idf double")
    agree = {(k, t): (bit, barred) for k, t, bit, barred in _needs()}
    weights = {(k, t): w / math.sqrt(sum(x * x for x in v.values())) for k, v in enumerate(templates) for t, w in v.items()}
    rows = [(t, k, TEMPLATES[k][0], _whole(k), weights.get((k, t), 0.0), *agree.get((k, t), (0, False))) for k, t in sorted({*agree, *weights})]
    sides = spark.createDataFrame(rows, "token string, ord int, license string, whole int, v double, bit int, barred boolean")
    distinct = compared.groupBy("unit").agg(F.min("text").alias("text"))
    named = distinct.select("unit", tagged(F.col("text")).alias("license"), F.lit(1.0).alias("similarity")).filter("license is not null")
    counted = distinct.select("unit", F.explode(_tokens(F.col("text"))).alias("token")).filter(~F.col("token").isin(STOP_WORDS)).groupBy("unit", "token").agg(F.count("*").alias("tf"))
    weighted = counted.join(F.broadcast(vocabulary), "token", "left").select("unit", "token", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(other))).alias("w"))
    norms = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(sides), "token").groupBy("unit", "ord", "license", "whole").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.count_if(F.col("v") > 0).alias("shared"), F.bit_or("bit").alias("bits"), F.bool_or("barred").alias("barred"))
    dots = dots.filter((F.col("shared") >= SHARED) & (F.col("bits") == F.col("whole")) & ~F.col("barred"))
    cosine = dots.join(norms, "unit").select("unit", "ord", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = cosine.groupBy("unit").agg(F.max(F.struct("similarity", (-F.col("ord")).alias("o"), "license")).alias("b"))
    return best.filter(F.col("b.similarity") >= SIMILAR).select("unit", "b.license", "b.similarity").unionByName(named)


def scan_licenses(files: DataFrame) -> DataFrame:
    """(path, license, similarity, licensed_by) for each row of ``files`` (path, text, is_notice).

    A file takes the most similar template of its own headers: whole, in windows, or one sentence of them, with two
    words in common at least and the words that tell licences and versions apart (ties: the first licence by name); a tag
    that names its licence comes before any template. A licence file is a header like any other. Otherwise it takes the licence of the nearest directory
    above it that has one: a directory has the licence of the file in it with ``is_notice`` (several: the most similar,
    then the first path). ``licensed_by`` is the file's own path, or that directory, or null. Directories, not files, are
    joined with their ancestors, so a directory with a third of all files is a few rows until the last join.

    Null or empty text: nothing of its own. Null path: no directory, nothing inherited. Repeated rows: equal rows each.
    No rows: no rows. Other columns are ignored.
    """
    return scan_runs(files.select("path", header_runs("text").alias("runs"), "is_notice"))


def scan_runs(files: DataFrame) -> DataFrame:
    """:func:`scan_licenses` of files (path, runs, is_notice) that are already brought down to :func:`header_runs`."""
    base = files.select("path", "runs", F.coalesce("is_notice", F.lit(False)).alias("is_notice"))
    # an inner explode would have Spark filter by the array's size where texts are read, and so find the headers twice
    runs = base.filter("path is not null").select("path", F.explode_outer("runs").alias("run")).filter("run is not null")
    found = units(written(runs, "headers"))
    alike = written(matched(found), "units")
    own = found.select("path", "unit").join(alike, "unit").groupBy("path").agg(F.max("similarity").alias("top"), F.min_by("license", F.struct(-F.col("similarity"), "license")).alias("own"))
    own = written(own, "own")
    placed = written(base.select("path", "is_notice", F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("dir")), "paths")
    notices = placed.filter("is_notice and dir is not null").join(own, "path").groupBy("dir").agg(F.min_by(F.struct("own", "top"), F.struct(-F.col("top"), "path")).alias("d")).select(F.col("dir").alias("above"), F.col("d.own").alias("theirs"), F.col("d.top").alias("their_top"))
    dirs = placed.filter("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above"))
    nearest = ups.join(notices, "above").groupBy("dir").agg(F.max_by(F.struct("above", "theirs", "their_top"), F.length("above")).alias("n"))
    out = placed.join(own, "path", "left").join(nearest, "dir", "left")
    by = F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("n.above"))
    return out.select("path", F.coalesce("own", "n.theirs").alias("license"), F.coalesce("top", "n.their_top").alias("similarity"), by.alias("licensed_by"))


def as_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files: source/lang/hundred of doc_id/doc_id.txt; null parts are ``_``. In each directory
    the first file stands for its licence file, and so does the first file of each source, one level up. Texts come down
    to their headers (``runs``) where they are read, so that the join moves no whole texts."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    top, deep = F.concat_ws("/", part("source"), part("lang")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_"))
    firsts = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("first_doc"))
    slim = docs.select("doc_id", "source", "lang", header_runs("text").alias("runs"))
    marked = slim.join(firsts.select(F.col("source").alias("s"), F.col("lang").alias("l"), "first_doc"), F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")))
    up = F.col("doc_id") == F.col("first_doc")
    path = F.when(up, F.concat_ws("/", top, F.concat(part("doc_id"), F.lit(".txt")))).otherwise(F.concat_ws("/", top, deep, F.concat(part("doc_id"), F.lit(".txt"))))
    return marked.select("doc_id", path.alias("path"), "runs", (up | (F.col("doc_id") % 100 == 0)).alias("is_notice"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of each document, its own or that of the nearest directory above it."""
    found = scan_runs(as_files(table(spark, sf_dir, "documents")))
    return found.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "path", "license", "similarity", "licensed_by")


def _values() -> str:
    quoted = [(k, name, text.replace("'", "''")) for k, (name, text, _) in enumerate(TEMPLATES)]
    return ", ".join(f"({k}, '{name}', '{text}', {_whole(k)})" for k, name, text in quoted)


def _agreeing() -> str:
    return ", ".join(f"({k}, '{t}', {bit}, {str(barred).lower()})" for k, t, bit, barred in _needs())


OP4_SQL = f"""
WITH firsts AS (SELECT source, lang, min(doc_id) AS first_doc FROM documents GROUP BY source, lang),
files AS (
  SELECT d.doc_id, d.text, d.doc_id = f.first_doc OR d.doc_id % 100 = 0 AS is_notice,
    coalesce(d.source, '_') || '/' || coalesce(d.lang, '_') || CASE WHEN d.doc_id = f.first_doc THEN '' ELSE '/' || CAST(d.doc_id // 100 AS VARCHAR) END AS dir
  FROM documents d JOIN firsts f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang
), split AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '{STOP}', '\\1' || chr(10) || '\\2', 'g'), '{BREAK}') AS s FROM files
), sentence AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i
  FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM split) WHERE regexp_matches(lower(s), '{TOKEN}')
), anchored AS (
  SELECT doc_id, s, i, list_has_any(regexp_extract_all(lower(s), '{TOKEN}'), {ANCHORS}) AS a FROM sentence
), islands AS (
  SELECT doc_id, s, i - sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run, i FROM anchored QUALIFY a
), placed AS (
  SELECT doc_id, run, s, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY doc_id, run) AS n FROM islands
), windows AS (
  SELECT doc_id, run, n AS w, 0 AS lo FROM placed GROUP BY ALL
  UNION ALL SELECT doc_id, run, 1, j FROM placed
  UNION ALL SELECT doc_id, run, w, j FROM placed, (SELECT unnest({WINDOWS}) AS w) WHERE n > w AND j % (w // 2) = 0
), unit AS (
  SELECT DISTINCT doc_id, text AS line FROM (
    SELECT p.doc_id, p.run, w, lo, string_agg(s, chr(10) ORDER BY j) AS text
    FROM windows v JOIN placed p ON p.doc_id = v.doc_id AND p.run = v.run AND j >= lo AND j < lo + w GROUP BY ALL)
), lines AS (SELECT DISTINCT line FROM unit),
notices(ord, license, text, whole) AS (VALUES {_values()}),
needs(ord, token, bit, barred) AS (VALUES {_agreeing()}),
fits AS (SELECT line, n.ord FROM (SELECT DISTINCT line, token FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TOKEN}')) AS token FROM lines)) t JOIN needs USING (token) JOIN notices n ON n.ord = needs.ord GROUP BY line, n.ord, whole HAVING bit_or(bit) = whole AND NOT bool_or(barred)),
tags AS (SELECT line, regexp_replace(regexp_replace(regexp_replace(regexp_extract(line, '{SPDX}', 1), '[()]', '', 'g'), '{CHOICE}', '\\1'), '[ \t]+', ' ', 'g') AS license FROM lines),
lt AS (SELECT line, token, 1 + ln(count(*)) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TOKEN}')) AS token FROM lines) WHERE token NOT IN ({str(STOP_WORDS)[1:-1]}) GROUP BY ALL),
nt AS (SELECT ord, license, token, 1 + ln(count(*)) AS tf FROM (SELECT ord, license, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM notices) WHERE token NOT IN ({str(STOP_WORDS)[1:-1]}) GROUP BY ALL),
idf AS (SELECT token, ln({1.0 + len(TEMPLATES)} / (1.0 + count(*))) + 1.0 AS idf FROM nt GROUP BY token),
w AS (SELECT line, token, tf * coalesce(idf, ln({1.0 + len(TEMPLATES)}) + 1.0) AS w FROM lt LEFT JOIN idf USING (token)),
v AS (SELECT ord, license, token, tf * idf AS v FROM nt JOIN idf USING (token)),
cosine AS (
  SELECT w.line, v.ord, license, round(sum(w * v) / (any_value(nl.norm) * any_value(nv.norm)), 6) AS similarity
  FROM w JOIN v USING (token) JOIN fits ON fits.line = w.line AND fits.ord = v.ord JOIN (SELECT line, sqrt(sum(w * w)) AS norm FROM w GROUP BY line) nl ON nl.line = w.line
  JOIN (SELECT ord, sqrt(sum(v * v)) AS norm FROM v GROUP BY ord) nv ON nv.ord = v.ord GROUP BY w.line, v.ord, license HAVING count(*) >= {SHARED}
), best AS (
  SELECT line, license, similarity FROM cosine QUALIFY row_number() OVER (PARTITION BY line ORDER BY similarity DESC, ord) = 1
), like_it AS (
  SELECT * FROM best WHERE similarity >= {SIMILAR} UNION ALL SELECT line, license, 1.0 FROM tags WHERE license <> ''
), own AS (
  SELECT doc_id, license AS own, similarity AS top FROM unit JOIN like_it USING (line)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license) = 1
), noticed AS (
  SELECT dir AS above, own AS theirs, top AS their_top FROM files JOIN own USING (doc_id) WHERE is_notice
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY top DESC, dir || '/' || doc_id || '.txt') = 1
), near AS (
  SELECT f.doc_id, above, theirs, their_top FROM files f JOIN noticed ON f.dir = above OR starts_with(f.dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(above) DESC) = 1
)
SELECT f.doc_id, f.dir || '/' || f.doc_id || '.txt' AS path, coalesce(own, theirs) AS license, coalesce(top, their_top) AS similarity,
  CASE WHEN own IS NOT NULL THEN f.dir || '/' || f.doc_id || '.txt' ELSE above END AS licensed_by
FROM files f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
"""
