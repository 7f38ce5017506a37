"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from directories.

DataFrame functions only.  Lines of one paragraph are joined, without the marks
of comments, and cut into sentences again, so that a notice wrapped at any width
is one passage; single lines are passages too, and the whole text of a licence
file is one.  Passages with a licence cue are compared with the templates; equal
passages are one row throughout, so a line that a third of all files carry costs
as much as a rare one.  A file without a licence of its own takes that of the
nearest ancestor directory that holds a licence file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import Workspace

# SPDX identifiers, and the public texts that announce these licences.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_KEEP = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_SHOW = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_FREE = "This is free and unencumbered software released into the public domain."
_FREE_ALL = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

#: Notices and texts, with their licences.
TEMPLATES = (
    ("AGPL-3.0", "This program " + _GNU.format("Affero General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD-2-Clause", " ".join((_BSD, _BSD_KEEP, _BSD_SHOW, _BSD_WARRANTY))),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _BSD_NAME),
    ("BSD-3-Clause", " ".join((_BSD, _BSD_KEEP, _BSD_SHOW, _BSD_NAME, _BSD_WARRANTY))),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program " + _GNU.format("General Public License", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program " + _GNU.format("General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_WARRANTY}"),
    ("LGPL-2.1", "This library " + _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library " + _GNU.format("Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", _MIT),
    ("MIT", _MIT_NOTICE),
    ("MIT", " ".join((_MIT, _MIT_NOTICE, _WARRANTY))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/. Mozilla Public License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", f"{_FREE} {_FREE_ALL}"),
)

#: Whole licence texts, and the dated titles that open those that are too long for a template.
TEXTS = tuple(t for _, t in TEMPLATES if t.endswith((_WARRANTY, _BSD_WARRANTY, _ISC_WARRANTY, _FREE_ALL)))
TITLES = tuple(t for _, t in TEMPLATES if t.startswith(("GNU ", "Apache License")))

#: What a passage must hold to be compared at all; every template does, and what is left of one with half its words (a test measures how often).
CUE = (
    r"(?i)\blicen[sc]e|\blicen[sc]ing|spdx|copyright|public (domain|licen)|permission (is|to)\b|permissions?\b|redistribut|\bCC[ -](BY|0)\b"
    r"|\b(apache|mozilla|affero|creative commons|unencumbered|sublicense|contributors?|free software|applicable law|compliance|express or implied|binary forms?|attribution|endorse|governed by|later version|without modification)\b"
    r"|warrant|merchantab|disclaim|noninfring|derivative works|(?-i:\b(GNU|A?GPL|LGPL|MPL|BSD|MIT|AS IS|BY-(NC|SA))\b)"
)
#: Marks of comments at the start of a line, with the space around them.
MARKS = r"(?m)^[\x20\t]*+(?:/\*++|\*++/?|//++|#++|;++|--++|%++|<!--|-->|(?:REM|rem|dnl)\b)?+[\x20\t]*+"
#: Paragraphs end at blank lines, sentences before a capital after a sentence mark.
PARAGRAPH = r"(?:\r\n?|\n)(?:\r\n?|\n)+"
SENTENCE = r"(?<=[.!?:])[\x20]+(?=[\p{Lu}\"(])"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.6


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weights(rows: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """key, term, unit-length TF-IDF weight, from key and tf per term."""
    w = rows.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def scan(files: DataFrame, ws: Workspace, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``files`` (path, text): path, own_license, score, n_headers, is_license_file, license, inherited_from.

    A passage with a cue whose cosine to the closest template is at least
    ``least`` is a header of that licence (on ties the first by name).  A file's
    own licence is that of its closest header; n_headers counts its paragraphs
    with one.  A licence file is one named LICENSE, LICENCE, COPYING or NOTICE
    that has a licence; of several in a directory the first path speaks for it.
    Inverse document frequencies count all passages with a cue of all files and
    the templates once each.  Null text: no headers; very long texts are read
    whole.  A row without path can't be told from others like it: its passages
    count for the frequencies, but it gets no licence.  Rows with one path share
    what their texts hold: n_headers counts over all of them.  Empty table: empty
    result; further columns are ignored.
    """
    spark = files.sparkSession
    named = F.upper(F.regexp_extract("path", r"([^/]*)$", 1)).rlike(r"^(LICEN[SC]E|COPYING|NOTICE)([.-]|$)")
    base = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    cued = base.where(F.col("text").rlike(CUE)).select("path", F.regexp_replace("text", MARKS, "").alias("plain"), named.alias("named"))
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    # Paragraph -1 is a licence file's whole text.
    parts = cued.select("path", F.posexplode(F.split("plain", PARAGRAPH)).alias("no", "par")).where(F.col("par").rlike(CUE))
    units = F.array_distinct(F.concat(F.split(one(F.col("par")), SENTENCE), F.transform(F.split("par", r"[\r\n]+"), one)))
    passages = parts.select("path", "no", F.explode(units).alias("passage"))
    passages = passages.unionByName(cued.where("named").select("path", F.lit(-1).alias("no"), one(F.col("plain")).alias("passage")))
    passages = passages.where(F.col("passage").rlike(CUE))
    passages = ws.save(passages, "passages")
    kinds = ws.save(passages.groupBy("passage").agg(F.count(F.lit(1)).alias("n")), "kinds")
    known = _templates(spark, templates)
    tf = ws.save(kinds.select("passage", "n", F.explode(terms(F.col("passage"))).alias("term")).groupBy("passage", "n", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    t_tf = known.select("template", F.explode(terms(F.col("template"))).alias("term")).groupBy("template", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = (kinds.agg(F.sum("n")).first()[0] or 0) + len(templates)
    df = tf.groupBy("term").agg(F.sum("n").alias("df")).unionByName(t_tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    idf = ws.save(df.select("term", (F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")), "idf")
    left = _weights(tf.select("passage", "term", "tf"), idf, "passage")
    right = ws.save(_weights(t_tf, idf, "template"), "template_weights")
    cos = left.join(right.withColumnRenamed("w", "tw"), "term").groupBy("passage", "template").agg(F.round(F.sum(F.col("w") * F.col("tw")), 9).alias("cosine"))
    best = cos.join(known, "template").where(F.col("cosine") >= least).groupBy("passage").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "license")).alias("m"))
    best = ws.save(best.select("passage", F.col("m.license").alias("license"), (-F.col("m.far")).alias("score")), "best")
    headers = ws.save(passages.join(best, "passage").select("path", "no", "license", "score"), "headers")
    own = headers.where("path is not null").groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("far"), "license")).alias("m"), F.count_distinct(F.when(F.col("no") >= 0, F.col("no"))).alias("n"))
    own = ws.save(own.select("path", F.col("m.license").alias("own_license"), (-F.col("m.far")).alias("score"), F.col("n").alias("n_headers"), named.alias("is_license_file")), "own")
    paths = ws.save(base.select("path", directory(F.col("path")).alias("dir")), "paths")
    holders = own.where("is_license_file and path is not null").select(directory(F.col("path")).alias("holder"), "path", "own_license")
    holders = ws.save(holders.groupBy("holder").agg(F.min(F.struct("path", "own_license")).alias("m")).select("holder", F.col("m.path").alias("inherited_from"), F.col("m.own_license").alias("inherited")), "holders")
    dirs = ws.save(paths.where("dir is not null").select("dir").distinct(), "dirs")
    up = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "holder")).join(holders, "holder")
    nearest = up.groupBy("dir").agg(F.max(F.struct("depth", "inherited", "inherited_from")).alias("m"))
    nearest = ws.save(nearest.select("dir", "m.inherited", "m.inherited_from"), "nearest")
    out = paths.join(own, "path", "left").join(nearest, "dir", "left")
    takes = F.col("own_license").isNull()
    return out.select("path", "own_license", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"), F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"), F.coalesce("own_license", "inherited").alias("license"), F.when(takes, F.col("inherited_from")).alias("inherited_from"))


def directory(path: Column) -> Column:
    """Directory of a path, with its trailing slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def ancestors(dir_: Column) -> Column:
    """The top, and every directory down to this one."""
    names = F.filter(F.split(dir_, "/"), lambda x: x != "")
    lead = F.when(dir_.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    down = F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.when(i == 0, lead).otherwise(F.concat(lead, F.array_join(F.slice(names, F.lit(1), F.greatest(i, F.lit(1))), "/"), F.lit("/"))))
    return down


def _templates(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """The templates as a table, without Python on the executors."""
    rows = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("template")) for a, b in templates])
    return spark.range(1).select(F.inline(rows))


def is_text(text: Column) -> Column:
    """Whether a text is a licence as a whole: it opens with the title of a long one, or grants in ``LEAST`` of the distinct words that it and a short one have."""
    title = "|".join(r"\s+".join(map(re.escape, t.split())) for t in TITLES)
    held = F.array_distinct(terms(text))
    close = lambda t: F.size(F.array_intersect(held, t)) >= LEAST * F.size(F.array_union(held, t))
    known = [F.array(*map(F.lit, dict.fromkeys(re.findall(TERM, t.lower())))) for t in TEXTS]
    grants = F.lower(text).contains("permi") | F.lower(text).contains("unencumbered")
    return F.coalesce(text.rlike(rf"(?i)^\s*+(?:{title})"), F.lit(False)) | F.when(grants, F.exists(F.array(*known), close)).otherwise(False)


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt, with ``_`` for a null source or lang; LICENSE.doc_id.txt if the text is a licence as a whole, which licenses its directory."""
    name = F.concat(F.when(is_text(F.col("text").cast("string")), F.lit("LICENSE.")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("_")), F.coalesce(F.col("lang").cast("string"), F.lit("_")), name)
    return docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
