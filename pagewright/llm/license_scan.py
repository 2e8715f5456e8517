"""License scans with DataFrame functions only.

What a file says about its licence is likened to templates by the cosine of TF-IDF weights, as a sparse dot product: an
equi-join on the word. Its units are the sentences, anywhere in its text, that hold a word of licences (a header; a
tag with a licence's short name counts as its first notice), and of a file that its name marks as a licence file also the whole text. Templates are short notices and whole licences. The
best unit decides. A file is a licence file of its directory if its name says so or its header is most of its words. A
file without a match of its own takes the licence of the nearest ancestor directory that has one: each directory (not
each file) is expanded into its ancestors, which join the licensed directories on the path, and the deepest wins; files
then join their directory.

Distinct units are weighed once, under their hash. Words of units and counts are all that is shuffled, besides the licence
files' distinct texts; directories are reduced to distinct ones before the path join, so a directory with a third of all
files meets it as one row, and the last join is between written tables, so Spark splits such a directory. Only the
templates' word weights, a fixed list, are broadcast.

Defined results: a null text has no unit; a null path is the root's; unit words that are in no template count in the norm,
so they lower the cosine; a tie goes to the first template by name; in a directory with several licence files the highest
cosine wins, then the least name; repeated rows match alike; an empty table gives an empty result; of other columns those
named like the results' are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."


def _gnu(name: str, version: str, what: str = "program", old: bool = False) -> tuple[str, str]:
    """The notice of a licence of the GNU family, its first sentence by itself too."""
    text = _GNU.format(what=what, name=name, version=version, colon=";" if old else ":", comma=";" if old else ",")
    return text.partition(". This")[0] + ".", text


#: Short notices by which files name their licence, and the texts of licences and of their standard notices.
TEMPLATES = {
    "0BSD": (
        "Licensed under the Zero-Clause BSD License (0BSD).",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", "3")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.", _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", *_gnu("General Public License", "2", old=True)),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3.",
        _gnu("General Public License", "3")[0],
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser General Public License", "2.1", "library", True)),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3", "library")),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "Released into the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _AS_IS + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/",
    ),
}
#: Words of licences; a sentence without any of them is no header.
CUE = r"licen[sc]e|copyright|spdx|redistribut|permission|warrant|free software|public domain"
#: A tag that names a licence by its short name, which may say that later versions are allowed.
TAG = r"(?i)spdx-license-identifier:\s*([a-z0-9.\-]+?)(?:-only|-or-later|\+)?(?:[^a-z0-9.\-]|\.?$)"
SENTENCE_END = r"[.!?]\s+|\n\s*\n"
LICENSE_NAME = r"^(licen[sc]e|copying)([.\-_]|$)"
MIN_COSINE = 0.55
FILE_SHARE = 0.5
WORD = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def headers(text):
    """The sentences that hold a word of licences; a blank line ends a sentence too."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda part: F.lower(part).rlike(CUE))


def noticed(header):
    """A header, or the first notice of the licence that its tag names."""
    notices = F.create_map(*[F.lit(x) for name, variants in sorted(TEMPLATES.items()) for x in (name.lower(), variants[0])])
    return F.coalesce(F.try_element_at(notices, F.lower(F.regexp_extract(header, TAG, 1))), header)


def template_words(spark: SparkSession) -> DataFrame:
    rows = [(name, i, text) for name, variants in sorted(TEMPLATES.items()) for i, text in enumerate(variants)]
    df = spark.createDataFrame(rows, "template string, variant int, text string")
    return df.select("template", "variant", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "variant", "word").agg(F.count("*").alias("tf"))


def matched(units: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """h, template and cosine of each distinct unit (h, unit) that matches a template."""
    spark = units.sparkSession
    distinct = units.groupBy("h").agg(F.count("*").alias("n"), F.first("unit").alias("unit"))
    terms = distinct.select("h", "n", F.explode(words(F.col("unit"))).alias("word")).groupBy("h", "word").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    terms = written(terms, "unit-words")
    total = units.count()
    df = terms.groupBy("word").agg(F.sum("n").alias("df"))
    known = template_words(spark)
    # idf of the templates' words in the corpus' units; other words count as seen once
    weight = F.log(F.lit(total + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    idf = F.broadcast(known.select("word").distinct().join(df, "word", "left").select("word", weight.alias("idf")))
    rare = F.log(F.lit((total + 1) / 2)) + 1
    weighed = terms.join(idf, "word", "left").select("h", "word", (F.col("tf") * F.coalesce("idf", rare)).alias("w"))
    norms = weighed.groupBy("h").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template = known.join(idf, "word").withColumn("tw", F.col("tf") * F.col("idf"))
    sizes = template.groupBy("template", "variant").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    template = F.broadcast(template.join(sizes, ["template", "variant"]).select("template", "variant", "word", (F.col("tw") / F.col("tnorm")).alias("tw")))
    dots = weighed.join(template, "word").groupBy("h", "template", "variant").agg(F.sum(F.col("w") * F.col("tw")).alias("dot")).join(norms, "h")
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    best = dots.groupBy("h").agg(F.min(F.struct((-cosine).alias("c"), "template")).alias("b")).select("h", F.col("b.template").alias("template"), (-F.col("b.c")).alias("cosine"))
    return best.where(F.col("cosine") >= min_cosine)


def scanned(files: DataFrame, id_col: str, path_col: str, text_col: str, min_cosine: float = MIN_COSINE) -> DataFrame:
    """id, path, licence, cosine and how it was found (own, inherited or none) of every file, with the directory it comes from."""
    path, text = F.regexp_replace(F.coalesce(F.col(path_col), F.lit("")), "^/+", ""), F.coalesce(F.col(text_col), F.lit(""))
    base = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("file_id"), path.alias("path"), text.alias("text"), headers(text).alias("header"))
    base = base.withColumn("directory", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("says", F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike(LICENSE_NAME))
    many = lambda v: F.size(F.split(v, r"\s+"))
    said = F.aggregate(F.transform("header", many), F.lit(0), lambda a, n: a + n)
    whole = F.when(F.col("says") & (F.col("text") != ""), F.array("text")).otherwise(F.array().cast("array<string>"))
    base = base.select("row", "file_id", "path", "directory", "says", (said >= F.lit(FILE_SHARE) * many(F.col("text"))).alias("most"), F.concat(F.transform("header", noticed), whole).alias("units"))
    base = written(base, "headers")
    units = base.select("row", F.explode("units").alias("unit")).withColumn("h", F.xxhash64("unit"))
    own = units.select("row", "h").join(matched(units.select("h", "unit"), min_cosine), "h").groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("template").alias("own"), "cosine")).alias("b")).select("row", "b.own", "b.cosine")
    found = written(base.drop("units").join(own, "row", "left"), "matches")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    licensed = found.where(F.col("own").isNotNull() & (F.col("says") | F.col("most"))).groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("c"), name.alias("name"), "own", "cosine")).alias("l")).select("directory", F.col("l.own").alias("dir_license"), F.col("l.cosine").alias("dir_cosine"))
    directories = found.select("directory").distinct()
    parts = F.when(F.col("directory") == "", F.array().cast("array<string>")).otherwise(F.split("directory", "/"))
    ancestors = directories.select("directory", parts.alias("p")).select("directory", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth"), "p").select("directory", "depth", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("ancestor"))
    nearest = ancestors.join(licensed.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "dir_license", "dir_cosine"), "depth").alias("i")).select("directory", "i.*")
    own = F.col("own").isNotNull()
    return found.join(written(nearest, "nearest"), "directory", "left").select(
        F.col("file_id").alias(id_col), "path", F.coalesce("own", "dir_license").alias("license"), F.when(own, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("found"), F.when(~own, F.col("ancestor")).alias("from_directory"),
    )


def tree_path(doc_id, source):
    """Where a document stands in the tree that the query scans: by source and id; some are licence files further up."""
    top, mid = F.coalesce(source, F.lit("none")), F.concat(F.lit("a"), F.pmod(doc_id, F.lit(7)).cast("string"))
    low, text_id = F.concat(F.lit("b"), F.pmod(doc_id, F.lit(1009)).cast("string")), doc_id.cast("string")
    deep = F.concat_ws("/", top, mid, low, F.concat(F.lit("file"), text_id, F.lit(".txt")))
    return F.when(doc_id % 16 == 0, F.concat_ws("/", top, mid, F.concat(F.lit("LICENSE."), text_id))).when(doc_id % 16 == 8, F.concat_ws("/", top, F.concat(F.lit("LICENSE."), text_id))).otherwise(deep)


def op5_license_scan(spark, sf_dir):
    """The licence of every document, in a tree of paths derived from source and id."""
    docs = table(spark, sf_dir, "documents").withColumn("path", tree_path(F.col("doc_id"), F.col("source")))
    return scanned(docs, "doc_id", "path", "text")


def sql() -> str:
    quoted = ", ".join(f"('{name}', {i}, '{text}')" for name, variants in sorted(TEMPLATES.items()) for i, text in enumerate(variants))
    tags = ", ".join(f"('{name.lower()}', '{variants[0]}')" for name, variants in sorted(TEMPLATES.items()))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, 'none') AS top, 'a' || (doc_id % 7) AS mid, 'b' || (doc_id % 1009) AS low, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, CASE doc_id % 16 WHEN 0 THEN top || '/' || mid || '/LICENSE.' || doc_id WHEN 8 THEN top || '/LICENSE.' || doc_id ELSE top || '/' || mid || '/' || low || '/file' || doc_id || '.txt' END AS path FROM d),
b AS (SELECT doc_id, path, text, regexp_replace(path, '/?[^/]*$', '') AS directory, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '{LICENSE_NAME}') AS says, len(regexp_split_to_array(text, '\s+')) AS n_words,
  list_filter(regexp_split_to_array(text, '{SENTENCE_END}'), lambda p: regexp_matches(lower(p), '{CUE}')) AS header FROM f),
notices AS (SELECT map(list(tag), list(notice)) AS m FROM (VALUES {tags}) AS t(tag, notice)),
units AS (SELECT doc_id, unnest(list_transform(header, lambda p: coalesce(m[lower(regexp_extract(p, '{TAG}', 1))], p)) || CASE WHEN says AND text <> '' THEN [text] ELSE [] END) AS unit FROM b, notices),
distinct_units AS (SELECT unit, count(*) AS n FROM units GROUP BY unit),
total AS (SELECT count(*) AS total FROM units),
words AS (SELECT unit, n, unnest(regexp_extract_all(lower(unit), '{WORD}')) AS word FROM distinct_units),
terms AS (SELECT unit, word, count(*) AS tf, first(n) AS n FROM words GROUP BY unit, word),
df AS (SELECT word, sum(n) AS df FROM terms GROUP BY word),
known AS (SELECT template, variant, word, count(*) AS tf FROM (SELECT template, variant, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM (VALUES {quoted}) AS t(template, variant, text)) GROUP BY ALL),
idf AS (SELECT word, ln((total + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM known) LEFT JOIN df USING (word), total),
weighed AS (SELECT unit, word, tf * coalesce(idf, ln((total + 1) / 2.0::DOUBLE) + 1) AS w FROM terms LEFT JOIN idf USING (word), total),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY unit),
tw AS (SELECT template, variant, word, tf * idf AS tw FROM known JOIN idf USING (word)),
tn AS (SELECT template, variant, sqrt(sum(tw * tw)) AS tnorm FROM tw GROUP BY ALL),
cos AS (SELECT unit, template, variant, round(sum(w * tw / tnorm) / any_value(norm), 9) AS c FROM weighed JOIN tw USING (word) JOIN tn USING (template, variant) JOIN norms USING (unit) GROUP BY unit, template, variant),
best AS (SELECT unit, template AS own, c AS cosine FROM cos QUALIFY row_number() OVER (PARTITION BY unit ORDER BY c DESC, template) = 1),
of_file AS (SELECT doc_id, own, cosine FROM units JOIN best USING (unit) WHERE cosine >= {MIN_COSINE}::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, own) = 1),
found AS (SELECT b.*, own, cosine FROM b LEFT JOIN of_file USING (doc_id)),
licensed AS (SELECT directory AS ancestor, own AS dir_license, cosine AS dir_cosine FROM found WHERE own IS NOT NULL AND (says OR coalesce(list_sum(list_transform(header, lambda p: len(regexp_split_to_array(p, '\s+')))), 0) >= {FILE_SHARE}::DOUBLE * n_words)
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, name, own) = 1),
dirs AS (SELECT DISTINCT directory FROM found),
anc AS (SELECT directory, depth, array_to_string(string_split(directory, '/')[1:depth], '/') AS ancestor FROM (SELECT directory, unnest(range(0, len(string_split(directory, '/')) + 1)) AS depth FROM dirs)),
near AS (SELECT directory, ancestor, dir_license, dir_cosine FROM anc JOIN licensed USING (ancestor) QUALIFY row_number() OVER (PARTITION BY directory ORDER BY depth DESC) = 1)
SELECT doc_id, path, coalesce(own, dir_license) AS license, CASE WHEN own IS NOT NULL THEN cosine ELSE dir_cosine END AS cosine,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS found, CASE WHEN own IS NULL THEN ancestor END AS from_directory
FROM found LEFT JOIN near USING (directory)
"""
