"""Licence scan with DataFrame functions only.

A text that holds a licence cue gives three kinds of passages: its lines with a cue, its blocks of lines between blank
ones that hold a cue (a wrapped header is one, comment marks and all), and the whole text. Passages and templates, opening
statements as well as whole headers and licence texts, are sparse TF-IDF vectors; the inverse document frequencies come
from all distinct passages and the templates. A passage takes the template with the largest cosine, if that reaches the
threshold; a file takes its best passage. An SPDX tag that joins several identifiers (OR, AND, WITH) is read as such: the
whole expression is the file's licence. A file that has a licence and is named like a licence file, or is named like a
plain text, not like a source file, and reaches the threshold with its whole text, is a licence file and covers its
directory. A file without a licence of its own inherits from the nearest ancestor directory that has one.

Equal passages are counted once before anything is exploded, and directories before they are joined, so a passage or a
directory that a third of all files share is one row of the work.

Defined results: null texts are empty, null paths lie in the root directory; ties go to the smaller licence name, also
those between the licence files of one directory, and of several SPDX expressions in one text the first counts;
files with the same path are scanned by themselves; texts without a cue cost one regular expression; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import staged

#: The templates' opening words, by licence name.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License. Neither the name of the copyright holder nor its contributors may be used to endorse.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "CC0 1.0 Universal. No copyright. Public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential.",
}
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_CLOSING = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu_header(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details. "
        f"You should have received a copy of the GNU {kind} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Whole headers and licence texts, titles of the long texts, and the identifiers of SPDX tags, by licence name.
TEXTS = (
    ("AGPL-3.0", _gnu_header("Affero", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_CLOSING),
    ("BSD-3-Clause", _BSD_OPENING + _BSD_NAMES + _BSD_CLOSING),
    ("GPL-2.0", _gnu_header("", "2")),
    ("GPL-3.0", _gnu_header("", "3")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", _gnu_header("Lesser", "2.1")),
    ("LGPL-3.0", _gnu_header("Lesser", "3")),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tags in (
        ("AGPL-3.0", ("AGPL-3.0-only", "AGPL-3.0-or-later")), ("Apache-2.0", ("Apache-2.0",)), ("BSD-2-Clause", ("BSD-2-Clause",)), ("BSD-3-Clause", ("BSD-3-Clause",)),
        ("CC0-1.0", ("CC0-1.0",)), ("GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")), ("GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")), ("ISC", ("ISC",)),
        ("LGPL-2.1", ("LGPL-2.1-only", "LGPL-2.1-or-later")), ("LGPL-3.0", ("LGPL-3.0-only", "LGPL-3.0-or-later")), ("MIT", ("MIT",)), ("MPL-2.0", ("MPL-2.0",)), ("Unlicense", ("Unlicense",)),
    ) for tag in tags),
)


def known_templates(templates: dict[str, str]) -> list[tuple[str, str, str]]:
    """(template, licence, words)"""
    return [(f"{i:03d}", licence, words) for i, (licence, words) in enumerate([*sorted(templates.items()), *TEXTS])]


#: What makes a line a statement (where words are apart a line of a comment may end), what makes a file name a licence
#: file's or a plain text's, and an SPDX expression of several identifiers.
_GAP = r"[\s/*#;!-]+"
CUE = r"licen[sc]e|copyright|spdx|creative commons|cc0|public domain|permission is hereby granted|permission to use, copy|free software|redistribution and use|all rights reserved".replace(" ", _GAP)
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
TEXT_NAME = r"(?i)(^|/)([^/.]*|[^/]*\.(txt|text|md|markdown|rst|adoc|html?))$"
_IDENTIFIER = r"\(*[A-Za-z0-9.+-]+\)*"
EXPRESSION = rf"(?i:spdx-license-identifier:)[ \t]*({_IDENTIFIER}(?:[ \t]+(?:OR|AND|WITH)[ \t]+{_IDENTIFIER})+)"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.6
#: Blank lines, which part blocks.
BLANK = r"\n[ \t\r]*(?:\n[ \t\r]*)+"


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"), 1)


def statements(text: Column) -> Column:
    """The text's distinct lines with a cue, an array. Texts without a cue aren't split."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line))
    return _with_cue(text, F.array_distinct(lines))


def blocks(text: Column) -> Column:
    """The blocks of several lines that hold a cue."""
    return F.filter(_with_cue(text, F.split(text, BLANK)), lambda block: F.contains(block, F.lit("\n")))


def _with_cue(text: Column, parts: Column) -> Column:
    return F.when(F.lower(text).rlike(CUE), F.filter(parts, lambda part: F.lower(part).rlike(CUE))).otherwise(F.array().cast("array<string>"))


def match_passages(passages: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, licence, cosine for each distinct passage that reaches the threshold. passages: key, words; one row for each key."""
    spark = passages.sparkSession
    known = spark.createDataFrame(known_templates(templates), "template string, licence string, words string")
    weigh = lambda df, key: df.select(key, F.explode(_tokens(F.col("words"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    ours, theirs = staged(weigh(passages, "key"), "licence-tokens"), weigh(known, "template")
    df = ours.groupBy("token").agg(F.count("*").alias("a")).join(theirs.groupBy("token").agg(F.count("*").alias("b")), "token", "full")
    n = passages.count()
    # written, so the join with the passages' tokens is of two plain shuffles and a hot token can be split
    idf = df.select("token", (F.log(F.lit(1.0 + known.count() + n) / (1 + F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)))) + 1).alias("idf"))
    idf = staged(idf, "licence-idf")
    ours = ours.join(idf, "token").select("key", "token", (F.col("tf") * F.col("idf")).alias("w"))
    theirs = theirs.join(idf, "token").select("template", "token", (F.col("tf") * F.col("idf")).alias("v"))
    length = lambda d, key, x: d.groupBy(key).agg(F.sqrt(F.sum(F.col(x) * F.col(x))).alias(f"{x}_norm"))
    dots = ours.join(F.broadcast(theirs), "token").groupBy("key", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    theirs = length(theirs, "template", "v").join(known.select("template", "licence"), "template")
    scored = dots.join(length(ours, "key", "w"), "key").join(F.broadcast(theirs), "template")
    cosine = F.round(F.col("dot") / (F.col("w_norm") * F.col("v_norm")), 4)
    best = scored.select("key", "licence", cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    return best.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("m")).select("key", "m.licence", (-F.col("m.less")).alias("cosine"))


def expression(text: Column) -> Column:
    """The text's first SPDX expression of several identifiers, white space single and one pair of outer brackets off; else empty."""
    found = F.regexp_replace(F.regexp_extract(text, EXPRESSION, 1), r"[ \t]+", " ")
    return F.regexp_replace(found, r"^\(([^()]*)\)$", "$1")


def _parents(path: Column) -> Column:
    """The directory of a path: what stands before its last slash, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file, path, n_statements, own_licence, own_cosine, is_licence_file, licence, inherited_from for every row.

    files: file (a key), path, text. inherited_from is the directory, null for own licences.
    """
    rows = files.select("file", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("file", "path", statements(F.col("text")).alias("lines"), blocks(F.col("text")).alias("blocks"), "text")
    rows = staged(rows.select("file", "path", "lines", "blocks", F.when(F.lower("text").rlike(CUE), F.col("text")).alias("whole")), "licence-rows")
    rows = rows.withColumn("tag", F.md5("whole"))
    kinds = rows.where("whole is not null").groupBy("tag").agg(F.any_value("lines").alias("lines"), F.any_value("blocks").alias("blocks"), F.any_value("whole").alias("whole"))
    parts = kinds.select("tag", F.md5("whole").alias("of_whole"), F.explode(F.array_distinct(F.concat("lines", "blocks", F.array("whole")))).alias("words"))
    parts = staged(parts.withColumn("key", F.md5("words")), "licence-passages")
    matched = staged(match_passages(parts.groupBy("key").agg(F.any_value("words").alias("words")), templates, threshold), "licence-matches")
    best = (
        parts.select("tag", "key", (F.col("key") == F.col("of_whole")).alias("is_whole"))
        .join(matched.hint("merge"), "key")
        .groupBy("tag")
        .agg(F.max("is_whole").alias("whole_matches"), F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("m"))
        .select("tag", "whole_matches", F.col("m.licence").alias("matched"), (-F.col("m.less")).alias("cosine"))
    )
    told = staged(kinds.select("tag", expression(F.col("whole")).alias("told")).where("told <> ''"), "licence-expressions")
    best = best.join(told, "tag", "full").select("tag", "whole_matches", F.coalesce("told", "matched").alias("own_licence"), F.when(F.col("told").isNotNull(), 1.0).otherwise(F.col("cosine")).alias("own_cosine"))
    best = staged(best, "licence-best")  # written, so the join below is of two plain shuffles and a hot text can be split
    seen = rows.select("file", "path", "tag", F.size("lines").cast("long").alias("n_statements"), _parents(F.col("path")).alias("dir"))
    known = seen.where("tag is not null").join(best.hint("merge"), "tag", "left").unionByName(seen.where("tag is null"), allowMissingColumns=True)
    is_file = F.coalesce(F.col("own_licence").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("path").rlike(TEXT_NAME) & F.col("whole_matches"))), F.lit(False))
    known = staged(known.select("file", "path", "dir", "n_statements", "own_licence", "own_cosine", is_file.alias("is_licence_file")), "licence-files")
    covered = known.where("is_licence_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("less"), "own_licence")).alias("m")).select(F.col("dir").alias("ancestor"), F.col("m.own_licence").alias("dir_licence"))
    dirs = known.select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(ancestors)).alias("ancestor"))
        .join(covered, "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct(F.char_length("ancestor").alias("depth"), "ancestor", "dir_licence")).alias("near"))
        .select("dir", "near.ancestor", "near.dir_licence")
    )
    joined = known.join(nearest, "dir", "left")
    own = F.col("own_licence").isNotNull()
    return joined.select(
        "file", "path", "n_statements", "own_licence", "own_cosine", "is_licence_file",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(~own, F.col("ancestor")).alias("inherited_from"),
    )
