"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, inheritance from the nearest licence
file above.

All of it is DataFrame functions. A text is compared as a whole, by its leading comment block, by its paragraphs (parted
by lines without a letter or digit of ASCII) and by its lines. A word counts once in what is compared; the inverse document
frequencies are those of the templates, a word outside all templates weighs most. A licence is found where the cosine
reaches ``threshold``; an SPDX identifier goes first, then the whole text and its comment block, then paragraphs and lines,
in each the best score, then the earlier place, then the smaller name.

Nothing is cut away before the cosine that could reach the threshold: the numbers of words known and unknown to the templates
bound it, and only what stays below the threshold by this bound is left out.

A file with a licence is the licence file of its directory by its name (LICENSE, COPYING, UNLICENSE, any ending), by the cosine
of its whole text, or as a notice of at most ``notice_words`` words. A document without a licence inherits from
the licence file in its own or the nearest ancestor directory; of several in one directory the best score counts, then the
smallest path.

Null texts and texts without a word have no licence; a null path has no directory and inherits nothing; repeated rows each
get the result. Empty tables give none.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegram.llm.common import WORD, written

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published
by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""

#: Texts and notices that the public licences prescribe, and short forms in common use. The long licences
#: (Apache, GNU, Mozilla) hold their own notice as a paragraph, by which their files are found.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License, Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-3-Clause", _BSD_THIRD),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived, CC0 1.0 public domain"),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2"),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("ISC", f"{_ISC} {_ISC_REST}"),
    ("ISC", _ISC),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License"),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} {_MIT_REST}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", _UNLICENSE),
)
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
BLANK_LINES = "\\n[^a-z0-9]*\\n"
_MARK = "(?:#|//|/\\*|\\*|--|;|%|<!--"
COMMENT, COMMENT_FIRST = f"^[ \\t]*{_MARK}|$)", f"^[ \\t\\n]*{_MARK})"
SPDX = "[Ss][Pp][Dd][Xx]-[Ll]icense-[Ii]dentifier:[ \\t]*\\(?([A-Za-z0-9.+-]+)"
LICENSE_NAME = "^((un)?licen[cs]e|copying)([._-].*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Weights:
    """Weights of the templates' words (a few hundred, fixed): ``idf``, that of an unknown word, and unit vectors."""

    def __init__(self, templates=TEMPLATES) -> None:
        words = [sorted(set(re.findall(TOKEN, text.translate(str.maketrans(UPPER, LOWER))))) for _, text in templates]
        n = len(templates)
        self.idf = {t: math.log((1 + n) / (1 + sum(t in w for w in words))) + 1 for t in sorted(set().union(*words))}
        self.unknown = math.log(1 + n) + 1
        norms = [math.sqrt(sum(self.idf[t] ** 2 for t in w)) for w in words]
        self.unit = [(license_, [(t, self.idf[t] / norm) for t in w]) for (license_, _), w, norm in zip(templates, words, norms)]

    def table(self, spark: SparkSession) -> DataFrame:
        """``token, idf, uses``: the templates that hold the word, and its weight in each."""
        rows = ", ".join(f"({i}, '{license_}', '{t}', {w!r}D, {self.idf[t]!r}D)"
                         for i, (license_, tokens) in enumerate(self.unit) for t, w in tokens)
        return (spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, token, w, idf)")
                .groupBy("token", "idf").agg(F.collect_list(F.struct("template", "license", "w")).alias("uses")))


def compared(text: Column, lines: Column) -> Column:
    """What is compared of a lower-cased text: itself, its leading comment block, and its other paragraphs and lines."""
    end = F.array_position(F.transform(lines, lambda line: ~F.rlike(line, F.lit(COMMENT))), True).cast("int")
    block = F.when(F.rlike(text, F.lit(COMMENT_FIRST)) & (end > 1),
                   F.array_join(F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0))), "\n")).otherwise("")
    return F.concat(F.array(text, block), F.array_remove(F.array_distinct(F.concat(F.split(text, BLANK_LINES), lines)), text))


def more_words(text: Column, n: int) -> Column:
    """True where the text has more than ``n`` words; reads no further than it must."""
    blank = WORD.replace("[^", "[")[:-1]
    return F.rlike(text, F.lit(f"^{blank}*(?:{WORD}{blank}+){{{n}}}{WORD}"))


def text_licenses(docs: DataFrame, threshold: float, notice_words: int) -> DataFrame:
    """``id, text_hash, license, score, alone`` of each text with a licence.

    ``alone``: by the cosine of all of the text, or of at most ``notice_words`` words.
    """
    weights = Weights()
    key = ["id", "text_hash", "short"]
    short = (~more_words(F.col("text"), notice_words)).alias("short")
    # cosine² <= K / (K + U): squared lengths of the known and the unknown words.
    square = (threshold - 1e-6) ** 2
    most = max(weights.idf.values()) ** 2 * (1 - square)
    units = (docs.select("id", "text_hash", short, F.translate("text", UPPER, LOWER).alias("low"))
             .withColumn("lines", F.split("low", "\n"))
             .select(*key, F.posexplode(compared(F.col("low"), F.col("lines"))).alias("place", "unit"))
             .select(*key, "place", F.array_distinct(F.regexp_extract_all("unit", F.lit(TOKEN), F.lit(0))).alias("words"))
             .select(*key, "place", F.size("words").alias("n"), F.filter("words", lambda w: w.isin(*weights.idf)).alias("known"))
             .withColumn("rest", F.col("n") - F.size("known"))
             .filter((F.size("known") > 0) & (F.col("rest") * (weights.unknown ** 2 * square) <= F.size("known") * most))
             .groupBy(*key, "place").agg(F.first("known").alias("known"), F.first("rest").alias("rest")))
    scored = (units.select(*key, "place", "rest", F.explode("known").alias("token"))
              .join(F.broadcast(weights.table(docs.sparkSession)), "token")
              .groupBy(*key, "place", "rest")
              .agg(F.sum(F.col("idf") * F.col("idf")).alias("square"),
                   F.flatten(F.collect_list(F.transform("uses", lambda u: F.struct(
                       u["template"].alias("template"), u["license"].alias("license"),
                       (u["w"] * F.col("idf")).alias("dot"))))).alias("dots"))
              .select(*key, "place", F.sqrt(F.col("square") + F.col("rest") * weights.unknown ** 2).alias("norm"), F.inline("dots"))
              .groupBy(*key, "place", "norm", "template", "license").agg(F.sum("dot").alias("dot"))
              .select(*key, "place", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
              .filter(F.col("score") >= threshold)
              .select(*key, F.when(F.col("place") < 2, 1).otherwise(2).alias("level"), "place", "license", "score"))
    declared = F.regexp_extract("text", SPDX, 1)
    spdx = docs.select("id", "text_hash", short, F.lit(0).alias("level"), F.lit(1).alias("place"), declared.alias("license"),
                       F.lit(1.0).alias("score")).filter(declared != "")
    best = F.min(F.struct("level", (-F.col("score")).alias("down"), "place", "license", "score")).alias("best")
    alone = F.max(F.col("short") | (F.col("place") == 0)).alias("alone")
    return (scored.unionByName(spdx).groupBy("id", "text_hash").agg(best, alone)
            .select("id", "text_hash", "best.license", "best.score", "alone"))


def scan_licenses(files: DataFrame, threshold: float = 0.6, notice_words: int = 40) -> DataFrame:
    """``doc_id, path, license, origin, score, license_dir`` of each row of ``files (doc_id, path, text)``.

    ``origin`` is "header" (its own text), "inherited" or "none"; ``path`` uses "/", and a file's directory is all before
    the last one.
    """
    directory, name = F.regexp_replace("path", "/?[^/]*$", ""), F.lower(F.substring_index("path", "/", -1))
    files = files.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                         F.xxhash64("text").alias("text_hash"), F.col("doc_id").cast("long").alias("doc_id"), "path",
                         directory.alias("dir"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = text_licenses(files, threshold, notice_words)
    named = written(files.drop("text").join(own, ["id", "text_hash"], "left"), "licences")
    is_license_file = F.col("license").isNotNull() & (F.col("alone") | F.rlike(name, F.lit(LICENSE_NAME)))
    above = (named.filter(is_license_file & F.col("dir").isNotNull()).groupBy("dir")
             .agg(F.min(F.struct((-F.col("score")).alias("down"), "path", "license", "score")).alias("best"))
             .select(F.col("dir").alias("license_dir"), F.col("best.license").alias("above"), F.col("best.score").alias("above_score")))
    parts = F.split("dir", "/")
    chain = (named.select("dir").distinct()
             .select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                                                  lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("license_dir")))
    nearest = (chain.join(above, "license_dir").groupBy("dir")
               .agg(F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "above", "above_score")).alias("near"))
               .select("dir", "near.license_dir", "near.above", "near.above_score"))
    header = F.col("license").isNotNull()
    return named.join(nearest, "dir", "left").select(
        "doc_id", "path", F.coalesce("license", "above").alias("license"),
        F.when(header, "header").when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("score", "above_score").alias("score"),
        F.when(~header, F.col("license_dir")).alias("license_dir"))
