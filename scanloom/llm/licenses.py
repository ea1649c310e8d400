"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Built-in functions only. A text is split into lower-case words; each word is hashed once, and five word hashes make a shingle's. Every template belongs to a window
class, the shortest that holds it, however long it is; the windows of a class overlap (by all but one word for short ones, by seven eighths for long ones). A template that
a window holds to 0.8 has Jaccard similarity of about 0.4 with it or more, so with 24 bands of one row at least one band meets
with probability 1 - 0.6^24 > 0.99999. Bands are joined with those of the templates; what they retrieve is verified exactly: the share of the template's
distinct five-word shingles that stand in the window and a step around it must be 0.8 or more.

A window without any shingle of a template can't match, so only windows with one are signed; which shingles those can be is told by a table of bytes whose size
is bounded, whatever the number of templates. It never rules out a shingle that a template has. Templates and their bands are a table of a catalogue's size, and are broadcast; texts are never
shuffled. Each row is scanned by itself, and only results are put together by id.

Defined results: null and empty texts, and texts under five words, match nothing. Of rows with one id, and of rows without an id, the result has one row a license, the
best of any of them.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and leading paragraphs of well-known licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-3 clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "Apache-2.0 terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
WIDTH = 5


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(" ".join(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)))


def window_class(words: int) -> int:
    """The shortest of the window lengths 6, 8, 12, 16, 24, 32, 48, ... that holds so many words."""
    short, long = 6, 8
    while short < words:
        short, long = long, 2 * short
    return short


def signature(hashes: str, bands: int) -> str:
    """SQL of an array of the least permuted hash for each band. Multipliers and offsets are odd constants from a rule."""
    parts = [f"array_min(transform({hashes}, h -> xxhash64(h, {1_000_003 * i + 17})))" for i in range(bands)]
    return f"array({', '.join(parts)})"


def shingle_hashes(words: str) -> str:
    """SQL of an array with the hash of each run of five words, from an array of words; each word is hashed once."""
    parts = ", ".join(f"element_at(v, i + {k})" for k in range(WIDTH))
    return f"element_at(transform(array(transform({words}, x -> xxhash64(x))), v -> transform(sequence(1, size(v) - {WIDTH - 1}), i -> xxhash64({parts}))), 1)"


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    for name, text in templates.items():
        if len(words_of(text)) < WIDTH:
            raise ValueError(f"template {name!r} has fewer than {WIDTH} words")
    rows = [(name, window_class(len(words_of(t))), shingles_of(t), words_of(t)) for name, t in templates.items()]
    known = spark.createDataFrame(rows, "license string, class int, shingles array<string>, w array<string>")
    return known.withColumn("h", F.expr(f"array_distinct({shingle_hashes('w')})")).withColumn("v", F.expr("transform(w, x -> xxhash64(x))")).drop("w")


def marked(hashes: list[int]) -> bytes:
    """A table of bytes, 1 at the two places of each given hash: 64 bytes for each, 4 MB at most. Of other hashes one in 4,096 has both places marked, and one in
    200 in a catalogue of 300,000 shingles."""
    size = 1 << 12
    while size < min(64 * len(set(hashes)), 1 << 22):
        size *= 2
    out = bytearray(size)
    for h in hashes:
        out[h % size] = out[(h >> 32) % size] = 1
    return bytes(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, bands: int = 24, templates: dict[str, str] | None = None) -> DataFrame:
    """(id_col, license, containment, first_word): the best match of each template in each text."""
    known = template_table(docs.sparkSession, templates or TEMPLATES)
    facts = known.select("class", "h", "v").collect()  # the catalogue

    def among(hashes: list[int]):
        bytes_ = marked(hashes)
        table, size = F.lit(bytes_), F.lit(len(bytes_))

        def test(h: Column) -> Column:
            places = F.pmod(h, size), F.pmod(F.shiftright(h, 32), size)
            first, second = (F.substring(table, (p + 1).cast("int"), F.lit(1)) == F.lit(b"\x01") for p in places)
            return first & second

        return test

    word_listed, listed = among([h for r in facts for h in r["v"]]), among([h for r in facts for h in r["h"]])

    def hits_of(x: Column) -> Column:
        """Where a shingle that a template may have begins: all of its words are in templates, and so is their hash. ``x``: hashes of words, and which are listed."""

        def hit(i: Column) -> Column:
            at = [i + k for k in range(WIDTH)]
            return reduce(and_, [F.element_at(x["known"], k) for k in at]) & listed(F.xxhash64(*[F.element_at(x["v"], k) for k in at]))

        return F.transform(F.filter(F.sequence(F.lit(1), F.size(x["v"]) - (WIDTH - 1)), hit), lambda i: i - 1)

    signed = known.withColumn("sig", F.expr(signature("h", bands)))
    bands_of = F.broadcast(signed.select("license", F.col("class").alias("_class"), F.posexplode("sig").alias("_band", "_low")))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.expr(f"regexp_extract_all(lower(`{text_col}`), '{_WORD}', 0)").alias("w")).where(f"size(w) >= {WIDTH}")
    one = F.array(F.transform("w", lambda x: F.xxhash64(x)))  # made once for a text
    told = F.transform(one, lambda v: F.struct(v.alias("v"), F.transform(v, word_listed).alias("known")))
    texts = texts.withColumn("hits", F.element_at(F.transform(told, hits_of), 1)).where("size(hits) > 0").withColumn("h", F.expr(shingle_hashes("w")))
    # Of each class the windows that hold one of those shingles, on the grid of the class's steps, with their words and a step more around them.
    windows = [
        f"transform(array_distinct(flatten(transform(hits, p -> sequence(greatest(0, (p - {c - WIDTH} + {s - 1}) div {s}), p div {s})))), g -> named_struct('class', {c}, 'start', int(g * {s}), "
        f"'h', slice(h, int(g * {s}) + 1, {c - WIDTH + 1}), 'around', slice(w, greatest(1, int(g * {s}) + 1 - {s}), {c + 2 * s})))"
        for c in sorted({r["class"] for r in facts})
        for s in [max(1, c // 8)]
    ]
    found = texts.select("row", "id", F.expr(f"inline(concat({', '.join(windows)}))")).where("size(h) > 0").withColumn("sig", F.expr(signature("h", bands)))
    met = found.select("row", "id", "class", "start", "around", F.posexplode("sig").alias("band", "low")).join(
        bands_of, (F.col("class") == F.col("_class")) & (F.col("band") == F.col("_band")) & (F.col("low") == F.col("_low"))
    )
    once = met.groupBy("row", "id", "class", "start", "license").agg(F.first("around").alias("around"))
    shingles = f"transform(sequence(1, size(around) - {WIDTH - 1}), i -> array_join(slice(around, i, {WIDTH}), ' '))"
    exact = once.join(F.broadcast(known.select("license", "shingles")), "license")
    exact = exact.withColumn("containment", F.expr(f"size(array_intersect(shingles, {shingles})) / size(shingles)")).where(F.col("containment") >= containment)
    best = exact.groupBy("id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"))
    return best.withColumnRenamed("id", id_col)


def op10_licenses(docs: DataFrame) -> DataFrame:
    return scan(docs)
