"""Licence scan: normalised units of text, and runs of words where no unit is one, against templates
by Dice coefficient of word bigrams."""

from __future__ import annotations

import functools
import math
import pathlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import stage, text_batches

# Notices and texts as their licences word them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL = """free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version. This {4} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."""
TEMPLATES = {
    "AGPL-header": "This program is " + _GPL.format(":", "Affero General Public License", ",", "3", "program"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{_BSD_2} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_2} {_BSD_NAME} {_BSD_WARRANTY}",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is " + _GPL.format(":", "General Public License", ",", "3", "program"),
    "ISC": _ISC,
    "ISC-full": f"{_ISC} {_ISC_WARRANTY}",
    "LGPL-header": "This library is " + _GPL.format(";", "Lesser General Public License", ";", "2.1", "library"),
    "MIT": "Released under the MIT License.",
    "MIT-full": f"{_MIT} {_MIT_WARRANTY}",
    "MIT-text": _MIT,
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. """
    + _MIT_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"),
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def templates_of(folder: str) -> dict[str, str]:
    """Further templates: the .txt files of a folder on the driver by name, such as whole licence texts."""
    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(pathlib.Path(folder).glob("*.txt"))}


# Words too common to tell a notice from prose.
COMMON = "a an and any but so are as at by for from if in is it may not of on or out that the this to under was with you your version".split()


def bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold with one of this size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _has(gram: str, word: str) -> bool:
    """Long words count as parts of others too, which is the quicker test; short ones on their own."""
    return word in gram if len(word) > 4 else word in gram.split()


def _holds(text: Column, words: list[str]) -> Column:
    """Some of the words by the rule of _has."""
    alone = lambda w: text.contains(w) & text.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])")
    tests = [text.contains(w) if len(w) > 4 else alone(w) for w in words]
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def needles(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with any template has one: it shares so
    many of the template's bigrams that, of any selection with one more than may be missing, one is
    there. Taken are the words that cover most of what the templates still need; ones that are common
    in prose, or short, only where no other word is left."""
    open_ = {name: set(bigrams(t)) for name, t in templates.items()}
    need = {name: len(g) - bounds(len(g), threshold)[0] + 1 for name, g in open_.items() if g}
    found: list[str] = []
    while need:
        gain: dict[str, int] = {}
        for name, n in need.items():
            own: dict[str, int] = {}
            for w in {w for g in open_[name] for w in g.split()}:
                own[w] = sum(_has(g, w) for g in open_[name])
            for w, k in own.items():
                gain[w] = gain.get(w, 0) + min(n, k)
        best = max(sorted(gain), key=lambda w: (w not in COMMON, len(w) > 4, gain[w], len(w)))
        found.append(best)
        for name in list(need):
            there = {g for g in open_[name] if _has(g, best)}
            open_[name] -= there
            need[name] -= len(there)
            if need[name] <= 0:
                del need[name]
    return found


def _units(text: Column) -> Column:
    """Lines; blocks of lines between blank ones, if of two lines or more; the whole text, if of two
    blocks or more. All with their number from 0."""
    lines = F.split(text, "\n")
    blocks = F.split(text, r"\n[ \t\r]*\n")
    named = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), x.alias("body")))
    return F.concat(
        named("line", lines),
        F.filter(named("block", blocks), lambda x: x["body"].contains("\n")),
        F.filter(named("text", F.array(text)), lambda x: F.size(blocks) > 1),
    )


def _dice(grams: list[str], template: set[str]) -> float:
    own = set(grams)
    return 2.0 * len(own & template) / (len(own) + len(template))


def _taken(text: str, grams: list[str], template: set[str], threshold: float) -> list[tuple[int, int]]:
    """First and end word of the lines, blocks and text that reach the threshold themselves."""
    out = []
    for parts in (text.split("\n"), re.split(r"\n[ \t\r]*\n", text), [text]):
        at = 0
        for part in parts:
            n = len(re.findall("[a-z0-9]+", part))
            if n > 1 and _dice(grams[at : at + n - 1], template) >= threshold:
                out.append((at, at + n))
            at += n
    return out


def windows(text: str, templates: dict[str, tuple[set[str], int]], threshold: float) -> list[tuple[int, str, float]]:
    """First word, template and Dice of the runs of words that reach the threshold and share no word
    with a unit or better run that does, for templates as (bigrams, bigrams with repeats). ``text`` is
    in lower case. A run is at most ``(2 - t) / t`` times as long as its template."""
    words = re.findall("[a-z0-9]+", text)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    there = set(grams)
    out = []
    for name, (template, length) in templates.items():
        # Dice d with sets of s and n shares d (s + n) / 2 of at most s: at least n d / (2 - d).
        need = bounds(len(template), threshold)[0]
        if not template or len(template & there) < need:
            continue
        most = bounds(length, threshold)[1]
        at = [i for i, g in enumerate(grams) if g in template]
        found = []
        for k, first in enumerate(at):
            if k + need > len(at) or at[k + need - 1] >= first + most:
                continue
            seen: set[str] = set()
            shared, best = 0, (0.0, 0)
            for i in range(first, min(first + most, len(grams))):
                if grams[i] not in seen:
                    seen.add(grams[i])
                    shared += grams[i] in template
                    best = max(best, (2.0 * shared / (len(seen) + len(template)), -i))
            if best[0] >= threshold:
                found.append((-best[0], first, 2 - best[1]))
        taken = _taken(text, grams, template, threshold) if found else []
        for dice, first, end in sorted(found):
            if all(end <= a or first >= b for a, b in taken):
                taken.append((first, end))
                out.append((first, name, -dice))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, unit (line, block or text), number, licence, dice for every unit and template of at
    least the threshold; and as unit ``window``, numbered by its first word, every run of words that
    does where no unit has the licence, such as a notice of several blocks or within a line. Null and empty texts match nothing; repeated rows match each; other columns
    are ignored. Candidates are joined on the size of the bigram set: a template stands under each
    size that can reach the threshold with its own, at most ``(2 - t) / t`` times its size, so the
    joined side is bounded by the templates alone."""
    spark = docs.sparkSession
    grams = {name: bigrams(t) for name, t in templates.items()}
    rows = []
    for name, g in grams.items():
        low, high = bounds(len(g), threshold)
        rows += [(size, name, g, len(g)) for size in range(max(1, low), high + 1)]
    if not rows:
        return spark.createDataFrame([], "doc_id long, unit string, number int, licence string, dice double")
    small, large = min(r[0] for r in rows), max(r[0] for r in rows)
    sized = spark.createDataFrame(rows, "_size int, licence string, _grams array<string>, _n int")
    words_ = needles(templates, threshold)
    # Each text is lowered once for all words; what has none of them leaves here.
    some = F.exists(F.array(F.lower("text")), lambda t: _holds(t, words_))
    lower = stage(docs.select("doc_id", "text").filter(some).select("doc_id", F.lower("text").alias("text")), "noticed")
    units = lower.select("doc_id", F.explode(_units(F.col("text"))).alias("u")).select("doc_id", "u.*").filter(_holds(F.col("body"), words_))
    # A bigram takes three characters of a unit at least, and words beyond those of the largest set
    # would have to repeat bigrams; so only the lower bound on length is sound.
    units = units.filter(F.length("body") >= 2 * small + 1)
    plain = F.trim(F.regexp_replace("body", "[^a-z0-9]+", " "))
    words = units.select("doc_id", "unit", "number", F.split(plain, " ").alias("w")).filter(F.size("w") > small)
    pairs = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    sets = words.select("doc_id", "unit", "number", pairs.alias("b"))
    sets = sets.withColumn("_size", F.size("b")).filter(F.col("_size").between(small, large))
    dice = 2.0 * F.size(F.array_intersect("b", "_grams")) / (F.col("_size") + F.col("_n"))
    found = sets.join(F.broadcast(sized), "_size").withColumn("dice", dice).filter(F.col("dice") >= threshold)
    found = found.select("doc_id", "unit", "number", "licence", F.round("dice", 6).alias("dice"))
    known = {name: (set(g), max(0, len(re.findall("[a-z0-9]+", templates[name].lower())) - 1)) for name, g in grams.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, *w) for i, t in enumerate(batch.column(1).to_pylist()) for w in windows(t, known, threshold)]
            ids = batch.column(0).take(pa.array([g[0] for g in got], pa.int64()))
            columns = [pa.array(["window"] * len(got), pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string()), pa.array([round(g[3], 6) for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "unit", "number", "licence", "dice"])

    text_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.unionByName(lower.mapInArrow(run, f"doc_id {kind}, unit string, number int, licence string, dice double"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    quoted = ", ".join(f"('{n}', [{', '.join(repr(g) for g in bigrams(t))}])" for n, t in templates.items())
    return f"""
WITH t(licence, g) AS (VALUES {quoted}),
lines AS (SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS number, unnest(string_split(text, chr(10))) AS body FROM documents),
blocks AS (SELECT doc_id, 'block' AS unit, unnest(range(len(b))) AS number, unnest(b) AS body, len(b) AS n, text
  FROM (SELECT doc_id, text, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS b FROM documents)),
u AS (SELECT * FROM lines UNION ALL SELECT doc_id, unit, number, body FROM blocks WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM blocks WHERE n > 1 AND number = 0),
w AS (SELECT *, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT doc_id, unit, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1)
SELECT doc_id, unit, number::INT AS number, licence, round(2.0 * len(list_intersect(b, g)) / (len(b) + len(g)), 6) AS dice
FROM b, t WHERE 2.0 * len(list_intersect(b, g)) / (len(b) + len(g)) >= {threshold}"""
