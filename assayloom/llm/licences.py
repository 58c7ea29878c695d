"""Licence scan: units of a text against licence templates by the Dice coefficient of their word bigrams.

Units are the lines of a text, its paragraphs (runs of lines between blank ones) and the whole text, each once. Text is
normalised to runs of a-z and 0-9 (A-Z count as a-z). Dice of two sets of bigrams of sizes a and b is at most
2 min(a, b) / (a + b), so a unit is compared only with the templates whose size lies within t/(2-t) and (2-t)/t of its
own. A match must also share t/(2-t) of the template's bigrams, so texts without any of a few words, chosen so that too
few bigrams are left without them, are passed over before they are taken apart. Everything happens inside a row, in DataFrame expressions: there is no shuffle and nothing to gather.

Defined cases: a null or empty text has no match; units of fewer than two words have no bigrams and match nothing; of
templates with the same score the first by name counts; repeated rows are scanned each by itself; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9

# Whole texts of short licences, without their copyright lines.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
)

# Notices of common licences, and the short licences whole.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD": [_BSD[0]],
    "BSD-2-Clause": [" ".join(_BSD[:3] + _BSD[4:])],
    "BSD-3-Clause": [" ".join(_BSD)],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [_ISC[0], " ".join(_ISC)],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", _MIT[0], " ".join(_MIT)],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": [_UNLICENSE[0], " ".join(_UNLICENSE)],
    "Zlib": [" ".join(_ZLIB)],
}


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def listed(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, bigrams(text)) for name in sorted(templates) for text in templates[name]]


def telling_words(known: list[tuple[str, list[str]]], ratio: float) -> list[str]:
    """Words such that no template can be matched by a text without all of them: taken greedily, long ones first."""
    need = [len(grams) - math.ceil(ratio * len(grams) - 1e-9) + 1 for _, grams in known]
    left = [set(grams) for _, grams in known]
    words = sorted({w for _, grams in known for g in grams for w in g.split()})
    taken: list[str] = []

    def gain(w: str) -> tuple:
        covered = sum(min(max(0, n), sum(w in g.split() for g in grams)) for n, grams in zip(need, left))
        return (covered > 0 and len(w) >= 6, covered > 0 and len(w) >= 3, covered, len(w), w)

    while any(n > 0 for n in need):
        best = max(words, key=gain)
        taken.append(best)
        for i, grams in enumerate(left):
            hit = {g for g in grams if best in g.split()}
            need[i] -= len(hit)
            left[i] = grams - hit
    return taken


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, matches (unit, licence, score of every unit that reaches the threshold), n_matches, licence and score of the best."""
    known = listed(TEMPLATES if templates is None else templates)
    sizes = [len(b) for _, b in known]
    ratio = threshold / (2 - threshold)
    words_most = int(max(sizes) / ratio) * 4 + 2  # more words than that make too many bigrams, unless they repeat
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), LETTERS, LETTERS.lower())
    lines = F.regexp_replace(text, "[^a-z0-9\n]++", " ")
    flat = "trim(regexp_replace({}, '[\\\\x20\\n]++', ' '))"
    units = f"array_distinct(concat(transform(split(t, '\\n'), u -> trim(u)), transform(split(t, '\\n(?:\\\\x20*+\\n)++'), u -> {flat.format('u')}), array({flat.format('t')})))"
    # words of a unit, then its bigrams; the counts come before the arrays are built
    gaps = "(length(u) - length(replace(u, ' ', '')))"
    some = f"filter({units}, u -> {gaps} >= 1)"
    pairs = "array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])))"
    scores = ", ".join(
        f"case when size(b) between {len(grams) * ratio!r}D and {len(grams) / ratio!r}D then named_struct('licence', '{name}', 'score',"
        f" 2D * size(array_intersect(b, array({', '.join(repr(g) for g in grams)}))) / (size(b) + {len(grams)})) end"
        for name, grams in known
    )
    low = min(sizes) * ratio
    # a unit whose words repeat may have few bigrams in many words: it is let through by its distinct words
    fits = f"{gaps} >= {low!r}D and ({gaps} <= {words_most} or size(array_distinct(split(u, ' '))) <= {words_most})"
    best = "reduce(filter(array({s}), x -> x is not null), cast(null as struct<licence:string,score:double>), (a, x) -> case when a is null or x.score > a.score then x else a end)".format(s=scores)
    grams_of = f"transform(array(split(u, ' ')), w -> {pairs})[0]"  # one split a unit
    each = f"transform(filter({some}, u -> {fits}), u -> named_struct('unit', u, 'best', transform(array({grams_of}), b -> {best})[0]))"
    matches = f"transform(filter({each}, m -> m.best.score >= {threshold!r}D), m -> named_struct('unit', m.unit, 'licence', m.best.licence, 'score', m.best.score))"
    top = "reduce(matches, cast(null as struct<unit:string,licence:string,score:double>), (a, x) -> case when a is null or x.score > a.score or (x.score = a.score and x.licence < a.licence) then x else a end)"
    telling = " or ".join(f"contains(l, '{w}')" for w in telling_words(known, ratio))
    worth = F.expr(f"transform(array(lower(coalesce(cast(text as string), ''))), l -> {telling})[0]")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(worth, lines).otherwise(F.lit("")).alias("t")).withColumn("matches", F.expr(matches)).withColumn("top", F.expr(top))
    return out.select("doc_id", "matches", F.size("matches").cast("long").alias("n_matches"), F.col("top.licence").alias("licence"), F.col("top.score").alias("score"))


def oracle(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same result in SQL, without the pruning."""
    known = listed(TEMPLATES if templates is None else templates)
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams in known)
    return f"""
    with t as (select doc_id, row_number() over () r, regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^a-z0-9\\n]+', ' ', 'g') t from documents),
    u as (select distinct doc_id, r, trim(regexp_replace(unnest(list_concat(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n[ \\n]*\\n')), [t])), '[ \\n]+', ' ', 'g')) u from t),
    w as (select doc_id, r, u, string_split(u, ' ') w from u where contains(u, ' ')),
    b as (select doc_id, r, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) b from w),
    k(licence, g) as (values {rows}),
    s as (select doc_id, r, u, licence, max(2.0::double * len(list_intersect(b, g)) / (len(b) + len(g))) score from b, k group by all),
    best as (select doc_id, r, u, first(licence order by score desc, licence) licence, max(score) score from s group by all having max(score) >= {threshold}),
    m as (select r, count(*) n_matches, first(licence order by score desc, licence) licence, max(score) score from best group by r)
    select t.doc_id, coalesce(m.n_matches, 0)::bigint n_matches, m.licence, m.score from t left join m using (r)
    """
