"""Licence scan: parts of a text against licence templates, by the Dice coefficient over distinct word bigrams.

Words are runs of ``[a-z0-9]`` after lower-casing. A text is cut at line ends and after ``.``, ``!`` or ``?`` before a blank; a
part is any run of neighbouring pieces that has no more words than the largest template allows. So a licence is found in
its published layout, wrapped or in paragraphs, between other text and inside a longer line. Dice of at least t asks for
sizes within ``t / (2 - t)`` and its inverse of each other, so templates outside that range are left out before any bigram is
compared. A part that can match any template at all holds one of a few words (`anchors`): most texts are passed over after
a plain search, and in the others only the surroundings of such words are looked at. All of it is one scan; only found
licences are shuffled.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and licence texts as their owners publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        'IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
LEAST_DICE = Fraction(4, 5)
#: Where a line is cut besides its end: after the mark, at the blanks.
MARK = r"([.!?])[ \t]+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, least: Fraction = LEAST_DICE) -> tuple[int, int]:
    """Fewest and most distinct bigrams of a part that can reach the Dice coefficient with a template of this size."""
    return math.ceil(size * least / (2 - least)), math.floor(size * (2 - least) / least)


def anchors(templates: list[list[str]], least: Fraction = LEAST_DICE) -> list[str]:
    """Words of which any matching part holds at least one.

    A part that reaches the coefficient with a template of n bigrams shares at least ``least * (low + n) / 2`` of them, so it
    misses fewer than n - that + 1. Words are taken, long ones first, until each template has that many bigrams with one.
    """
    left = {}
    for i, grams in enumerate(templates):
        shared = math.ceil(least * (size_bounds(len(grams), least)[0] + len(grams)) / 2)
        left[i] = (set(grams), max(1, len(grams) - shared + 1))
    covered, chosen = dict.fromkeys(left, 0), []
    while any(covered[i] < need for i, (_, need) in left.items()):
        gain: dict[str, int] = {}
        for i, (grams, need) in left.items():
            for w in {w for g in grams for w in g.split()}:
                new = sum(w in g.split() for g in grams)
                gain[w] = gain.get(w, 0) + min(new, max(0, need - covered[i]))
        word = max((w for w in gain if gain[w]), key=lambda w: (len(w) >= 7, len(w) >= 5, gain[w], w))
        chosen.append(word)
        for i, (grams, need) in left.items():
            has = {g for g in grams if word in g.split()}
            covered[i] += len(has)
            left[i] = (grams - has, need)
    return chosen


def bigrams(words: Column) -> Column:
    """Distinct bigrams of a list of words; empty for fewer than two."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def pieces(text: Column) -> Column:
    """The words of each piece of a lower-case text, without pieces that have none."""
    cut = F.split(F.regexp_replace(text, MARK, "$1\n"), "\n")
    words = lambda p: F.filter(F.split(F.regexp_replace(p, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.filter(F.transform(cut, words), lambda w: F.size(w) > 0)


def within(listed: Column, most: int) -> Column:
    """The first pieces of a list that have ``most`` words together."""
    none = F.struct(F.lit(0).alias("pieces"), F.lit(0).alias("words"))

    def add(a: Column, p: Column) -> Column:
        words = a["words"] + F.size(p)
        return F.struct((a["pieces"] + F.when(words <= most, 1).otherwise(0)).alias("pieces"), words.alias("words"))

    return F.slice(listed, F.lit(1), F.aggregate(listed, none, add, lambda a: a["pieces"]))


def runs_at(listed: Column, at: Column, after: Column, fewest: int, most: int) -> Column:
    """The words of each run of pieces that holds piece ``at``, but none up to ``after``, and has ``fewest`` to ``most`` words."""
    right = within(F.slice(listed, at, F.lit(most)), most)
    first = F.greatest(after + 1, at - most)
    left = within(F.reverse(F.slice(listed, first, F.greatest(at - first, F.lit(0)))), most)
    sides = F.array(F.struct(F.reverse(left).alias("left"), right.alias("right")))  # both are made once

    def runs(s: Column) -> Column:
        n = F.size(s["left"])
        each = lambda i: F.transform(F.sequence(F.lit(1), F.size(s["right"])), lambda j: F.flatten(F.concat(
            F.slice(s["left"], n - i + 1, i), F.slice(s["right"], F.lit(1), j))))
        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), n), each)), lambda w: F.size(w).between(fewest, most))

    return F.when(F.size(right) > 0, F.flatten(F.transform(sides, runs))).otherwise(F.array().cast("array<array<string>>"))


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                  least: Fraction = LEAST_DICE) -> DataFrame:
    """Licences found: ``(doc_id, license, n_parts, dice)``, a row per id and licence: how many parts match, and the best coefficient.

    A null or empty text has no parts, hence no row. Repeated ids count together, null ids too. Templates of fewer than two
    words match nothing. The templates are literals of the plan: a list that a person keeps, not data.
    """
    known = {name: template_bigrams(t) for name, t in (TEMPLATES if templates is None else templates).items()}
    rows = []
    for name, grams in sorted(known.items()):
        if grams:
            low, high = size_bounds(len(grams), least)
            rows.append(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"),
                                 F.lit(low).alias("low"), F.lit(high).alias("high")))
    if not rows:
        return docs.where(F.lit(False)).select(F.col(id).alias("doc_id"), F.lit("").alias("license"), F.lit(0).cast("long").alias("n_parts"), F.lit(0.0).alias("dice"))
    words = anchors([g for g in known.values() if g], least)
    fewest = min(size_bounds(len(g), least)[0] for g in known.values() if g) + 1
    most = max(size_bounds(len(g), least)[1] for g in known.values() if g) + 1
    lowered = docs.select(F.col(id).alias("doc_id"), F.lower(F.col(text)).alias("low"))
    likely = lowered.where(reduce(or_, (F.contains(F.col("low"), F.lit(w)) for w in words)))
    cut = likely.select("doc_id", pieces(F.col("low")).alias("listed"))
    anchored = F.transform("listed", lambda p, i: F.when(F.arrays_overlap(p, F.array(*map(F.lit, words))), i + 1))
    held = cut.withColumn("at", F.filter(anchored, lambda i: i.isNotNull()))
    # a run belongs to the first piece with an anchor in it
    turns = F.transform("at", lambda a, i: F.struct(a.alias("at"), F.when(i > 0, F.element_at("at", F.greatest(i, F.lit(1)))).otherwise(0).alias("after")))
    each = held.select("doc_id", F.explode(F.transform(turns, lambda t: runs_at(F.col("listed"), t["at"], t["after"], fewest, most))).alias("runs"))
    units = each.select("doc_id", F.explode("runs").alias("run")).select("doc_id", bigrams(F.col("run")).alias("grams"))
    fits = F.filter(F.array(*rows), lambda t: F.size("grams").between(t["low"], t["high"]))
    found = units.select("doc_id", "grams", F.explode(fits).alias("t")).select(
        "doc_id", "t.license", F.size(F.array_intersect("grams", "t.grams")).alias("shared"),
        (F.size("grams") + F.size("t.grams")).alias("sizes"),
    )
    return (
        found.where(F.col("shared") * 2 * least.denominator >= F.col("sizes") * least.numerator)
        .groupBy("doc_id", "license")
        .agg(F.count(F.lit(1)).alias("n_parts"), F.max(F.col("shared") * 2.0 / F.col("sizes")).alias("dice"))
    )


def oracle() -> str:
    """The same over the table ``documents`` in DuckDB's SQL, over all runs of pieces of texts that share a bigram with a template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    grams = {n: template_bigrams(t) for n, t in sorted(TEMPLATES.items())}
    known = ", ".join(f"({quote(n)}, [{', '.join(map(quote, g))}])" for n, g in grams.items())
    bounds = [size_bounds(len(g)) for g in grams.values()]
    fewest, most = min(b[0] for b in bounds) + 1, max(b[1] for b in bounds) + 1
    t = f"{LEAST_DICE.numerator}::BIGINT", f"{LEAST_DICE.denominator}::BIGINT"
    split = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""
WITH templates(license, t) AS (VALUES {known}),
rows AS (SELECT row_number() OVER () AS r, doc_id, text, {split('text')} AS w FROM documents),
likely AS (SELECT * FROM rows WHERE list_has_any(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), (SELECT flatten(list(t)) FROM templates))),
cut AS (SELECT r, doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS piece FROM likely),
spelled AS (SELECT r, doc_id, row_number() OVER (PARTITION BY r) AS i, {split('piece')} AS ws FROM cut),
placed AS (SELECT r, doc_id, i, ws, len(ws) AS n, sum(len(ws)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS upto FROM spelled WHERE len(ws) > 0),
tails AS (SELECT doc_id, n, upto, list(ws) OVER t AS pieces, list(upto) OVER t AS ends FROM placed
  WINDOW t AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {most} FOLLOWING)),
cutoff AS (SELECT doc_id, list_slice(flatten(pieces), 1, {most}) AS w,
  unnest(list_filter(list_transform(ends, lambda e: e - upto + n), lambda e: e BETWEEN {fewest} AND {most})) AS last FROM tails),
parts AS (SELECT doc_id, list_slice(w, 1, last) AS w FROM cutoff),
grams AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM parts),
scored AS (SELECT doc_id, license, len(list_intersect(g, t)) AS shared, len(g) + len(t) AS sizes FROM grams JOIN templates
  ON len(g) * 2 * {t[1]} >= (len(g) + len(t)) * {t[0]} AND len(t) * 2 * {t[1]} >= (len(g) + len(t)) * {t[0]})
SELECT doc_id, license, count(*) AS n_parts, max(shared * 2::DOUBLE / sizes) AS dice FROM scored
WHERE shared * 2 * {t[1]} >= sizes * {t[0]} AND shared > 0 GROUP BY doc_id, license"""
