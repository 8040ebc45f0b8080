"""License notices found by the Dice coefficient over word bigrams.

Text and templates are normalised alike: ASCII-lower-cased, and every run of other characters
than letters and digits is one blank. The scanned units of a document are its lines, its
sentences, its paragraphs (between lines that are empty but for white space and comment marks),
and the whole text; so the standard sentences and paragraphs of a licence are found wherever its
text stands, whether wrapped or not. A unit with a distinct bigrams can reach Dice ``threshold`` with
a template of b only if ``a`` lies between ``b t / (2 - t)`` and ``b (2 - t) / t``; other
templates are pruned before any comparison, by a list of templates for each size, and most units
have no template left. Such a unit also shares most bigrams of its template, so it has a word of any
set of words that is in enough of them (``anchors``): a text, and then a unit, without one is not
taken to words at all.

Templates are a fixed small table, so they are constants of the plan. Everything is DataFrame
functions inside a document's row: matches are gathered per row, nothing is shuffled.

Defined cases: a null or empty text has no match; a unit of fewer than two words has no bigrams
and never matches; of equal scores the template that sorts first wins; repeated rows are scanned
alike; null ids pass through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.common import settled

THRESHOLD = 0.8

# Wording of common public notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This work is in the public domain.",
    # Standard sentences and paragraphs of whole texts and file notices.
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2.0-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache-2.0-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def normal_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def bigrams(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


#: Frequent words, which tell little; they are taken as anchors only where no others are enough.
_FREQUENT = frozenset("a all and any as at be by for from in is it may not of on or other that the this to under use with you".split())


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit that reaches ``threshold`` with a template has at least one; none where that cannot be told.

    Such a unit shares ``k = ceil(t (n + a) / 2)`` or more of a template's n bigrams, a being the least size that can reach it;
    so of any ``n - k + 1`` bigrams it has one, and the words chosen are in as many.
    """
    out = set()
    for text in templates.values():
        grams = [g.split() for g in bigrams(text)]
        n = len(grams)
        low = math.ceil(n * threshold / (2 - threshold) - 1e-9)
        need = n - math.ceil(threshold * (n + low) / 2 - 1e-9) + 1
        if not n:
            continue
        if not 0 < need <= n:
            return []
        left = grams
        for word in sorted({w for g in grams for w in g}, key=lambda w: (w in _FREQUENT, -len(w), w)):
            if n - len(left) >= need:
                break
            rest = [g for g in left if word not in g]
            if len(rest) < len(left):
                out.add(word)
                left = rest
    return sorted(out)


def _anchored(column: str, words: list[str]) -> str:
    """Whether a text has one of the words, as a SQL condition; the words stand by their first letter."""
    if not words:
        return "true"
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(word[1:])
    found = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items())
    return f"{column} rlike '(?i)(?<![a-z0-9])(?:{found})(?![a-z0-9])'"


def _constant(templates: dict[str, str], threshold: float) -> tuple[str, str]:
    """The templates as a SQL array of (id, rank, bigrams, n), and for each size of a unit the places of those it can reach."""
    rows, reach = [], {}
    for rank, (name, text) in enumerate(sorted(templates.items())):
        grams = bigrams(text)
        quoted = ", ".join(f"'{g}'" for g in grams)
        n = len(grams)
        rows.append(f"named_struct('id', '{name}', 'rank', {-rank}, 'g', array({quoted}), 'n', {n})")
        low, high = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
        for size in range(low, high + 1):
            reach.setdefault(size, []).append(str(rank))
    sizes = [f"cast(array({', '.join(reach.get(k, []))}) as array<int>)" for k in range(max(reach, default=0) + 1)]
    return f"array({', '.join(rows)})", f"array({', '.join(sizes)})"


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document row: id, license (best template or null), dice, n_units (matching units)."""
    constant, reach = _constant(templates, threshold)
    steps = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = anchors(templates, threshold)
    units = (
        r"array_distinct(concat(array(t), split(t, '\n'), split(t, '(?<=[.!?])[\\x20\\x09-\\x0D]+'), "
        r"split(t, '\n(?:[\\x20\\x09\\x0B-\\x0D*#/;%-]*\n)+')))"
    )
    steps = steps.select(
        "id",
        F.expr(f"if({_anchored('t', words)}, filter({units}, u -> {_anchored('u', words)}), cast(array() as array<string>))").alias("units"),
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    steps = steps.select(
        "id", F.expr(f"transform(units, u -> array_remove(split(translate(u, '{upper}', '{lower}'), '[^a-z0-9]+'), ''))").alias("words")
    )
    pairs = "array_distinct(transform(sequence(1, size(w) - 1), i -> concat(get(w, i - 1), ' ', get(w, i))))"
    steps = steps.select("id", F.expr(f"transform(filter(words, w -> size(w) > 1), w -> {pairs})").alias("grams"))
    score = "named_struct('dice', 2.0D * size(array_intersect(a, x.g)) / (size(a) + x.n), 'rank', x.rank, 'id', x.id)"
    compared = f"transform(transform(get({reach}, size(a)), i -> get({constant}, i)), x -> {score})"
    steps = steps.select(
        "id", F.expr(f"filter(transform(grams, a -> array_max({compared})), m -> m.dice >= {threshold!r}D)").alias("found")
    )
    return settled(steps, "found").select(
        F.col("id").alias(id_col),
        F.expr("array_max(found).id").alias("license"),
        F.expr("array_max(found).dice").alias("dice"),
        F.size("found").cast("long").alias("n_units"),
    )
