"""Licence scan: Dice coefficient of word bigrams between windows of a text and licence templates.

The text is normalised once into its words, line breaks and marks being blanks, so a notice is
found wherever it stands and however it is wrapped.  Three bounds prune before a window is built,
and none can lose a match at threshold t, where a window shares at least t/(2-t) of the
template's bigrams with it:

* every template has anchors, some of its bigrams without which that share is out of reach, and a
  text that holds no anchor of any template is passed over;
* the text as a whole must share as many of a template's bigrams;
* the size of a window lies between t/(2-t) and (2-t)/t times the template's.

Windows begin and end where bigrams of text and template lie in step: a start that a fifth of the
template's bigrams agree on is combined with every place the template may begin or end at nearby.
Of windows that overlap, the best stays.  All of it is built-in expressions over each row: no
shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import whole_text

#: Public notices by licence identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
     "either express or implied. See the License for the specific language governing permissions and limitations "
     "under the License."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior written "
     "permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
     "(at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

WORD = re.compile(r"[^\W_]+")
BETWEEN = r"[^\p{L}\p{N}]+"


def template_bigrams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Every template as the bigrams of its normalised words, in order."""
    out = []
    for name, text in templates:
        words = WORD.findall(text.lower())
        out.append((name, [f"{a} {b}" for a, b in zip(words, words[1:])]))
    return out


def anchors(known: list[tuple[str, list[str]]], share: float) -> list[str]:
    """Bigrams of which a text must hold one to share so much of any template's bigrams.

    As many of each template as it cannot miss all, its longest ones: they are the rarer ones in
    other texts.
    """
    chosen = set()
    for _, bigrams in known:
        own = sorted(set(bigrams), key=lambda b: (-len(b), b))
        chosen.update(own[:len(own) - math.ceil(share * len(own) - 1e-9) + 1])
    return sorted(chosen)


#: The steps over one row, each in the terms of the one before; {share} and {threshold} are numbers.
PAIRS = "transform(slice(words, 2, size(words)), (w, i) -> concat(words[i], ' ', w))"
# where the template would have to begin for each of its bigrams to stand where it does, in order
STEPS = """transform(near, t -> struct(t.license, t.n, t.distinct, array_sort(filter(
    transform(pairs, (w, i) -> CASE WHEN array_contains(t.distinct, w) THEN i + 1 - cast(array_position(t.b, w) AS int) END),
    s -> s IS NOT NULL)) AS steps))"""
# a start that a fifth of the bigrams agree on stands as often in a row
STARTS = """transform(stepped, t -> struct(t.license, t.n, t.distinct, array_distinct(
    filter(t.steps, (s, i) -> get(t.steps, i + cast(ceil(t.n / 5) AS int) - 1) = s)) AS starts))"""
WINDOWS = """flatten(transform(started, t -> transform(t.starts, s -> struct(t.license, t.distinct, filter(array_distinct(flatten(
    transform(sequence(-shiftright(t.n, 1), shiftright(t.n, 1)), d -> array(
        struct(greatest(s, 0) AS low, least(s + t.n + 1 + d, size(words)) AS high),
        struct(greatest(s + d, 0) AS low, least(s + t.n + 1, size(words)) AS high))))),
    w -> w.high - w.low - 1 >= size(t.distinct) * {share}) AS windows))))"""
# the best window of every start
FOUND = """filter(transform(ranged, t -> array_max(transform(
    transform(t.windows, w -> struct(w.low, w.high, array_distinct(slice(pairs, w.low + 1, w.high - w.low - 1)) AS own)),
    w -> struct(2.0D * size(array_intersect(w.own, t.distinct)) / (size(w.own) + size(t.distinct)) AS dice,
                w.high - w.low AS size, t.license AS license, -w.low AS before)))),
    w -> w.dice >= {threshold})"""
KEPT = """aggregate(reverse(array_sort(found)),
    cast(array() AS array<struct<dice: double, size: int, license: string, before: int>>),
    (kept, w) -> CASE WHEN exists(kept, k -> k.size - k.before > -w.before AND w.size - w.before > -k.before)
                 THEN kept ELSE concat(kept, array(w)) END)"""


def scan(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """A row per licence found in a document: ``doc_id``, ``unit``, ``license``, ``dice``.

    ``unit`` is the window's normalised text, ``license`` the template of the highest coefficient.
    Of overlapping windows the one with the higher coefficient stays, then the longer one, then
    the last name, then the first in the text.  Null, empty and other texts without a licence give
    no row; repeated rows give their rows each; further columns are ignored; an empty table gives
    an empty result.
    """
    known = template_bigrams(templates)
    share = threshold / (2 - threshold)
    literal = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b"),
                 F.array(*map(F.lit, sorted(set(b)))).alias("distinct")) for name, b in known])
    near = F.filter(literal, lambda t: F.size(F.array_intersect("pairs", t["distinct"])) >= F.size(t["distinct"]) * share)
    words = F.split(F.trim(F.regexp_replace(F.lower(whole_text()), BETWEEN, " ")), " ")

    def step(rows, kept, name, value):
        # a generator of one row, or of none where nothing is left, so that no step is computed twice
        return rows.select(*kept, F.explode(F.filter(F.array(value), lambda x: F.size(x) > 0)).alias(name))

    rows = step(docs, [F.col("doc_id").cast("long").alias("doc_id")], "words", words)
    rows = step(rows, ["doc_id", "words"], "pairs", F.expr(PAIRS))
    anchored = rows.where(F.arrays_overlap("pairs", F.array(*map(F.lit, anchors(known, share)))))
    rows = step(anchored, ["doc_id", "words", "pairs"], "near", near)
    rows = step(rows, ["doc_id", "words", "pairs"], "stepped", F.expr(STEPS))
    rows = step(rows, ["doc_id", "words", "pairs"], "started", F.expr(STARTS))
    rows = step(rows, ["doc_id", "words", "pairs"], "ranged", F.expr(WINDOWS.format(share=share)))
    rows = step(rows, ["doc_id", "words"], "found", F.expr(FOUND.format(threshold=threshold)))
    rows = rows.select("doc_id", "words", F.explode(F.expr(KEPT)).alias("w"))
    unit = F.array_join(F.slice("words", 1 - F.col("w.before"), F.col("w.size")), " ")
    return rows.select("doc_id", unit.alias("unit"), "w.license", "w.dice")
