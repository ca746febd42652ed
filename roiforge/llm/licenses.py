"""Licence scans by a trained paragraph classifier, with DataFrame functions alone.

Paragraphs (lines, and runs of lines that a notice is wrapped over) are split into words and word 1-3-grams. A sparse multinomial logistic regression, fitted here on variants of
templates (whole, and cut as lines cut them) and on paragraphs that are no licences, scores the licence families, the class "unknown" (texts of other licences, and clauses that several
families share) and the class "none"; its scores are calibrated on notices and sentences in other words than the templates', and a paragraph whose best family is not likely enough is "unknown" too.
A prediction is confirmed where the paragraph holds most of the word pairs of one of the family's templates, so words in another order don't confirm.
The weights are a bounded literal, so that scoring is one narrow pass. Most weights are exactly 0 (an L1 penalty), so the words follow from
the model without which a paragraph is certain to be "none": anchors(). Only paragraphs with one of them need scoring.
"""

from __future__ import annotations

import functools
import random
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
# fixed values: phrases by which licence families are declared
TEMPLATES = {
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only", "You should have received a copy of the GNU Affero General Public License along with this program", "GNU Affero General Public License version 3"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "distributed under the Apache License 2.0", "You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0", "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "See the License for the specific language governing permissions and limitations under the License"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License", "released under the BSD license", "SPDX-License-Identifier: BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "This software is provided by the copyright holders and contributors AS IS and any express or implied warranties are disclaimed"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights", "released under CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GNU General Public License, version 2", "You should have received a copy of the GNU General Public License along with this program", "it under the terms of the GNU General Public License as published by"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License", "SPDX-License-Identifier: ISC", "provided that the above copyright notice and this permission notice appear in all copies", "The software is provided AS IS and the author disclaims all warranties with regard to this software"),
    "LGPL": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "GNU Lesser General Public License, version 3", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "Licensed under the MIT license", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The software is provided AS IS, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability", "arising from, out of or in connection with the software or the use or other dealings in the software"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "Proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited", "This software is proprietary and confidential", "All rights reserved"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
}
# fixed values: phrases of other licences, and clauses that several families share
OTHER_LICENCES = (
    "This software is provided as-is, without any express or implied warranty", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it", "The origin of this software must not be misrepresented", "Altered source versions must be plainly marked as such",
    "This notice may not be removed or altered from any source distribution", "Boost Software License, Version 1.0", "Distributed under the Boost Software License", "Do What The Fuck You Want To Public License", "Everyone is permitted to copy and distribute verbatim copies of this license document",
    "Licensed under the Artistic License 2.0", "Common Development and Distribution License", "SIL Open Font License, Version 1.1", "Microsoft Public License", "The PostgreSQL License", "Python Software Foundation License", "European Union Public Licence", "Academic Free License", "Open Database License", "The Beerware License", "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: WTFPL", "Licensed under the terms of our own license", "Use of this program is subject to the license agreement", "See the LICENSE file for the license terms", "This file is covered by the license of the project", "you can redistribute it and/or modify it",
    "This program is free software: you can redistribute it and/or modify", "the Free Software Foundation, either version 3 of the License, or", "either version 2 of the License, or (at your option) any later version", "This program is distributed in the hope that it will be useful, but without any warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose", "In no event will the authors be held liable for any damages arising from the use of this software", "with or without fee, provided that the notices are kept", "You should have received a copy of the license along with this program",
)
OTHERS = (
    "They reserved a room with all the rights of a guest", "the rights of all citizens were reserved to them", "He kept all rights and she reserved a table", "Nobody has the right to all of it", "The damages to the house were held to be small", "It was provided in the contract that no claim is made", "the authors of the letter had their reasons", "They had the hope that it will be useful to others",
    "the conditions of the road were bad", "in no event will she come", "a licence to fish in the lake", "The notice on the door was removed", "the foundation of the house", "The following list of books is in the library", "the names of the authors are in the book", "the limits of the use of force", "She sold and published many copies of her book", "the liability of the company is limited by law",
    "The warranty had run out and nothing was provided", "They were liable for the damages to the field", "the distribution of seed and the modification of the house", "She was granted leave for a week", "We modify the plan of the house", "a list of the members is provided", "The holders of the land had no claim", "the author wrote a copy by hand", "no permission is needed in the forest",
    "You need a licence to drive a car in this country", "She lost her driving license on the way", "Copyright law protects the authors of books", "The permission of the owner is required to enter", "We had no permission to leave",
    "The warranty covers two years of use", "free of charge for children under six", "the public house on the corner", "general terms of trade", "the software was slow and the users complained", "a version of the story with another end", "published by a small press in the city",
)
# fixed values: notices and other sentences in words of their own, which calibrate
JUDGED = (
    ("Apache-2.0", "Licensed to you under the Apache License, Version 2.0 (the License)"), ("Apache-2.0", "This project uses the Apache License 2.0, see the file LICENSE"), ("MIT", "The code is available under the MIT license"), ("MIT", "Permission is hereby granted free of charge to any person who obtains a copy of this software and its documentation"),
    ("BSD", "Use of this source code is governed by a BSD license"), ("BSD", "redistribution and use in source and binary forms with or without modification are allowed"), ("GPL", "you can redistribute it under the terms of the GNU General Public License, version 3"), ("GPL", "Published under the GNU General Public License"),
    ("LGPL", "The library is covered by the GNU Lesser General Public License"), ("AGPL", "The server is covered by the GNU Affero General Public License"), ("MPL-2.0", "Subject to the Mozilla Public License, v. 2.0"), ("EPL-2.0", "Made available under the Eclipse Public License 2.0"),
    ("CC-BY", "Text under the Creative Commons Attribution 4.0 International License"), ("CC-BY-SA", "Content is licensed under CC BY-SA 4.0 unless stated"), ("CC-BY-NC", "Photos are licensed under CC BY-NC 4.0"), ("CC0", "The author has waived all copyright and related rights to the extent possible under law"),
    ("Unlicense", "free and unencumbered software in the public domain"), ("ISC", "Permission to use, copy, modify and distribute this software for any purpose is hereby granted"), ("Proprietary", "Copyright 2020. All rights reserved."), ("Proprietary", "This document is proprietary and confidential"),
    ("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"), ("BSD", "Redistributions of source code must retain this list of conditions"), ("GPL", "See the GNU General Public License for more details."), ("LGPL", "See the GNU Lesser General Public License for more details"), ("Apache-2.0", "limitations under the License. See the License for the specific language"),
    (UNKNOWN, "Licensed under the zlib license"), (UNKNOWN, "either version 3 of the License, or any later version"), (UNKNOWN, "This library is covered by the Artistic License"), (UNKNOWN, "the license of this file is the Open Font License"), (UNKNOWN, "but without any warranty; without even the implied warranty"), (UNKNOWN, "Permission is granted to anyone to use this library"),
    (NONE, "The rights to the house were reserved by all the sons"), (NONE, "The warranty of the car was not provided"), (NONE, "Nobody was held liable for the damages to the road"), (NONE, "the notice of the owner shall be included in the list"), (NONE, "The driver showed a licence that had expired"), (NONE, "All the people in the public square had rights"), (NONE, "The source of the river is in the mountains and it is free for all"), (NONE, "She has the general idea of the work and the use of it"), (NONE, "In the version of 1999 the second clause was removed by the court"),
    (NONE, "He asked for permission to use the car of the company"), (NONE, "the software was released in May by a small company"), (NONE, "A copy of the book is in the library, as it is by a well known author"), (NONE, "this is the file with the details"), (NONE, "Under the terms of the contract the goods are sent by ship"),
    (NONE, "the distribution of the food was fair and without modification of the plan"), (NONE, "International law and the public domain of the sea"), (NONE, "Er kam mit dem Zug und mit viel Zeit"), (NONE, "Elle a vu sa copie et sa source"),
)
# fixed values: words that licences share with everything else, in any language; n-grams of such words alone don't count
COMMON = (
    "a", "all", "and", "any", "are", "as", "at", "available", "be", "by", "can", "code", "copy", "distribute", "distributed", "domain", "extent", "file", "for", "form", "forms", "free", "from", "general", "had", "has", "have", "identifier", "in", "international", "into", "is", "it", "its", "later", "made", "materials",
    "may", "mit", "not", "of", "on", "only", "or", "person", "program", "public", "published", "purpose", "related", "released", "sa", "software", "source", "strictly", "subject", "terms", "that", "the", "this", "to", "under", "universal", "use", "version", "was", "with", "without", "work", "you", "above", "altered", "anyone", "but", "either", "except", "european", "following", "including", "kept", "kind", "language", "law", "must", "names", "open", "origin", "other", "our", "out", "own", "particular", "python", "received", "shall", "union", "what", "will", "your", "see", "such", "used", "should", "along", "v", "want", "held", "removed", "project", "authors", "option", "www", "0", "1", "2", "3", "4",
)
FILLER_WORDS = ("this", "work", "the", "and", "project", "file", "code", "text", "dataset", "here", "see", "notice", "our", "all", "for", "details", "is", "version")
#: N-grams kept in the model, and the share of a template's word pairs that confirms.
VOCABULARY, CONFIRMED = 1000, 0.8


class Model(NamedTuple):
    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    scale: float
    threshold: float


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


#: Phrases of the classes that a paragraph is compared with.
PHRASES = {**TEMPLATES, UNKNOWN: OTHER_LICENCES}
#: Words of the longest template: one that begins in a line ends within so many words after it.
SPAN = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)


def pairs_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def ngrams_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


def _variants(rng: random.Random, n: int) -> list[tuple[list[str], str]]:
    out = []
    for _ in range(n):
        family = rng.choice([*PHRASES, *[UNKNOWN] * 4, *[NONE] * 8])
        noise = lambda: [rng.choice(FILLER_WORDS) for _ in range(rng.randint(0, 4))]
        if family == NONE and rng.random() < 0.6:
            out.append(([rng.choice(COMMON) for _ in range(rng.randint(3, 25))], NONE))
            continue
        base = words_of(rng.choice(PHRASES.get(family, OTHERS)))
        if len(base) > 8 and rng.random() < 0.35:  # as a line's end cuts it
            at = rng.randint(0, len(base) - 6)
            base = base[at : at + rng.randint(6, len(base))]
        words = [w for w in base if rng.random() > 0.08 or len(base) < 9]  # short ones keep what tells families apart
        out.append(([*noise(), *words, *noise()], family))
    return out


@functools.cache
def trained(seed: int = 11, penalty: float = 2e-4) -> Model:
    """Fitted on 5000 variants by proximal gradient descent (L1), with momentum; temperature and threshold from JUDGED."""
    data = _variants(random.Random(seed), 5000)
    classes = [*sorted(PHRASES), NONE]
    y = np.array([classes.index(f) for _, f in data])
    bags = [ngrams_of(w) for w, _ in data]
    counts: dict[str, int] = {}
    for b in bags:
        for g in b:
            counts[g] = counts.get(g, 0) + 1
    of_templates = {g for ts in PHRASES.values() for t in ts for g in ngrams_of(words_of(t)) if not set(g.split()) <= set(COMMON)}
    vocabulary = {g: k for k, g in enumerate(sorted(sorted(g for g in counts if g in of_templates), key=lambda g: -counts[g])[:VOCABULARY])}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)))
        for r, b in enumerate(rows):
            x[r, [vocabulary[g] for g in b if g in vocabulary]] = 1
        return x

    x, w, bias = matrix(bags), np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    truth, rate, before = np.eye(len(classes))[y], 1.0, w
    for k in range(400):
        ahead = w + k / (k + 3) * (w - before)
        z = x @ ahead + bias
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - truth) / len(x)
        before, w = w, ahead - rate * (x.T @ e)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        bias -= rate * e.sum(0)
    w, bias = np.round(w, 4), np.round(bias, 4)
    w -= w[:, -1:]  # against "none", which so has no weights
    bias -= bias[-1]
    kept = {g: k for g, k in vocabulary.items() if np.any(w[k])}
    z = matrix([ngrams_of(words_of(t)) for _, t in JUDGED]) @ w + bias
    actual = np.array([classes.index(f) for f, _ in JUDGED])

    def likelihood(scale: float) -> float:
        q = np.exp(scale * (z - z.max(1, keepdims=True)))
        return float(np.log((q / q.sum(1, keepdims=True))[np.arange(len(z)), actual] + 1e-12).mean())

    scale = max((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0), key=likelihood)
    p = np.exp(scale * (z - z.max(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best, likely = p.argmax(1), p.max(1)
    family = best < len(classes) - 1
    threshold = next((c for c in np.arange(0.5, 1.0, 0.01) if (best == actual)[family & (likely >= c)].mean() >= 0.98), 0.99)
    return Model(classes, {g: w[k].tolist() for g, k in kept.items()}, bias.tolist(), float(scale), float(round(threshold, 2)))


@functools.cache
def anchors() -> tuple[str, ...]:
    """Words of which a paragraph must hold one to be anything but "none", whatever else it holds.

    Words are added, those first that weigh most for the family closest to winning, until no family can outweigh "none" with all n-grams that
    are free of these words.
    """
    model = trained()
    grams = [(g.split(), np.maximum(np.array(x), 0)) for g, x in model.weights.items()]
    found: set[str] = set()
    while True:
        free = [(ws, x) for ws, x in grams if not found & set(ws)]
        most = np.array(model.bias) + sum((x for _, x in free), np.zeros(len(model.bias)))
        most[-1] = -np.inf
        if most.max() < 0:
            return tuple(sorted(found))
        f = int(most.argmax())
        weigh: dict[str, float] = {}
        for ws, x in free:
            for w in set(ws):
                weigh[w] = weigh.get(w, 0.0) + x[f]
        found.add(max(sorted(set(weigh) - set(COMMON)), key=lambda w: weigh[w]))


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _doubles(values: list[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def _anchored(column: str | Column) -> Column:
    """Whether a text holds an anchor as a word."""
    return F.lower(column).rlike("(?<![a-z0-9])(?:" + "|".join(anchors()) + ")(?![a-z0-9])")


def _holds(words: str | Column) -> Column:
    return F.arrays_overlap(words, F.expr(_strings(list(anchors()))))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generator keeps the optimizer from repeating the expression at every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _words(column: str | Column, limit: int = -1) -> Column:
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+", limit), lambda w: w != "")


def _pairs(words: str) -> Column:
    return F.when(F.size(words) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " ")))).otherwise(F.expr("cast(array() as array<string>)"))


def _similarity(pairs: str, family: str) -> Column:
    """The largest share of a phrase's word pairs, over the family's phrases."""
    share = lambda t: f"size(array_intersect({pairs}, {_strings(sorted(pairs_of(words_of(t))))})) / {float(len(pairs_of(words_of(t))))}D"
    return F.expr(f"CASE {family} " + " ".join(f"WHEN '{f}' THEN greatest({', '.join(map(share, ts))}, 0D)" for f, ts in PHRASES.items()) + " END")


def _scored(rows: DataFrame, words: str, to: str = "") -> DataFrame:
    """rows with best, likely, similar, family and confirmed (names after to) for their array of words; similar is null for no licence."""
    model = trained()
    vocabulary = sorted(model.weights)
    gram = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))
    bags = _once(rows, "grams", F.array_intersect(F.concat(gram(1), gram(2), gram(3)), F.expr(_strings(vocabulary))))
    weights = f"map_from_arrays({_strings(vocabulary)}, array({', '.join(_doubles(model.weights[g]) for g in vocabulary)}))"
    sums = F.expr(f"transform(aggregate(grams, {_doubles(model.bias)}, (acc, g) -> zip_with(acc, element_at({weights}, g), (a, b) -> a + b)), z -> z * {model.scale!r}D)")
    scored = _once(_once(bags, "z", sums).drop("grams"), "top", F.array_max("z"))
    scored = _once(scored, f"{to}best", F.expr(f"element_at({_strings(model.classes)}, cast(array_position(z, top) as int))"))
    likely = _once(scored, f"{to}likely", 1.0 / F.aggregate(F.transform("z", lambda z: F.exp(z - F.col("top"))), F.lit(0.0), lambda a, b: a + b)).drop("z", "top")
    found = _once(_once(likely, "pairs", _pairs(words)), f"{to}similar", _similarity("pairs", f"{to}best")).drop("pairs").withColumn(f"{to}family", F.when(F.col(f"{to}likely") >= model.threshold, F.col(f"{to}best")).otherwise("unknown"))
    return found.withColumn(f"{to}confirmed", F.coalesce((F.col(f"{to}similar") >= CONFIRMED) & (F.col(f"{to}family") != "unknown"), F.lit(False)))


def _wrapped(docs: DataFrame) -> DataFrame:
    """Confirmed runs of two lines or more, scored, with the number of their first line; see scan()."""
    lines = _once(docs.where(_anchored("text")).select("doc_id", "text"), "lines", F.split("text", "\n")).drop("text")
    near = _once(lines, "near", F.transform("lines", _anchored))
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.exists(F.slice("near", i + 1, SPAN + 1), lambda x: x))
    runs = near.select("doc_id", F.explode(F.transform(begins, lambda i: F.struct(i.alias("paragraph"), F.get("lines", i).alias("line"), F.slice("lines", i + 2, SPAN).alias("after")))).alias("run")).select("doc_id", "run.*")
    runs = _once(_once(runs, "first", _words("line")), "heads", F.transform("after", lambda x: F.slice(_words(x, SPAN + 2), 1, SPAN))).where(F.size("first") > 0)
    blank = F.array_position(F.transform("heads", F.size), 0)
    runs = _once(runs, "n", F.when(blank > 0, blank.cast("int") - 1).otherwise(F.size("heads"))).where("n > 0")
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda q: F.size(F.flatten(F.slice("heads", 1, q - 1))) <= SPAN - 2)
    runs = runs.select("doc_id", "paragraph", "line", F.get("after", F.lit(0)).alias("next"), "first", "heads", F.explode(ends).alias("q"))
    runs = _once(_once(runs, "middle", F.flatten(F.slice("heads", F.lit(1), F.col("q") - 1))), "tail", F.slice("first", F.greatest(F.size("first") - SPAN + 1, F.lit(1)), SPAN))
    runs = _once(runs, "whole", F.concat("tail", "middle", F.get("heads", F.col("q") - 1))).where(_holds("whole"))
    runs = _scored(runs, "whole").where("confirmed")
    pair = F.col("q") == 1
    for name, alone, rest in (("upper", "line", F.concat("tail", "middle")), ("lower", "next", F.concat("middle", F.get("heads", F.col("q") - 1)))):
        runs = _once(_once(runs, "part", rest), "parts", _pairs("part")).where(_similarity("parts", "best") < F.col("similar")).drop("part", "parts")
        runs = _once(runs, name, F.when(pair, _words(alone)).otherwise(rest))
        runs = _scored(runs, name, f"{name}_").where(~(_holds(name) & F.col(f"{name}_confirmed") & (F.col(f"{name}_family") == F.col("family"))))
    return runs


def scan(docs: DataFrame) -> DataFrame:
    """Licence paragraphs: doc_id, paragraph (number from 0 of its first line), family, probability, similarity, confirmed.

    All lines of every whole text are scored, those without an anchor being certain to be no licence; lines that are most likely no
    licence are left out, those of other licences, of clauses that families share, or without a likely enough family are "unknown" (never confirmed). Besides, every run of lines that a template can be wrapped over is scored, as its
    words: the first line's last SPAN, the last line's first SPAN, and all of the lines between; a line without words ends a run. A
    run counts where it holds an anchor and is confirmed, but not, for the same family, without its first or without its last
    line, and both of these raise its similarity; so a line can begin several paragraphs, and a notice can have overlapping ones. Where two notices meet in one line the
    likelier one can hide the other, as in a line alone. similarity is the largest share of a template's distinct pairs of adjacent words in
    the paragraph, over the family's templates; confirmed means CONFIRMED of them at least. Null and empty texts have no
    paragraphs; repeated rows give repeated results; other columns are ignored.
    """
    lines = docs.select("doc_id", "text").where(_anchored("text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where(_anchored("line"))
    alone = _scored(_once(lines, "words", _words("line")).drop("line"), "words").where(F.col("best") != NONE)
    shown = ("doc_id", "paragraph", "family", F.round("likely", 6).alias("probability"), F.round("similar", 6).alias("similarity"), "confirmed")
    return alone.select(*shown).union(_wrapped(docs).select(*shown))


def _similar_by_hand(words: list[str], family: str) -> float:
    return max((len(pairs_of(words) & pairs_of(words_of(t))) / len(pairs_of(words_of(t))) for t in PHRASES.get(family, ())), default=0.0)


def _scored_by_hand(words: list[str]) -> tuple[str, str, float, float, bool]:
    """best, family, likely, similar, confirmed"""
    model = trained()
    z = np.array(model.bias)
    for g in sorted(ngrams_of(words)):
        z = z + np.array(model.weights.get(g, [0.0] * len(z)))
    z = z * model.scale
    best, likely = model.classes[int(z.argmax())], 1 / np.exp(z - z.max()).sum()
    similar = _similar_by_hand(words, best)
    family = best if likely >= model.threshold else "unknown"
    return best, family, float(likely), similar, similar >= CONFIRMED and family != "unknown"


def scan_by_hand(texts: list[tuple[int, str | None]]) -> list[tuple]:
    """What scan() gives, computed row by row in Python: for tests."""
    out = []

    def joined(lines: list[str]) -> list[list[str]]:
        words = [words_of(x) for x in lines]
        return [words[0][-SPAN:], [w for x in words[1:-1] for w in x], words[-1][:SPAN]]

    def sure(lines: list[str]) -> tuple | None:
        words = words_of(lines[0]) if len(lines) == 1 else sum(joined(lines), [])
        found = _scored_by_hand(words)
        return found if found and found[4] else None

    for doc_id, text in texts:
        lines = (text or "").split("\n")
        for at, line in enumerate(lines):
            best, family, likely, similar, confirmed = _scored_by_hand(words_of(line))
            if best != NONE:
                out.append((doc_id, at, family, round(likely, 6), round(similar, 6), confirmed))
            for to in range(at + 1, len(lines)):
                if not (words_of(line) and words_of(lines[to])) or sum(len(words_of(x)) for x in lines[at + 1 : to]) > SPAN - 2:
                    break
                run, (tail, middle, head) = sure(lines[at : to + 1]), joined(lines[at : to + 1])
                if not run or max(_similar_by_hand(tail + middle, run[0]), _similar_by_hand(middle + head, run[0])) >= run[3]:
                    continue
                if not any(part and part[1] == run[1] for part in (sure(lines[at + 1 : to + 1]), sure(lines[at:to]))):
                    out.append((doc_id, at, run[1], round(run[2], 6), round(run[3], 6), True))
    return out
