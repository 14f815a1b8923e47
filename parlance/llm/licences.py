"""Licence scans: a trained classifier of paragraphs by sparse word n-grams, confirmed against templates.

A paragraph ends at a blank line; comment marks and other words of punctuation only count for nothing, and a notice may be
wrapped anyhow. Of a long paragraph overlapping windows are looked at, so a notice is found amid prose."""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append
from .words import U, Words, bare, scan, shingles, slices

#: Customary notices and key sentences of public licences, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is released under the Apache License 2.0.",
        "This project is licensed under the terms of the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "License: Apache-2.0",
        "License: Apache License, Version 2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "License: MIT",
        "This project is MIT licensed.",
        "MIT licensed.",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "This software is released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "License: BSD-3-Clause",
        "License: BSD",
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "License: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.',
    ],
    "gpl-2.0": [
        "This program is licensed under the GNU General Public License, version 2.",
        "Released under the terms of the GNU GPL version 2 only.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This software is licensed under the terms of the GNU General Public License version 2, as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "GNU General Public License Version 2, June 1991",
        "Distributed under GPLv2.",
        "License: GPL-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the terms of the GNU GPL version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License Version 3, 29 June 2007",
        "Distributed under GPLv3.",
        "License: GPL-3.0",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "GNU Lesser General Public License Version 2.1, February 1999",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU Affero General Public License Version 3, 19 November 2007",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License, Version 2.0.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright the company. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential.",
        "This software contains confidential and proprietary information and may not be disclosed without prior written consent.",
    ],
}
#: Sentences near the subject that name no licence, or none of these families.
OTHERS = [
    "The driver showed a license at the counter and paid the fee.",
    "A version of the work was released to the public in general.",
    "All of the rights were reserved for the members.",
    "You may use the file and the source of the data under these conditions.",
    "The general terms of the public agreement are subject to the law.",
    "They redistribute the software to any person free of charge.",
    "The version 3 of the program was published by the foundation.",
    "The public domain of the common good is free to all who come.",
    "Licensed under the Mozilla Public License, version 1.1.",
    "This program is licensed under the GNU General Public License, version 1.",
    "This library is licensed under the GNU Library General Public License, version 2.",
    "Licensed under the Eclipse Public License, Version 1.0.",
    "Licensed under the Apache License, Version 1.1.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Distributed under the Artistic License 2.0.",
    "Licensed under the zlib license.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: MPL-1.1",
    "SPDX-License-Identifier: EPL-1.0",
    "SPDX-License-Identifier: Artistic-2.0",
]
#: Words that name a licence, and words that tell its variants; a template confirms only where its own are.
NAMES = "apache mit bsd isc gnu gpl gplv2 gplv3 lgpl agpl mozilla mpl eclipse epl boost bsl unlicense creative commons cc cc0 proprietary".split()
VARIANTS = "general lesser affero sharealike noncommercial noderivatives sa nc nd".split()
#: Sentences that stand beside notices of several licences.
BESIDE = [
    "Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Terms and conditions for use, reproduction, and distribution",
    "Copyright (c) the authors.",
    "See the LICENSE file for details.",
]
UNKNOWN = "unknown"
#: Documents and units of theirs, chosen by hash, that the unknown class is learned from.
SAMPLE_DOCS, SAMPLE_UNITS = 300, 2500
GRAMS = (1, 2, 3)
#: Words of a window, and from one window of a paragraph to the next.
WIDTH, STEP = 48, 24
#: Least probability of a family, least share of a template that is there, and share of what is there of a template that
#: another one must have to explain it.
SURE, ALIKE, EXPLAINED = 0.5, 0.6, 0.8


class Units(NamedTuple):
    """Windows of the paragraphs of texts, over the texts' words."""

    words: Words  # the words that are more than punctuation, with hashes of what is left
    first: np.ndarray  # of each unit, its first word
    last: np.ndarray  # one past its last word
    paragraph: np.ndarray  # the number of its paragraph in the text
    of: np.ndarray  # n+1 unit offsets of the texts


def units(data: np.ndarray, off: np.ndarray) -> Units:
    """A paragraph is what stands between lines without words; hyphens part words. It is one unit if it has WIDTH words or
    fewer; else units of WIDTH words begin at every STEP-th word, up to the one that reaches its end."""
    w = scan(np.where(data == ord("-"), np.uint8(32), data), off)
    h = bare(w)
    some = h != 0
    of = np.concatenate([[0], np.cumsum(some)])[w.of]
    w = w._replace(start=w.start[some], end=w.end[some], hash=h[some], of=of)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Units(w, none, none, none, np.zeros(len(off), np.int64))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.zeros(n, bool)
    stop[:-1] = lines[w.start[1:]] - lines[w.end[:-1]] >= 2
    stop[w.of[1:][np.diff(w.of) > 0] - 1] = True
    last = np.flatnonzero(stop) + 1
    first = np.concatenate([[0], last[:-1]])
    text = np.searchsorted(w.of, first, side="right") - 1
    head = np.searchsorted(text, np.arange(len(off)))  # the first paragraph of each text
    many = 1 + np.maximum(0, -(-(last - first - WIDTH) // STEP))
    par = np.repeat(np.arange(len(first)), many)
    at = first[par] + STEP * (np.arange(len(par)) - np.repeat(np.cumsum(many) - many, many))
    return Units(w, at, np.minimum(at + WIDTH, last[par]), par - head[text[par]], np.searchsorted(text[par], np.arange(len(off))))


def grams(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the units, and the unit of each; the last two bits tell n."""
    hashes, rows = [], []
    for n in GRAMS:
        many = np.maximum(0, u.last - u.first - n + 1)
        every, off = shingles(u.words, n)
        # shingles are numbered by text; a text of fewer than n words has one all the same, which no unit asks for
        text = np.searchsorted(u.of, np.arange(len(u.first)), side="right") - 1
        start = off[text] + u.first - u.words.of[text]
        ends = np.cumsum(many)
        at = np.repeat(start - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
        hashes.append((every[at] & ~U(3)) | U(n))
        rows.append(np.repeat(np.arange(len(u.first)), many))
    return np.concatenate(hashes), np.concatenate(rows)


def features(texts: list[str]) -> list[np.ndarray]:
    """The distinct n-grams of each text, taken as one paragraph."""
    out: list[np.ndarray] = []
    for _, data, off in slices(pa.array([" ".join(t.split()) for t in texts], pa.string())):
        u = units(data, off)
        h, rows = grams(u)
        order = np.lexsort([h, np.searchsorted(u.of, rows, side="right") - 1])
        cut = np.searchsorted((np.searchsorted(u.of, rows, side="right") - 1)[order], np.arange(len(off)))
        out += [np.unique(h[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Templates(NamedTuple):
    pairs: np.ndarray  # sorted hashes of all word pairs that some template has
    has: np.ndarray  # which of them each template has, a column a template
    family: np.ndarray  # of each template
    keys: list[np.ndarray]  # n-grams of each template without which it is not there, see `keys`
    grams: list[np.ndarray]  # all n-grams of each template

    def among(self, own: np.ndarray) -> np.ndarray:
        """Which of the pairs are among n-grams."""
        at = np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)
        there = np.zeros(len(self.pairs), bool)
        there[at[self.pairs[at] == own]] = True
        return there


class Model(NamedTuple):
    known: np.ndarray  # sorted n-gram hashes
    families: list[str]  # UNKNOWN is the last
    weights: np.ndarray  # of known n-grams by family
    bias: np.ndarray
    heat: float
    templates: Templates

    def probabilities(self, at: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of units with the known n-grams `at` (each once a unit), one unit after the other, between offsets."""
        return sigmoid(self.heat * (add(self.weights[at], off) + self.bias))


def add(rows: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros((len(off) - 1, rows.shape[1]), rows.dtype)
    some = np.diff(off) > 0
    if some.any():
        out[some] = np.add.reduceat(rows, off[:-1][some], axis=0)
    return out


def pairs(distinct: np.ndarray) -> np.ndarray:
    """The word pairs among n-grams, which templates are compared by; of a single word, that word."""
    two = distinct[(distinct & U(3)) == U(2)]
    return two if len(two) else distinct


def keys(template: str) -> list[str]:
    """What must be there word for word if a template is to be: its words that name a licence, and each version number and
    variant together with the word before it. So `version 1.1` is not `version 2.0`, nor `BY-ND 4.0` `BY 4.0`."""
    words = [w.strip(string.punctuation).lower() for w in template.replace("-", " ").split()]
    words = [w for w in words if w]
    number = lambda w: any(c.isdigit() for c in w) and w not in NAMES
    return [w for w in words if w in NAMES] + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if b in VARIANTS or number(b)]


def templates() -> Templates:
    whole = [(k, f) for k, own in enumerate(TEMPLATES.values()) for f in features(own)]
    each = [(k, pairs(f)) for k, f in whole]
    every = np.unique(np.concatenate([t for _, t in each]))
    musts = [keys(t) for own in TEMPLATES.values() for t in own]
    # an n-gram alone is a text whose longest n-gram is itself
    hashed = [np.array([max(f.tolist(), key=lambda g: g & 3) for f in features(m)], U) for m in musts]
    return Templates(every, np.column_stack([np.isin(every, t) for _, t in each]), np.array([k for k, _ in each]), hashed, [f for _, f in whole])


Share = tuple[float, np.ndarray, np.ndarray, int]


def shares(own: np.ndarray, known: Templates) -> dict[int, Share]:
    """Of each family with one: the largest share of a template whose keys are all among the n-grams of a unit that is among
    its pairs, those pairs, all of the template's, and its number."""
    there = known.among(own)
    share = known.has[there].sum(0) / known.has.sum(0)
    best: dict[int, Share] = {}
    for t in np.flatnonzero(share > 0).tolist():
        if not np.isin(known.keys[t], own).all():
            continue
        k = int(known.family[t])
        if share[t] > best.get(k, (0.0,))[0]:
            best[k] = float(share[t]), there & known.has[:, t], known.has[:, t], t
    return best


def confirmed(family: int, best: dict[int, Share], known: Templates) -> tuple[bool, float]:
    """Whether a family's best share in a paragraph confirms it, and that share: ALIKE or more, unless a template of
    another family that is there to a larger share explains it: it has EXPLAINED of what is there, and the keys too."""
    if family not in best:
        return False, 0.0
    share, there, _, own = best[family]
    explained = any(j != family and s > share and (there & t).sum() >= EXPLAINED * there.sum() and np.isin(known.keys[own], known.grams[u]).all() for j, (s, _, t, u) in best.items())
    return share >= ALIKE and not explained, share


def examples(rng: np.random.Generator, prose: list[list[str]]) -> tuple[list[str], list[tuple[int, ...]]]:
    """Units to learn from and their families: templates whole, in part, with words lost and with prose around; two
    notices together; prose; near misses."""
    texts: list[str] = []
    kinds: list[tuple[int, ...]] = []
    beside = [t.split() for t in BESIDE]

    def around(n: int) -> str:
        if n <= 0 or not prose:
            return ""
        some = beside if rng.random() < 0.2 else prose
        return " ".join(some[rng.integers(len(some))][: int(rng.integers(0, n))])

    def put(words: list[str], own: tuple[int, ...]) -> None:
        left = WIDTH - len(words)
        before = around(left) if rng.random() < 0.5 else ""
        after = around(left - len(before.split())) if rng.random() < 0.5 else ""
        texts.append(" ".join([before, *words, after]))
        kinds.append(own)

    every = [(k, t.split()) for k, own in enumerate(TEMPLATES.values()) for t in own]
    for k, words in every:
        for _ in range(16):
            some = [x for x in words if rng.random() > 0.08]
            if len(words) > 14 and rng.random() < 0.5:
                a = int(rng.integers(0, len(words) // 3))
                some = words[a : a + int(rng.integers(10, len(words)))]
            put(some, (k,))
        put(words, (k,))
    short = [(k, words) for k, words in every if len(words) <= 14]
    for _ in range(400):
        (j, one), (k, two) = short[rng.integers(len(short))], short[rng.integers(len(short))]
        if j != k:
            put([*one, ("or", "and", "")[rng.integers(3)], *two[int(rng.integers(0, 3)) :]], (j, k))
    named = [(k, t.split()[-1]) for k, own in enumerate(TEMPLATES.values()) for t in own if t.startswith("SPDX")]
    for _ in range(1200):  # expressions of identifiers
        (j, one), (k, two) = named[rng.integers(len(named))], named[rng.integers(len(named))]
        if j != k:
            both = f"{one} {('OR', 'AND', 'or', '/')[rng.integers(4)]} {two}"
            put(f"{('SPDX-License-Identifier:', 'License:')[rng.integers(2)]} {f'({both})' if rng.random() < 0.5 else both}".split(), (j, k))
    for line in prose:
        texts.append(" ".join(line))
        kinds.append(())
    vocabulary = [x for _, words in every for x in words]
    for t in OTHERS * 20:
        put(rng.permutation(t.split()).tolist() if rng.random() < 0.3 else t.split(), ())
    for _ in range(400):  # words of notices, out of order
        put(rng.choice(vocabulary, int(rng.integers(2, 12))).tolist(), ())
    return texts, kinds


def some_units(docs: DataFrame, text: str, seed: int) -> list[str]:
    """Units of about SAMPLE_DOCS documents, SAMPLE_UNITS at most; both chosen by hash, so reruns agree."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    some = docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1_000_000)) < max(1, int(share * 1_000_000))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in slices(batch.column(0)):
                u = units(data, off)
                at = zip(u.words.start[u.first].tolist(), u.words.end[u.last - 1].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in at], pa.string())], names=["unit"])

    rows = some.select(text).mapInArrow(run, "unit string").distinct().orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE_UNITS)
    return [r["unit"] for r in rows.collect()]


def train(docs: DataFrame, text: str = "text", seed: int = 2) -> Model:
    """A classifier learned from the templates and, for the unknown class, from units of sampled documents that are not
    like a template. It has a logistic score for each family and for `unknown`; a fifth of the examples sets the heat of
    the probabilities."""
    rng = np.random.default_rng(seed)
    compare = templates()
    sampled = some_units(docs, text, seed)
    like = lambda f: (compare.has[compare.among(f)].sum(0) / compare.has.sum(0)).max()
    prose = [t.split() for t, f in zip(sampled, features(sampled), strict=True) if like(f) < 0.3]
    texts, kinds = examples(rng, prose)
    known = np.unique(np.concatenate(features([t for own in TEMPLATES.values() for t in own] + OTHERS + BESIDE)))
    sets = []
    for f in features(texts):
        at = np.minimum(np.searchsorted(known, f), len(known) - 1)
        sets.append(at[known[at] == f])
    y = np.zeros((len(sets), len(TEMPLATES) + 1), np.float32)
    for i, own in enumerate(kinds):
        y[i, list(own) or [len(TEMPLATES)]] = 1
    order = rng.permutation(len(sets))
    back, use = order[: len(order) // 5], order[len(order) // 5 :]
    flat = lambda rows: (np.concatenate([sets[i] for i in rows]).astype(np.int64), np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])]))
    p = np.zeros((len(known) + 1, y.shape[1]), np.float32)  # the constant is last
    m, v, t = np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(25):
        use = rng.permutation(use)
        for i in range(0, len(use), 256):
            rows = use[i : i + 256]
            at, off = flat(rows)
            e = (sigmoid(add(p[at], off) + p[-1]) - y[rows]) / len(rows)
            g = 1e-5 * p
            by = np.argsort(at, kind="stable")
            there, first = np.unique(at[by], return_index=True)
            g[there] += np.add.reduceat(np.repeat(e, np.diff(off), axis=0)[by], first, axis=0)
            g[-1] = e.sum(0)
            t += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    at, off = flat(back)
    logits = add(p[at], off) + p[-1]
    lost = lambda h: np.logaddexp(0, np.where(y[back] > 0, -h * logits, h * logits)).mean()
    heat = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lost)
    return Model(known, [*TEMPLATES, UNKNOWN], p[:-1], p[-1], heat, compare)


PARAGRAPH = T.StructType(
    [T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType())]
    + [T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())]
)
FIELDS = [T.StructField("families", T.ArrayType(T.StringType())), T.StructField("found", T.ArrayType(PARAGRAPH))]


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with families, the confirmed licence families of a text by name, and found, what was predicted in which of its
    paragraphs (numbered from 0), by paragraph and family.

    A family is predicted of a paragraph if one of its windows has that family with a probability of SURE or more and
    `unknown` with less; several families may be, and each is confirmed or not by its templates (`confirmed`). Of several
    windows the largest probability and the largest share of a template count. Whole texts of any
    length are looked at. Null and empty texts have empty lists; repeated rows are treated alike; columns of those names
    are replaced. No rows give no rows."""

    def make(column: pa.Array) -> list[pa.Array]:
        maybe = np.zeros(1 << 22, bool)
        maybe[(model.known >> U(42)).astype(np.int64)] = True
        found: list[list[dict]] = [[] for _ in range(len(column))]
        for first, data, off in slices(column):
            u = units(data, off)
            h, rows = grams(u)
            hit = np.flatnonzero(maybe[(h >> U(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(model.known, h[hit]), len(model.known) - 1)
            same = model.known[at] == h[hit]
            one = np.unique(rows[hit[same]] * len(model.known) + at[same])  # an n-gram counts once a unit
            p = model.probabilities(one % len(model.known), np.searchsorted(one // len(model.known), np.arange(len(u.first) + 1)))
            likely = (p[:, :-1] >= SURE) & (p[:, -1:] < SURE)
            some = np.flatnonzero(likely.any(1))
            wanted = np.zeros(len(u.first), bool)
            wanted[some] = True
            two = wanted[rows] & ((h & U(3)) <= U(2))
            h, rows = h[two], rows[two]
            order = np.argsort(rows, kind="stable")
            start = np.searchsorted(rows[order], np.arange(len(u.first) + 1))
            best: dict[tuple[int, int], dict] = {}  # of each paragraph, its families' best shares
            chances: dict[tuple[int, int, int], float] = {}
            for k in some.tolist():
                place = int(np.searchsorted(u.of, k, side="right")) - 1, int(u.paragraph[k])
                mine = best.setdefault(place, {})
                for family, share in shares(h[order[start[k] : start[k + 1]]], model.templates).items():
                    mine[family] = max(mine.get(family, share), share, key=lambda x: x[0])
                for family in np.flatnonzero(likely[k]).tolist():
                    chances[*place, family] = max(chances.get((*place, family), 0.0), float(p[k, family]))
            for (doc, paragraph, family), chance in sorted(chances.items(), key=lambda x: (x[0][0], x[0][1], model.families[x[0][2]])):
                fine, share = confirmed(family, best[doc, paragraph], model.templates)
                found[first + doc].append({"paragraph": paragraph, "family": model.families[family], "probability": chance, "similarity": share, "confirmed": fine})
        kind = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])
        families = [sorted({f["family"] for f in own if f["confirmed"]}) for own in found]
        return [pa.array(families, pa.list_(pa.string())), pa.array(found, pa.list_(kind))]

    return append(docs, [text], FIELDS, make)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs)).select("doc_id", "families", "found")
