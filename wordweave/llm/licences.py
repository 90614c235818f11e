"""Licence notices: a trained paragraph classifier, confirmed by templates.

A sparse logistic regression over word n-grams knows one class per licence
family and one for everything else. It is trained on variants of the templates
below and on paragraphs of the corpus; its probabilities are calibrated by a
temperature on variants kept out of training. A predicted family is confirmed
if the paragraph holds enough of one of the family's templates.

Only n-grams with a word that tells of licences are features. A paragraph
without such a word has no feature and belongs to the unknown class.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.llm.common import WORDS, bounded, text_map

# Opening notices of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "bsl": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "Dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, Version 2.0 (EPL-2.0).",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
}
UNKNOWN = "unknown"
FAMILIES = sorted(TEMPLATES)

# The bare reservation, by family: a notice only where the caller says so.
RESERVED = {"proprietary": ("All rights reserved.",)}

# Words that tell nothing about licences.
PLAIN = frozenset(
    "a all and any are as at be by can form found found from if in is it kind may means no not of on "
    "one or other part part possible prior project style that the their this to use was with without "
    "work you your author code file person program source extent following above appear fee form forms "
    "0 1 2 3 4 http www org com v s t".split()
)

# Longest n-gram; words of a window when a line is longer, and its step.
GRAMS, SPAN, STEP = 3, 96, 48

# Comment marks that are words, where lines next to each other begin with one.
MARKS = frozenset(("rem", "dnl"))

# Background paragraphs: of at most so many documents, chosen by a hash of the id,
# so many lines each, chosen by a hash among all that are not longer than this.
BACKGROUND_ROWS, LINES_OF_EACH, LINE_LENGTH = 400, 4, 2_000

VARIANTS, ROUNDS, RATE, DECAY = 40, 250, 4.0, 1e-4
CONFIRMED, PROBABLE = 0.6, 0.5


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, A-Z lower-cased."""
    return text.encode().translate(WORDS).decode("utf-8", "replace").split()


def ngrams(words: list[str], longest: int = GRAMS) -> set[str]:
    return {
        " ".join(words[i : i + n])
        for n in range(1, longest + 1)
        for i in range(len(words) - n + 1)
    }


def tells(gram: str) -> bool:
    return any(w not in PLAIN for w in gram.split())


class Classifier:
    """The trained model: ``weights`` has a row per n-gram, one for the share
    of words outside all of them, and one for the bias. ``reserved`` adds the
    bare reservation to the templates."""

    def __init__(self, background: list[str], reserved: bool = False):
        self.reserved = reserved
        self.texts = {f: TEMPLATES[f] + (RESERVED.get(f, ()) if reserved else ()) for f in FAMILIES}
        grams = sorted({g for ts in self.texts.values() for t in ts for g in ngrams(words_of(t)) if tells(g)})
        self.index = {g: i for i, g in enumerate(grams)}
        self.telling = {g for g in grams if " " not in g}
        self.classes = [*FAMILIES, UNKNOWN]
        self.templates = [
            [{g for g in ngrams(words_of(t), 2) if " " in g} for t in self.texts[f]] for f in FAMILIES
        ]
        self.own, self.pairs = {}, {}
        for number, family in enumerate(self.templates):
            for place, template in enumerate(family):
                for pair in template:
                    self.own.setdefault(pair, set()).add(number)
                    self.pairs.setdefault(pair, []).append((number, place))
        self.own = {pair for pair, families in self.own.items() if len(families) == 1}
        self.weights = np.zeros((len(grams) + 2, len(self.classes)))
        self.temperature = 1.0
        self._train(background)

    def features(self, words: list[str]) -> tuple[list[int], float, float]:
        """Sparse features of one paragraph: its n-grams, the value of each,
        and the share of words outside all of them."""
        at = sorted({self.index[g] for g in ngrams(words) if g in self.index})
        others = sum(w not in self.telling and w not in PLAIN for w in words)
        return at, 1 / max(1.0, np.sqrt(len(at))), others / max(1, len(words))

    def row(self, words: list[str]) -> np.ndarray:
        """The same as a row of the training matrix."""
        out = np.zeros(len(self.weights))
        at, value, others = self.features(words)
        out[at], out[-2], out[-1] = value, others, 1
        return out

    def _samples(self, background: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Variants: words lost or added, notices cut short; and paragraphs of
        the corpus, telling words out of order, notices without their name."""
        draw = random.Random(5)
        usual = [w for t in background for w in words_of(t)] or ["text"]
        rows, labels = [], []
        for number, family in enumerate(FAMILIES):
            for text in self.texts[family]:
                words = words_of(text)
                for _ in range(VARIANTS):
                    kept = [w for w in words if draw.random() > 0.04] or words
                    around = [draw.choice(usual) for _ in range(draw.choice((0, 0, 2, 6, 12)))]
                    at = draw.randint(0, len(around))
                    rows.append(self.row([*around[:at], *kept, *around[at:]]))
                    labels.append(number)
        other = [words_of(t) for t in background]
        telling = sorted(self.telling)
        for _ in range(6 * VARIANTS):
            mixed = draw.sample(telling, draw.randint(1, 3)) + [draw.choice(usual) for _ in range(draw.randint(3, 30))]
            draw.shuffle(mixed)
            other.append(mixed)
        other += [
            words_of(t)
            for t in (
                "licensed under the terms of the license", "see the license file for details",
                "the license plate of the car", "free software for everyone", "all rights reserved",
                "permission to land was granted", "public domain", "version 3 was released",
            )
            if not (self.reserved and t == "all rights reserved")
            for _ in range(VARIANTS // 2)
        ]
        rows += [self.row(w) for w in other]
        labels += [len(FAMILIES)] * len(other)
        return np.array(rows), np.array(labels)

    def _train(self, background: list[str]) -> None:
        x, y = self._samples(background)
        held = np.arange(len(y)) % 5 == 0
        target = np.eye(len(self.classes))[y]
        share = target[~held].sum(axis=0)
        weight = (1 / share)[y[~held]]
        weight /= weight.sum()
        tx, ty = x[~held], target[~held]
        speed = np.zeros_like(self.weights)
        for _ in range(ROUNDS):
            error = (self._softmax(tx @ self.weights) - ty) * weight[:, None]
            speed = 0.9 * speed - RATE * (tx.T @ error + DECAY * self.weights)
            self.weights += speed
        raw = x[held] @ self.weights

        def loss(temperature: float) -> float:
            p = self._softmax(raw / temperature)
            return -np.log(p[np.arange(len(p)), y[held]] + 1e-12).mean()

        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)

    @staticmethod
    def _softmax(raw: np.ndarray) -> np.ndarray:
        e = np.exp(raw - raw.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def probabilities(self, words: list[str]) -> np.ndarray:
        at, value, others = self.features(words)
        raw = self.weights[at].sum(axis=0) * value + self.weights[-2] * others + self.weights[-1]
        return self._softmax(raw / self.temperature)

    def judge(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, share of its best template) or None."""
        if self.telling.isdisjoint(words):
            return None
        p = self.probabilities(words)
        best = int(p.argmax())
        if self.classes[best] == UNKNOWN or p[best] < PROBABLE:
            return None
        pairs = {g for g in ngrams(words, 2) if " " in g}
        alike = max(len(t & pairs) / len(t) for t in self.templates[best])
        return self.classes[best], float(p[best]), alike

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, int, int, float]]:
        """(pairs of words, family's number, begin, end, likeness) of the places
        that hold enough of a template, each as short as can be; one template's
        do not overlap. A pair that only this family has must be there."""
        hits: dict[tuple[int, int], list[tuple[int, str]]] = {}
        for at, pair in enumerate(map(" ".join, zip(words, words[1:]))):
            for key in self.pairs.get(pair, ()):
                hits.setdefault(key, []).append((at, pair))
        for (family, place), found in sorted(hits.items()):
            pairs = len(self.templates[family][place])
            need, reach = CONFIRMED * pairs, pairs + pairs // 2 + 8
            if len({p for _, p in found}) < need:
                continue
            best, first, last = None, 0, 0
            held: Counter[str] = Counter()
            while last < len(found) or best:
                if best and (last == len(found) or found[last][0] >= best[1] + reach):
                    yield best[0], family, *best[1:], best[0] / pairs
                    # On with what follows it.
                    first = last = bisect_left(found, (best[2] - 1,))
                    best = None
                    held.clear()
                    continue
                at, pair = found[last]
                last += 1
                held[pair] += 1
                while at - found[first][0] >= reach or held[found[first][1]] > 1:
                    held[found[first][1]] -= 1
                    if not held[found[first][1]]:
                        del held[found[first][1]]
                    first += 1
                if len(held) >= need and len(held) > (best or [0])[0] and not self.own.isdisjoint(held):
                    best = len(held), found[first][0], at + 2

    def block(self, lines: list[list[str]]) -> Iterator[tuple[int, int, str, float, float]]:
        """(first line, last line, family, probability, likeness) of all
        confirmed notices in a block of lines.

        A place is judged with the words around it; if it tells of another
        family, once more without the notices that were found in it."""
        words = [w for line in lines for w in line]
        if self.telling.isdisjoint(words):
            return
        of = [n for n, line in enumerate(lines) for _ in line]
        taken: dict[int, int] = {}  # bits of the families found at a word
        open_places = sorted(self.spans(words), reverse=True)
        for again in (False, True):
            others, left = dict(taken), []
            for place in open_places:
                _, family, begin, end, alike = place
                if any(taken.get(i, 0) >> family & 1 for i in range(begin, end)):
                    continue
                # As many words around it as the template has more.
                more = round((end - begin) * (1 / alike - 1)) + 1 if alike < 1 else 0
                judged = range(max(0, begin - more), min(len(words), end + more))
                if again:
                    judged = [i for i in judged if i not in others]
                    rest = [f"{words[i]} {words[j]}" for i, j in zip(judged, judged[1:]) if j == i + 1]
                    if not any(p in self.own and self.pairs[p][0][0] == family for p in rest):
                        continue
                p = self.probabilities([words[i] for i in judged])
                if p.argmax() == family and p[family] >= PROBABLE:
                    for i in range(begin, end):
                        taken[i] = taken.get(i, 0) | 1 << family
                    yield of[begin], of[end - 1], self.classes[family], float(p[family]), alike
                else:
                    left.append(place)
            open_places = left

    def scan(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, likeness) of every notice, one per line
        and family, by line: single lines, and blocks of lines up to one
        without words, which count at the notice's first line."""
        words = words_of(text)
        if self.telling.isdisjoint(words):
            return []
        lines = [words_of(line) for line in re.split(r"\r\n|\r|\n", text)]
        found = {(f[0], f[1]): f for f in self.lines(lines)}
        marks = [None, *(w[0] if w and w[0] in MARKS else None for w in lines), None]
        lines = [
            w[1:] if marks[n] and marks[n] in (marks[n - 1], marks[n + 1]) else w for n, w in enumerate(lines, 1)
        ]
        begin = 0
        for number in range(len(lines) + 1):
            if number < len(lines) and lines[number]:
                continue
            if number > begin:
                for first, last, family, probability, alike in self.block(lines[begin:number]):
                    first, last = first + begin, last + begin
                    inside = [found[n, family] for n in range(first, last + 1) if (n, family) in found]
                    if any(f[3] >= CONFIRMED for f in inside):
                        continue  # the notice of that line
                    for f in inside:
                        del found[f[:2]]
                    found[first, family] = first, family, probability, alike
            begin = number + 1
        return sorted(found.values())

    def lines(self, lines: list[list[str]]) -> Iterator[tuple[int, str, float, float]]:
        """The notices of single lines, confirmed or not, one per family and
        line: of its windows the most probable one."""
        for number, words in enumerate(lines):
            if self.telling.isdisjoint(words):
                continue
            spans = range(0, max(1, len(words) - SPAN + STEP), STEP) if len(words) > SPAN else [0]
            found = [f for at in spans if (f := self.judge(words[at : at + SPAN]))]
            for family in sorted({f[0] for f in found}):
                yield number, *max((f for f in found if f[0] == family), key=lambda f: (f[2] >= CONFIRMED, f[1]))


class _Scan:
    def __init__(self, model: Classifier):
        self.model = model

    def __call__(self, texts: list[str]) -> dict[str, object]:
        kind = pa.list_(
            pa.struct(
                [("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]
            )
        )
        names = ("paragraph", "family", "probability", "likeness")
        rows = [[dict(zip(names, f)) for f in self.model.scan(t)] for t in texts]
        return {"found": pa.array(rows, kind)}


def background(docs: DataFrame, doc_id: str, text: str, reserved: bool = False) -> list[str]:
    """Paragraphs of a bounded sample that look like no template."""
    chosen = (
        docs.select(F.col(doc_id).alias("_chosen"))
        .where(F.col("_chosen").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("_chosen"), "_chosen")
        .limit(BACKGROUND_ROWS)
    )
    short = F.filter(F.split(F.col(text), r"\n", -1), lambda x: (x != "") & (F.length(x) <= LINE_LENGTH))
    hashed = F.transform(F.array_distinct(short), lambda x: F.struct(F.xxhash64(x).alias("at"), x.alias("line")))
    some = F.transform(F.slice(F.array_sort(hashed), 1, LINES_OF_EACH), lambda x: x["line"])
    sample = (
        docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("_chosen"))
        .select(F.explode(some).alias("line"))
        .distinct()
    )
    rows = bounded(sample, BACKGROUND_ROWS * LINES_OF_EACH).collect()
    texts = [t for ts in (*TEMPLATES.values(), *(RESERVED.values() if reserved else ())) for t in ts]
    known = [{g for g in ngrams(words_of(t), 2) if " " in g and tells(g)} for t in texts]

    def like_a_template(line: str) -> bool:
        pairs = ngrams(words_of(line), 2)
        return any(len(k & pairs) > len(k) / 3 for k in known if k)

    return sorted(r.line for r in rows if not like_a_template(r.line))


def licences(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reserved: bool = False
) -> DataFrame:
    """(doc_id, paragraph, family, probability, likeness, confirmed): one row
    per paragraph and family of a licence notice in it.

    A paragraph is a line, numbered from 0; lines end with \\n, \\r or both. A
    confirmed notice that runs over several lines, up to one without words,
    counts at its first line; a line in it that is confirmed as the same family
    by itself counts instead.
    ``likeness`` is the share of a template's word pairs that the paragraph
    holds, for the family's best template; from 0.6 on the prediction is
    confirmed. NULL and empty texts have no rows; long texts and lines are read
    whole. Repeated rows give their rows each. An empty table gives no rows; other columns are not read.
    With ``reserved`` a bare "All rights reserved." is a proprietary notice.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = Classifier(background(plain, "doc_id", "text", reserved), reserved)
    found = text_map(
        plain,
        ["doc_id"],
        "text",
        _Scan(model),
        "found array<struct<paragraph:int,family:string,probability:double,likeness:double>>",
    )
    return (
        found.select("doc_id", F.explode("found").alias("_f"))
        .select("doc_id", "_f.*")
        .withColumn("confirmed", F.col("likeness") >= CONFIRMED)
    )
