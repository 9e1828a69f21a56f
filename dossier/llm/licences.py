"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Blank lines part a text. Between them, lines that follow each other and all have a word of the vocabulary are one paragraph, so that wrapped
notices stay whole; every other line is a paragraph of its own. A sparse logistic regression over word n-grams (long single
words, pairs, triples) names the licence family of a paragraph, `other` for licences of no family, or none.

It is trained on the driver on varied parts of the families' notices, on notices of made-up licences for `other`, and on a bounded sample of
ordinary paragraphs (SAMPLE lines, one by hash out of each of as many documents by hash; lines that a template confirms are left out). Half of the
data calibrates a temperature and the least confidence. A paragraph without any n-gram of the vocabulary is ordinary. One that the
model takes for a family's has its n-grams compared with the sentences of that family's notices: enough of one sentence's must be
there. Where confidence or comparison fails, or the class is `other`, the paragraph is `unknown`.

Null and empty texts are one empty, ordinary paragraph; blank lines are none in other texts. Rows come back one for one with null ids, ties and
copies as they are; only the id and the text are read. There is no shuffle besides the bounded sample.
A text of any length is read whole by its task. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import slices

#: Ordinary paragraphs in the sample, notices made for each family, least share of a sentence's n-grams, false alarms in the calibration half.
SAMPLE, NOTICES, CONTAINED, FALSE_ALARMS = 3000, 160, 0.5, 0.001
#: Words that a sentence of a notice needs to be a template.
SENTENCE_WORDS = 5
SCHEMA = "doc_id long, n_paragraphs long, n_licence long, n_unknown long, families string"
NONE, OTHER, UNKNOWN = "none", "other", "unknown"

#: The notices by which the licence families are stated.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the 3-Clause BSD License.", "Distributed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
        "Licensed under CC BY 4.0.", "Available under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
        "Licensed under CC BY-NC 4.0.", "Available under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License.",
    ),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0",
    ),
}
#: Wording of licences that are in no family; {} stands for a name.
OTHER_WORDING = (
    "Licensed under the {} License.", "Released under the {} Public License, version 1.0.", "Distributed under the {} Software License, Version 1.0.", "This work is licensed under the {} License.",
    "This program and the accompanying materials are made available under the terms of the {} License which accompanies this distribution.",
    "Use of this software is subject to the terms of the {} licence agreement.", "You may use, copy and modify this software under the terms of the {} License.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is granted, provided that this notice appears in all copies.",
    "This software is provided by {} without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Subject to the terms and conditions of this Agreement, each Contributor grants {} a non-exclusive, worldwide, royalty-free copyright license.", "SPDX-License-Identifier: {}-1.0", "All rights reserved under the {} licence; redistribution is permitted only with this notice.",
)
_OPENERS = ("", "", "Copyright 2021 the authors.", "Copyright (c) 2019", "All files here are", "Note:", "Unless stated otherwise,")
_CLOSERS = ("", "", "See the file for details.", "All rights reserved.", "Thank you.")
_SPLIT = {ord(c): " " for c in ",.;:!?()[]{}\"'*/|<>=#\t\x0b\x0c\r\n"}


def words_of(paragraph: str) -> list[str]:
    return paragraph.lower().translate(_SPLIT).split()


def grams(words: list[str]) -> set:
    """Words of at least five letters, pairs and triples."""
    out: set = {w for w in words if len(w) >= 5}
    out.update(zip(words, words[1:]))
    out.update(zip(words, words[1:], words[2:]))
    return out


def sentences(notice: str) -> list[str]:
    """Sentences of enough words; a shorter notice is one."""
    parts = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", notice) if len(words_of(s)) >= SENTENCE_WORDS]
    return parts or [notice]


def notices(seed: int = 5) -> list[tuple[str, str]]:
    """(family, paragraph): whole notices, runs of their sentences or of their words, with openings and closings, some words lost."""
    rng, out = random.Random(seed), []
    name = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).title()
    for family, wording in (*TEMPLATES.items(), (OTHER, OTHER_WORDING)):
        for i in range(NOTICES):
            text = wording[i % len(wording)].replace("{}", name())
            parts = sentences(text)
            first = rng.randrange(len(parts))
            words = (text if rng.random() < 0.4 else " ".join(parts[first : first + rng.randint(1, 3)])).split()
            if len(words) > 24 and rng.random() < 0.4:
                at = rng.randrange(len(words) - 14)
                words = words[at : at + rng.randint(14, 24)]
            if len(words) > 6 and rng.random() < 0.3:
                del words[rng.randrange(len(words))]
            out.append((family, f"{rng.choice(_OPENERS)} {' '.join(words)} {rng.choice(_CLOSERS)}"))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


class Sparse:
    """Rows as lists of the columns that are 1."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], dtype=np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.row, w[self.column, k], self.n) for k in range(w.shape[1])])

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.column, y[self.row, k], self.width) for k in range(y.shape[1])])


class Classifier:
    """Multinomial logistic regression on n-gram presence; the vocabulary is what at least two notices share."""

    def __init__(self, ordinary: list[str], seed: int = 5):
        self.families = [NONE, *TEMPLATES, OTHER]
        self.templates = {f: [grams(words_of(s)) for t in ts for s in sentences(t)] for f, ts in TEMPLATES.items()}
        # What a template confirms is no ordinary paragraph, whoever wrote it.
        plain = [g for g in (grams(words_of(p)) for p in sorted(ordinary)) if not any(self._contains(g, f) for f in TEMPLATES)]
        rows = [(f, grams(words_of(p))) for f, p in notices(seed)] + [(NONE, g) for g in plain] + [(NONE, set())]
        random.Random(seed).shuffle(rows)
        seen = Counter(g for f, gs in rows if f != NONE for g in gs)
        common = Counter(g for g_ in plain for g in g_)
        # N-grams that ordinary paragraphs use as a rule say nothing.
        self.vocabulary = {g: i for i, g in enumerate(sorted((g for g, n in seen.items() if n >= 2 and common[g] * 50 <= len(plain)), key=str))}
        # A paragraph with an n-gram of the vocabulary has that n-gram's rarest word.
        often = Counter(w for g_ in plain for g in g_ for w in ([g] if isinstance(g, str) else g if len(g) == 2 else ()))
        self.anchors = frozenset(min([g] if isinstance(g, str) else g, key=lambda w: (often[w], w)) for g in self.vocabulary)
        cut = len(rows) // 2
        self.weights = self._fit(rows[:cut])
        self.temperature, self.least = 1.0, 0.5
        self._calibrate(rows[cut:])

    def _columns(self, known: set) -> list[int]:
        return [len(self.vocabulary), *(self.vocabulary[g] for g in known if g in self.vocabulary)]

    def _sparse(self, rows) -> Sparse:
        return Sparse([self._columns(gs) for _, gs in rows], len(self.vocabulary) + 1)

    def _fit(self, rows, steps: int = 300, rate: float = 1.0, ridge: float = 1e-4) -> np.ndarray:
        x = self._sparse(rows)
        y = np.eye(len(self.families))[[self.families.index(f) for f, _ in rows]]
        w = np.zeros((x.width, len(self.families)))
        for _ in range(steps):
            w -= rate * (x.transposed_times(_softmax(x.times(w)) - y) / x.n + ridge * w)
        return w

    def _calibrate(self, rows) -> None:
        y = np.array([self.families.index(f) for f, _ in rows])
        z = self._sparse(rows).times(self.weights)
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        wrong = np.sort(_softmax(z[y == 0] / self.temperature)[:, 1:].max(1)) if (y == 0).any() else np.zeros(1)
        self.least = float(min(0.95, max(0.5, wrong[min(len(wrong) - 1, math.ceil(len(wrong) * (1 - FALSE_ALARMS)) - 1)])))

    def _contains(self, known: set, family: str) -> bool:
        return any(len(t & known) >= CONTAINED * len(t) for t in self.templates[family])

    def family(self, paragraph: str) -> str:
        """Family, `unknown` or `none`."""
        words = words_of(paragraph)
        if self.anchors.isdisjoint(words):
            return NONE
        known = grams(words)
        hit = self._columns(known)
        if len(hit) == 1:
            return NONE
        p = _softmax(self.weights[hit].sum(0) / self.temperature)
        best = int(p.argmax())
        if best == 0 or p[0] >= 0.5:
            return NONE
        name = self.families[best]
        return name if name != OTHER and p[best] >= self.least and self._contains(known, name) else UNKNOWN

    def paragraphs(self, text: str) -> list[str]:
        """The paragraphs of a text, in order."""
        out: list[str] = []
        joined: list[str] = []
        for line in text.split("\n"):
            if line.strip() and not self.anchors.isdisjoint(words_of(line)):
                joined.append(line)
                continue
            if joined:
                out.append("\n".join(joined))
                joined = []
            if line.strip():
                out.append(line)
        if joined:
            out.append("\n".join(joined))
        return out or [""]


def ordinary_sample(docs: DataFrame, text_col: str, sample: int) -> list[str]:
    """About `sample` lines, twice as many at most: one by hash out of each document whose text's hash is below a threshold."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n = docs.count()
    if not n:
        return []
    lines, salted = F.split(text, "\n"), F.xxhash64(F.lit(3), text)
    below = -(1 << 63) + min(int((1 << 64) * sample / n), (1 << 64) - 1)
    chosen = docs.where(salted <= F.lit(below)).select(F.get(lines, F.pmod(F.xxhash64(F.lit(4), text), F.size(lines)).cast("int")).alias("line"), salted.alias("h"))
    # A text that many rows have comes once; the limit is a safeguard for the driver and not reached by hashes that are spread.
    return [r["line"] for r in chosen.distinct().orderBy("h", "line").limit(2 * sample).collect()]


def licence_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Numbers of paragraphs, of licence notices and of unknown ones, and the families found, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(ordinary_sample(docs, text_col, sample)))

    def run(batches):
        model = shared.value
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = model.paragraphs(text.as_py() or "")
                found = Counter(f for f in map(model.family, parts) if f != NONE)
                unknown = found.pop(UNKNOWN, 0)
                rows.append((doc_id, len(parts), sum(found.values()), unknown, ",".join(sorted(found))))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_paragraphs", "n_licence", "n_unknown", "families"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
