"""License scan by a trained paragraph classifier, confirmed by template comparison.

Read are lines of text and, for notices wrapped over lines, paragraphs: consecutive lines
that hold words. What has more than ``WINDOW`` words is read in overlapping
windows of that many, and also in windows of half as many, in which a short notice stands out. The features are hashed word 1- to 3-grams (letters and digits, A-Z
lower-cased); a multinomial logistic regression, trained by stochastic gradient
descent in numpy, gives a probability to each license family and to a class of unknown
text. Training paragraphs are made from the notices below (set in other text, with words
lost or replaced), from sentences that speak of licenses without granting one, and from
lines of at most ``NEGATIVE_ROWS`` documents of at most ``NEGATIVE_BYTES`` bytes (``READ_LINES`` lines of them are read, and ``NEGATIVE_LINES`` without a notice are trained on); every fifth is held back to calibrate a temperature and the
probability under which a paragraph counts as unknown. A family that is probable against unknown text
stands only if what is read holds ``CONFIRMED`` of the word 1- and 2-grams of one of that family's
notices. Of several the most similar is taken, and the words before and after its notice are
read again by themselves, so that each notice counts. A finding bears the number of the line that its notice begins on.

Whole texts are scanned. Null or empty text: no families. Repeated and null ids keep their rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, narrow, pieces, table
from .decontaminate import word_hashes

#: Bounds of what is trained on: documents that negative lines come from, bytes of such a document, lines, variants of a notice.
NEGATIVE_ROWS = 400
NEGATIVE_BYTES = 20_000
READ_LINES = 16_000
NEGATIVE_LINES = 4000
VARIANTS = 40
WINDOW = 60
ORDERS = 3
BITS = 16
EPOCHS = 6
CONFIRMED = 0.75
#: Share of calibration negatives that may pass.
FALSE_SHARE = 0.001
LEAST_PROBABILITY = 0.5
_BUCKETS = 1 << BITS
_PLACE = np.random.default_rng(61).integers(1, 2**62, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# Usual notices of each family.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version.", "Licensed under the GNU General Public License v2.0", "SPDX-License-Identifier: GPL-2.0"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.", "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License v2.1", "Licensed under the GNU Lesser General Public License v3.0", "SPDX-License-Identifier: LGPL-2.1"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License v3.0", "SPDX-License-Identifier: AGPL-3.0"),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Creative Commons Zero public domain dedication"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "Artistic-2.0": ("This program is free software; you may redistribute it under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"),
    "EUPL-1.2": ("Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"),
    "All-rights-reserved": ("All rights reserved.", "Copyright by the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}

# Sentences about licenses that grant none.
OTHERS = (
    "He lost his driving license after the accident.",
    "The bar was granted a license to sell alcohol last year.",
    "Licensed plumbers and electricians are hard to find here.",
    "The general public was invited to the opening.",
    "Version 2 of the program was released in March.",
    "The foundation published a report on free education for any person.",
    "All rights and duties of the members are described in the statutes.",
    "The author reserved a table for the evening.",
    "A public license plate register is kept by the state.",
    "Permission to leave was granted without delay.",
    "The software was modified and distributed to all offices.",
    "Creative people in common spaces share their work.",
)


def grams(h: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the word n-grams of one order at each place."""
    m = max(0, len(h) - order + 1)
    out = np.zeros(m, np.uint64)
    for k in range(order):
        out += h[k : k + m] * _PLACE[k]
    return mix(out + np.uint64(order))


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def _bag(h: np.ndarray) -> np.ndarray:
    return np.concatenate([grams(h, n) >> np.uint64(64 - BITS) for n in range(1, ORDERS + 1)]).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Scanner:
    """The trained classifier with the notices that confirm it."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, least: float) -> None:
        self.families = list(NOTICES)
        self.weights, self.bias, self.temperature, self.least = weights, bias, temperature, least
        self.notices = [[self._set(_hashes(t)) for t in ts] for ts in NOTICES.values()]

    @staticmethod
    def _set(h: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([grams(h, 1), grams(h, 2)]))

    def similarity(self, h: np.ndarray, family: int) -> float:
        """The largest share of one of the family's notices that the words hold."""
        mine = self._set(h)
        return max(len(np.intersect1d(n, mine, assume_unique=True)) / len(n) for n in self.notices[family])

    def probabilities(self, totals: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each class, for the words [first, last)."""
        z, n = np.zeros((len(first), self.weights.shape[1])), np.zeros(len(first))
        for order, total in enumerate(totals, 1):
            end = np.maximum(last - order + 1, first)
            inside = end > first
            z[inside] += total[end[inside]] - total[first[inside]]
            n += end - first
        return _softmax((z / np.sqrt(np.maximum(n, 1))[:, None] + self.bias) / self.temperature)

    def probable(self, p: np.ndarray) -> np.ndarray:
        """Families that are probable against unknown text, whatever the others."""
        return p[:, :-1] >= self.least * (p[:, :-1] + p[:, -1:])

    def place(self, h: np.ndarray, family: int) -> tuple[int, int]:
        """Where the family's most similar notice stands in the words."""
        mine = self._set(h)
        notice = max(self.notices[family], key=lambda n: len(np.intersect1d(n, mine, assume_unique=True)) / len(n)).tolist()
        one = [g if g in notice else 0 for g in grams(h, 1).tolist()]
        two = [g if g in notice else 0 for g in grams(h, 2).tolist()]
        best = (0.0, 0, 1)
        for a in range(len(h)):
            seen: set[int] = set()
            for b in range(a, min(len(h), a + len(notice)) if one[a] else a):
                seen |= {one[b], two[b - 1] if b > a else 0}
                # a word that adds nothing costs half a gram
                best = max(best, (len(seen - {0}) - (b - a) / 2, -a, b + 1))
        return -best[1], best[2]

    def found(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """(row, paragraph, family number, probability, similarity) of each paragraph with a license, of whole texts."""
        h, starts, _, rows = word_hashes(data, offs)
        if not len(h):
            return []
        lines = np.flatnonzero(data == 10)
        line = np.searchsorted(lines, starts)
        row = np.searchsorted(rows, np.arange(len(h)), "right") - 1
        first = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(row) != 0)]))
        last = np.append(first[1:], len(h))
        # paragraphs of more than one line: their first lines, each with the end of the last
        starting = np.concatenate([[True], (np.diff(line[first]) != 1) | (np.diff(row[first]) != 0)])
        whole = np.append(last[:-1][starting[1:]], len(h))
        wrapped = whole > last[starting]
        units = [_windows(first, last), _windows(first[starting][wrapped], whole[wrapped])]
        totals = []
        for order in range(1, ORDERS + 1):
            total = np.zeros((max(0, len(h) - order + 1) + 1, self.weights.shape[1]))
            np.cumsum(self.weights[(grams(h, order) >> np.uint64(64 - BITS)).astype(np.int64)], axis=0, dtype=np.float64, out=total[1:])
            totals.append(total)
        finds = []
        for first, last in units:
            p = self.probabilities(totals, first, last)
            todo = [(int(first[k]), int(last[k]), p[k]) for k in np.flatnonzero(self.probable(p).any(axis=1)).tolist()]
            while todo:
                a, b, q = todo.pop()
                same = {f: self.similarity(h[a:b], f) for f in np.flatnonzero(self.probable(q[None])[0]).tolist()}
                f = max(same, key=lambda f: (same[f], q[f]), default=-1)
                if f < 0 or same[f] < CONFIRMED:
                    continue
                x, y = self.place(h[a:b], f)
                finds.append((same[f], float(q[f]), a + x, a + y, f))
                rest = [(c, d) for c, d in ((a, a + x), (a + y, b)) if c < d]
                if rest:
                    todo += [(*z, q) for z, q in zip(rest, self.probabilities(totals, *np.array(rest).T))]
        # one family for each stretch: of finds that overlap the most similar
        out: dict[tuple[int, int, int], tuple[float, float]] = {}
        taken = np.zeros(len(h), bool)
        for same, q, x, y, f in sorted(finds, key=lambda z: (-z[0], z[2] - z[3], -z[1])):
            if not taken[x:y].any():
                taken[x:y] = True
                r = int(row[x])
                at = (r, int(line[x] - np.searchsorted(lines, offs[r])), f)
                out[at] = max(out.get(at, (0.0, 0.0)), (q, same))
        return sorted((*k, *v) for k, v in out.items())


def _windows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches, the long ones in overlapping windows, and all in windows of half the size, where a short notice stands out."""
    size = last - first
    firsts, lasts = [first[size <= WINDOW]], [last[size <= WINDOW]]
    for width, step in ((WINDOW, WINDOW // 2), (WINDOW // 2, WINDOW // 6)):
        for a, b in zip(first[size > width].tolist(), last[size > width].tolist()):
            firsts.append(np.arange(a, b - width + step, step))
            lasts.append(np.minimum(firsts[-1] + width, b))
    return np.concatenate(firsts), np.concatenate(lasts)


def fit(negatives: list[str], seed: int = 3) -> Scanner:
    """Train and calibrate on the notices and on lines that are taken for unlicensed text, but for those that hold a notice."""
    rng = np.random.default_rng(seed)
    bare = Scanner(np.zeros((_BUCKETS, len(NOTICES) + 1), np.float32), np.zeros(len(NOTICES) + 1), 1.0, 1.0)
    pool = [h for t in negatives if len(h := _hashes(t))]
    pool = [h for h in pool if all(bare.similarity(h, f) < 0.6 for f in range(len(NOTICES)))]
    filler = np.concatenate(pool) if pool else _hashes(" ".join(OTHERS))
    unknown = len(NOTICES)

    def around(h: np.ndarray) -> np.ndarray:
        a, b = (int(x) for x in rng.integers(0, 15, 2) * (rng.random(2) < 0.4))
        at, to = (int(x) for x in rng.integers(0, max(1, len(filler) - 15), 2))
        return np.concatenate([filler[at : at + a], h, filler[to : to + b]])

    bags, labels = [], []
    for f, notices in enumerate(NOTICES.values()):
        for t in notices:
            h = _hashes(t)
            for v in range(VARIANTS):
                x = h[rng.random(len(h)) > 0.06 * (v % 3)] if len(h) > 5 else h
                bags.append(_bag(around(x)))
                labels.append(f)
    for h in [*pool[:NEGATIVE_LINES], *[_hashes(t) for t in OTHERS for _ in range(20)]]:
        a = int(rng.integers(0, max(1, len(h) - WINDOW)))
        bags.append(_bag(h[a : a + WINDOW]))
        labels.append(unknown)
    y = np.array(labels)
    order = rng.permutation(len(bags))
    held, train = order[::5], np.setdiff1d(order, order[::5])
    w, bias = np.zeros((_BUCKETS, unknown + 1), np.float32), np.zeros(unknown + 1, np.float32)
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + epoch)
        for i in rng.permutation(train).tolist():
            x = bags[i]
            scale = 1 / np.sqrt(max(1, len(x)))
            g = _softmax(w[x].sum(axis=0) * scale + bias)
            g[y[i]] -= 1
            np.subtract.at(w, x, (rate * scale * g).astype(np.float32))
            bias -= rate * 0.1 * g
    z = np.array([w[bags[i]].sum(axis=0) / np.sqrt(max(1, len(bags[i]))) + bias for i in held], np.float64)
    grid = np.geomspace(0.1, 10, 40)
    temperature = float(grid[int(np.argmin([-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean() for t in grid]))])
    p = _softmax(z / temperature)
    wrong = p[y[held] == unknown][:, :unknown].max(axis=1)
    least = float(max(LEAST_PROBABILITY, np.quantile(wrong, 1 - FALSE_SHARE))) if len(wrong) else LEAST_PROBABILITY
    return Scanner(w, bias.astype(np.float64), temperature, min(least, 0.99))


def train(docs: DataFrame) -> Scanner:
    """A scanner whose negative lines come from a bounded sample of the documents."""
    usable = narrow(docs).where(F.octet_length("text") <= NEGATIVE_BYTES).withColumn("h", F.xxhash64("doc_id", F.lit(6))).withColumn("th", F.xxhash64("text"))
    # ids first: each partition sends numbers, and only the texts of the chosen rows come to the driver
    chosen = usable.select("h", "th").orderBy("h", "th").limit(NEGATIVE_ROWS)
    rows = usable.join(F.broadcast(chosen.distinct()), ["h", "th"]).select("h", "th", "text").dropDuplicates(["h", "th"]).orderBy("h", "th").limit(NEGATIVE_ROWS).collect()
    return fit([x for r in rows for x in r.text.split("\n")][:READ_LINES])


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id and found (array of paragraph, family, probability, similarity) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scanner))
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = pickle.loads(sent.value)
        for batch in batches:
            for a, b, data, offs in pieces(batch, most=1 << 20):
                found: list[list] = [[] for _ in range(b - a)]
                for r, line, f, p, same in s.found(data, offs):
                    found[r].append({"paragraph": line, "family": s.families[f], "probability": p, "similarity": same})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, kind)], names=["doc_id", "found"])

    return narrow(docs).mapInArrow(run, "doc_id long, found array<struct<paragraph: long, family: string, probability: double, similarity: double>>")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return scan(docs, train(docs)).select("doc_id", families.alias("families"), F.size("found").cast("long").alias("n_found"), F.round(F.array_max(F.transform("found", lambda x: x["probability"])), 4).alias("best"))
