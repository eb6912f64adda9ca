"""Licence scan: a trained paragraph classifier, confirmed against templates.

Every line of a text, and every stretch of lines between blank ones (lines without a word), is read
in windows of up to ``WINDOW`` words, one starting at every half. Features are the lower-cased words and word pairs of the templates; a sparse multinomial
logistic regression over them gives each licence family and the class ``unknown`` a probability. It
is trained here, on variants of the templates (words dropped, text around them) against ordinary
paragraphs of a bounded sample of documents and sentences that use licence words for other things.
A temperature fitted on held-out variants calibrates the probabilities.

A window counts when its families together have a probability of ``min_probability``. Its likeliest
family, with that probability, is confirmed when the window holds at least ``min_similarity`` of the
word pairs of one of the family's templates. The words so explained are set aside, and the other
families are tried on the rest, the most similar first: they need the same similarity there, and to be
the likeliest by the words that match. So one window can state several. Every line of every text is
scored; words that are no feature add nothing. A paragraph is a line; a notice over several lines
counts once per stretch, for the line where it starts or for those that are confirmed by themselves.

Documents are scanned in place without a shuffle; the model is a few hundred kB. Defined cases: null
and empty texts have no rows; a family that several paragraphs state gives one row; repeated rows
give their rows each; other columns are not read; an empty table trains on the fixed sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm.words import U64, Words, mix, texts

WINDOW = 64
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.6
SAMPLE_DOCS = 400
SAMPLE_LINES, SAMPLE_LINE = 10_000, 2000
VARIANTS = 24
STEPS, RATE, PENALTY = 300, 2.0, 1e-4
SCREEN_BITS = 20
UNKNOWN = "unknown"

#: Notices by family (fixed values).
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0.",
        "Released under the GPL version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ],
    "public-domain": [
        "This work is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2024. All rights reserved.",
    ],
}
#: Sentences with the same words that state no licence (fixed values).
OTHER = [
    "The driver had to show a valid license before the race.",
    "A fishing license is required in most public waters.",
    "Professors at MIT released a new version of the study.",
    "An Apache helicopter landed near the public square.",
    "The general public was free to use the new library.",
    "All seats in the first row are reserved for guests.",
    "The right of way is reserved for buses.",
    "They released version 2.0 of the program without warranty claims.",
    "Copyright law differs between countries.",
    "The work is under way and the terms of the contract are known.",
    "Permission was granted by the city to hold the market.",
    "By 4 o'clock the creative work was done and the commons voted.",
    "The international attribution of the painting is unknown.",
    "This file contains a list of names and the source of each.",
    "Modification of the form is not permitted.",
    "The domain name was sold to the public company.",
]
FAMILIES = [*TEMPLATES, UNKNOWN]

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
_SEPARATOR[128:] = False


def pair_hash(h: np.ndarray) -> np.ndarray:
    """Hash of every two neighbouring words."""
    return mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]


def word_hashes(text: str) -> np.ndarray:
    for t in texts(pa.array([text])):
        return t.words((0,), fold=True, space=_SEPARATOR).hashes[0]


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: list[list[np.ndarray]]

    def probabilities(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return softmax((self.bias + sums / np.sqrt(np.maximum(sizes, 1))[:, None]) / self.temperature)

    def of_words(self, h: np.ndarray) -> np.ndarray:
        own = np.concatenate([h, pair_hash(h)])
        at = np.minimum(np.searchsorted(self.features, own), len(self.features) - 1)
        return self.probabilities(self.weights[at[self.features[at] == own]].sum(axis=0)[None], np.array([len(h)]))[0]

    def similarity(self, k: int, pairs: np.ndarray) -> tuple[float, np.ndarray]:
        """Share of the pairs of the family's template that is most like, and these pairs."""
        return max(((float(np.isin(m, pairs).mean()), m) for m in self.pairs[k] if len(m)), key=lambda x: x[0])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def variants(words: list[str], filler: list[str], rng: np.random.Generator) -> list[str]:
    """A notice with some words dropped and ordinary words around it."""
    kept = [w for w in words if len(words) < 6 or rng.random() > 0.08]
    most = 12 if rng.random() < 0.5 else WINDOW
    around = [filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(0, most)))] if filler else []
    cut = int(rng.integers(0, len(around) + 1))
    return [*around[:cut], *kept, *around[cut:]]


def train(paragraphs: list[str], seed: int = 1) -> Model:
    """Model from the templates and ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    filler = [w for p in paragraphs for w in p.split()]
    rows, target = [], []
    for f, notices in enumerate(TEMPLATES.values()):
        for notice in notices:
            words = notice.split()
            for v in range(VARIANTS):
                rows.append(" ".join(words if not v else variants(words, filler, rng)))
                target.append(f)
    for p in [*paragraphs, *[" ".join(variants(o.split(), filler, rng)) for o in OTHER for _ in range(VARIANTS)]]:
        rows.append(p)
        target.append(len(FAMILIES) - 1)
    hashes = [word_hashes(r) for r in rows]
    known = [word_hashes(n) for notices in [*TEMPLATES.values(), OTHER] for n in notices]
    features = np.unique(np.concatenate([np.concatenate([h, pair_hash(h)]) for h in known]))
    x = np.zeros((len(rows), len(features)), dtype=np.float32)
    for i, h in enumerate(hashes):
        own = np.concatenate([h, pair_hash(h)])
        at = np.minimum(np.searchsorted(features, own), len(features) - 1)
        np.add.at(x[i], at[features[at] == own], 1 / np.sqrt(max(len(h), 1)))
    y = np.array(target)
    test = np.arange(len(rows)) % 5 == 4
    weights, bias = _regression(x[~test], y[~test], len(FAMILIES))
    temperature = _temperature(x[test] @ weights + bias, y[test])
    pairs = [[np.unique(pair_hash(word_hashes(n))) for n in notices] for notices in TEMPLATES.values()]
    return Model(features, weights, bias, temperature, pairs)


def _regression(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression, classes weighted alike, with a squared penalty."""
    w, b = np.zeros((x.shape[1], classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    share = 1 / (np.bincount(y, minlength=classes).clip(1) * classes)
    goal = np.eye(classes, dtype=np.float32)[y]
    step_w, step_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(STEPS):
        gap = (softmax(x @ w + b) - goal) * share[y][:, None].astype(np.float32)
        g_w, g_b = x.T @ gap + PENALTY * w, gap.sum(axis=0)
        step_w += g_w**2
        step_b += g_b**2
        w -= RATE * g_w / np.sqrt(step_w)
        b -= RATE * g_b / np.sqrt(step_b)
    return w, b


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature of the least log loss on held-out rows."""
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def ordinary_paragraphs(docs: DataFrame, text: str = "text", size: int = SAMPLE_DOCS) -> list[str]:
    """Distinct lines without licence words from about ``size`` documents, chosen by hash.

    At most ``SAMPLE_LINES`` lines, those with the smallest hashes, of their first ``SAMPLE_LINE`` characters.
    """
    one_in = max(1, docs.count() // size)
    picked = docs.filter(F.pmod(F.xxhash64(F.col(text)), F.lit(one_in)) == 0)
    lines = picked.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    stated = "(?i)licen[cs]|copyright|rights reserved|public domain|creative commons|redistribut|spdx"
    plain = lines.filter(~F.col("line").rlike(stated) & (F.length(F.trim("line")) > 0)).select(F.substring("line", 1, SAMPLE_LINE).alias("line")).distinct()
    return sorted(plain.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).toArrow()["line"].to_pylist())


def densest(hits: np.ndarray) -> tuple[int, int]:
    """First and last of the stretch with the most hits, a miss counting against two."""
    best, total, start, found = 0, 0, 0, (0, 0)
    for i, hit in enumerate(hits.tolist()):
        if total <= 0:
            total, start = 0, i
        total += 1 if hit else -2
        if total > best:
            best, found = total, (start, i)
    return found


def stated(h: np.ndarray, p: np.ndarray, model: Model, min_probability: float, min_similarity: float):
    """Family, probability, similarity and first word of every family that a window states."""
    pairs = pair_hash(h)
    free = np.ones(len(pairs), dtype=bool)
    k = int(p.argmax())
    likeliest = k if k < len(FAMILIES) - 1 and p[k] >= min_probability else None
    open_ = set(range(len(FAMILIES) - 1))
    while open_:
        if likeliest is not None:
            k, (similarity, template) = likeliest, model.similarity(likeliest, pairs)
        else:
            similarity, k, template = max(((s, -f, m) for f in open_ for s, m in [model.similarity(f, pairs[free])]), key=lambda x: x[:2])
            k = -k
            if similarity < min_similarity:
                return
        open_.discard(k)
        a, e = densest(np.isin(pairs, template) & free)
        if likeliest is not None:
            q, good = float(p[k]), similarity >= min_similarity
        else:
            own = model.of_words(h[max(a - 2, 0):e + 4])
            q, good = float(own[k]), int(own.argmax()) == k and own[k] >= min_probability
        likeliest = None
        if not good:
            continue
        yield k, q, similarity, a
        while (left := model.similarity(k, pairs[free]))[0] >= min_similarity:
            a, e = densest(np.isin(pairs, left[1]) & free)
            free[a:e + 1] = False


def windows_of(w: Words, text_starts: np.ndarray, newline: np.ndarray, model: Model, screen: np.ndarray,
               min_probability: float = MIN_PROBABILITY, gap: int = 1):
    """Of one slice: text, first and last line of the stretch, first and last word and probabilities of every window
    that is likely to state a licence. A stretch ends where ``gap`` newlines follow each other without a word."""
    n, half = len(w), WINDOW // 2
    h = w.hashes[0]
    line = newline[w.starts]
    before = newline[text_starts]
    new = np.ones(n, dtype=bool)
    new[1:] = (np.diff(w.text) != 0) | (np.diff(line) >= gap)
    first = np.flatnonzero(new)
    paragraph = np.cumsum(new) - 1
    block_new = new | ((np.arange(n) - first[paragraph]) % half == 0)
    block = np.cumsum(block_new) - 1
    starts = np.flatnonzero(block_new)
    sizes = np.diff(np.append(starts, n))
    sums = np.zeros((len(starts), len(FAMILIES)), dtype=np.float32)
    pairs = pair_hash(h)
    for values, ok in ((h, None), (pairs, ~new[1:])):
        at = np.flatnonzero(screen[values >> U64(64 - SCREEN_BITS)] if ok is None else screen[values >> U64(64 - SCREEN_BITS)] & ok)
        f = np.minimum(np.searchsorted(model.features, values[at]), len(model.features) - 1)
        hit = model.features[f] == values[at]
        if hit.any():
            owner = block[at[hit]]
            edge = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[edge]] += np.add.reduceat(model.weights[f[hit]], edge, axis=0)
    follows = np.zeros(len(starts), dtype=bool)
    follows[:-1] = paragraph[starts[1:]] == paragraph[starts[:-1]]
    total, size = sums.copy(), sizes.copy()
    total[:-1] += sums[1:] * follows[:-1, None]
    size[:-1] += sizes[1:] * follows[:-1]
    touched = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
    p = model.probabilities(total[touched], size[touched])
    last = np.append(first[1:], n) - 1
    known = 1 - p[:, -1] >= min_probability
    for b, q in zip(touched[known].tolist(), p[known], strict=True):
        a, e = int(starts[b]), int(starts[b] + size[b])
        own, at = int(w.text[a]), paragraph[a]
        yield own, int(line[first[at]] - before[own]), int(line[last[at]] - before[own]), a, e, q


def scan(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text",
         min_probability: float = MIN_PROBABILITY, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Per document and family stated: id, family, probability and similarity (the best), n_paragraphs, first_paragraph."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, family string, probability double, similarity double, n_paragraphs long, first_paragraph long"
    screen = np.zeros(1 << SCREEN_BITS, dtype=bool)
    screen[model.features >> U64(64 - SCREEN_BITS)] = True

    def run(batches):
        for batch in batches:
            found: dict[tuple[int, int], list] = {}
            for t in texts(batch.column(1)):
                w = t.words((0,), fold=True, space=_SEPARATOR)
                if not len(w):
                    continue
                newline = np.concatenate([[0], np.cumsum(t.bytes == 10)])
                lines = newline[w.starts] - newline[t.bounds[:-1]][w.text]
                for gap in (1, 2):
                    for i, top, end, a, e, p in windows_of(w, t.bounds[:-1], newline, model, screen, min_probability, gap):
                        if gap == 2 and lines[a] == lines[e - 1]:
                            continue  # seen as a line
                        for k, q, similarity, at in stated(w.hashes[0][a:e], p, model, min_probability, min_similarity):
                            best = found.setdefault((t.first + i, k), [0.0, 0.0, set()])
                            best[0], best[1] = max(best[0], q), max(best[1], similarity)
                            if not any(top <= x <= end for x in best[2]):
                                best[2].add(int(lines[a + at]))
            if found:
                at = sorted(found)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([i for i, _ in at], pa.int64())), pa.array([FAMILIES[k] for _, k in at]),
                    pa.array([found[x][0] for x in at], pa.float64()), pa.array([float(found[x][1]) for x in at], pa.float64()),
                    pa.array([len(found[x][2]) for x in at], pa.int64()), pa.array([min(found[x][2]) for x in at], pa.int64())],
                    [id, "family", "probability", "similarity", "n_paragraphs", "first_paragraph"])

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, schema)


def op1_license_scan(spark, sf_dir):
    """Licences that documents state."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(ordinary_paragraphs(docs)))


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL: dict[str, str] = {}
