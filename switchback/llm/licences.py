"""Licence scans (operator 9): a trained paragraph classifier, confirmed by templates.

Paragraphs are lines, and runs of lines without an empty one between them; what has more
than WINDOW words is read in overlapping windows, so whole texts are covered. A softmax
regression over word 1- and 2-grams tells licence families from an unknown class. It is
trained on the templates below, varied by seeded edits, against paragraphs of a bounded
sample of the corpus (NEGATIVE_TEXTS texts, by hash, without those that a template
confirms) and licence-like sentences that name no licence. Its temperature and the least
probability of a family are calibrated on variants and corpus lines left out. A prediction
counts when a template of its family agrees: enough of the template's 2-grams are in the
paragraph.

Windows without any template's 2-gram are left out before they are scored: none of them
could be confirmed, so nothing is lost.

Defined cases: null, empty and word-less texts have no licence; ties go to the first
family by name; repeated rows are scanned each; an empty table gives no rows, and without
a sample the licence-like sentences are the only negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import small_batches

WINDOW = 60
NEGATIVE_TEXTS = 300
NEGATIVES = 3000
VARIANTS = 60
CONFIRM = 0.5
FALSE_RATE = 0.001
UNKNOWN = "unknown"

# Notices as the licences' publishers give them, shortened where they are long.
TEMPLATES = {
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL version 3 or later."],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0."],
    "BSD": ["Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal Public Domain Dedication."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2 or later.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU LGPL version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
NOT_LICENCES = [
    "The driver showed a license at the border.", "The new version was released under pressure.", "The bar lost its liquor license in May.", "He has the right to remain silent.", "The public library is free to use.",
    "Permission to build was granted by the town.", "The apache helicopter landed.", "She studied at MIT for two years.", "Software is subject to change without notice.", "All seats are reserved.", "The rights of the people were reserved for later debate.",
    "License plates are issued by the state.", "The foundation published its terms.", "A license agreement was signed between the companies.", "Licensed under contract to the city.",
]


def words_of(text: str) -> list[str]:
    w = tc.Words(*tc.column_bytes(pa.array([text], pa.string())))
    return [w.text(k) for k in range(len(w.hash))]


def _grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _variant(words: list[str], filler: list[str], rng) -> list[str]:
    """A template with words dropped or replaced, numbers changed and words put around it."""
    out = []
    for w in words:
        if w.isdigit() and rng.random() < 0.3:
            w = str(rng.integers(1, 5))
        r = rng.random()
        if r < 0.04:
            continue
        out.append(filler[rng.integers(len(filler))] if r < 0.06 else w)
    pad = rng.integers(0, 12)
    extra = [filler[k] for k in rng.integers(0, len(filler), pad)]
    cut = int(rng.integers(0, pad + 1))
    return extra[:cut] + out + extra[cut:]


class Model:
    """Vocabulary, weights, calibration and templates."""

    def __init__(self, negatives: list[list[str]]):
        rng = np.random.default_rng(5)
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        self.templates = {k: [words_of(t) for t in v] for k, v in TEMPLATES.items()}
        self.pairs = {k: [set(zip(t, t[1:], strict=False)) for t in v] for k, v in self.templates.items()}
        negatives = negatives + [words_of(t) for t in NOT_LICENCES]
        negatives = [n for n in negatives if not any(self.share(k, n) >= CONFIRM for k in self.templates)]
        filler = sorted({w for n in negatives for w in n[:20]}) or ["the"]
        self.vocab = {g: k for k, g in enumerate(sorted({g for v in self.templates.values() for t in v for g in _grams(t)}))}
        x, y = [], []
        for k, c in enumerate(self.classes[:-1]):
            for t in self.templates[c]:
                x += [t] + [_variant(t, filler, rng) for _ in range(VARIANTS)]
                y += [k] * (VARIANTS + 1)
        some = [negatives[k] for k in rng.permutation(len(negatives))[:NEGATIVES]]
        near = [_variant(words_of(t), filler, rng) for t in NOT_LICENCES for _ in range(10)]
        x += some + near
        y += [len(self.classes) - 1] * (len(some) + len(near))
        y = np.array(y)
        m = np.zeros((len(x), len(self.vocab) + 1), np.float32)
        for k, w in enumerate(x):
            m[k] = self.row(w)
        test = rng.random(len(x)) < 0.2
        self.weights = self._fit(m[~test], y[~test])
        z = m[test] @ self.weights
        p = lambda t: self._softmax(z / t)
        self.temperature = min(np.geomspace(0.2, 5, 25), key=lambda t: -np.log(p(t)[np.arange(test.sum()), y[test]] + 1e-9).mean())
        q = p(self.temperature)
        wrong = np.sort(q[y[test] == len(self.classes) - 1, :-1].max(axis=1)) if (y[test] == len(self.classes) - 1).any() else np.array([0.5])
        self.hashed_ = self.hashed()
        self.least = float(np.clip(wrong[min(len(wrong) - 1, int((1 - FALSE_RATE) * len(wrong)))], 0.3, 0.8))

    def row(self, words: list[str]) -> np.ndarray:
        """L2-normalised known 1- and 2-grams and a constant."""
        out = np.zeros(len(self.vocab) + 1, np.float32)
        for g in _grams(words):
            k = self.vocab.get(g)
            if k is not None:
                out[k] = 1
        norm = np.sqrt(out.sum())
        if norm:
            out /= norm
        out[-1] = 1
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Softmax regression by Adam on the whole set, with a small ridge."""
        n = len(self.classes)
        w = np.zeros((x.shape[1], n), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        hot = np.eye(n, dtype=np.float32)[y]
        for t in range(1, 151):
            g = x.T @ (self._softmax(x @ w) - hot) / len(x) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return w

    def share(self, family: str, words: list[str]) -> float:
        """The largest share of a template's 2-grams that the words hold."""
        have = set(zip(words, words[1:], strict=False))
        return max(len(t & have) / max(1, len(t)) for t in self.pairs[family])

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, their rows in the weights, 2-gram hashes, their rows), each sorted by hash."""
        one = {g: k for g, k in self.vocab.items() if " " not in g}
        h = word_hashes(list(one))
        two = [(g.split(" "), k) for g, k in self.vocab.items() if " " in g]
        b = pair_hash(word_hashes([x for (x, _), _ in two]), word_hashes([y for (_, y), _ in two]))
        out = []
        for keys, rows in ((h, list(one.values())), (b, [k for _, k in two])):
            order = np.argsort(keys)
            out += [keys[order], np.array(rows)[order]]
        return tuple(out)

    def classify(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(family or the unknown class, its probability) from rows of summed weights."""
        p = self._softmax(x / self.temperature)
        k = p[:, :-1].argmax(axis=1)
        best = p[np.arange(len(p)), k]
        unknown = (best < self.least) | (best < p[:, -1])
        return np.where(unknown, len(self.classes) - 1, k), np.where(unknown, p[:, -1], best)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes that `textcore.Words` gives to these words."""
    return tc.Words(*tc.column_bytes(pa.array(words, pa.string()))).hash


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tc.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def _rows(keys: np.ndarray, rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash in sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, rows[at], -1)


def windows(w: tc.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last word + 1) of the windows of all lines, then of paragraphs of several lines."""
    feed = np.append(0, np.cumsum(w.low == 10))
    line = feed[w.start]
    other = np.concatenate([[True], w.doc[1:] != w.doc[:-1]])
    step = np.append(0, np.diff(line))
    starts, ends = [], []
    lines = np.flatnonzero(other | (step > 0))
    for new in (lines, np.flatnonzero(other | (step > 1))):
        end = np.append(new[1:], len(line))
        if new is not lines:
            many = np.searchsorted(lines, end) - np.searchsorted(lines, new) > 1
            new, end = new[many], end[many]
        n = np.maximum(-(-(end - new - WINDOW) // (WINDOW // 2)), 0) + 1
        s = np.repeat(new, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW // 2)
        starts.append(s)
        ends.append(np.minimum(s + WINDOW, np.repeat(end, n)))
    return np.concatenate(starts), np.concatenate(ends)


def scan_chunk(model: Model, data: np.ndarray, off: np.ndarray) -> dict[int, list]:
    """(family, probability) of the confirmed windows of each text."""
    w = tc.Words(data, off)
    found: dict[int, list] = {}
    if not len(w.hash):
        return found
    one, one_row, two, two_row = model.hashed_
    start, end = windows(w)
    pair = np.append(_rows(two, two_row, pair_hash(w.hash[:-1], w.hash[1:])), -1)
    known = np.append(0, np.cumsum(pair >= 0))
    some = np.flatnonzero(known[end - 1] > known[start])
    single = _rows(one, one_row, w.hash)
    for part in np.array_split(some, -(-len(some) // 4096)) if len(some) else ():
        s, e = start[part], end[part]
        n = e - s
        which = np.repeat(np.arange(len(part)), n)
        at = np.arange(n.sum()) + np.repeat(s - (np.cumsum(n) - n), n)
        rows = np.concatenate([single[at], np.where(at + 1 < e[which], pair[at], -1)])
        key = (np.concatenate([which, which]) * len(model.weights) + rows)[rows >= 0]
        key = np.unique(key)
        which, rows = key // len(model.weights), key % len(model.weights)
        size = np.bincount(which, minlength=len(part))
        x = np.add.reduceat(model.weights[rows], np.cumsum(size) - size, axis=0) / np.sqrt(size)[:, None] + model.weights[-1]
        family, p = model.classify(x)
        for k in np.flatnonzero(family < len(model.classes) - 1).tolist():
            name, doc = model.classes[family[k]], int(w.doc[s[k]])
            if model.share(name, [w.text(i) for i in range(s[k], e[k])]) >= CONFIRM:
                found.setdefault(doc, []).append((name, float(p[k])))
    return found


def train(docs: DataFrame) -> Model:
    ids = docs.where(F.col("text").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEGATIVE_TEXTS)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id").orderBy("doc_id", "text").limit(NEGATIVE_TEXTS).toLocalIterator()
    negatives = []
    for r in sample:
        for line in r.text.split("\n"):
            if len(negatives) < 4 * NEGATIVES:
                negatives.append(words_of(line)[:WINDOW])
    return Model([n for n in negatives if n])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, licences, best, probability, n_matches) of every row (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found: dict[int, list] = {}
            for i, _, data, off in tc.chunks(b.column(1)):
                found |= {i + d: x for d, x in scan_chunk(shared.value, data, off).items()}
            rows = [found.get(k, []) for k in range(b.num_rows)]
            best = [min(x, key=lambda y: (-y[1], y[0])) if x else (None, None) for x in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted({f for f, _ in x}) for x in rows], pa.list_(pa.string())), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64()), pa.array([len(x) for x in rows], pa.int64())], names=["doc_id", "licences", "best", "probability", "n_matches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licences array<string>, best string, probability double, n_matches long")


def op9_licences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
