"""Licence scan by a trained paragraph classifier.

Whole names of licences and runs of six words of licence texts make the candidates in a paragraph's sentences. A sparse
logistic regression over n-grams, of the candidate's own words and of those around it, decides whether a candidate states a
licence and of which family, or is of the unknown class. It is trained on templates (names in notices, and licence texts)
and on the same names put into paragraphs of the corpus; notices that no training row uses calibrate it by a temperature. A
prediction counts if it is the family whose template the candidate's words are: what the templates cannot confirm would
be unknown in any case, so only candidates are classified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudospark.llm.training import TEXT_BYTES
from pseudospark.llm.words import ALPHANUMERIC, Words, find_words, gram_hashes, pieces, text_column

# Names of licences, notices with a name in them, and texts, by family.
NAMES = {
    "mit": "MIT License, MIT licence, MIT, MIT/X11 license, Expat License, opensource.org/licenses/MIT",
    "apache-2.0": "Apache License, Apache licence, Apache License Version 2.0, Apache 2.0, Apache-2.0 license, Apache Software License, "
    "apache.org/licenses/LICENSE-2.0",
    "gpl": "GNU General Public License, General Public License, GNU GPL, GPL, GPLv2, GPLv3, GPL version 3, GPL-2.0-only, "
    "GPL-3.0-or-later, gnu.org/licenses/gpl",
    "lgpl": "GNU Lesser General Public License, Lesser General Public License, GNU Library General Public License, GNU LGPL, LGPL, "
    "LGPLv2, LGPLv3, LGPL version 3, LGPL-2.1-or-later, gnu.org/licenses/lgpl",
    "agpl": "GNU Affero General Public License, Affero General Public License, GNU AGPL, AGPL, AGPLv3, AGPL version 3, AGPL-3.0-only, "
    "gnu.org/licenses/agpl",
    "bsd": "BSD License, BSD licence, BSD, BSD 3-Clause, BSD 2-Clause, BSD-3-Clause License, BSD-style license, "
    "opensource.org/licenses/BSD",
    "mpl-2.0": "Mozilla Public License, Mozilla Public Licence, MPL 2.0, MPL, MPL-2.0, mozilla.org/MPL",
    "isc": "ISC License, ISC licence, ISC, opensource.org/licenses/ISC",
    "cc-by": "CC BY, CC BY 4.0, Creative Commons Attribution, Creative Commons Attribution 4.0, creativecommons.org/licenses/by",
    "cc-by-sa": "CC BY-SA, CC BY-SA 4.0, Creative Commons Attribution-ShareAlike, creativecommons.org/licenses/by-sa",
    "cc-by-nc": "CC BY-NC, CC BY-NC 4.0, Creative Commons Attribution-NonCommercial, creativecommons.org/licenses/by-nc",
    "cc-by-nd": "CC BY-ND, CC BY-ND 4.0, Creative Commons Attribution-NoDerivatives, creativecommons.org/licenses/by-nd",
    "cc0": "CC0, CC0 1.0, Creative Commons Zero, creativecommons.org/publicdomain/zero",
    "unlicense": "Unlicense, unlicense.org",
    "proprietary": "All rights reserved, Alle Rechte vorbehalten, Tous droits r\u00e9serv\u00e9s, Todos los derechos reservados",
}
NOTICES = (
    "Released under the {}.", "Licensed under {}.", "Licensed under the {}.", "This work is licensed under the {}.", "License: {}",
    "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "Available under the {}.", "This code is {} licensed.",
    "{}", "See the {} for details.", "Choose either the {}.", "Or, if you wish, take the {}.", "Published under a {}.",
    "It is under the {}.", "Subject to the terms of the {}.", "All of it may be used under {}.", "You may copy it under the terms of the {} if you like.",
    "This program is free software under the {}, version 3.", "Released under {} and no other.",
)
#: Notices that calibrate and are not trained on.
HELD_BACK = (
    "The source is available under {}.", "May be copied under the conditions of the {}.", "Copying is governed by the {}.",
    "Provided under {}, without any warranty.", "License of this package: {}",
)
RIGHTS = ("{}.", "Copyright by the authors. {}.", "Copyright 2020, the publisher, {}.", "\u00a9 2019 {}", "(c) the authors. {}")
RIGHTS_HELD_BACK = ("Copyright \u00a9 by the owner - {}.", "All contents copyright, {}!")
TEXTS = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation.",
    ),
    "agpl": (
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: redistributions of source code must retain the above copyright notice.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
UNKNOWN = "unknown"
#: Words of a licence text that make a candidate.
RUN = 6
#: Candidates of one family that lie no further apart are one.
GAP = 2
#: Words on each side of a candidate, inside its sentence, that are looked at.
CONTEXT = 8
#: Documents whose paragraphs stand for the unknown class, and training rows made for each family, with and without notice.
SAMPLE_DOCUMENTS = 300
SAMPLE_PARAGRAPHS = 3000
POSITIVES, NEGATIVES = 240, 240
#: Least probability of a family.
PROBABLE = 0.5
#: Tokens for words that no template has, and for the ends of a sentence.
OTHER, BEGIN, END = 0, 1, 2


@dataclass
class Templates:
    """Words of the templates, and the hashes of names and of runs of words, by number of words, with their families."""

    words: set[int]
    hashes: dict[int, np.ndarray]
    families: dict[int, np.ndarray]


@dataclass
class Candidate:
    """Words ``first`` to ``last`` (exclusive) that are a family's, and the bounds of what is looked at around them."""

    first: int
    last: int
    family: int
    begin: int
    end: int
    begins_sentence: bool
    ends_sentence: bool


@dataclass
class Classifier:
    families: list[str]  # the unknown class last
    features: dict[tuple, int]
    weights: np.ndarray  # features and intercept x families
    temperature: float
    templates: Templates

    def probabilities(self, keys: list[tuple]) -> np.ndarray:
        places = [self.features[k] for k in keys if k in self.features]
        odds = self.weights[places].sum(axis=0) / max(1, len(keys)) ** 0.5 + self.weights[-1]
        return _softmax(odds / self.temperature)

    def judge(self, words: Words, candidate: Candidate) -> tuple[str, float]:
        """Family of a candidate and its probability; unknown if the prediction is not the family of its template."""
        probability = self.probabilities(_features(self.templates, words, candidate))
        best = int(probability.argmax())
        if best != candidate.family or probability[best] < PROBABLE:
            return UNKNOWN, float(probability[-1])
        return self.families[best], float(probability[best])

    def notices(self, text: str) -> list[tuple[str, float]]:
        """Family (or unknown) and probability of each candidate in a text."""
        data = np.frombuffer(text.encode(), np.uint8)
        words = find_words(data, np.array([0, len(data)]), ALPHANUMERIC)
        return [self.judge(words, c) for c in _candidates(self.templates, words, data)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _words(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words of texts, and the bytes as they are written."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    return find_words(data, np.cumsum([0, *(len(t) for t in encoded)]), ALPHANUMERIC), data


def _templates() -> Templates:
    words: set[int] = set()
    found: dict[int, dict[int, int]] = {}
    shared: set[tuple[int, int]] = set()
    for number, family in enumerate(NAMES):
        for text in NAMES[family].split(", "):
            own, _ = _words([text])
            n = len(own.hash)
            found.setdefault(n, {})[int(gram_hashes(own, n)[0])] = number
            words.update(own.hash.tolist())
        for text in TEXTS.get(family, ()):
            own, _ = _words([text])
            words.update(own.hash.tolist())
            for run in gram_hashes(own, RUN).tolist():
                # A run that texts of two families have tells neither.
                if found.setdefault(RUN, {}).setdefault(run, number) != number:
                    shared.add((RUN, run))
    for n, run in shared:
        del found[n][run]
    for text in (*NOTICES, *RIGHTS):
        words.update(_words([text.replace("{}", " ")])[0].hash.tolist())
    hashes = {n: np.array(sorted(known), np.uint64) for n, known in found.items()}
    return Templates(words, hashes, {n: np.array([found[n][h] for h in hashes[n].tolist()]) for n in hashes})


def _lines(words: Words) -> np.ndarray:
    """Number of the paragraph of each word, counted over the run of texts."""
    line = np.cumsum(words.data == 10)[words.start]
    return np.cumsum(np.r_[0, (words.text[1:] != words.text[:-1]) | (line[1:] != line[:-1])])


def _sentences(words: Words) -> np.ndarray:
    """Number of the sentence of each word, counted over the run of texts."""
    data = words.data
    space = np.r_[(data[1:] == 32) | ((data[1:] >= 9) & (data[1:] <= 13)), True]
    breaks = np.cumsum((data == 10) | (np.isin(data, np.frombuffer(b".!?;", np.uint8)) & space))[words.start]
    return np.cumsum(np.r_[0, (words.text[1:] != words.text[:-1]) | (breaks[1:] != breaks[:-1])])


def _candidates(templates: Templates, words: Words, raw: np.ndarray) -> list[Candidate]:
    """Spans of template words inside sentences; of spans that overlap the longest."""
    if not len(words.start):
        return []
    spans: list[tuple[int, int, int]] = []
    sentence = None
    for n, known in templates.hashes.items():
        grams = gram_hashes(words, n)
        if not len(grams):
            continue
        place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        at = np.flatnonzero(known[place] == grams)
        if n == 1 and len(at):
            # Short names are words of other languages: they count as they are written, in capitals.
            second = raw[np.minimum(words.start[at] + 1, len(raw) - 1)]
            named = (raw[words.start[at]] >= 65) & (raw[words.start[at]] <= 90)
            at = at[named & (((second >= 65) & (second <= 90)) | (words.end[at] - words.start[at] > 6))]
        if not len(at):
            continue
        if sentence is None:
            sentence = _sentences(words)
        at = at[sentence[at] == sentence[at + n - 1]]
        spans += [(i, i + n, f) for i, f in zip(at.tolist(), templates.families[n][place[at]].tolist())]
    if not spans:
        return []
    merged: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda x: (x[2], x[0])):
        last = merged[-1] if merged else None
        if last and last[2] == span[2] and span[0] <= last[1] + GAP and sentence[last[0]] == sentence[span[0]]:
            merged[-1] = (last[0], max(last[1], span[1]), span[2])
        else:
            merged.append(span)
    kept: list[tuple[int, int, int]] = []
    for span in sorted(merged):
        while kept and kept[-1][1] > span[0] and kept[-1][1] - kept[-1][0] < span[1] - span[0]:
            kept.pop()
        if not kept or kept[-1][1] <= span[0]:
            kept.append(span)
    found = []
    for k, (first, last, family) in enumerate(kept):
        low = max(int(np.searchsorted(sentence, sentence[first])), kept[k - 1][1] if k else 0)
        high = min(int(np.searchsorted(sentence, sentence[first], "right")), kept[k + 1][0] if k + 1 < len(kept) else len(sentence))
        begin, end = max(low, first - CONTEXT), min(high, last + CONTEXT)
        begins = begin == 0 or sentence[begin - 1] != sentence[first]
        ends = end == len(sentence) or sentence[end] != sentence[first]
        found.append(Candidate(first, last, family, begin, end, begins, ends))
    return found


def _features(templates: Templates, words: Words, c: Candidate) -> list[tuple]:
    """N-grams of a candidate's own words, of what is around it, and across its two ends."""

    def tokens(a: int, b: int) -> list[int]:
        return [h if h in templates.words else OTHER for h in words.hash[a:b].tolist()]

    own = words.hash[c.first : c.last].tolist()
    left = [BEGIN] * int(c.begins_sentence) + tokens(c.begin, c.first)
    right = tokens(c.last, c.end) + [END] * int(c.ends_sentence)
    keys = [("own", w) for w in set(own)] + [("own", a, b) for a, b in zip(own, own[1:])]
    keys += [("around", w) for w in {*left, *right} - {OTHER}]
    keys += [("length", min(len(own), RUN))]
    keys += [("left", *left[-n:]) for n in (1, 2) if len(left) >= n]
    keys += [("right", *right[:n]) for n in (1, 2) if len(right) >= n]
    keys += [("into", left[-1], own[0])] if left else []
    keys += [("out", own[-1], right[0])] if right else []
    return keys + ([("sides", left[-1], right[0])] if left and right else [])


def _examples(draw: np.random.Generator, prose: list[list[str]]) -> tuple[list[str], list[int], list[bool]]:
    """Texts, the family that each states (or the number of families), and whether a text is one that calibrates."""
    texts, labels, held = [], [], []

    def some(most: int) -> str:
        line = prose[int(draw.integers(len(prose)))]
        first = int(draw.integers(0, max(1, len(line) - most)))
        return " ".join(line[first : first + int(draw.integers(1, most + 1))])

    def pick(options):
        return options[int(draw.integers(len(options)))]

    def add(text: str, label: int, calibrates: bool) -> None:
        texts.append(text)
        labels.append(label)
        held.append(calibrates)

    for number, family in enumerate(NAMES):
        names = NAMES[family].split(", ")
        frames = (RIGHTS, RIGHTS_HELD_BACK) if family == "proprietary" else (NOTICES, HELD_BACK)
        for k in range(POSITIVES):
            back = bool(draw.random() < 0.2)
            name, notice = pick(names) if k >= len(names) else names[k], pick(frames[back])
            if notice == "{}" and not set(" /-.") & set(name):
                # A short name that stands alone states nothing: it may be any word in capitals.
                add(name if draw.random() < 0.5 else f"{some(12)}. {name}. {some(12)}", len(NAMES), bool(back))
                continue
            said = notice.format(name)
            if draw.random() < 0.3:
                said = f"{some(12)}, {said[0].lower()}{said[1:]}" if said[:1].isalpha() and said[1:2].islower() else said
            if draw.random() < 0.2:
                said = f"{said.rstrip('.')} {pick(('and', 'or', 'as', 'for', 'which'))} {some(12)}"
            add(f"{some(12)}. {said} {some(12)}" if draw.random() < 0.3 and said.endswith(".") else said, number, back)
        for text in TEXTS.get(family, ()):
            parts = text.split()
            for _ in range(POSITIVES // 4):
                first = int(draw.integers(0, max(1, len(parts) - 8)))
                said = " ".join(parts[first : first + int(draw.integers(8, max(9, len(parts)) + 1))])
                add(said if draw.random() < 0.5 else f"{some(8)}. {said} {some(8)}", number, draw.random() < 0.2)
        short = [n for n in names if "/" not in n]
        for _ in range(NEGATIVES):
            before = some(10) if draw.random() < 0.7 else ""
            add(f"{before} {pick(short)} {some(10)}", len(NAMES), draw.random() < 0.2)
    return texts, labels, held


def trained(paragraphs: list[str], seed: int = 5) -> Classifier:
    """A classifier from the templates and paragraphs of a corpus, most of which name no licence."""
    draw = np.random.default_rng(seed)
    templates = _templates()
    # Words around notices of the corpus itself are no example of what names none.
    data = [p for p in paragraphs if len(p.split()) > 1]
    words, raw = _words([f"{p}\n" for p in data])
    named = {int(words.text[c.first]) for c in _candidates(templates, words, raw)} if data else set()
    prose = [p.split() for i, p in enumerate(data) if i not in named] or [["a", "line", "of", "prose"]]
    texts, labels, held = _examples(draw, prose)
    words, raw = _words([f"{t}\n" for t in texts])
    rows, y, back = [], [], []
    for c in _candidates(templates, words, raw):
        text = int(words.text[c.first])
        if labels[text] in (c.family, len(NAMES)):
            rows.append(_features(templates, words, c))
            y.append(labels[text])
            back.append(held[text])
    y, back = np.array(y), np.array(back)
    counts: dict[tuple, int] = {}
    for row, b in zip(rows, back):
        if not b:
            for key in row:
                counts[key] = counts.get(key, 0) + 1
    features = {key: i for i, key in enumerate(sorted((k for k, n in counts.items() if n > 1), key=repr))}
    x = np.zeros((len(rows), len(features) + 1), np.float32)
    for i, row in enumerate(rows):
        x[i, [features[k] for k in row if k in features]] = len(row) ** -0.5
    x[:, -1] = 1
    target = np.eye(len(NAMES) + 1, dtype=np.float32)[y]
    w = np.zeros((len(features) + 1, len(NAMES) + 1), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    fit, goal = x[~back], target[~back]
    for step in range(1, 121):
        slope = fit.T @ (_softmax(fit @ w) - goal) / len(fit) + 1e-5 * w
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        w -= (0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    odds, right = x[back] @ w, y[back]
    loss = {t: -np.log(_softmax(odds / t)[np.arange(len(right)), right] + 1e-9).mean() for t in (0.5, 0.7, 1.0, 1.5, 2.0, 3.0)}
    return Classifier([*NAMES, UNKNOWN], features, w, min(loss, key=loss.get), templates)


def _scan(model: Classifier):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch, "text")
            found: list[list[tuple[str, float]]] = [[] for _ in range(len(batch))]
            confirmed: list[set[int]] = [set() for _ in range(len(batch))]
            for first, last in pieces(offsets):
                words = find_words(data, offsets[first : last + 1], ALPHANUMERIC)
                candidates = _candidates(model.templates, words, data[int(offsets[first]) : int(offsets[last])])
                if not candidates:
                    continue
                paragraph = _lines(words)
                for c in candidates:
                    name, probability = model.judge(words, c)
                    if name != UNKNOWN:
                        row = first + int(words.text[c.first])
                        found[row].append((name, probability))
                        confirmed[row].add(int(paragraph[c.first]))
            families = [sorted({n for n, _ in f}) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([max(f, key=lambda x: (x[1], x[0]))[0] if f else UNKNOWN for f in found], pa.string()),
                    pa.array([max((p for _, p in f), default=0.0) for f in found], pa.float64()),
                    pa.array([",".join(f) for f in families], pa.string()),
                    pa.array([len(c) for c in confirmed], pa.int64()),
                ],
                ["doc_id", "license", "score", "families", "n_paragraphs"],
            )

    return scan


def corpus_paragraphs(docs: DataFrame) -> list[str]:
    """Paragraphs of a bounded sample of documents, drawn by a hash of their id and text; long texts are left out."""
    usable = (
        docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
        .where(F.octet_length("text") <= TEXT_BYTES)
        .withColumn("order", F.xxhash64("id", "text"))
    )
    # Hashes alone find the bound; only the texts below it leave the executors.
    bound = usable.select("order").orderBy("order").limit(SAMPLE_DOCUMENTS).agg(F.max("order")).first()[0]
    rows = usable.where(F.col("order") <= F.lit(bound).cast("long")).limit(SAMPLE_DOCUMENTS).collect()
    lines = sorted({line for r in rows for line in r.text.split("\n") if line.strip()})
    step = max(1, -(-len(lines) // SAMPLE_PARAGRAPHS))
    return lines[::step]


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, license, score, families, n_paragraphs`` for each row of ``docs`` (``doc_id, text``).

    ``license`` is the family of the surest confirmed paragraph (``unknown`` if there is none), ``score`` its calibrated
    probability (else 0), ``families`` all confirmed families, sorted and joined by commas, ``n_paragraphs`` how many
    paragraphs were confirmed. Whole texts are scanned; null and empty ones have no paragraphs. Repeated rows are scanned
    each by itself, ids may be null; other columns are ignored; an empty table gives no rows.
    """
    model = trained(corpus_paragraphs(docs))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_scan(model), f"doc_id {kind}, license string, score double, families string, n_paragraphs long")
