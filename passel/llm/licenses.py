"""Licence statements in texts: a trained paragraph classifier finds them, a comparison with templates confirms them.

Every line and every window of 6, 12 and 24 words of a paragraph is classified. Where the classifier gives a family some
probability, the words around are compared with that family's templates. What agrees is confirmed; what the classifier
takes for a licence and no template confirms is reported as unconfirmed, or as unknown where the words that tell
licences apart are another's.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passel.llm.tables import tidy

UNKNOWN = "unknown"

# Customary wordings of licence statements, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GPL, version 2 or later.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the 3-clause BSD License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "boost-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty.",
        "Licensed under the zlib license.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain.",
        "Released under CC0 1.0 Universal.",
    ],
    "all-rights-reserved": ["All rights reserved.", "Copyright 2020 by the authors. All rights reserved.", "No part of this work may be reproduced without permission."],
}
# Sentences that share words with licences and are none.
OTHERS = [
    "The driver lost the license after the accident and may not use the car.",
    "All rights of the people are protected by the general public.",
    "The work is free and the public may use it at any time.",
    "A new version of the software was released under the old name.",
    "The committee reserved a room under the name of the foundation.",
    "Permission to enter the building was granted by the general.",
    "The terms of the agreement are subject to review.",
    "The source of the river is in the public park and the commons.",
]

NGRAM = 3
# Paragraphs of the corpus that the unknown class is fitted on, and the documents that they come from, at most.
SAMPLE_PARAGRAPHS = 2000
SAMPLE_DOCS = 300
SAMPLE_WORDS = 24
VARIANTS = 40
# Lengths in words of the windows that are classified; they start at every half length. Longer lines have windows only.
WINDOWS = (6, 12, 24)
LINE_WORDS = 64
# Words of a paragraph that are classified at once, a multiple of all starts.
BLOCK_WORDS = 12 * 1024
# The probability from which a window is compared with a family's templates, and that from which one that no family is
# sure of is reported as unknown.
LEAST_CHANCE = 0.05
LEAST_DOUBT = 0.25
# A family needs this calibrated probability, and this share of a template's words in order.
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.8
# Words that tell licences apart. A passage must have those of its template, and none of the others in
# the middle of what it shares with it.
MARKS = set(
    "apache 2.0 www.apache.org license-2.0 mit gnu gpl lesser bsd mozilla cc by by-nc by-sa attribution attribution-noncommercial "
    "attribution-sharealike cc0 eclipse boost 1.0 zlib unlicense".split()
)
QUALIFIERS = set("affero lesser noncommercial sharealike noderivs noderivatives nc nd sa".split())
# Longer gaps hold something else, such as another licence.
GAP_WORDS = 3
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def ngrams(words: list[str], known: set[str]) -> Iterator[str]:
    """The runs of up to ``NGRAM`` words that hold only known words."""
    for i, word in enumerate(words):
        if word not in known:
            continue
        yield word
        gram = word
        for after in words[i + 1 : i + NGRAM]:
            if after not in known:
                break
            gram = f"{gram} {after}"
            yield gram


def similarity(words: list[str], template: list[str]) -> float:
    """The share of the template's words that the paragraph has in the same order."""
    blocks = SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


def marked(words: list[str], template: list[str], blocks: list) -> bool:
    """Whether words that agree with a template in ``blocks`` have its marks and no other qualifier between them."""
    matched = {w for b in blocks for w in words[b.a : b.a + b.size]}
    for one, two in zip(blocks, blocks[1:]):
        gap = words[one.a + one.size : two.a]
        if len(gap) > GAP_WORDS:
            continue
        matched.update(w[1:] for w in gap if w.startswith("v"))
        before = words[one.a + one.size - 1]
        if any(w in QUALIFIERS or w.startswith(("by-", "attribution-")) for w in gap if w not in template) or (before == "gnu" and gap[:1] == ["library"]):
            return False
    return MARKS.intersection(template) <= matched


class Finding(NamedTuple):
    """Line that a statement begins in, family or unknown, the likeliest family, the classifier's probabilities of it and
    of the unknown class, and the similarity with the family's nearest template (0 if unknown)."""

    paragraph: int
    family: str
    nearest: str
    probability: float
    unknown: float
    similarity: float


class LicenceModel:
    """Multinomial logistic regression over counts of sparse word n-grams, with a temperature that calibrates it."""

    def __init__(self, others: list[str], seed: int = 5):
        chance = random.Random(seed)
        self.families = [*TEMPLATES, UNKNOWN]
        self.templates = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.known = {w for ts in self.templates.values() for t in ts for w in t}
        rows = [(self._varied(t, others, chance), f) for f, ts in self.templates.items() for t in ts for _ in range(VARIANTS)]
        # Windows see parts of long statements, too.
        long = [(t, f) for f, ts in self.templates.items() for t in ts if len(t) > WINDOWS[0]]
        rows += [(self._part(t, chance), f) for t, f in long for _ in range(VARIANTS // 2)]
        plain = [words_of(o) for o in OTHERS for _ in range(VARIANTS // 4)]
        plain += [w for o in others if (w := words_of(o)) and self.best(w)[1] < LEAST_SIMILARITY / 2]
        # Words of licences out of order are no licence.
        pool = sorted(self.known)
        plain += [chance.sample(pool, chance.randrange(2, 9)) for _ in range(VARIANTS * 4)]
        rows += [(w, UNKNOWN) for w in plain]
        chance.shuffle(rows)
        grams = sorted({g for words, _ in rows for g in ngrams(words, self.known)})
        self.index = {g: i for i, g in enumerate(grams)}
        y = np.array([self.families.index(f) for _, f in rows])
        held = np.arange(len(rows)) % 5 == 0
        features = [self.features(words) for words, _ in rows]
        self.temperature = 1.0
        self._fit([f for f, h in zip(features, held) if not h], y[~held])
        self._calibrate([f for f, h in zip(features, held) if h], y[held])
        self._number()

    def _number(self) -> None:
        """Numbers of words and of their pairs and triples, to score all places of a paragraph at once."""
        self.word = {w: i for i, w in enumerate(sorted(self.known))}
        self.table = np.vstack([self.weights, np.zeros(len(self.families))])
        self.codes = []
        for n in range(1, NGRAM + 1):
            own = sorted((self._code([self.word[w] for w in g.split(" ")]), i) for g, i in self.index.items() if g.count(" ") == n - 1)
            self.codes.append((np.array([c for c, _ in own] or [-1]), np.array([i for _, i in own] or [len(self.index)])))

    def _code(self, numbers: Sequence) -> int | np.ndarray:
        code = 0
        for number in numbers:
            code = code * len(self.word) + number
        return code

    @staticmethod
    def _part(template: list[str], chance: random.Random) -> list[str]:
        size = chance.randrange(WINDOWS[0], len(template) + 1)
        start = chance.randrange(len(template) - size + 1)
        return template[start : start + size]

    @staticmethod
    def _varied(template: list[str], others: list[str], chance: random.Random) -> list[str]:
        """A template with a word lost or spoilt now and then, and other words around it."""
        words = [w if chance.random() > 0.04 else w[:-1] + "x" for w in template if chance.random() > 0.04]
        around = words_of(chance.choice(others)) if others else words_of(chance.choice(OTHERS))
        cut = chance.randrange(len(around) + 1) if around and chance.random() < 0.3 else 0
        return around[:cut][-12:] + words + (around[cut:][:12] if cut else [])

    def features(self, words: list[str]) -> list[int]:
        return sorted(i for g in ngrams(words, self.known) if (i := self.index.get(g)) is not None)

    def _scores(self, features: list[list[int]]) -> np.ndarray:
        out = np.tile(self.bias, (len(features), 1))
        for row, own in zip(out, features):
            if own:
                row += self.weights[own].sum(axis=0)
        return out

    def _fit(self, features: list[list[int]], y: np.ndarray, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> None:
        x = np.zeros((len(features), len(self.index) + 1), np.float32)
        for row, own in zip(x, features):
            np.add.at(row, own, 1)
        x[:, -1] = 1
        target = np.eye(len(self.families), dtype=np.float32)[y]
        weights, speed = np.zeros((x.shape[1], len(self.families)), np.float32), 0.0
        for _ in range(rounds):
            scores = x @ weights
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed + x.T @ (target - p) / len(x) - ridge * weights
            weights += rate * speed * 0.1
        self.weights, self.bias = weights[:-1].astype(float), weights[-1].astype(float)

    def _calibrate(self, features: list[list[int]], y: np.ndarray) -> None:
        """The temperature of least log loss on rows that were held out."""
        scores = self._scores(features)

        def loss(t: float) -> float:
            s = scores / t - (scores / t).max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

        self.temperature = min((0.25 * 1.25**i for i in range(16)), key=loss)

    def _chances(self, scores: np.ndarray) -> np.ndarray:
        scores = scores / self.temperature
        p = np.exp(scores - scores.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    def classify(self, words: list[str]) -> tuple[str, float]:
        """The likeliest family and its probability; unknown where no known word stands."""
        p = self._chances(self._scores([self.features(words)])[0])
        best = int(np.argmax(p))
        return self.families[best], float(p[best])

    def window_chances(self, words: list[str], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The probabilities of all families for windows of ``words``: what ``classify`` works out for each of them."""
        return self._chances(self._window_scores(words, starts, ends))

    def _window_scores(self, words: list[str], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        numbers = np.fromiter((self.word.get(w, -1) for w in words), np.int64, len(words))
        scores = np.tile(self.bias, (len(starts), 1))
        for n, (codes, rows) in enumerate(self.codes):
            # Places where a run of n + 1 known words begins.
            known = numbers >= 0
            for i in range(1, n + 1):
                known = known[:-1] & (numbers[i:] >= 0)
            (places,) = np.nonzero(known)
            code = self._code([numbers[places + i] for i in range(n + 1)])
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            places, at = places[hit], at[hit]
            sums = np.zeros((len(places) + 1, len(self.families)))
            np.cumsum(self.table[rows[at]], axis=0, out=sums[1:])
            # Grams that begin and end in the window.
            low, high = np.searchsorted(places, starts), np.searchsorted(places, np.maximum(ends - n, starts))
            (some,) = np.nonzero(low < high)
            scores[some] += sums[high[some]] - sums[low[some]]
        return scores

    def compare(self, words: list[str], family: str) -> float:
        return max(similarity(words, t) for t in self.templates[family])

    def best(self, words: list[str]) -> tuple[str, float]:
        """The family of the template that is most like a paragraph."""
        return max(((f, self.compare(words, f)) for f in self.templates), key=lambda b: b[1])

    def passage(self, words: list[str], start: int, end: int, template: list[str]) -> tuple[int, int, float, list[str], bool] | None:
        """First place, end, similarity and common words of what agrees with a template in or around a window, and
        whether it has the words that tell the licence apart."""
        low = max(start - len(template), 0)
        near = words[low : end + len(template)]
        least = LEAST_SIMILARITY * len(template) - 1e-9
        have = set(near)
        if sum(w in have for w in template) < least:
            return None
        blocks = SequenceMatcher(None, near, template, autojunk=False).get_matching_blocks()[:-1]
        if sum(b.size for b in blocks) < least:
            return None
        first, last = blocks[0].a, blocks[-1].a + blocks[-1].size
        if last - first > 2 * len(template) + 2:
            return None
        common = [w for b in blocks for w in near[b.a : b.a + b.size]]
        return low + first, low + last, len(common) / len(template), common, marked(near, template, blocks)

    @staticmethod
    def _windows(paragraphs: list[list[tuple[int, list[str]]]]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines and windows of paragraphs whose words are put one behind the other, by start."""
        lines = np.array([len(own) for lines in paragraphs for _, own in lines])
        n = np.array([sum(len(own) for _, own in lines) for lines in paragraphs])
        base = np.cumsum(n) - n
        short = lines <= LINE_WORDS
        starts, sizes = [(np.cumsum(lines) - lines)[short]], [lines[short]]
        for size in WINDOWS:
            count = -(-np.maximum(n - size, 0) // (size // 2)) + 1
            own = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts.append(np.repeat(base, count) + own * (size // 2))
            sizes.append(np.minimum(size, np.repeat(base + n, count) - starts[-1]))
        codes = np.unique(np.concatenate(starts) * (LINE_WORDS + 1) + np.concatenate(sizes))
        return codes // (LINE_WORDS + 1), codes // (LINE_WORDS + 1) + codes % (LINE_WORDS + 1)

    def _paragraphs(self, paragraphs: list[list[tuple[int, list[str]]]]) -> Iterator[list[Finding]]:
        """The findings of each of some paragraphs, which are classified together."""
        texts = [[w for _, own in lines for w in own] for lines in paragraphs]
        words = [w for own in texts for w in own]
        starts, ends = self._windows(paragraphs)
        cuts = np.searchsorted(starts, np.arange(0, len(words), BLOCK_WORDS))
        suspects = [[] for _ in paragraphs]
        base = np.cumsum([len(own) for own in texts]) - [len(own) for own in texts]
        for block, (one, two) in enumerate(zip(cuts, [*cuts[1:], len(starts)])):
            low = block * BLOCK_WORDS
            scores = self._window_scores(words[low : low + BLOCK_WORDS + LINE_WORDS], starts[one:two] - low, ends[one:two] - low)
            # A family of at least this chance is not much less likely than the unknown class.
            (rows,) = np.nonzero(scores[:, :-1].max(axis=1) - scores[:, -1] >= self.temperature * np.log(LEAST_CHANCE))
            chances = self._chances(scores[rows])
            owners = np.searchsorted(base, starts[one:two][rows], side="right") - 1
            for start, end, owner, own in zip(starts[one:two][rows].tolist(), ends[one:two][rows].tolist(), owners.tolist(), chances):
                if own[:-1].max() >= LEAST_CHANCE:
                    suspects[owner].append((start - int(base[owner]), end - int(base[owner]), own))
        for lines, own, doubts in zip(paragraphs, texts, suspects):
            yield sorted(self._statements(lines, own, doubts)) if doubts else []

    def _statements(self, lines: list[tuple[int, list[str]]], words: list[str], suspects: list) -> Iterator[Finding]:
        """Confirmed passages of a paragraph, then what else is taken for a licence."""
        place = np.repeat([number for number, _ in lines], [len(own) for _, own in lines])
        passages, refused = self._compared(words, suspects)
        for first, _, family, p, unknown, share in passages:
            yield Finding(int(place[first]), family, family, p, unknown, share)
        yield from self._doubtful(words, place, suspects, refused, [(first, last) for first, last, *_ in passages])

    def _compared(self, words: list[str], suspects: list[tuple[int, int, np.ndarray]]) -> tuple[list[tuple], set[tuple[int, int]]]:
        """Passages that a template and the classifier give the same family, of those that overlap the most similar;
        and the places of passages like a template that have the name or version of another licence."""
        found, refused = {}, set()
        for start, end, chances in suspects:
            for number in np.nonzero(chances[:-1] >= LEAST_CHANCE)[0]:
                family = self.families[number]
                for template in self.templates[family]:
                    if not (hit := self.passage(words, start, end, template)):
                        continue
                    first, last, share, common, named = hit
                    if not named:
                        refused.add((first, last))
                        continue
                    p = self._chances(self._scores([self.features(common)])[0])
                    if p.argmax() == number and p[number] >= LEAST_PROBABILITY:
                        own = (first, last, family)
                        found[own] = max(found.get(own, (0.0,)), (share, float(p[number]), float(p[-1])))
        kept, taken = [], {}
        for (first, last, family), (share, p, unknown) in sorted(found.items(), key=lambda f: (-f[1][0], f[0])):
            if taken.setdefault(family, set()).isdisjoint(range(first, last)):
                taken[family].update(range(first, last))
                kept.append((first, last, family, p, unknown, share))
        return sorted(kept), refused

    def _doubtful(
        self, words: list[str], place: Sequence, suspects: list, refused: set[tuple[int, int]], covered: list[tuple[int, int]]
    ) -> Iterator[Finding]:
        """What the classifier takes for a licence outside of confirmed passages: refused passages, the longest first,
        then the surest windows; of those that overlap, one."""
        taken = {i for first, last in covered for i in range(first, last)}
        passages = [(s, e, self._chances(self._scores([self.features(words[s:e])])[0]), True) for s, e in sorted(refused, key=lambda r: (r[0] - r[1], r))]
        windows = [(s, e, c, False) for s, e, c in suspects if c[:-1].max() >= LEAST_DOUBT and e - s >= 3]
        for start, end, chances, other in passages + sorted(windows, key=lambda w: (-w[2][:-1].max(), w[:2])):
            if not taken.isdisjoint(range(start, end)):
                continue
            taken.update(range(start, end))
            number = int(chances[:-1].argmax())
            nearest, p = self.families[number], float(chances[number])
            share = self.compare(words[start:end], nearest)
            sure = not other and p >= LEAST_PROBABILITY and share < LEAST_SIMILARITY
            yield Finding(int(place[start]), nearest if sure else UNKNOWN, nearest, p, float(chances[-1]), share if sure else 0.0)

    def findings_of(self, texts: Iterable[str]) -> list[list[Finding]]:
        """For each text what looks like a licence, by paragraphs: runs of lines with words."""
        found, waiting, size = [], [], 0

        def classified() -> None:
            for (number, _), own in zip(waiting, self._paragraphs([lines for _, lines in waiting])):
                found[number].extend(own)
            waiting.clear()

        for number, text in enumerate(texts):
            found.append([])
            lines = []
            for place, line in enumerate([*text.split("\n"), ""]):
                if words := words_of(line):
                    lines.append((place, words))
                    size += len(words)
                elif lines:
                    waiting.append((number, lines))
                    lines = []
                    if size >= BLOCK_WORDS:
                        classified()
                        size = 0
        if waiting:
            classified()
        return found

    def findings(self, text: str) -> list[Finding]:
        return self.findings_of([text])[0]

    def scan(self, text: str) -> Iterator[tuple[int, str, float, float]]:
        """First line, family, probability and template similarity of the findings."""
        for found in self.findings(text):
            yield found.paragraph, found.family, found.probability, found.similarity


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> LicenceModel:
    """Fit on variants of the templates, and for the unknown class on runs of words of up to ``sample_docs`` documents.

    The documents are chosen by the hash of their id, and of their lines at most ``SAMPLE_PARAGRAPHS`` runs of up to
    ``SAMPLE_WORDS`` words by their own. Runs that are half like a template are left out.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("doc")).dropna().orderBy(F.xxhash64("doc"), "doc").limit(sample_docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).dropna()
    # Bounded by the parameters: no run has more than about forty characters a word.
    run = rf"(?:\S{{1,40}}[ \t]{{0,4}}){{1,{SAMPLE_WORDS}}}"
    runs = texts.join(F.broadcast(ids), "doc", "left_semi").select(F.explode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("run"))
    rows = runs.orderBy(F.xxhash64("run"), "run").limit(SAMPLE_PARAGRAPHS).collect()
    return LicenceModel([r.run for r in rows])


FOUND = "array<struct<paragraph:int,family:string,nearest:string,probability:double,unknown:double,similarity:double>>"
FOUND_TYPE = pa.list_(
    pa.struct(
        [
            ("paragraph", pa.int32()),
            ("family", pa.string()),
            ("nearest", pa.string()),
            ("probability", pa.float64()),
            ("unknown", pa.float64()),
            ("similarity", pa.float64()),
        ]
    )
)


def scan_licences(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence statement: a passage of a paragraph that the classifier takes for a licence.

    Paragraphs are runs of lines with words; a statement may be wrapped over several lines, and a line may hold
    several. ``doc_id``, ``paragraph`` (the number of the line that the statement begins in, from 0), ``family``,
    ``nearest`` (the likeliest family), ``probability`` (of that one), ``unknown`` (the probability of the unknown class)
    and ``similarity`` with the family's nearest template; ``confirmed`` if that is at least ``LEAST_SIMILARITY``. What
    agrees with a template except for the words that tell licences apart (Affero, ND, another version), and what no
    family has half of the probability of, is of family ``unknown``. The whole text is scanned; null and empty texts
    have no row. A repeated row gives its statements again; a null id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    @tidy
    def found(texts: pa.Array) -> pa.Array:
        found = shared.value.findings_of(t.as_py() or "" for t in texts)
        return pa.array([[f._asdict() for f in own] for own in found], FOUND_TYPE)

    hits = docs.select(F.col(f"`{id_col}`").alias("doc_id"), found(F.col(f"`{text_col}`")).alias("hits"))
    return hits.select("doc_id", F.inline("hits")).withColumn("confirmed", F.col("similarity") >= LEAST_SIMILARITY)
