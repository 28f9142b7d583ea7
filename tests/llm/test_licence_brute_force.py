"""The licence scan against every window, every template and the classifier, and its answers to what no template has."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow.parquet as pq
import pytest

from passel.llm import licenses
from passel.llm.licenses import LEAST_PROBABILITY, LEAST_SIMILARITY, OTHERS, TEMPLATES, UNKNOWN, marked, train, words_of
from passel.llm.registered import QUERIES


@pytest.fixture(scope="module")
def model(spark, tables):
    return train(spark.read.parquet(f"{tables}/documents.parquet"))


def every_window(model, text):
    """(line, family) of every stretch of words that is like a template and that the classifier gives the same family."""
    found, lines, out = [], [(n, words_of(x)) for n, x in enumerate(text.split("\n"))], set()
    paragraphs = [[]]
    for n, words in lines:
        paragraphs[-1].extend((n, w) for w in words)
        if not words:
            paragraphs.append([])
    for paragraph in paragraphs:
        place, words = [n for n, _ in paragraph], [w for _, w in paragraph]
        found = []
        for family, templates in model.templates.items():
            for template in templates:
                for start in range(len(words)):
                    near = words[start : start + 2 * len(template)]
                    blocks = SequenceMatcher(None, near, template, autojunk=False).get_matching_blocks()[:-1]
                    share = sum(b.size for b in blocks) / len(template)
                    if share < LEAST_SIMILARITY or not marked(near, template, blocks):
                        continue
                    got, p = model.classify([w for b in blocks for w in near[b.a : b.a + b.size]])
                    if got == family and p >= LEAST_PROBABILITY:
                        found.append((-share, start + blocks[0].a, start + blocks[-1].a + blocks[-1].size, family))
        kept = []
        for share, first, last, family in sorted(found):
            if all(family != f or last <= a or first >= b for a, b, f in kept):
                kept.append((first, last, family))
                out.add((place[first], family))
    return out


def confirmed(model, text):
    return {(f.paragraph, f.family) for f in model.findings(text) if f.similarity >= LEAST_SIMILARITY}


def test_query(spark, tables, model):
    docs = pq.read_table(f"{tables}/documents.parquet").to_pylist()
    got = {(r.doc_id, r.paragraph, r.family) for r in QUERIES["op4_licences"](spark, tables).collect() if r.confirmed}
    want = {(d["doc_id"], *hit) for d in docs for hit in every_window(model, d["text"] or "")}
    assert want and got == want


def test_spoilt_and_wrapped_statements(model):
    """Words lost, spoilt or put before and behind, at any place of a page, wrapped at any width."""
    chance = random.Random(17)
    filler = words_of(" ".join(OTHERS)) + ["page", "town", "river", "winter", "2004"]
    seen = 0
    for round_ in range(3):
        for templates in TEMPLATES.values():
            for template in templates:
                words = template.split()
                if round_:
                    words = [w for w in words if chance.random() > 0.06]
                around = [chance.choice(filler[-5:]) for _ in range(chance.randrange(60))]
                cut = chance.randrange(len(around) + 1)
                words = around[:cut] + words + around[cut:]
                width = chance.randrange(4, 20)
                text = "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
                want = every_window(model, text)
                assert confirmed(model, text) == want, text
                seen += bool(want)
    assert seen > 80


def test_window_chances_are_those_of_the_words(model):
    chance = random.Random(3)
    words = [w for t in TEMPLATES.values() for s in t for w in words_of(s)] + words_of(" ".join(OTHERS)) * 2
    chance.shuffle(words)
    words += words_of(TEMPLATES["mit"][2])
    starts = np.array([chance.randrange(len(words)) for _ in range(60)] + [0, len(words) - 1])
    ends = np.minimum(starts + np.array([chance.randrange(1, 30) for _ in starts]), len(words))
    for start, end, p in zip(starts, ends, model.window_chances(words, starts, ends)):
        family, best = model.classify(words[start:end])
        assert model.families[int(p.argmax())] == family and p.max() == pytest.approx(best)


def test_blocks_of_long_paragraphs(model, monkeypatch):
    text = ("page of the town " * 30 + TEMPLATES["gpl"][1] + " winter " * 40 + "All rights reserved. ") * 5
    whole = list(model.findings(text))
    monkeypatch.setattr(licenses, "BLOCK_WORDS", 24)
    assert sorted(model.findings(text)) == sorted(whole) and sum(f.similarity == 1 for f in whole) == 10


@pytest.mark.parametrize(
    "text, nearest",
    [
        ("Licensed under the Apache License, Version 1.1.", "apache-2.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "gpl"),
        # Its words are as near to the other two families.
        ("Licensed under CC BY-ND 4.0.", "cc-by"),
    ],
)
def test_unknown_licences_have_rows(model, text, nearest):
    found = list(model.findings(f"A page of the town.\n\n{text}"))
    assert [(f.paragraph, f.family) for f in found] == [(2, UNKNOWN)] and found[0].nearest.startswith(nearest)
    assert found[0].similarity == 0 and 0 < found[0].probability < 1 and 0 < found[0].unknown < 1


def test_long_sampled_lines(spark):
    """What the classifier is fitted on is bounded, whatever the length of lines and words."""
    docs = spark.createDataFrame([(i, "word of a page " * 50_000 + "x" * 500_000) for i in range(3)], "doc_id long, text string")
    assert train(docs).classify(words_of("Released under the MIT License."))[0] == "mit"
