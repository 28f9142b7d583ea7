"""Near copies of the pipeline beside all pairs by brute force."""

import random
from collections import Counter, defaultdict
from math import comb

import pytest

from passel.llm import near_text
from passel.llm.line_dedup import drop_repeated_lines
from passel.llm.near_text import drop_near_texts, key_shape, near_text_groups

DOCS = "doc_id long, text string, lang string"


def shingles_by_hand(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(texts):
    """All pairs of ids whose shingles have a Jaccard similarity of 0.8 or more; texts: {id: text}."""
    sets = {i: shingles_by_hand(t) for i, t in texts.items()}
    having = defaultdict(list)
    for i, own in sets.items():
        for s in own or [None]:
            having[s].append(i)
    for i, own in sets.items():
        common = Counter(j for s in own or [None] for j in having[s] if j < i)
        for j, n in common.items():
            if not own or n * 5 >= (len(own) + len(sets[j]) - n) * 4:
                yield j, i, 1.0 if not own else n / (len(own) + len(sets[j]) - n)


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def changed(words, share, chance):
    out = list(words)
    for at in chance.sample(range(len(out)), round(share * len(out))):
        out[at] = f"other{chance.randrange(10**6)}"
    return " ".join(out)


def test_groups_equal_brute_force(spark):
    """Near copies far more than two bits apart are one group; texts below 0.8 are not."""
    folder = "/root/testdata/sf0.01"
    docs = drop_repeated_lines(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    chance = random.Random(3)
    for k in range(150):
        words = [f"w{chance.randrange(5000)}" for _ in range(chance.randrange(100, 900))]
        texts[10**6 + 2 * k] = " ".join(words)
        # From a similarity of about 0.95 to one of about 0.6.
        texts[10**6 + 2 * k + 1] = changed(words, 0.005 + 0.045 * (k / 150), chance)
    pairs = [*similar_pairs(texts)]
    want = components(texts, pairs)
    rows = [(i, t, "x") for i, t in texts.items()]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in near_text_groups(frame).collect()}
    near = [(a, b) for a, b, j in pairs if j < 1]
    assert len(near) > 50
    assert sum(got[a] == got[b] for a, b in near) >= 0.96 * len(near)
    # Nothing is linked that brute force does not link.
    assert all(want[i] == want[c] for i, c in got.items())
    kept = {r.doc_id for r in drop_near_texts(frame).collect()}
    assert kept == {i for i, c in got.items() if c == i}


def test_large_group_of_near_copies(spark):
    """All of a group far larger than what a text is compared with in one bucket."""
    chance = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = {i: changed(words, 0.01, chance) for i in range(400)}
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOCS)
    assert [r.doc_id for r in drop_near_texts(frame).collect()] == [0]


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (9, "  "), (2, "same text here now"), (7, "Same TEXT here\nnow"), (None, "same text here now"), (2, "same text here now")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    kept = drop_near_texts(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([4, 2, 2, None], key=repr)
    assert drop_near_texts(frame.limit(0)).count() == 0


def test_keys_grow_with_the_corpus():
    """Buckets keep few unrelated texts and pairs at a similarity of 0.8 are found as often, at any size."""
    assert key_shape(0) == key_shape(5_000_000) == (10, 24)
    for n in (10**7, 10**9, 10**11):
        tables, bits = key_shape(n)
        meets = sum(comb(bits, d) * 0.1515**d * 0.8485 ** (bits - d) for d in range(3))
        assert (bits + 1) * n / 2**bits <= 8 and 1 - (1 - meets) ** tables >= 0.958


@pytest.mark.parametrize("n_texts", [10**7, 10**10])
def test_longer_keys_find_near_copies(spark, n_texts):
    chance = random.Random(6)
    texts = {}
    for k in range(100):
        words = [f"w{chance.randrange(5000)}" for _ in range(300)]
        texts |= {2 * k: " ".join(words), 2 * k + 1: changed(words, 0.015, chance)}
    got = {r.doc_id: r.component_id for r in near_text_groups(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOCS), n_texts=n_texts).collect()}
    near = [(a, b) for a, b, _ in similar_pairs(texts)]
    assert len(near) > 80 and sum(got[a] == got[b] for a, b in near) >= 0.96 * len(near)
    assert all(c in (i, i - 1) for i, c in got.items())


@pytest.mark.parametrize("back, block", [(8, 64), (1, 7), (2, 1024)])
def test_buckets_of_many_unrelated_texts(spark, monkeypatch, back, block):
    """With keys of four bits a bucket holds a good part of all texts: no pair is lost for that."""
    monkeypatch.setattr(near_text, "key_shape", lambda n: (4, 4))
    chance = random.Random(7)
    texts = {}
    for k in range(120):
        words = [f"w{chance.randrange(5000)}" for _ in range(200)]
        texts |= {3 * k + c: " ".join(words) if c == 1 else changed(words, 0.012, chance) for c in range(3)}
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOCS)
    got = {r.doc_id: r.component_id for r in near_text_groups(frame, back=back, block=block).collect()}
    assert got == components(texts, similar_pairs(texts))


def test_a_crowded_group_with_strangers(spark):
    """Near copies of one text, most of them below 0.8 of one another, in buckets far above what is compared at first."""
    chance = random.Random(8)
    words = [f"w{chance.randrange(5000)}" for _ in range(300)]
    texts = {0: " ".join(words)} | {i: changed(words, 0.03, chance) for i in range(1, 200)}
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOCS)
    want = components(texts, similar_pairs(texts))
    results = []
    for back, block in ((8, 1024), (1, 16)):
        results.append({r.doc_id: r.component_id for r in near_text_groups(frame, back=back, block=block).collect()})
    assert results[0] == results[1]
    assert all(want[i] == want[c] for i, c in results[0].items())


def test_clashing_columns_and_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, 1, 2, 3, 4), (2, long + " end", 1, 2, 3, 4), (3, "a b c d e f", None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class long, n int, check long, variant long")
    kept = drop_near_texts(frame)
    assert kept.columns == frame.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
