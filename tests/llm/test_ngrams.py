"""Collocations and the language model beside plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passel.llm import grams, language_model
from passel.llm.collocations import collocations, frequent_candidates
from passel.llm.grams import buckets, packed, unpacked, unpacked_keys, words
from passel.llm.language_model import STRETCH, Automaton, Grams, concentration, score_texts
from passel.llm.registered import QUERIES

DOCS = "doc_id long, text string, lang string, a long, words string, bucket string, held int, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", "y", 0, "z") for i, t, lang in rows], DOCS)


# ---- the exchange


def test_keys_come_back():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for part in (keys, keys[:1], keys[:0]):
        assert (unpacked_keys(packed(part)) == part).all()
    numbers = np.array([-1, 5, 0, 1 << 20, -1])
    for part in (numbers, numbers[:0]):
        assert (unpacked(packed(part)) == part).all()


def test_words_of_all_blanks():
    texts = [" A\tb\nC\x0bd\x0ce\rF ", None, "", "x\x1cy z \x85 É", "   "]
    flat, sizes = words(pa.array(texts))
    assert flat.to_pylist() == ["a", "b", "c", "d", "e", "f", "x\x1cy z \x85", "É"]
    assert sizes.tolist() == [6, 0, 0, 2, 0]
    # A slice of a longer column has offsets that do not begin at 0.
    assert words(pa.array(texts)[3:])[1].tolist() == [2, 0]


def test_buckets_are_bounded(monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 2)

    monkeypatch.setattr(grams.TaskContext, "get", staticmethod(lambda: Task))
    texts = ["x" * n for n in (3, 4, 50, 1, 1, 1, 0)] + [None, "y" * 10]
    batches = [pa.record_batch({"text": pa.array(texts[a:b], pa.string())}) for a, b in ((0, 4), (4, 9))]
    found = [(n, t["text"].to_pylist()) for n, t in buckets(iter(batches), 10)]
    assert [t for _, part in found for t in part] == texts
    assert len({n for n, _ in found}) == len(found)
    assert [sum(len(t or "") for t in part) for _, part in found] == [7, 50, 3, 10]


# ---- collocations


def collocations_by_hand(rows, most=5, threshold=100, top=2000, inside=100):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            run = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(run)
            for k in range(1, most + 1):
                for i in range(len(run) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(run[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        found = []
        for p, a in often.items():
            inner = any(
                len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()
            )
            if not inner:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def as_rows(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_rows(seed, n=300):
    pick = random.Random(seed)
    vocabulary = ["a", "B", "cc", "é", "dd", "EÉ"] + [f"w{i}" for i in range(12)]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "? ", "\r\n", "  "]
    rows = []
    for i in range(n):
        text = "".join(pick.choice(vocabulary[: pick.randint(2, len(vocabulary))]) + pick.choice(marks) for _ in range(pick.randint(0, 40)))
        if pick.random() < 0.4:
            text += " one two three four five six. one two three"
        rows.append((i, text, pick.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize(("threshold", "inside", "top"), [(20, 100, 2000), (5, 80, 7), (1, 100, 2000)])
def test_collocations_equal_plain_counts(spark, threshold, inside, top):
    rows = random_rows(threshold, 300 if threshold > 1 else 12)
    frame = collocations(docs_of(spark, rows).repartition(5), threshold=threshold, inside=inside, top=top)
    assert as_rows(frame) == collocations_by_hand(rows, threshold=threshold, inside=inside, top=top)


def test_collocations_of_small_parts(spark, monkeypatch):
    """Many buckets and hash partitions give what one of each gives."""
    rows = random_rows(8)
    monkeypatch.setattr(grams, "PART_TOKENS", 64)
    from passel.llm import collocations as module

    monkeypatch.setattr(module, "part_bits", lambda tokens: 5)
    assert as_rows(collocations(docs_of(spark, rows).repartition(7), threshold=15)) == collocations_by_hand(rows, threshold=15)


def test_collocations_of_edge_texts(spark):
    rows = [(1, None, None), (1, "", "en"), (None, "... ,,\n", "en"), (2, "x " * 5000, "en"), (3, "ab cd " * 60, None), (3, "ab cd " * 60, None)]
    assert as_rows(collocations(docs_of(spark, rows))) == collocations_by_hand(rows)
    assert as_rows(collocations(docs_of(spark, []))) == []
    assert as_rows(collocations(docs_of(spark, rows[:3]))) == []


def test_summaries_keep_all_frequent_keys():
    pick = np.random.default_rng(5)
    for threshold in (3, 10, 50):
        stream = np.concatenate([pick.zipf(1.3, 20000) % 5000, np.repeat(np.arange(6000, 6040), threshold)]).astype(np.uint64)
        pick.shuffle(stream)
        summaries = [np.unique(part, return_counts=True) for part in np.array_split(stream, 40)]
        keys, counts = np.unique(stream, return_counts=True)
        found = frequent_candidates(summaries, threshold)
        assert set(keys[counts >= threshold]) <= set(found)
        assert len(found) <= len(stream) // threshold + 1


# ---- language model


def tokens_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w] + [" end"]


class ByHand:
    """The same model, by dictionaries and recursion over contexts."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for tokens in texts:
            line = [" begin", *tokens]
            for n in range(order):
                self.counts[n].update(tuple(line[i - n : i + 1]) for i in range(n, len(line)))
        words_ = {w: c for (w,), c in self.counts[0].items() if w != " begin"}
        self.n, self.v = sum(words_.values()), len(words_)
        self.strengths = []
        for n in range(1, order):
            bins = Counter(), Counter()
            for g, c in self.counts[n - 1].items():
                if g != (" begin",):
                    bins[0][c.bit_length()] += 1
                    bins[1][c.bit_length()] += c
            once = sum(c == 1 for c in self.counts[n].values())
            self.strengths.append(concentration([(bins[0][b], bins[1][b]) for b in sorted(bins[0])], once / max(1, sum(self.counts[n].values()))))

    def p(self, context, word):
        if not context:
            return (self.counts[0][(word,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        lower, held = self.p(context[1:], word), self.counts[len(context) - 1][context]
        if not held:
            return lower
        k = self.strengths[len(context) - 1]
        return (self.counts[len(context)][(*context, word)] + k * lower) / (held + k)

    def log(self, tokens):
        line = [" begin", *tokens]
        return sum(math.log10(self.p(tuple(line[max(0, i - self.order + 1) : i]), line[i])) for i in range(1, len(line)))


def check_scores(frame, rows, held, order):
    model = ByHand([tokens_of(t) for i, t, _ in rows if not held(i)], order)
    want = []
    for i, text, _ in rows:
        tokens = tokens_of(text)
        base = sum(math.log10(model.p((), w)) for w in tokens)
        want.append((i, held(i), len(tokens), sum(model.counts[0][(w,)] > 0 for w in tokens), model.n, base, model.log(tokens)))
    got = [tuple(r) for r in frame.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(language_model, "part_bits", lambda tokens: 3)
    rows = random_rows(order)
    check_scores(score_texts(docs_of(spark, rows).repartition(6), held_out(), order=order), rows, fold, order)


def test_scores_of_edge_texts(spark):
    pick = random.Random(1)
    long = " ".join(pick.choice(["a", "b", "c", "D", f"x{pick.randint(0, 300)}"]) for _ in range(3 * STRETCH + 5))
    rows = [(0, None, None), (0, "", "en"), (7, " \n\t", "en"), (None, "a b a b", "en"), (9, long, "de"), (9, long, "de"), (11, "begin end </s> <s>", "en")]
    for order in (2, 3):
        check_scores(score_texts(docs_of(spark, rows), held_out(), order=order), rows, fold, order)
    assert score_texts(docs_of(spark, []), held_out()).collect() == []


def test_scores_with_nothing_to_learn(spark):
    rows = [(3, "a b", "en"), (4, None, "en")]
    check_scores(score_texts(docs_of(spark, rows), F.lit(True)), rows, lambda i: True, 2)


def test_arcs_of_a_state_sum_to_one():
    """All words, and one for the unknown ones, have a probability of one together after any context."""
    vocabulary, texts = 7, [[2, 3, 4, 2, 3], [2, 2, 5], [6, 3, 4]]
    keys = np.random.default_rng(1).integers(0, 1 << 62, vocabulary)
    seq = np.concatenate([[0, *t, 1] for t in texts]).astype(np.int32)
    row = {
        "seq": pa.scalar(packed(seq), pa.binary()), "sizes": pa.scalar([len(t) + 2 for t in texts], pa.list_(pa.int32())),
        "held": pa.scalar([False] * 3, pa.list_(pa.bool_())), "keys": pa.scalar(keys.tolist(), pa.list_(pa.int64())),
    }
    bucket = Grams(row, 3)
    counts = [bucket.counts(n) for n in range(3)]
    automaton = Automaton(bucket, counts, [0.7, 1.9], int(counts[0].sum()) - 3, int((counts[0] > 0).sum()) - 1)
    unknown = 0.5 / (14 + 0.5 * (6 + 1))
    last = np.concatenate([[0], *(seq[one] for one in bucket.one[:2])])
    # What ends in an end mark is the context of nothing.
    for state in np.flatnonzero(last != 1):
        words_ = np.arange(1, vocabulary)
        after, logs = automaton.step(np.full(len(words_), state), words_)
        left, s = unknown, state
        while s:
            left, s = left * 10 ** automaton.weight[s], automaton.fail[s]
        assert (10**logs).sum() + left == pytest.approx(1)


def test_registered_queries_on_whole_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [tuple(r) for r in docs]
    check_scores(QUERIES["op13_lm"](spark, tables), rows, fold, 2)
    assert as_rows(QUERIES["op11_collocations"](spark, tables)) == collocations_by_hand(rows)
