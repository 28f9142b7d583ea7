"""A backoff n-gram model of a corpus, scored as a weighted automaton that reads each text once, from left to right."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.llm.grams import PIECES, PIECES_TYPE, buckets, chained, opened, packed, part_bits, pieces, unpacked, word_keys, words
from passel.llm.tables import checkpoint, delete, stored

ORDER = 2
# Numbers of the marks before and behind a text, and their keys; no word holds a blank.
BEGIN, END, FIRST_WORD = 0, 1, 2
_MARKS = word_keys(pa.array([" begin", " end"]))
# Tokens of a text that are read at once beside others; the state at a later stretch is that after the words before it.
STRETCH = 2048
# Text of a bucket: a task needs about 25 times its memory.
TEXT_BYTES = 8 << 20
# Counts are summed up in bins of a factor of two.
BINS = 64

STATE = "bucket long, tokens long, keys array<long>, seq binary, sizes array<int>, ids array<long>, held array<boolean>"
STATE_TYPE = pa.schema([
    ("bucket", pa.int64()), ("tokens", pa.int64()), ("keys", pa.list_(pa.int64())), ("seq", pa.binary()), ("sizes", pa.list_(pa.int32())),
    ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
])
# An answer to a bucket, or (bucket null) how many n-grams have a count of a bin, and the counts' sum.
ANSWERS = "bucket long, series int, first int, at binary, counts binary, bin int, types long, mass long"
ANSWERS_TYPE = pa.schema([
    ("bucket", pa.int64()), ("series", pa.int32()), ("first", pa.int32()), ("at", pa.binary()), ("counts", pa.binary()),
    ("bin", pa.int32()), ("types", pa.int64()), ("mass", pa.int64()),
])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORES_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])


def _whole(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets as word numbers: each text with a mark before and one behind."""
    for number, table in buckets(batches, TEXT_BYTES):
        flat, sizes = words(table["text"].combine_chunks())
        coded = flat.dictionary_encode()
        vocabulary, coded_words = coded.dictionary, coded.indices.to_numpy()
        # Frequent words get small numbers, which take less room.
        often = np.argsort(-np.bincount(coded_words, minlength=len(vocabulary)), kind="stable")
        renamed = np.empty(len(often), np.int32)
        renamed[often] = np.arange(FIRST_WORD, FIRST_WORD + len(often))
        ends = np.cumsum(sizes + 2)
        seq = np.empty(int(ends[-1]), np.int32)
        inner = np.ones(len(seq), bool)
        inner[ends - 1] = inner[ends - sizes - 2] = False
        seq[inner] = renamed[coded_words]
        seq[ends - 1], seq[ends - sizes - 2] = END, BEGIN
        keys = np.concatenate([_MARKS, word_keys(vocabulary.take(pa.array(often)))]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([len(seq) - len(sizes)], pa.int64()), _whole(pa.array(keys)), pa.array([packed(seq)], pa.binary()),
                _whole(pa.array(sizes + 2, pa.int32())), _whole(table["doc_id"].combine_chunks()), _whole(table["held"].combine_chunks()),
            ],
            schema=STATE_TYPE,
        )


class Grams:
    """The n-grams of a bucket: for each length the number of the one that ends at each token (-1: none of one text),
    numbered in the order of their keys, with keys and one place of each."""

    def __init__(self, row: dict[str, pa.Scalar], order: int):
        self.seq = unpacked(row["seq"].as_py())
        self.sizes = row["sizes"].values.to_numpy().astype(np.int64)
        self.held = row["held"].values.to_numpy(zero_copy_only=False).astype(bool)
        word_key = row["keys"].values.to_numpy().view(np.uint64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.depth = np.arange(len(self.seq), dtype=np.int32) - np.repeat(self.begins, self.sizes).astype(np.int32)
        self.learned = np.repeat(~self.held, self.sizes)
        self.at, self.keys, self.one = [], [], []
        for n in range(order):
            there = np.flatnonzero(self.depth >= n)
            code = self.seq[there].astype(np.int64)
            if n:
                code += self.at[n - 1][there - 1].astype(np.int64) * len(word_key)
            _, one, code = np.unique(code, return_index=True, return_inverse=True)
            one = there[one]
            keys = word_key[self.seq[one]]
            if n:
                keys = chained(self.keys[n - 1][self.at[n - 1][one - 1]], keys)
            by_key = np.argsort(keys, kind="stable")
            place = np.empty(len(by_key), np.int32)
            place[by_key] = np.arange(len(by_key))
            at = np.full(len(self.seq), -1, np.int32)
            at[there] = place[code]
            self.at.append(at)
            self.keys.append(keys[by_key])
            self.one.append(one[by_key])

    def counts(self, n: int) -> np.ndarray:
        """How often each n-gram of n + 1 words stands in the bucket's texts that are learned from."""
        own = self.at[n][self.learned & (self.at[n] >= 0)]
        return np.bincount(own, minlength=len(self.keys[n]))


def _rows(batch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch[c][i] for c in batch.schema.names}


def _sender(order: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                grams = Grams(row, order)
                for n in range(order):
                    yield pieces(row["bucket"].as_py(), grams.keys[n], grams.counts(n), bits, n)

    return send


def _counter(bits: int):
    def counted(table: pa.Table) -> pa.Table:
        """All counts of the n-grams of a hash partition; a bucket is told those that its own texts do not make up."""
        series = table["part"][0].as_py() >> bits
        rows = opened(table)
        found, place = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, np.concatenate([r[3] for r in rows]))
        out, upto = [], 0
        for bucket, first, keys, counts in rows:
            own = total[place[upto : upto + len(keys)]]
            upto += len(keys)
            at = np.flatnonzero(own != counts)
            if len(at):
                out.append((bucket, series, first, at.astype("<i4").tobytes(), own[at].tobytes(), None, None, None))
        # The mark before a text is a context and no token: its count goes into no bin.
        known = total[(total > 0) & ((found != _MARKS[BEGIN]) | (series > 0))]
        bins = np.log2(known).astype(int)
        types, mass = np.bincount(bins, minlength=BINS), np.bincount(bins, known, BINS).astype(np.int64)
        out += [(None, series, None, None, None, int(b), int(types[b]), int(mass[b])) for b in np.flatnonzero(types)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, ANSWERS_TYPE.types)], schema=ANSWERS_TYPE)

    return counted


def concentration(contexts: list[tuple[int, int]], unseen: float) -> float:
    """How strong the shorter context counts, so that the mass left to it is the share of n-grams that occur once.

    ``contexts``: (how many, occurrences of all of them) in bins of about equal counts.
    """
    low, high = 1e-3, 1e6
    mass = sum(m for _, m in contexts)
    for _ in range(60):
        middle = (low * high) ** 0.5
        left = sum(m * middle / (m / t + middle) for t, m in contexts) / max(mass, 1)
        low, high = (middle, high) if left < unseen else (low, middle)
    return low


class Automaton:
    """States are the contexts of a bucket's n-grams that the corpus has, 0 the empty one; arcs are n-grams with the
    log10 probability of their last word and the state of the longest context behind it; a failure arc leads from each
    state to that of the context without its first word, at the weight of backing off.

    Probabilities are interpolated: (count + strength * probability in the shorter context) / (context's count + strength),
    down to single words, whose counts are raised by a half, one word standing for all unknown ones.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], strengths: list[float], tokens: int, types: int):
        self.n_words = int(grams.seq.max(initial=1)) + 1
        order, seq = len(counts), grams.seq
        self.base = np.log10((counts[0] + 0.5) / (tokens + 0.5 * (types + 1)))
        starts = np.cumsum([1, *(len(c) for c in counts[: order - 1])])
        self.fail, self.weight = np.zeros(starts[-1], np.int64), np.zeros(starts[-1])
        keys, logs, targets = [], [], []
        below = None
        for n, (count, one) in enumerate(zip(counts, grams.one)):
            shorter = grams.at[n - 1][one] if n else None
            context = grams.at[n - 1][one - 1] if n else None
            if n:
                weight = strengths[n - 1] / (counts[n - 1] + strengths[n - 1])
                self.weight[starts[n - 1] : starts[n]] = np.log10(weight)
                chance = (count + strengths[n - 1] * below[shorter]) / (counts[n - 1][context] + strengths[n - 1])
            else:
                chance = 10**self.base
            known = count > 0 if n else np.ones(len(count), bool)
            state = starts[n - 1] + context if n else np.zeros(len(count), np.int64)
            if n < order - 1:
                own = starts[n] + np.arange(len(count))
                self.fail[own] = starts[n - 1] + shorter if n else 0
                target = np.where(count > 0, own, 0)
            else:
                target = starts[n - 1] + shorter if n else np.zeros(len(count), np.int64)
            keys.append((state * self.n_words + seq[one])[known])
            logs.append(np.log10(chance)[known])
            targets.append(target[known])
            below = chance
        by_key = np.argsort(keys := np.concatenate(keys))
        self.keys, self.logs, self.targets = keys[by_key], np.concatenate(logs)[by_key], np.concatenate(targets)[by_key]
        begin = grams.at[0][grams.begins[:1]]
        self.start = int(starts[0] + begin[0]) if order > 1 and len(begin) and counts[0][begin[0]] > 0 else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word each, and the log-probabilities: failure arcs until a state has an arc."""
        key = state * self.n_words + word
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[place] == key
        log, after = self.logs[place], self.targets[place]
        failed = np.flatnonzero(~found)
        if len(failed):
            lower = state[failed]
            after[failed], rest = self.step(self.fail[lower], word[failed])
            log[failed] = self.weight[lower] + rest
        return after, log

    def read(self, seq: np.ndarray, begins: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
        """The log-probability of each text: one traversal that carries the state of every text, a word at a time."""
        n = -(-(sizes - 1) // STRETCH)
        text = np.repeat(np.arange(len(sizes)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        back = np.where(number > 0, order - 1, 0)
        begin = begins[text] + 1 + number * STRETCH - back
        size = np.minimum(STRETCH, sizes[text] - 1 - number * STRETCH) + back
        # A stretch of a few words may reach back over the text's begin mark: it starts there.
        over = np.maximum(begins[text] + 1 - begin, 0)
        begin, size, back = begin + over, size - over, back - over
        rank = np.argsort(-size, kind="stable")
        begin, size, back, number = begin[rank], size[rank], back[rank], number[rank]
        state = np.where(number == 0, self.start, 0)
        total = np.zeros(len(rank))
        for t in range(int(size.max(initial=0))):
            k = int(np.searchsorted(-size, -t, "left"))
            state[:k], log = self.step(state[:k], seq[begin[:k] + t])
            total[:k] += np.where(t >= back[:k], log, 0.0)
        return np.bincount(text[rank], total, len(sizes))


def _scorer(order: int, strengths: list[float], tokens: int, types: int):
    def scored(state: pa.Table, answers: pa.Table) -> pa.Table:
        if not state.num_rows:
            return SCORES_TYPE.empty_table()
        row = next(_rows(state.combine_chunks()))
        grams = Grams(row, order)
        counts = [grams.counts(n) for n in range(order)]
        for a in answers.to_pylist():
            counts[a["series"]][a["first"] + np.frombuffer(a["at"], "<i4")] = np.frombuffer(a["counts"], "<i8")
        automaton = Automaton(grams, counts, strengths, tokens, types)
        text = np.repeat(np.arange(len(grams.sizes)), grams.sizes)
        real = grams.depth > 0
        own = grams.at[0][real]
        return pa.Table.from_arrays(
            [
                row["ids"].values, row["held"].values, pa.array(grams.sizes - 1),
                pa.array(np.bincount(text[real], counts[0][own] > 0, len(grams.sizes)).astype(np.int64)),
                pa.array(np.bincount(text[real], automaton.base[own], len(grams.sizes))),
                pa.array(automaton.read(grams.seq, grams.begins, grams.sizes, order)),
            ],
            schema=SCORES_TYPE,
        )

    return scored


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER
) -> DataFrame:
    """For each row doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, the log10 probabilities
    of its text by single words and by the automaton of n-grams of up to ``order`` words.

    All rows where ``held_out`` is not true are learned from, nothing of them is left out: each bucket of texts gets from
    the hash partitions the counts of its own n-grams, so a task holds the part of the model that its texts can reach
    and no more. How strong shorter contexts count follows from the n-grams that occur once in the corpus.

    Null and empty texts are an end mark alone. Rows without an id are scored like others, and learned from unless
    ``held_out`` says otherwise. Repeated rows are rows of their own. With no rows to learn from, every text has
    the probability of unknown words. Columns of any other name play no part. A text of any length is read by stretches.
    Words are told apart by 64 bits of XXH3, n-grams by 64 bits made of those.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held")
    )
    state, path = stored(rows.mapInArrow(_coded, STATE))
    bits = part_bits(state.agg(F.sum("tokens")).first()[0] or 0)
    sent = state.mapInArrow(_sender(order, bits), PIECES)
    answers, told_path = stored(sent.groupBy("part").applyInArrow(_counter(bits), ANSWERS))
    # At most BINS rows for each length.
    bins = answers.where("bucket is null").groupBy("series", "bin").agg(F.sum("types").alias("types"), F.sum("mass").alias("mass")).collect()
    of = [[(b.types, b.mass) for b in bins if b.series == n] for n in range(order)]
    once = [sum(b.types for b in bins if b.series == n and b.bin == 0) for n in range(order)]
    tokens, types = sum(m for _, m in of[0]), sum(t for t, _ in of[0])
    strengths = [concentration(of[n - 1], once[n] / max(1, sum(m for _, m in of[n]))) for n in range(1, order)]
    told = answers.where("bucket is not null").select("bucket", "series", "first", "at", "counts")
    scored = checkpoint(state.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_scorer(order, strengths, tokens, types), SCORES))
    for read in (path, told_path):
        delete(docs.sparkSession, read)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
