"""Phrases whose words stand together more often than by chance: frequent n-grams by Misra-Gries summaries, counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passel.llm.grams import PIECES, PIECES_TYPE, buckets, chained, opened, packed, part_bits, pieces, unpacked, word_keys
from passel.llm.tables import checkpoint, delete, stored
from passel.session import broadcast_if_small

MOST_WORDS = 5
THRESHOLD = 100
TOP = 2000
# A longer phrase that is at least this share of a phrase, in hundredths, takes its place.
INSIDE = 100
# Sub-groups that cut a language's candidates to its first ones before they meet.
SALTS = 32

_MARKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(46 if b in _MARKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

STATE = "bucket long, lang string, n long, words array<string>, size long, seq binary, phrases array<struct<words:array<string>,a:long>>"
_PHRASES = pa.list_(pa.struct([("words", pa.list_(pa.string())), ("a", pa.int64())]))
STATE_TYPE = pa.schema([
    ("bucket", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("size", pa.int64()), ("seq", pa.binary()), ("phrases", _PHRASES),
])
ANSWERS = "bucket long, first int, at binary, counts binary, own binary"
ANSWERS_TYPE = pa.schema([("bucket", pa.int64()), ("first", pa.int32()), ("at", pa.binary()), ("counts", pa.binary()), ("own", pa.binary())])


def _array(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each language as word numbers, -1 between two pieces."""
    for number, table in buckets(batches):
        langs = table["lang"].combine_chunks().dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = table["text"].combine_chunks().filter(pa.compute.equal(langs.indices, k)).cast(pa.binary()).to_pylist()
            data = b".".join(t or b"" for t in texts).translate(_FOLD).replace(b".", b" . ")
            tokens = pa.array(data.split(), pa.binary())
            coded = tokens.dictionary_encode()
            seq = coded.indices.to_numpy().astype(np.int32)
            stop = pa.compute.index(coded.dictionary, pa.scalar(b".", pa.binary())).as_py()
            if stop >= 0:
                seq = np.where(seq == stop, -1, np.where(seq > stop, seq - 1, seq)).astype(np.int32)
            kept = coded.dictionary.filter(pa.compute.not_equal(coded.dictionary, pa.scalar(b".", pa.binary())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(number << 16) + k], pa.int64()), pa.array([lang], pa.string()), pa.array([int((seq >= 0).sum())], pa.int64()),
                    _array([0, len(kept)], kept.cast(pa.string(), safe=False)), pa.array([len(seq)], pa.int64()), pa.array([packed(seq)], pa.binary()),
                    pa.array([None], _PHRASES),
                ],
                schema=STATE_TYPE,
            )


def _windows(seq: np.ndarray, keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of ``order`` words in ``seq``: where they start, the number of each, a start of each number, its key.

    Numbers follow the order of the keys.
    """
    start = np.arange(max(0, len(seq) - order + 1))
    for k in range(order):
        start = start[seq[start + k] >= 0]
    code = seq[start].astype(np.int64)
    for k in range(1, order):
        code = np.unique(code, return_inverse=True)[1] * len(keys) + seq[start + k]
    _, one, code = np.unique(code, return_index=True, return_inverse=True)
    own = keys[seq[start[one]]]
    for k in range(1, order):
        own = chained(own, keys[seq[start[one] + k]])
    by_key = np.argsort(own, kind="stable")
    place = np.empty(len(by_key), np.int64)
    place[by_key] = np.arange(len(by_key))
    return start, place[code], start[one][by_key], own[by_key]


def _of_state(row: dict, order: int):
    lang = row["lang"].encode()
    vocabulary = row["words"].values if isinstance(row["words"], pa.ListScalar) else row["words"]
    keys = word_keys(vocabulary, lang + b"\x00")
    seq = unpacked(row["seq"].as_py())
    return seq, vocabulary, _windows(seq, keys, order)


def _sender(order: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {"lang": batch["lang"][i].as_py(), "words": batch["words"][i], "seq": batch["seq"][i]}
                _, _, (_, code, one, keys) = _of_state(row, order)
                yield pieces(batch["bucket"][i].as_py(), keys, np.bincount(code, minlength=len(one)), bits)

    return send


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def frequent_candidates(summaries: list[tuple[np.ndarray, np.ndarray]], threshold: int) -> np.ndarray:
    """Sorted keys among which is every one that occurs ``threshold`` times in all the summaries (keys, counts).

    The Misra-Gries summary keeps ``mass // threshold + 1`` counters. Where a merge has more, the largest count that
    has to go is taken from all: that removes a mass of more than capacity times it, so in all a counter loses less than
    ``threshold``, and one that stood for ``threshold`` occurrences is still above zero.
    """
    mass = sum(int(counts.sum()) for _, counts in summaries)
    capacity = mass // threshold + 1
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, size = [], 0
    for number, summary in enumerate(summaries):
        waiting.append(summary)
        size += len(summary[0])
        # Several small summaries are merged at once, else each would cost a pass over all counters.
        if size > capacity or number == len(summaries) - 1:
            keys, counts = _merged(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))
            waiting, size = [], 0
            if len(keys) > capacity:
                counts = counts - np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
    return keys


def _counter(threshold: int):
    def counted(table: pa.Table) -> pa.Table:
        rows = opened(table)
        candidates = frequent_candidates([(keys, counts) for _, _, keys, counts in rows], threshold)
        exact, places = np.zeros(len(candidates), np.int64), []
        for _, _, keys, counts in rows:
            at = np.flatnonzero(np.isin(keys, candidates))
            place = np.searchsorted(candidates, keys[at])
            np.add.at(exact, place, counts[at])
            places.append((at, place))
        taken = exact < threshold
        out = []
        for (bucket, first, _, _), (at, place) in zip(rows, places):
            often = exact[place] >= threshold
            at, place = at[often], place[often]
            if len(at):
                own = ~taken[place]
                taken[place] = True
                out.append((bucket, first, at.astype("<i4").tobytes(), exact[place].tobytes(), own.tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, ANSWERS_TYPE.types)], schema=ANSWERS_TYPE)

    return counted


def _runs(often: np.ndarray, start: np.ndarray, seq: np.ndarray, order: int) -> np.ndarray:
    """The words of ``seq`` in which two or more windows follow one another that are all ``often``, -1 behind each run."""
    flags = np.zeros(len(seq) + 2, bool)
    flags[start[often] + 1] = True
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= 2
    begin, size = begin[long], (end - begin)[long] + order - 1
    total = size + 1
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    value = seq[np.minimum(np.repeat(begin, total) + at, max(len(seq) - 1, 0))]
    return np.where(at == np.repeat(size, total), -1, value).astype(np.int32)


def _receiver(order: int, most: int):
    def receive(state: pa.Table, answers: pa.Table) -> pa.Table:
        if not state.num_rows or not answers.num_rows:
            return STATE_TYPE.empty_table()
        state = state.combine_chunks()
        row = {c: state[c].chunk(0)[0] for c in ("words", "seq")} | {"lang": state["lang"][0].as_py()}
        seq, vocabulary, (start, code, one, _) = _of_state(row, order)
        often, phrases = np.zeros(len(one), bool), []
        for a in answers.to_pylist():
            at = a["first"] + np.frombuffer(a["at"], "<i4")
            often[at] = True
            own = np.frombuffer(a["own"], bool)
            counts = np.frombuffer(a["counts"], "<i8")[own]
            where = one[at[own]][:, None] + np.arange(order)
            named = vocabulary.take(pa.array(seq[where].ravel())).to_pylist()
            phrases += [{"words": named[i * order : (i + 1) * order], "a": int(c)} for i, c in enumerate(counts)]
        seq = _runs(often[code], start, seq, order) if order < most else np.zeros(0, np.int32)
        used = np.unique(seq[seq >= 0])
        number = np.full(len(vocabulary) + 1, -1, np.int32)
        number[used] = np.arange(len(used))
        kept = vocabulary.take(pa.array(used))
        return pa.Table.from_arrays(
            [
                state["bucket"], state["lang"], state["n"], _array([0, len(kept)], kept), pa.array([len(seq)], pa.int64()),
                pa.array([packed(number[seq])], pa.binary()),
                pa.array([phrases], _PHRASES),
            ],
            schema=STATE_TYPE,
        )

    return receive


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, threshold: int = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """``lang, words, a`` of every phrase of 1 to ``most_words`` words that occurs ``threshold`` times in its language,
    and ``lang, n``, the words of each language.

    A round for each length: buckets send their n-grams, each hash partition merges the summaries, counts the candidates
    exactly and answers; a bucket keeps the runs of words in which all n-grams are frequent, for only there can longer
    ones be. One bucket of those that hold a phrase names its words.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    spark = docs.sparkSession
    state, path = stored(docs.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_split, STATE))
    totals = checkpoint(state.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"))
    phrases = None
    for order in range(1, most_words + 1):
        bits = part_bits(state.agg(F.sum("size")).first()[0] or 0)
        sent = state.select("bucket", "lang", "words", "seq").mapInArrow(_sender(order, bits), PIECES)
        answers = sent.groupBy("part").applyInArrow(_counter(threshold), ANSWERS)
        runs = state.drop("phrases").groupBy("bucket").cogroup(answers.groupBy("bucket"))
        before = path
        state, path = stored(runs.applyInArrow(_receiver(order, most_words), STATE))
        delete(spark, before)
        found = checkpoint(state.select("lang", F.explode("phrases").alias("p")).select("lang", "p.*"))
        phrases = found if phrases is None else phrases.unionByName(found)
    delete(spark, path)
    return phrases, totals


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, threshold: int = THRESHOLD,
    top: int = TOP, inside: int = INSIDE,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at sentence marks and line ends into pieces and at blanks into words. A phrase of 2 to
    ``most_words`` words that occurs ``a >= threshold`` times is cut where ``1000 a n / (l r)``, rounded down, is lowest
    (l, r: occurrences of both parts; the first such cut). It gives way to a longer phrase around it that has at least
    ``inside`` hundredths of its occurrences.

    Null languages are ``und``, null and empty texts have no words, repeated rows count each. An empty table, or one
    without frequent phrases, has no rows. Other columns play no part. Words are told apart by 64 bits of XXH3 and
    n-grams by 64 bits made of those: of a billion frequent ones among 10^11, one may be counted with another.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, most_words, threshold)
    named = phrases.select("lang", "words", "a", _joined(F.col("words")).alias("phrase"))
    parts = named.select("lang", "phrase", "a")
    cuts = named.where("size(words) > 1").select(
        "lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    )
    cuts = cuts.withColumn("head", _joined(F.slice("words", 1, F.col("k")))).withColumn("tail", _joined(F.slice("words", F.col("k") + 1, most_words)))
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(a AS {wide}) * cast(n AS {wide}) * 1000) div (cast(l AS {wide}) * cast(r AS {wide}))")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(broadcast_if_small(totals), "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = named.where("size(words) > 2").select("lang", "words", F.col("a").alias("around")).select(
        "lang", "around", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")
    )
    spans = spans.select(
        "lang", "around",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: _joined(F.slice("words", i, F.col("size"))))).alias("phrase"),
    )
    around = spans.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("around") * 100 < F.col("a") * inside, F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
