"""Removal of every byte that lies in a string of 100 bytes which also starts earlier, by sorting suffixes.

Not every suffix is sorted, but those at anchors: of the grams of ``GRAM`` bytes in a window of ``LENGTH`` bytes, the
first one of least hash. Equal windows have equal anchors at the same place, so equal windows meet at the
suffixes of their anchors. The consecutive windows of one anchor form a stretch, the string from the first
byte to the last byte of these windows.

1. Stretches are range-partitioned by the leading bytes of their anchor suffix, its hash, a hash of the whole stretch,
   and their place in the corpus. Spark samples the splitters. As the place is part of the key, a passage of every third
   document is cut into as many ranges as it needs. Ranges are sorted by multikey quicksort; a stretch that
   follows an equal one is a copy. First and last keys of neighbouring ranges are compared at the end.
2. Anchors with different stretches mark where repeated passages begin and end. Only there the bytes are fetched
   again, and the stretches are cut into blocks of ``OFFSETS`` windows at fixed distances from the anchor. Blocks
   go through the same sort, keyed by the bytes that all windows of the block share and by the whole block.
3. Where blocks share those bytes and still differ, their windows are sorted one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.llm.tables import ROW, checkpoint, delete, held, of_row, released, shared_folder, tidy

LENGTH = 100
GRAM = 32
# Grams in a window.
SPAN = LENGTH - GRAM + 1
# Texts are hashed in blocks of about so many bytes.
BLOCK = 1 << 18
# Records of a range.
RANGE_RECORDS = 1 << 17
# Windows of a block, and the bytes that they all have.
OFFSETS = 8
CORE = LENGTH - OFFSETS + 1
# Stretches that a worker hands over at once.
FETCHED_AT_ONCE = 1 << 13

COPY, REP, FIRST, LAST = range(4)
IN_FIRST, IN_LAST, HEAD, MULTI = 1, 2, 4, 8
RECORD = "k1 long, k2 long, doc long, at long"
JUDGED = "bucket int, kind byte, k1 long, k2 long, doc long, at long, flags byte"
JUDGED_TYPES = [pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8()]
JUDGED_NAMES = ["bucket", "kind", "k1", "k2", "doc", "at", "flags"]

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_S29, _S32, _S24 = np.uint64(29), np.uint64(32), np.uint64(24)


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from each place on, by doubling."""
    h, n, kept = _BYTE[data], 1, None
    for step in range(6):
        mixed = h[:-n] * _ODD[2 * step]
        mixed += h[n:]
        mixed ^= mixed >> _S29
        mixed *= _ODD[2 * step + 1]
        mixed ^= mixed >> _S32
        h, n = mixed, 2 * n
        if n == GRAM:
            kept = h
    return kept, h


def _least_in_span(key: np.ndarray) -> np.ndarray:
    """The least of each ``SPAN`` consecutive values."""
    least, n = key, 1
    while 2 * n <= SPAN:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    return np.minimum(least[: -(SPAN - n)], least[SPAN - n :]) if n < SPAN else least


def pack(place: np.ndarray, left: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Anchor place, bytes before the anchor (under 128) and bytes of the stretch (under 256) in one number."""
    return place << 15 | left << 8 | length


def stretches(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Leading bytes with gram hash, stretch hash, document and packed place of all stretches of some texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if total < LENGTH:
        return (np.empty(0, np.int64),) * 4
    data = np.frombuffer(b"".join(texts) + bytes(2 * LENGTH), np.uint8)
    grams, wide = gram_hashes(data)
    # 40 bits of hash, then the place, which lets the first of equals win.
    key = grams[:total] >> _S24 << _S24 | np.arange(total, dtype=np.uint64)
    anchor = (_least_in_span(key) & np.uint64((1 << 24) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[owner])
    if not len(window):
        return (np.empty(0, np.int64),) * 4
    anchor = anchor[window]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    low, high = window[new], window[np.concatenate([new[1:], [len(window)]]) - 1] + LENGTH
    anchor, owner = anchor[new], owner[window[new]]
    lead = data[anchor].astype(np.uint64) << np.uint64(56) | data[anchor + 1].astype(np.uint64) << np.uint64(48)
    lead |= data[anchor + 2].astype(np.uint64) << np.uint64(40) | grams[anchor] >> _S24
    # Three wide grams cover a stretch of up to 192 bytes.
    whole = (wide[low] * _ODD[12] ^ wide[np.minimum(low + 64, high - 64)]) * _ODD[13] ^ wide[high - 64]
    whole = (whole ^ whole >> _S29) * _ODD[14] + ((anchor - low) << 8 | (high - low)).astype(np.uint64)
    place = anchor - (ends - lengths)[owner]
    return lead.view(np.int64), whole.view(np.int64), docs[owner], pack(place, anchor - low, high - low)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts in blocks, with ids and the place of each in its document; long ones in pieces that overlap by a window."""
    texts, ids, starts, size = [], [], [], 0
    step = 16 * BLOCK
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer()
            for start in range(0, max(1, len(data) - LENGTH + 1), step):
                texts.append(data[start : start + step + LENGTH - 1].to_pybytes() if len(data) else b"")
                ids.append(doc)
                starts.append(start)
                size += len(texts[-1])
                if size >= BLOCK:
                    yield texts, np.array(ids, np.int64), np.array(starts, np.int64)
                    texts, ids, starts, size = [], [], [], 0
    if texts:
        yield texts, np.array(ids, np.int64), np.array(starts, np.int64)


@tidy
def _emit_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, ids, starts in _blocks(batches):
        k1, k2, owner, at = stretches(texts, np.arange(len(texts)))
        columns = [k1, k2, ids[owner], at + (starts[owner] << 15)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "doc", "at"])


def multikey_order(n: int, key: Callable[[int, np.ndarray], np.ndarray], levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``n`` strings and the run of equals that each one in this order is in.

    ``key(level, rows)`` gives one word of the strings of ``rows``. Like multikey quicksort, only strings that are equal
    so far are sorted by their next word. Equal strings keep their order.
    """
    order, run, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for level in range(levels):
        words = key(level, order[tied])
        inner = np.lexsort((words, run[tied]))
        order[tied] = order[tied][inner]
        words, runs = words[inner], run[tied]
        differs = np.zeros(n, bool)
        differs[tied[1:]] = (words[1:] != words[:-1]) | (runs[1:] != runs[:-1])
        starts = np.concatenate([[True], run[1:] != run[:-1]]) | differs if n else np.empty(0, bool)
        run = np.cumsum(starts) - 1
        alone = starts & np.concatenate([starts[1:], [True]]) if n else starts
        tied = tied[~alone[tied]]
        if not len(tied):
            break
    return order, run


@tidy
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the records of one range; tell copies from the first of a class (k1, k2) and say which classes share k1."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    columns = [np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(4)]
    order, run = multikey_order(len(columns[0]), lambda level, rows: columns[level][rows], 4)
    once = np.concatenate([[True], run[1:] != run[:-1]])
    k1, k2, doc, at = (c[order[once]] for c in columns)
    same1 = np.concatenate([[False], k1[1:] == k1[:-1]])
    rep = ~(same1 & np.concatenate([[False], k2[1:] == k2[:-1]]))
    group = np.cumsum(~same1) - 1
    reps = np.bincount(group, weights=rep)[group]
    flags = (group == 0) * IN_FIRST + (group == group[-1]) * IN_LAST + (reps > 1) * MULTI
    flags[0] += HEAD
    bucket = TaskContext.get().partitionId()

    def rows(kind: int, chosen: np.ndarray, keys: bool) -> pa.RecordBatch:
        n = len(chosen)
        data = [np.full(n, bucket), np.full(n, kind), k1[chosen] * keys, k2[chosen] * keys, doc[chosen], at[chosen], flags[chosen] * keys]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(data, JUDGED_TYPES)], JUDGED_NAMES)

    yield rows(FIRST, np.array([0]), True)
    yield rows(LAST, np.array([len(k1) - 1]), True)
    yield rows(COPY, np.flatnonzero(~rep), False)
    yield rows(REP, np.flatnonzero(rep & ((flags & (MULTI | IN_FIRST | IN_LAST)) > 0)), True)


def _ranged(records: DataFrame, n_ranges: int) -> DataFrame:
    return records.repartitionByRange(n_ranges, "k1", "k2", "doc", "at").mapInArrow(_judge, JUDGED)


def _across(judged: DataFrame) -> DataFrame:
    """Representatives, compared with the ranges on both sides: ``copy``, or ``open`` if another class shares their k1."""

    def flag(bit: int) -> Column:
        return F.col("flags").bitwiseAND(F.lit(bit).cast("byte")) > 0

    # A sampled splitter is a record of its range, so no range between two others is empty.
    before = judged.where(F.col("kind") == LAST).select((F.col("bucket") + 1).alias("bucket"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    after = judged.where(F.col("kind") == FIRST).select((F.col("bucket") - 1).alias("bucket"), F.col("k1").alias("n1"))
    reps = judged.where(F.col("kind") == REP)
    edge = reps.where(flag(IN_FIRST | IN_LAST)).join(before, "bucket", "left").join(after, "bucket", "left")
    goes_back = flag(IN_FIRST) & F.coalesce(F.col("p1") == F.col("k1"), F.lit(False))
    goes_on = flag(IN_LAST) & F.coalesce(F.col("n1") == F.col("k1"), F.lit(False))
    edge = edge.withColumns({"crosses": goes_back | goes_on, "copy": flag(HEAD) & goes_back & (F.col("p2") == F.col("k2"))})
    inner = reps.where(~flag(IN_FIRST | IN_LAST)).withColumns({"crosses": F.lit(False), "copy": F.lit(False)})
    both = edge.select(*inner.columns).unionByName(inner)
    return both.select("doc", "at", "copy", (~F.col("copy") & (flag(MULTI) | F.col("crosses"))).alias("open"))


def _sources(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of fetched stretches: document, anchor place, bytes before the anchor, size, where each begins, and the hashes
    of the 64 bytes from each place on."""
    doc, at = rows.column("doc").to_numpy(), rows.column("at").to_numpy()
    sizes = at & 255
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()) + bytes(LENGTH), np.uint8)
    _, wide = gram_hashes(data)
    return doc, at >> 15, at >> 8 & 127, sizes, np.cumsum(sizes) - sizes, wide


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the number within its row of ``counts`` things a row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


@tidy
def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per block of a stretch: hash of the bytes that its windows share, hash of the whole, document, place."""
    for batch in batches:
        for begin in range(0, len(batch), FETCHED_AT_ONCE):
            rows = batch.slice(begin, FETCHED_AT_ONCE)
            doc, _, left, sizes, starts, wide = _sources(rows)
            # Windows start from ``left`` bytes before the anchor down to ``least``.
            least = left - (sizes - LENGTH)
            row, block = _each((left // OFFSETS) - (least // OFFSETS) + 1)
            block += (least // OFFSETS)[row]
            low, high = _offsets(left[row], sizes[row], block)
            first, end = starts[row] + left[row] - high, starts[row] + left[row] - low + LENGTH
            core = starts[row] + left[row] - block * OFFSETS
            k1 = (wide[core] * _ODD[12] ^ wide[core + CORE - 64]) * _ODD[13] + block.astype(np.uint64)
            k2 = (wide[first] * _ODD[14] ^ wide[end - 64]) * _ODD[15] + (low * 256 + high).astype(np.uint64)
            place = rows.column("at").to_numpy()[row] << 4 | block
            columns = [(k1 ^ k1 >> _S29).view(np.int64), (k2 ^ k2 >> _S29).view(np.int64), doc[row], place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "doc", "at"])


@tidy
def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per window of an open block, keyed by the hashes of its first and its last 64 bytes."""
    for batch in batches:
        for begin in range(0, len(batch), FETCHED_AT_ONCE):
            rows = batch.slice(begin, FETCHED_AT_ONCE)
            doc, place, left, sizes, starts, wide = _sources(rows)
            low, high = _offsets(left, sizes, rows.column("block").to_numpy())
            row, inner = _each(high - low + 1)
            offset = low[row] + inner
            where = starts[row] + left[row] - offset
            columns = [wide[where].view(np.int64), wide[where + LENGTH - 64].view(np.int64), doc[row], place[row] - offset]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "doc", "at"])


def _offsets(left, sizes, block):
    """The least and the greatest distance from the anchor of the windows in a block of a stretch."""
    least = left - (sizes - LENGTH)
    return np.maximum(least, block * OFFSETS), np.minimum(left, block * OFFSETS + OFFSETS - 1)


@F.arrow_udf(T.BinaryType())
def _pressed(texts: pa.Array) -> pa.Array:
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(memoryview(t.as_buffer())) for t in texts], pa.binary())


def _opened(value: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


@tidy
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches that are asked for, document by document."""

    def batch_of(docs: list[np.ndarray], places: list[np.ndarray], found: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(docs)), pa.array(np.concatenate(places)), pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc", "at", "bytes"])

    for batch in batches:
        docs, places, found = [], [], []
        for doc, pressed, asked in zip(batch.column("doc").to_pylist(), batch.column("pressed"), batch.column("asked")):
            text, at = _opened(pressed), asked.values.to_numpy()
            low = (at >> 15) - (at >> 8 & 127)
            found += [text[a:b] for a, b in zip(low.tolist(), (low + (at & 255)).tolist())]
            docs.append(np.full(len(at), doc, np.int64))
            places.append(at)
            if len(found) > FETCHED_AT_ONCE:
                yield batch_of(docs, places, found)
                docs, places, found = [], [], []
        if found:
            yield batch_of(docs, places, found)


def _asked(of: DataFrame, texts: DataFrame) -> DataFrame:
    asked = of.groupBy("doc").agg(F.collect_list("at").alias("asked"))
    joined = texts.select("doc", _pressed("text").alias("pressed")).join(asked, "doc")
    return joined.mapInArrow(_fetch, "doc long, at long, bytes binary")


def _span(low: Column, high: Column) -> list[Column]:
    return ["doc", low.alias("low"), high.alias("high")]


def _stretch_bounds(of: DataFrame) -> DataFrame:
    low = F.shiftright("at", 15) - F.shiftright("at", 8).bitwiseAND(F.lit(127))
    return of.select(*_span(low, low + F.col("at").bitwiseAND(F.lit(255))))


def _block_bounds(of: DataFrame) -> DataFrame:
    """The bytes of blocks, whose place is that of their stretch and their number."""
    at = F.shiftright("at", 4)
    place, left, size = F.shiftright(at, 15), F.shiftright(at, 8).bitwiseAND(F.lit(127)), at.bitwiseAND(F.lit(255))
    block = F.col("at").bitwiseAND(F.lit(15)) * OFFSETS
    high = F.least(left, block + (OFFSETS - 1))
    low = F.greatest(left - (size - LENGTH), block)
    return of.select(*_span(place - high, place - low + LENGTH))


def repeated_ranges(texts: DataFrame, size: int) -> DataFrame:
    """``doc`` and ``ranges``, the sorted disjoint intervals of bytes to remove, of the documents that have any.

    ``texts`` has ``doc``, a long, and ``text``, bytes; a doc has one text. ``size`` is the number of bytes.
    """
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def sorted_out(records: DataFrame, name: str, n: int) -> tuple[DataFrame, DataFrame]:
        """Copies and open representatives among ``n`` records, about."""
        judged = stored(_ranged(records, 1 + n // RANGE_RECORDS), name)
        reps = _across(judged)
        copies = judged.where(F.col("kind") == COPY).select("doc", "at").unionByName(reps.where("copy").select("doc", "at"))
        return copies, stored(reps.where("open").select("doc", "at"), f"open {name}")

    # Two in SPAN + 1 places are anchors.
    copies, opened = sorted_out(texts.mapInArrow(_emit_stretches, RECORD), "stretches", int(size * 2 / (SPAN + 1)))
    spans = [_stretch_bounds(copies)]
    if n_open := opened.count():
        fetched = stored(_asked(opened, texts), "bytes")
        copies, blocks = sorted_out(fetched.mapInArrow(_emit_blocks, RECORD), "blocks", n_open * SPAN // (2 * OFFSETS))
        spans.append(_block_bounds(copies))
        if n_open := blocks.count():
            of_stretch = blocks.select("doc", F.shiftright("at", 4).alias("at"), F.col("at").bitwiseAND(F.lit(15)).alias("block"))
            windows = fetched.join(of_stretch, ["doc", "at"]).mapInArrow(_emit_windows, RECORD)
            copies, _ = sorted_out(windows, "windows", n_open * OFFSETS)
            spans.append(copies.select(*_span(F.col("at"), F.col("at") + LENGTH)))
    intervals = reduce(DataFrame.unionByName, spans)
    found = intervals.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    ranges = checkpoint(found.select("doc", _merged("spans").alias("ranges")))
    delete(spark, folder)
    return ranges


@F.arrow_udf(T.ArrayType(T.StructType().add("low", T.LongType()).add("high", T.LongType())))
def _merged(spans: pa.Array) -> pa.Array:
    out = []
    for row in spans:
        low, high = row.values.field("low").to_numpy(), row.values.field("high").to_numpy()
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
        ends = high[np.concatenate([new[1:], [len(low)]]) - 1]
        out.append([{"low": a, "high": b} for a, b in zip(low[new].tolist(), ends.tolist())])
    return pa.array(out, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))


def _remaining(texts: pa.Array, ranges: pa.Array) -> Iterator[bytes]:
    for text, row in zip(texts, ranges):
        data = _opened(text)
        if row.is_valid:
            low, high = row.values.field("low").to_pylist(), row.values.field("high").to_pylist()
            data = b"".join(data[a:b] for a, b in zip([0, *high], [*low, len(data)]))
        yield data


@F.arrow_udf(T.BinaryType())
def _kept(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    return pa.array(_remaining(texts, ranges), pa.binary())


@F.arrow_udf(T.StringType())
def _kept_text(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    return pa.array((kept.decode("utf-8", "ignore") for kept in _remaining(texts, ranges)), pa.string())


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the text that remains, ``kept``, its exact bytes, and ``n_bytes``,
    ``n_removed`` and ``n_spans``.

    A byte goes if a string of 100 bytes that holds it also starts earlier: in a document of smaller id, or before
    in the same one. Cuts may fall between the bytes of a character; the text leaves out such broken characters.
    Null texts are empty. Rows without an id neither lose bytes nor take them from others. Equal rows are one
    document. Of several texts under one id, the one of the least hash is the document, and rows with another
    stay whole. Input columns called like the new ones are replaced.
    """
    text = F.coalesce(of_row(text_col), F.lit("")).cast("binary")
    rows = held(docs).select(ROW, of_row(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("version"))
    texts = rows.where("doc is not null").select("doc", "text", "version")
    per_id = texts.groupBy("doc").agg(F.count("*").alias("rows"), F.min("version").alias("version"), F.max(F.length("text")).alias("size"))
    repeated, size = per_id.agg(F.max("rows") > 1, F.sum("size")).first()
    if repeated:
        texts = texts.groupBy("doc").agg(F.min_by("text", "version").alias("text"))
        rows = rows.join(per_id.select("doc", "version", F.lit(True).alias("chosen")), ["doc", "version"], "left")
        rows = rows.withColumn("doc", F.when(F.col("chosen"), F.col("doc")))
    ranges = repeated_ranges(texts.select("doc", "text"), size or 0)
    slim = rows.select(F.col(ROW).dropFields(text_col).alias(ROW), "doc", _pressed("text").alias("pressed"), F.length("text").alias("size"))
    nothing = F.lit(0).cast("long")
    kept = slim.join(ranges, "doc", "left").select(
        ROW,
        F.col("size").cast("long").alias("size"),
        # What is not asked for of these two is not made.
        _kept("pressed", "ranges").alias("kept"),
        _kept_text("pressed", "ranges").alias("text"),
        F.coalesce(F.aggregate("ranges", nothing, lambda total, r: total + r["high"] - r["low"]), nothing).alias("removed"),
        F.coalesce(F.size("ranges").cast("long"), nothing).alias("spans"),
    )
    new = {"kept": "kept", "n_bytes": "size", "n_removed": "removed", "n_spans": "spans"}
    return released(kept, docs.columns, **{text_col: F.col("text")}, **{name: F.col(c) for name, c in new.items()})
