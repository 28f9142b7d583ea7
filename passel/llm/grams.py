"""Word n-grams of a whole corpus, counted by exchange between buckets of documents and hash partitions.

A bucket is a bounded run of documents of one scan partition, stored as word numbers. It sends the sorted 64-bit keys of its
n-grams, with counts, to the hash partitions; a partition answers by the keys' places in the bucket, so neither keys nor
words travel back. A key has one entry for each bucket at most, however often an n-gram occurs, so no partition is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext

# Text that a bucket gathers; a longer text is a bucket of its own.
BUCKET_BYTES = 12 << 20
# Occurrences for each hash partition.
PART_TOKENS = 1 << 20
_BUCKETS_IN_PART = 24

PIECES = "bucket long, part int, first int, keys binary, counts binary"
PIECES_TYPE = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("first", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def buckets(batches: Iterator[pa.RecordBatch], limit: int = BUCKET_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Tables of at most ``limit`` bytes in the column ``text`` (or one row), numbered apart in all tasks."""
    number, held, size = TaskContext.get().partitionId() << _BUCKETS_IN_PART, [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + limit - size, "right"))
            stop = start + 1 if stop <= start and not held else stop
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
                start = stop
            if start < batch.num_rows:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A to Z in lower case, cut at 0x20 and 0x09 to 0x0D; how many each text has."""
    runs = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(runs)
    kept = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    offsets = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    return flat.filter(kept), np.diff(upto[offsets])


def word_keys(vocabulary: pa.Array, prefix: bytes = b"") -> np.ndarray:
    """64 bits of each word, after a prefix that sets it apart."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(prefix + w) for w in vocabulary.cast(pa.binary()).to_pylist()), np.uint64, len(vocabulary))


def chained(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The keys of n-grams that go on by a word each (multiply, then the finaliser of SplitMix64)."""
    x = keys * np.uint64(0x9E3779B97F4A7C15) + words
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from -1 on, or sorted keys as differences, compressed with the bytes of each weight together."""
    rising = values.dtype == np.uint64
    values = np.diff(values, prepend=np.uint64(0)) if rising else (values + 1).astype("<u4")
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def unpacked(data: bytes) -> np.ndarray:
    return _unpacked(data, "<u4").astype(np.int32) - np.int32(1)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def part_bits(tokens: int, part_tokens: int = PART_TOKENS) -> int:
    """How many leading bits of a key name its hash partition, so that partitions do not grow with the corpus."""
    return max(0, int(tokens // part_tokens).bit_length())


def pieces(bucket: int, keys: np.ndarray, counts: np.ndarray, bits: int, series: int = 0) -> pa.RecordBatch:
    """Rows of ``PIECES``: sorted keys with their counts, one row for each hash partition; ``series`` keeps kinds apart."""
    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    found, first = np.unique(parts, return_index=True)
    ends = [*first[1:].tolist(), len(keys)]
    spans = list(zip(first.tolist(), ends))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(spans), bucket), pa.int64()),
            pa.array(found + (series << bits), pa.int32()),
            pa.array(first, pa.int32()),
            pa.array([packed(keys[a:b]) for a, b in spans], pa.binary()),
            pa.array([packed(counts[a:b]) for a, b in spans], pa.binary()),
        ],
        schema=PIECES_TYPE,
    )


def opened(table: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(bucket, first, keys, counts) of each row of ``PIECES``, by bucket."""
    rows = [(r["bucket"], r["first"], unpacked_keys(r["keys"]), unpacked(r["counts"]).astype(np.int64)) for r in table.to_pylist()]
    return sorted(rows, key=lambda r: r[:2])
