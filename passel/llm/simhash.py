"""Near duplicates by SimHash fingerprints that differ in few bits, found by meeting in the middle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passel.llm.components import connected_components
from passel.llm.tables import ROW, checkpoint, held, of_row, released

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
# Shingles whose bits are counted at once.
BLOCK = 1 << 15
# Bytes of a text that are split into words at once.
SLICE = 1 << 22
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _word_runs(data: bytes, carried: int) -> Iterator[list[bytes]]:
    """The words of a text, in runs that begin with the last ``carried`` words of the run before."""
    last, start = [], 0
    while start < len(data):
        blank = BLANK.search(data, start + SLICE)
        end = blank.start() if blank else len(data)
        words = last + data[start:end].split()
        if len(words) > carried or end == len(data):
            yield words
            last = words[len(words) - carried :]
        else:
            last = words
        start = end


def _shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """The hashes of all runs of ``size`` words, repeats included, in blocks; of all words, if they are fewer."""
    digest = xxhash.xxh64_intdigest
    for number, words in enumerate(_word_runs(data, size - 1)):
        last = len(words) - size + 1
        # Too few words are one shingle, unless they are the end of a longer text.
        last = 1 if last < 1 and number == 0 and words else last
        for start in range(0, last, BLOCK):
            block = words[start : min(start + BLOCK, last) + size - 1]
            line = b" ".join(block)
            ends = np.cumsum([len(w) + 1 for w in block])
            begins = [0, *ends[:-1].tolist()]
            stops = (ends[min(size, len(block)) - 1 :] - 1).tolist()
            yield np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, stops)), "<u8", len(stops))


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: the bits that over half of its shingle hashes have; 0 without words."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes(text.encode().translate(_LOWER), shingle_words):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


# Bytes with A to Z as a to z; white space is what bytes.split() splits at: 0x20 and 0x09 to 0x0D.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _hasher(shingle_words: int):
    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py() or "", shingle_words) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return hashed


def ball(value: Column, radius: int) -> Column:
    """The fingerprint and all that differ from it in up to ``radius`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda mask: value.bitwiseXOR(mask))


def near_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between the ``first`` of classes whose ``fingerprint`` differs in at most ``radius`` bits; the
    links connect all that chains of such differences connect.

    Every fingerprint emits what lies within half the radius of it, and two fingerprints meet in such a variant
    exactly if they are near enough. All that meet in a variant are within the radius of one another, so each is
    linked with the one before it only, and no chain is lost. A variant is met by no more fingerprints than its own
    ball holds, 65 for a radius of 2, however many documents there are.
    """
    if radius % 2:
        raise ValueError("the radius must be even: half of it is emitted on either side")
    emitted = classes.select("first", "fingerprint", F.explode(ball(F.col("fingerprint"), radius // 2)).alias("variant"))
    order = Window.partitionBy("variant").orderBy("first")
    met = emitted.select(
        F.col("first").alias("u"),
        "fingerprint",
        F.lag("first").over(order).alias("v"),
        F.lag("fingerprint").over(order).alias("other"),
    )
    return met.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius).select("u", "v")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """For each row ``doc_id``, ``version`` (a hash of its text), ``fingerprint`` as a signed number and
    ``component_id``, the smallest id that links of at most ``radius`` bits lead to.

    Null, empty and blank texts have the fingerprint 0, which links like any other. Rows without an id take part in
    nothing and have a null component. Of rows with one id each has its own fingerprint and component.

    Copies collapse to one class per fingerprint before anything is emitted.
    """
    hashed = _hasher(shingle_words)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("version"), hashed(text).alias("fingerprint"))
    rows = checkpoint(rows)
    classes = rows.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    linked = connected_components(near_links(classes, radius))
    component = F.coalesce("component", "first").alias("component_id")
    labelled = classes.join(linked, F.col("first") == F.col("node"), "left").select("fingerprint", component)
    # A null id must not meet a class of others with the same text.
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return rows.join(labelled, "fingerprint", "left").select("doc_id", "version", "fingerprint", own)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group, and those without an id."""
    groups = simhash_groups(docs, id_col, text_col, **options)
    first = groups.where("doc_id = component_id").select("doc_id", "version").distinct()
    text = F.coalesce(of_row(text_col), F.lit(""))
    rows = held(docs).select(ROW, of_row(id_col).alias("doc_id"), F.xxhash64(text).alias("version"))
    kept = rows.join(first.withColumn("kept", F.lit(True)), ["doc_id", "version"], "left").where("kept or doc_id is null")
    return released(kept, docs.columns)
