"""Token sequences of bounded length, packed in one pass with a bounded number of open windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passel.llm.bpe import AT_ONCE, ID, encoder, vocabulary
from passel.llm.tables import checkpoint, tidy

MAX_TOKENS = 4096
OPEN_WINDOWS = 16
# Leftover windows that one task merges.
MERGED_AT_ONCE = 1024
# Pieces that a worker hands over at once.
BATCH_PIECES = 4096

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("left_over", pa.bool_()),
    ]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left_over boolean"


class Window:
    __slots__ = ("pieces", "free")

    def __init__(self, size: int):
        self.pieces: list[tuple] = []
        self.free = size

    def put(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.free -= piece[2]


class Packer:
    """Places pieces of at most ``size`` tokens into ``n_open`` open windows.

    A piece goes where it leaves the least room. If it fits nowhere, the fullest window is emitted, and a new one
    opened for it.
    """

    def __init__(self, size: int, n_open: int):
        self.size = size
        self.windows = [Window(size) for _ in range(n_open)]

    def fullest(self) -> Window:
        return min(self.windows, key=lambda w: w.free)

    def place(self, piece: tuple) -> Iterator[Window]:
        fits = [w for w in self.windows if w.free >= piece[2]]
        if fits:
            window = min(fits, key=lambda w: w.free)
        else:
            full = self.fullest()
            yield full
            window = self.windows[self.windows.index(full)] = Window(self.size)
        window.put(piece)
        if not window.free:
            yield window
            self.windows[self.windows.index(window)] = Window(self.size)

    def cut_and_place(self, doc: int | None, ids: np.ndarray) -> Iterator[Window]:
        """Place a document, cut where no window takes its rest: the first part fills the fullest to the end."""
        start = 0
        while start < len(ids):
            length = len(ids) - start
            if length > max(w.free for w in self.windows):
                length = self.fullest().free
            crc = zlib.crc32(ids[start : start + length].tobytes())
            yield from self.place((doc, start, length, crc, len(ids)))
            start += length


def _batches(windows: Iterable[tuple[Window, bool]], first_id: int) -> Iterator[pa.RecordBatch]:
    """The pieces of emitted windows as rows; sequence ids count up from ``first_id``."""
    rows: list[tuple] = []
    for sequence, (window, left_over) in enumerate(windows, first_id):
        offset = 0
        for piece in window.pieces:
            rows.append((*piece, sequence, offset, left_over))
            offset += piece[2]
        if len(rows) >= BATCH_PIECES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    size: int = MAX_TOKENS,
    n_open: int = OPEN_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document: where its ids begin and how many they are, their CRC-32, the document's
    number of ids, and the sequence and offset that hold it.

    A document is its token ids and ``end_id``; a null text is empty, so every row, whatever its id, has a piece.
    Each partition packs its rows in order. A piece that fits into no open window is cut: its first part fills the
    fullest window to the last token, and the rest is placed as any other piece. So all windows that are emitted
    while the rows last are full, and only those still open at the end have room. These leftovers, ``n_open`` windows
    of a partition at most, are merged as whole pieces, longest first, in groups of ``MERGED_AT_ONCE`` windows.
    """
    spec = vocabulary(docs.sparkSession, path)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(spec.value)
        packer = Packer(size, n_open)

        def emitted() -> Iterator[tuple[Window, bool]]:
            for batch in batches:
                for begin in range(0, len(batch), AT_ONCE):
                    some = batch.slice(begin, AT_ONCE)
                    texts = use.encode_batch([t.as_py() or "" for t in some.column(1)])
                    for doc, own in zip(some.column(0).to_pylist(), texts):
                        yield from ((w, False) for w in packer.cut_and_place(doc, np.append(own, end_id).astype(ID)))
            yield from ((w, True) for w in packer.windows if w.pieces)

        yield from _batches(emitted(), TaskContext.get().partitionId() << 32)

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:5]))]
        rows.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3]))
        packer = Packer(size, max(1, sum(r[2] for r in rows) // size))

        def emitted() -> Iterator[tuple[Window, bool]]:
            for row in rows:
                for window in packer.place(row):
                    yield window, False
            yield from ((w, False) for w in packer.windows if w.pieces)

        # Negative ids, so that no window of the first pass has the same.
        yield from _batches(emitted(), -(TaskContext.get().partitionId() + 1) << 32)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = checkpoint(texts.mapInArrow(pack, DDL))
    open_windows = pieces.where("left_over")
    groups = -(-open_windows.select("sequence_id").distinct().count() // MERGED_AT_ONCE)
    # Windows stay together, each with the others of its group.
    merged = open_windows.repartition(max(1, groups), "sequence_id").mapInArrow(merge, DDL)
    return pieces.where("not left_over").unionByName(merged).drop("left_over")
