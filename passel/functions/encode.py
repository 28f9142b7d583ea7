"""Text to vector."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.functions.vectors import NORM_FLOOR

DEFAULT_DIM = 64
DEFAULT_MODEL = "md5-token-buckets"
# Text that is split into tokens at once; the tokens take some ten times its memory.
SLICE_BYTES = 1 << 20


def _slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Runs of texts of at most ``limit`` bytes together, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def _token_buckets(tokens: pa.Array, dim: int) -> np.ndarray:
    """The first 32 bits of the MD5 of every token, modulo ``dim``; -1 for an empty token."""
    heads = b"".join([hashlib.md5(t).digest()[:4] for t in tokens.cast(pa.binary()).to_pylist()])
    buckets = np.frombuffer(heads, dtype=">u4").astype(np.int64) % dim
    buckets[pc.equal(tokens, "").to_numpy(zero_copy_only=False)] = -1
    return buckets


def _bucket_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Token counts per bucket, one row per text; each distinct token is hashed once a call."""
    words = pc.split_pattern(pc.fill_null(texts, ""), " ")
    tokens = pc.list_flatten(words).dictionary_encode()
    if len(tokens) == 0:
        return np.zeros((len(texts), dim))
    bucket = _token_buckets(tokens.dictionary, dim)[tokens.indices.to_numpy()]
    row = pc.list_parent_indices(words).to_numpy()
    kept = bucket >= 0
    cell = row[kept] * dim + bucket[kept]
    return np.bincount(cell, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)


def _unit_counts(texts: pa.Array, dim: int) -> np.ndarray:
    counts = _bucket_counts(texts, dim)
    lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return (counts / np.maximum(lengths, NORM_FLOOR)).astype(np.float32)


def hashing_encoder(dim: int = DEFAULT_DIM) -> Callable[[Column], Column]:
    """An encoder that needs no model file: token counts in ``dim`` buckets, scaled to unit length.

    Tokens are lower-cased and separated by spaces; the whole text counts. A batch is worked through in slices of
    bounded length, so the memory of a task does not grow with the passages that a batch holds.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pa.Array) -> pa.Array:
        unit = np.empty((len(texts), dim), np.float32)
        start = 0
        for some in _slices(texts, SLICE_BYTES):
            unit[start : start + len(some)] = _unit_counts(some, dim)
            start += len(some)
        offsets = np.arange(0, unit.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))

    return lambda text: encode(F.lower(text))


def model_encoder(make_predict: Callable[[], Callable], batch_size: int = 256) -> Callable[[Column], Column]:
    """An encoder around a user's model.

    ``make_predict`` runs once per Python worker and returns a function from an array of texts to
    a matrix of vectors.
    """
    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda text: udf(text)
