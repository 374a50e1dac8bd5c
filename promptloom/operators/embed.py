"""Text embedding (V1): one vector per text, no shuffle.

Default: a deterministic feature-hashing embedder.  Every token (lower-cased run
of letters/digits) gets the number of the first 8 hex digits of its MD5, JVM-side;
the number modulo ``dim`` is its bucket and the top bit its sign.  An Arrow UDF adds
the signs per bucket for a whole batch with one ``numpy.bincount`` and L2-normalises
the vectors.  Any model can be plugged in as ``embedder``: a function
``Column -> Column`` such as an iterator ``pandas_udf`` that loads the model once per
task and embeds batches (Arrow batches of
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, 512 in the reference's batched
mode).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bm25 import lexical_tokens

TOP_BIT = 1 << 31
PIECE_TOKENS = 1 << 18


def token_numbers(text_col, max_tokens: int | None = None) -> Column:
    """The 32-bit number of every token."""
    toks = lexical_tokens(text_col)
    if max_tokens is not None:
        toks = F.slice(toks, 1, max_tokens)
    return F.transform(toks, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"))


def dense_vectors(numbers: pa.Array, dim: int, most: int = PIECE_TOKENS) -> pa.Array:
    """Normalised signed bucket counts of every row (null or empty: zeros), at most about ``most``
    tokens (a row at least) at a time."""
    n = len(numbers)
    lengths = np.asarray(numbers.value_lengths().fill_null(0), dtype=np.int64)
    out = np.zeros((n, dim), np.float32)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        flat = numbers.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(hi - lo) * dim, lengths[lo:hi]) + flat % dim
        v = np.bincount(at, np.where(flat >= TOP_BIT, 1.0, -1.0), (hi - lo) * dim)
        v = v.astype(float).reshape(hi - lo, dim)      # of no tokens at all it counts integers
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        out[lo:hi] = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        lo = hi
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(out.ravel()))


def _dense(dim: int):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def dense(numbers: pa.Array) -> pa.Array:
        return dense_vectors(numbers, dim)
    return dense


def embed_text(df: DataFrame, text_col: str, *, dim: int = 64, out_col: str = "embedding",
               embedder=None, max_tokens: int | None = None) -> DataFrame:
    """V1: add ``out_col`` (array<float>) for every row.

    ``max_tokens`` truncates like a fixed-length encoder would; the default
    embeds the whole text."""
    if embedder is not None:
        return df.withColumn(out_col, embedder(F.col(text_col)))
    return df.withColumn(out_col, _dense(dim)(token_numbers(text_col, max_tokens)))
