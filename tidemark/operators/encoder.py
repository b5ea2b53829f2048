"""A text encoder that is fitted to the collection: truncated SVD of its TF-IDF matrix, by a randomised range finder.

Words are hashed to ``features`` columns. The matrix A (a unit row per text) is never held: a pass returns AᵀAQ for a block Q of a
few columns, summed in the tasks and then by Spark. A random block, a few passes with QR in between, and the eigenproblem of the
small matrix QᵀAᵀAQ give the leading right singular vectors V; a text, seen or new, is encoded as its row times V, at unit length.

The driver holds ``features`` x (``dim`` + ``OVERSAMPLE``) numbers, whatever the number of texts. Texts without words have the zero
vector; null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import tokens_retrieval
from tidemark.operators.cells import stored

FEATURES, DIM, OVERSAMPLE, PASSES = 4_096, 64, 10, 3
#: Words of a batch that are worked on at once (a text with more is one slice): memory doesn't grow with the batch.
SLICE_WORDS = 1 << 16


@dataclass
class Encoder:
    idf: np.ndarray
    vectors: np.ndarray  # features x dim
    singular: np.ndarray
    energy: float  # the squared length of the whole matrix

    @property
    def features(self) -> int:
        return len(self.idf)


def hashed(text: Column, features: int) -> Column:
    """The column of each word, in order."""
    return F.transform(tokens_retrieval(text), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def _slices(lists: pa.Array):
    """``lists`` in stretches of rows with at most ``SLICE_WORDS`` words, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(int(np.searchsorted(ends, before + SLICE_WORDS, side="right")), start + SLICE_WORDS))
        yield lists.slice(start, stop - start)
        start = stop


def _rows(lists: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of a batch: TF-IDF, each row of unit length; sorted by row, then column."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.repeat(np.arange(len(lists)), sizes) * len(idf) + lists.flatten().to_numpy(zero_copy_only=False)
    code, tf = np.unique(code, return_counts=True)
    row, col = np.divmod(code, len(idf))
    value = tf * idf[col]
    length = np.sqrt(np.bincount(row, value * value, minlength=len(lists)))[row]
    return row, col, np.divide(value, length, out=np.zeros(len(value)), where=length > 0)


def _times(row: np.ndarray, col: np.ndarray, value: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """The rows of the batch times ``q``."""
    out = np.zeros((n, q.shape[1]))
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[first]] = np.add.reduceat(value[:, None] * q[col], first)
    return out


def _summed(df: DataFrame, part, rows: int, width: int) -> np.ndarray:
    """The sum of ``part(lists)``, a matrix of ``rows`` x ``width``, over all batches."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def sums(batches):
        total = np.zeros((rows, width))
        for batch in batches:
            for lists in _slices(batch.column(0)):
                total += part(lists)
        some = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        offsets = np.arange(len(some) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[some].ravel()))], names=["i", "v"])

    by_row = df.select("h").mapInArrow(sums, "i int, v array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("s"))
    out = np.zeros((rows, width))
    for i, v in by_row.select("i", vector_to_array("s")).collect():  # at most ``rows`` rows
        out[i] = v
    return out


def fit(docs: DataFrame, text: Column, dim: int = DIM, features: int = FEATURES, passes: int = PASSES, seed: int = 17) -> Encoder:
    """Fit to all rows of ``docs``."""
    h = stored(docs.select(hashed(F.coalesce(text, F.lit("")), features).alias("h")), "hashed")
    n = h.count()

    def present(lists):
        row, col, _ = _rows(lists, np.ones(features))
        return np.bincount(col, minlength=features).astype(float)[:, None]

    df = _summed(h, present, features, 1)[:, 0]
    idf = np.log((n + 1) / (df + 1)) + 1
    width = min(features, dim + OVERSAMPLE)

    def gram(q):
        def part(lists):
            row, col, value = _rows(lists, idf)
            p = _times(row, col, value, q, len(lists))
            order = np.argsort(col, kind="stable")
            return _times(col[order], row[order], value[order], p, features)

        return _summed(h, part, features, width)

    def energy(lists):
        return np.array([[(_rows(lists, idf)[2] ** 2).sum()]])

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    for _ in range(passes):
        q = np.linalg.qr(gram(q))[0]
    small = q.T @ gram(q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(values)[::-1][:dim]
    return Encoder(idf, q @ turn[:, keep], np.sqrt(np.maximum(values[keep], 0)), float(_summed(h, energy, 1, 1)[0, 0]))


def encode(df: DataFrame, text: Column, encoder: Encoder, out: str = "vec", share: str | None = None) -> DataFrame:
    """``df`` with the unit vector of each text in ``out``; ``share`` names a column for the part of the row's length that the
    fitted directions keep (0 to 1). Map-only."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    kind = "struct<vec: array<float>, share: double>"

    @F.arrow_udf(kind)
    def run(lists: pa.Array) -> pa.Array:
        e = shared.value
        x = np.concatenate([_times(*_rows(some, e.idf), e.vectors, len(some)) for some in _slices(lists)] or [np.zeros((0, e.vectors.shape[1]))])
        length = np.linalg.norm(x, axis=1)
        unit = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0).astype(np.float32)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * x.shape[1]), pa.array(unit.ravel()))
        return pa.StructArray.from_arrays([vec, pa.array(length)], names=["vec", "share"])

    made = run(hashed(F.coalesce(text, F.lit("")), encoder.features))
    out_df = df.withColumn("_made", made).withColumn(out, F.col("_made.vec"))
    return (out_df.withColumn(share, F.col("_made.share")) if share else out_df).drop("_made")
