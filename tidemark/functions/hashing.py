"""Fingerprints, SimHash and Hamming distance."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from tidemark.functions.text import tokens_dedup


def fingerprint(text: Column) -> Column:
    return F.md5(F.lower(F.coalesce(text, F.lit(""))))


def cache_key(text: Column) -> Column:
    """Labels are shared by equal texts only: the whole text counts."""
    return F.md5(F.coalesce(text, F.lit("")))


def trimmed_md5(text: Column) -> Column:
    return F.md5(F.trim(F.coalesce(text, F.lit(""))))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@lru_cache(maxsize=1 << 17)
def _signs(shingle: str) -> np.ndarray:
    """+1 / -1 for each of the low 64 bits of md5, bit 0 first."""
    low = np.frombuffer(hashlib.md5(shingle.encode("utf-8")).digest()[:7:-1], dtype=np.uint8)
    return np.unpackbits(low, bitorder="little").astype(np.int32) * 2 - 1


#: Votes added up at once: rows of 64 small numbers. Numbers of the histograms made at once.
VOTES, HISTOGRAM = 1 << 18, 1 << 21
#: A histogram pays for a text with more windows than this part of the distinct ones.
DENSE = 24


def simhash_batch(texts: list[bytes], n: int) -> np.ndarray:
    """SimHash of ASCII texts over windows of ``n`` (at most 7) bytes; a shorter text is one window. All texts at once."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros(len(texts), np.int64)
    short = np.flatnonzero(sizes < n)
    out[short] = [_bits(_signs(texts[i].decode("ascii"))[None, :])[0] for i in short]
    windows = np.maximum(sizes - n + 1, 0)
    at = np.arange(windows.sum()) + np.repeat((sizes.cumsum() - sizes) - (windows.cumsum() - windows), windows)
    spread = np.concatenate((data, np.zeros(n, np.uint8)))
    code = np.zeros(len(data), np.int32 if n <= 3 else np.int64)
    for j in range(n):
        code = (code << 8) | spread[j : j + len(data)]
    code = code[at]
    distinct, which = _numbered(code, n)
    signs = np.array([_signs(int(c).to_bytes(n, "big").decode("ascii")) for c in distinct], np.int32).reshape(-1, 64)
    starts = windows.cumsum() - windows
    # of a text long beside the distinct windows a histogram times their signs; of a shorter one its own windows
    dense = np.flatnonzero(windows * DENSE > len(distinct))
    step = max(1, HISTOGRAM // max(len(distinct), 1))
    exact = signs.astype(np.float32 if windows.max(initial=0) < 1 << 24 else np.float64)
    for k in range(0, len(dense), step):
        texts_now = dense[k : k + step]
        size = windows[texts_now]
        own = np.arange(size.sum()) + np.repeat(starts[texts_now] - (size.cumsum() - size), size)
        held = np.bincount(np.repeat(np.arange(len(size)), size) * len(distinct) + which[own], minlength=len(size) * len(distinct))
        out[texts_now] = _bits(held.reshape(len(size), -1).astype(exact.dtype) @ exact)
    sparse = np.flatnonzero((windows > 0) & (windows * DENSE <= len(distinct)))
    ends = windows[sparse].cumsum()
    k = 0
    while k < len(sparse):  # whole texts, about VOTES windows of them
        first = ends[k] - windows[sparse[k]]
        stop = max(k + 1, int(np.searchsorted(ends, first + VOTES, side="right")))
        size = windows[sparse[k:stop]]
        begin = size.cumsum() - size
        own = np.arange(size.sum()) + np.repeat(starts[sparse[k:stop]] - begin, size)
        out[sparse[k:stop]] = _bits(np.add.reduceat(signs[which[own]], begin, axis=0))
        k = stop
    return out


def _numbered(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and the place of each code among them; short codes by a table instead of a sort."""
    if n > 3:
        return np.unique(code, return_inverse=True)
    present = np.zeros(1 << 8 * n, bool)
    present[code] = True
    distinct = np.flatnonzero(present)
    place = np.zeros(len(present), np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[code]


def _bits(votes: np.ndarray) -> np.ndarray:
    return np.packbits((votes > 0).astype(np.uint8), axis=1, bitorder="little").view(np.int64)[:, 0]


def simhash_joined(n: int = 3):
    @F.arrow_udf(T.LongType())
    def run(s: pa.Array) -> pa.Array:
        texts = [v or b"" for v in s.cast(pa.binary()).to_pylist()]
        out, k = np.zeros(len(texts), np.int64), 0
        while k < len(texts):  # about four million bytes at once
            stop, size = k, 0
            while stop < len(texts) and size < 1 << 22:
                size += len(texts[stop])
                stop += 1
            out[k:stop] = simhash_batch(texts[k:stop], n)
            k = stop
        return pa.array(out)

    return run


def simhash64(text: Column, n: int = 3) -> Column:
    """64-bit SimHash over character shingles, signed.

    The tokens come from JVM expressions; the 64-way vote is taken for all rows of a
    batch together.  The step is map-only: exploding the shingles instead would shuffle 64
    counters per row and need a join to get the row back.
    """
    return simhash_joined(n)(F.array_join(tokens_dedup(text), " "))


def simhash_bands(h: Column, bands: int = 4) -> list[Column]:
    """Band values, low bits first; widths differ by one when 64 is not divisible."""
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    return [bit_slice(h, lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def bit_slice(h: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


# --- MinHash ----------------------------------------------------------------------------------

PRIME = 2_147_483_647


def hash_family(hashes: int) -> list[tuple[int, int]]:
    """Factor and shift of each MinHash function."""
    draw = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16) + 1
    return [(draw(f"a{k}"), draw(f"b{k}")) for k in range(hashes)]


@lru_cache(maxsize=1 << 17)
def _number(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16) % PRIME


def least_hashes(words: Column, hashes: int, marked: frozenset[str] | None = None) -> Column:
    """Per row the least value of each hash function over its words; empty for no words.

    A word is digested once per batch, whatever the number of functions. With ``marked`` words the value is doubled, plus one where
    the least word is not among them: so equal values say whether the word that two rows agree on is marked.
    """
    family = hash_family(hashes)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(lists: pa.Array) -> pa.Array:
        found = lists.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.flatnonzero(sizes)
        out = np.zeros((len(some), hashes), np.int64)
        if len(some):
            distinct = found.dictionary.to_pylist()
            number = np.array([_number(w) for w in distinct], np.int64)
            plain = np.array([w not in marked for w in distinct], np.int64) if marked is not None else None
            which = found.indices.to_numpy()
            starts = (sizes.cumsum() - sizes)[some]
            for k, (a, b) in enumerate(family):
                value = (a * number + b) % PRIME
                out[:, k] = np.minimum.reduceat((value if plain is None else 2 * value + plain)[which], starts)
        offsets = np.concatenate(([0], (sizes > 0).cumsum() * hashes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return run(words)
