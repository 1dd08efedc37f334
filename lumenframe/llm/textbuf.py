"""Vectorised views of text columns inside Arrow batches.

Every operator that leaves the JVM gets its texts through ``chunks``: whole documents,
a bounded number of bytes at a time (one document longer than the bound is a chunk of
its own), as one byte buffer plus offsets, without making a Python string per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes whose prefix sums are held at once.
HASH_BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
_SEED = np.random.default_rng(20240229)
#: One random 64-bit value per byte value, for polynomial hashes.
BYTE_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_table() -> np.ndarray:
    """ASCII letters (lower-cased), ASCII digits and all non-ASCII bytes keep a value; the rest is 0."""
    t = np.zeros(256, np.uint8)
    t[0x30:0x3A] = np.arange(0x30, 0x3A)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


WORDS = word_table()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text each, or a single row: (rows, bytes, offsets)."""
    for batch in batches:
        buf, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * HASH_BLOCK)
        out = []
        for base in (_BASE, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, out=p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[starts:ends]`` for every span, starts ascending; equal content gives an equal hash wherever it stands.

    Prefix sums of a polynomial, over blocks of bytes, so that memory does not grow with the text.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + HASH_BLOCK)))
        a, b = starts[i:j] - lo, ends[i:j] - lo
        part = BYTE_VALUES[values[lo : lo + int(b.max())]]
        p, inv = powers(len(part) + 1)
        acc = np.zeros(len(part) + 1, np.uint64)
        part *= p[:-1]
        np.cumsum(part, out=acc[1:])
        out[i:j] = mix((acc[b] - acc[a]) * inv[a] + (b - a).astype(np.uint64))
        i = j
    return out


def spans_of(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a document boundary: (starts, ends)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    heads = off[:-1][off[1:] > off[:-1]]
    tails = off[1:][off[1:] > off[:-1]] - 1
    first[heads] = mask[heads]
    last[tails] = mask[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, word starts, word ends, word hashes, index of each document's first word plus the total)."""
    norm = table[buf]
    starts, ends = spans_of(norm != 0, off)
    return norm, starts, ends, span_hashes(norm, starts, ends), np.searchsorted(starts, off)


_DIGESTS: dict[bytes, int] = {}
_MOST_DIGESTS = 1 << 19


def strong_words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits of the BLAKE2b digest of every word, index of each document's first word plus the total).

    Words are told apart by their bytes; a worker keeps the digests of words that it has met.
    """
    norm = table[buf]
    starts, ends = spans_of(norm != 0, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(norm[norm != 0])]).dictionary_encode()
    if len(_DIGESTS) > _MOST_DIGESTS:
        _DIGESTS.clear()
    out = np.empty(len(coded.dictionary), np.uint64)
    for k, w in enumerate(coded.dictionary.to_pylist()):
        if (d := _DIGESTS.get(w)) is None:
            d = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            if len(w) <= 64:
                _DIGESTS[w] = d
        out[k] = d
    return out[coded.indices.to_numpy()], np.searchsorted(starts, off)


def per_doc(first: np.ndarray) -> np.ndarray:
    """Document number of every word, from the ``first`` that words() returns."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema], schema=schema)
