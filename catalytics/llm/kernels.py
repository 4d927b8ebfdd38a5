"""Vectorised text kernels: numpy over the byte buffers of Arrow string columns.

All of them see a *run* of documents as one byte array with offsets, so a batch
of short texts costs a few array passes instead of a Python loop per word.
Hashes are 64-bit polynomial hashes (wrapping arithmetic, odd base, random
values per byte) finished by a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once (one longer text is a run of its own).
RUN_BYTES = 1 << 19

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def release() -> None:
    """Hand freed memory of the process back to the system, where the platform can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed + 0x632BE59BD9B4E019], np.uint64))[0]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept between runs)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def byte_class(text: str, high: bool = False) -> np.ndarray:
    """Table of 256: True for the ASCII characters of ``text`` (and for bytes >= 0x80 if ``high``)."""
    table = np.zeros(256, bool)
    table[list(text.encode("ascii"))] = True
    table[128:] = high
    return table


#: Everything but ASCII space and \x09-\x0D.
NOT_SPACE = ~byte_class("\x20\x09\x0a\x0b\x0c\x0d")
#: 0-9, a-z and all non-ASCII (texts are lower-cased first).
ALNUM = byte_class("0123456789abcdefghijklmnopqrstuvwxyz", high=True)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n+1 offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(batch: pa.RecordBatch, column: str, most: int = RUN_BYTES):
    """Cut a batch into slices of about ``most`` bytes of ``column``: ``(slice, bytes, offsets)``."""
    data, offsets = buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Maximal runs of bytes of the class ``inside``, within documents.

    Returns starts, ends (byte positions) and ``first``: words of document d are
    ``first[d]:first[d+1]``.
    """
    n = len(data)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(flag[1:] & (~flag[:-1] | edge))
    ends = np.flatnonzero(flag[:-1] & (~flag[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums, from which any substring's hash follows, and the inverse powers."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums, powers(BASE_INVERSE, len(data) + 1)


def span_hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes ``starts[i]:ends[i]`` (length included)."""
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seeded(seed))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(*prefix(data), starts, ends)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (across documents too: mask with ``gram_fits``)."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, seeded(seed + k), np.uint64)
    for j in range(k):
        out *= np.uint64(BASE)
        out += hashes[j:j + n]
    return mix(out)


def gram_docs(first: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document of each gram position of n, and whether the gram lies within it."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    return doc, np.arange(n) + k <= first[1:][doc] if n else np.zeros(0, bool)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(s, s + l)`` over all pairs."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def cover_counts(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of n positions that lie in any of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as sorted disjoint spans (touching ones join)."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])]


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)
