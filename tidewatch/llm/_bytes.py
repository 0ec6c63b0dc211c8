"""Words of Arrow text columns as numpy arrays: byte runs and their 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PRIME = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a run that are read in strides of eight; what is longer goes through xxhash, or a comparison, run by run.
STRIDED = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end: a view with strides of one byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each begins and the end); null texts have no bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(column.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, bounds: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of runs of bytes that are ``inside``, none across texts or ``breaks``, and the first run of each text and the end."""
    size = len(inside)
    edge = np.zeros(size + 1, bool)
    edge[bounds] = True
    if breaks is not None:
        edge[breaks] = True
    before = np.concatenate([[False], inside[:-1]]) if size else inside
    after = np.concatenate([inside[1:], [False]]) if size else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: length and then eight bytes at a time are mixed in, so runs of up to eight bytes and equal length never collide."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) * PRIME)
    view = eights(data)
    rest = np.flatnonzero((size > 0) & (size <= STRIDED))
    at = 0
    while len(rest):
        out[rest] = mixed(out[rest] ^ (view[starts[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    long = np.flatnonzero(size > STRIDED)
    if len(long):
        import xxhash

        for i in long.tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def equal_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each byte run of ``data`` equals the run of ``other`` at the same place of the lists, byte by byte."""
    size = ends - starts
    same = size == other_ends - other_starts
    a, b = eights(data), eights(other)
    rest = np.flatnonzero(same & (size > 0))
    at = 0
    while len(rest) and at < STRIDED:
        differ = (a[starts[rest] + at] ^ b[other_starts[rest] + at]) & _MASK[np.minimum(size[rest] - at, 8)]
        same[rest[differ != 0]] = False
        at += 8
        rest = rest[(differ == 0) & (size[rest] > at)]
    for i in rest.tolist():
        same[i] = np.array_equal(data[starts[i] + at : ends[i]], other[other_starts[i] + at : other_ends[i]])
    return same
