"""Word scanning, word hashes and rolling hashes over UTF-8 buffers, all in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that separate words of the white-space convention: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 256
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the maximal runs of ``word_byte`` bytes; runs end with their document."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = word_byte[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * _P1
    h ^= h >> np.uint64(29)
    h *= _P2
    h ^= h >> np.uint64(32)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
    h = _mix(size.astype(np.uint64), eight[starts] & _MASK[np.minimum(size, 8)])
    at = np.flatnonzero((size > 8) & (size <= _LONG))
    step = 8
    while len(at):
        left = size[at] - step
        h[at] = _mix(h[at], eight[starts[at] + step] & _MASK[np.minimum(left, 8)])
        step += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return h


def rolling(h: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every ``width`` consecutive values, by doubling."""
    out_len = len(h) - width + 1
    if out_len <= 0:
        return np.zeros(0, np.uint64)
    power = np.uint64(multiplier)
    block, span = h, 1
    done, out = 0, None
    rest = width
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                piece = block[done : done + out_len]
                out = piece.copy() if out is None else out * power + piece
                done += span
            rest >>= 1
            if rest:
                block = block[: len(block) - span] * power + block[span:]
                span *= 2
                power = power * power
    return out


def byte_planes(values: np.ndarray) -> bytes:
    """Little-endian bytes of an integer array, plane by plane, so that small values compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(blob: memoryview, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, count * size).reshape(size, count).T).view(kind).reshape(count)
