"""Words of Arrow text columns as 64-bit hashes, made from the bytes of many documents at once.

The hash of a word is a polynomial of its bytes, taken from prefix sums over the line of bytes; words of more than LONG
bytes are hashed one by one. Equal words have equal hashes wherever they stand. No step makes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of documents that are read together, of a step over them, and of the longest word that the sums hash.
CHUNK, STEP, LONG = 1 << 20, 1 << 16, 32
_SEED = np.random.default_rng(20)
_BASE = int(_SEED.integers(2**62, 2**63, dtype=np.uint64)) * 2 + 1
_VALUE = _SEED.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_FOLDED = _VALUE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STEP + 2 * LONG, _BASE, np.uint64)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STEP + 2 * LONG, pow(_BASE, -1, 2**64), np.uint64)]))
#: Odd multipliers of the hashes of several words.
_FACTORS = [np.random.default_rng(k).integers(2**62, 2**63, 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in range(3)]


def mixed(h: np.ndarray) -> np.ndarray:
    """h with its bits spread, in place."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Line(NamedTuple):
    """Words of documents that stand one after the other; cuts[k] is the number of words before document k."""

    first: int  # the row of the first document in its batch
    data: np.ndarray  # bytes of the documents
    starts: np.ndarray  # byte at which each word starts
    ends: np.ndarray  # and ends
    cuts: np.ndarray
    ids: np.ndarray


def _ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    value, a = _FOLDED if fold else _VALUE, 0
    while a < len(starts):
        zero = int(starts[a])
        b = int(np.searchsorted(starts, zero + STEP))
        part = data[zero : zero + STEP + LONG]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * _POWER[: len(part)], out=sums[1:])
        s, e = starts[a:b] - zero, np.minimum(ends[a:b] - zero, len(part))
        out[a:b] = (sums[e] - sums[s]) * _INVERSE[s]
        a = b
    out += (ends - starts).astype(np.uint64)
    mixed(out)
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        import xxhash

        raw = data.tobytes()
        for k in long.tolist():
            word = raw[starts[k] : ends[k]]
            out[k] = xxhash.xxh3_64_intdigest(word.translate(_LOWER) if fold else word)
    return out


def line(data: np.ndarray, offsets: np.ndarray, first: int = 0, fold: bool = False) -> Line:
    """The words of documents; document k is data[offsets[k]:offsets[k + 1]]. fold: A-Z count as a-z."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    # white space between words: 0x20 and 0x09 to 0x0D
    np.logical_and(data != 0x20, data - np.uint8(0x09) > 4, out=solid[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return Line(first, data, starts, ends, np.searchsorted(starts, offsets), _ids(data, starts, ends, fold))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lines(data: np.ndarray, offsets: np.ndarray, fold: bool = False, chunk: int = CHUNK) -> Iterator[Line]:
    """The words of all documents, about `chunk` bytes of whole documents at a time."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, side="right")) - 1)
        yield line(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, fold)
        a = b


def rolled(ids: np.ndarray, n: int, which: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = ids[:m].copy()
    for k in range(1, n):
        out *= _FACTORS[which]
        out += ids[k : k + m]
    return mixed(out)


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of its keys)."""
    shard = (keys >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part
