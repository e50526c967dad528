"""HyperMinHash registers of sets of hashed words, and the similarity they tell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Registers of a set, and bits of a register after the leading zeros.
REGISTERS, MANTISSA = 64, 4
#: Bytes of a signature: the registers, then the parity sketch of 64 bits.
WIDTH = REGISTERS + 8

_A, _B = (np.random.default_rng(5).integers(0, 1 << 63, (2, REGISTERS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def words_of(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, starts) of a column of sets, each the bytes of its sorted 32-bit words, none null or empty."""
    ends = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
    return np.frombuffer(sets.buffers()[2], "<i4", (ends[-1] - ends[0]) // 4, ends[0]), (ends[:-1] - ends[0]) // 4


def signatures(sets: pa.Array) -> np.ndarray:
    """WIDTH bytes of each set: its registers, and its sketch, the parity of its words in each of 64 places."""
    head = np.empty((len(sets), WIDTH), dtype=np.uint8)
    if len(sets):
        flat, starts = words_of(sets)
        word = flat.astype(np.uint64)
        for k in range(REGISTERS):
            head[:, k] = register(np.minimum.reduceat(word * _A[k] + _B[k], starts))  # by its upper bits a strongly universal hash
        place = np.uint64(1) << ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        head[:, REGISTERS:] = np.bitwise_xor.reduceat(place, starts)[:, None].view(np.uint8)
    return head


def as_column(head: np.ndarray) -> pa.Array:
    """Signatures as a column of bytes."""
    ends = (np.arange(len(head) + 1) * WIDTH).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(head))])


def shared_words(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many words two sets have in common, pair by pair."""
    words = lambda x: np.frombuffer(x, dtype="<i4")
    return np.array([len(np.intersect1d(words(x), words(y), assume_unique=True)) for x, y in zip(a.to_pylist(), b.to_pylist())], dtype=np.int64)


def register(least: np.ndarray) -> np.ndarray:
    """Leading zeros, 15 at most, and the bits after the first one, of 64-bit hashes."""
    top = (least >> np.uint64(44)).astype(np.int64)  # 20 bits: 15 leading zeros, a one, 4 bits
    zeros = np.minimum(20 - np.frexp(top.astype(np.float64))[1], 15)
    after = np.where(zeros < 15, top >> np.maximum(15 - zeros, 0), top >> 1)
    return ((zeros << MANTISSA) | (after & ((1 << MANTISSA) - 1))).astype(np.uint8)


def _cells() -> np.ndarray:
    """For each value of a register the hashes it stands for, as [low, high) of the unit interval."""
    out = np.zeros((256, 2))
    for z in range(16):
        lo, width = (2.0 ** -(z + 1), 2.0 ** -(z + 1)) if z < 15 else (0.0, 2.0**-15)
        for m in range(16):
            out[z * 16 + m] = lo + width * m / 16, lo + width * (m + 1) / 16
    return out


_CELLS = _cells()


def collisions(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The chance that a register of a set of na words equals that of a set of nb other words."""
    sizes, inv = np.unique(np.concatenate([na, nb]), return_inverse=True)
    p = (1 - _CELLS[:, 0][None]) ** sizes[:, None] - (1 - _CELLS[:, 1][None]) ** sizes[:, None]
    return np.einsum("ij,ij->i", p[inv[: len(na)]], p[inv[len(na) :]])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that the registers of two classes tell, corrected for chance collisions."""
    c = collisions(na, nb)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of signatures, without nulls, a row each."""
    if not len(column):
        return np.empty((0, WIDTH), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * WIDTH, first).reshape(-1, WIDTH)
