"""Vectorised hashes of byte strings, windows and words (numpy)."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix((np.arange(256, dtype=U) + U(1)) * GOLD)
ODD = mix(np.arange(1, 65, dtype=U) * GOLD) | U(1)


def powers(n: int) -> np.ndarray:
    """ODD[0] to the powers 0 to n-1, modulo 2**64."""
    out = np.full(n, ODD[0], dtype=U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def doubled(rank: np.ndarray, step: int, offset: int) -> np.ndarray:
    """Ranks of strings of twice the length, or less: of each position's rank and that at offset."""
    return mix(rank[: len(rank) - offset] * ODD[2 * step] + rank[offset:] * ODD[2 * step + 1])


def string_ranks(buf: np.ndarray, length: int) -> np.ndarray:
    """A rank for the string of that length at every position, by prefix doubling."""
    rank, have, step = BYTE[buf], 1, 0
    while have < length:
        offset = min(have, length - have)
        if len(rank) <= offset:
            return np.zeros(0, dtype=U)
        rank, have, step = doubled(rank, step, offset), have + offset, step + 1
    return rank


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of that width."""
    have = 1
    while have < width:
        offset = min(have, width - have)
        x, have = op(x[: len(x) - offset], x[offset:]), have + offset
    return x


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Masks of the first 0 to 8 bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
LONG = 4096


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: maximal runs without ASCII white space."""
    gap = np.ones(len(buf) + 2, dtype=bool)
    gap[1:-1] = SPACE[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of buf: eight bytes at a time, each step mixed with all before it; spans over LONG by a library."""
    size = ends - starts
    out = np.full(len(starts), GOLD, dtype=U)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    some, at = np.arange(len(starts)), 0
    if len(size) and size.max() > LONG:
        for i in np.flatnonzero(size > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        some = np.flatnonzero(size <= LONG)
    while len(some):
        piece = np.ascontiguousarray(wide[starts[some] + at]).view("<u8").ravel()
        left = size[some] - at
        piece &= FIRST[np.minimum(left, 8)]
        out[some] = mix(out[some] * ODD[41] + piece)
        at += 8
        some = some[left > 8]
    return mix(out + size.astype(U) * GOLD)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=U)
    for i in range(n):
        out = mix(out * ODD[20] + words[i : len(words) - n + 1 + i] + U(i))
    return out + U(n)


def pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)
