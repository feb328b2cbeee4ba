"""Sorted keys in packed blocks: blocks of documents ask buckets of a key space about their keys.

A row carries all keys of one block that fall in one bucket, as fixed-width bytes, so a key
costs a few bytes of shuffle and no row. A block sends each key once however many of its
documents hold it; a bucket therefore gets at most one entry a block for the most frequent key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def bucket_bits(n_blocks: int) -> int:
    """A quarter as many buckets as blocks, as a power of two, 64 at least."""
    return max(6, (-(-n_blocks // 4) - 1).bit_length())


def split(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) for the buckets that sorted 64-bit keys fall in, by their top bits."""
    if not len(keys):
        return
    top = keys >> U(64 - bits)
    edges = np.append(np.append(0, np.flatnonzero(top[1:] != top[:-1]) + 1), len(keys))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(top[lo]), int(lo), int(hi)


def short(keys: np.ndarray, bits: int) -> bytes:
    """The 32 bits of each key below those that name its bucket."""
    return ((keys << U(bits)) >> U(32)).astype(np.uint32).tobytes()


def rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    cols = [table.column(n) for n in names]
    for i in range(table.num_rows):
        yield tuple(c[i].as_py() for c in cols)


def ordered(table: pa.Table, by: str, *names: str) -> list[tuple]:
    return sorted(rows(table, by, *names), key=lambda r: r[0])
