"""Suffix-array dedup: prefix doubling over the positions of all documents.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a
smaller id. The rank of a string is that of the pair of its halves' ranks, as in prefix doubling,
from 8 bytes (their value) to 16, 32 and `length`. In each round Spark sorts the ranks of all
positions that are left by buckets of the rank, and what the round decides leaves: positions whose
rank is one document's only, and positions that are past the threshold.

All positions don't fit a round: at 4 bytes to ask and more to sort, each would be over 4 times the
input. Of each `length`-byte window only the position with the least 16-byte rank, its anchor, takes
part; equal windows have equal anchors, so nothing is missed, and there is about one anchor in 18 bytes.

1. 16 bytes at the anchors. Anchors whose rank is one document's leave.
2. Whole contexts: the string from an anchor's first window to the end of its last, by the pair of
   the two windows' ranks. Where a smaller document holds the same, all windows are removed and the
   anchor leaves; the smallest document's stay.
3. 32 bytes, at the anchor and 16 before it: each window holds one of the two. What is one
   document's only leaves, and with it the inside of every passage that is the same wherever it is.
4. `length` bytes, for the windows that are left. The smallest document of each keeps it.

Rounds 2 and 4 decide by ranks of 128 bits, from two independent series of pairs. Documents are dealt
to blocks by id. A block sends each rank once in a round, packed, with its smallest document, so a
passage in a third of all documents costs a bucket one entry a block; buckets are dealt by mixed
ranks. A block's anchors are found anew in each round: that costs CPU, where keeping them would cost disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import exchange as X
from larkspur.llm import hashing as H
from larkspur.llm.common import block_count, blocked, lean, text_bytes, union_all

U = np.uint64
FIRST, MIDDLE = 16, 32
CHUNK = 1 << 16
LAST_ID = np.iinfo(np.int64).max


def pair(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """The rank of two strings, one after the other or overlapping; lane: one of two series."""
    return H.mix(a * H.ODD[50 + 2 * lane] + b * H.ODD[51 + 2 * lane])


def _groups(*names: np.ndarray) -> np.ndarray:
    """Where the groups of equal names begin in sorted arrays."""
    if not len(names[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(names[0]) - 1, bool)
    for x in names:
        new |= x[1:] != x[:-1]
    return np.append(0, np.flatnonzero(new) + 1)


def _ordered(first: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order by rank, and where its groups begin; `check` tells equal 64 bits of different strings apart."""
    order = np.argsort(first)
    name = first[order]
    if check is None:
        return order, _groups(name)
    more = check[order]
    if ((name[1:] == name[:-1]) & (more[1:] != more[:-1])).any():
        order = np.lexsort((check, first))
        name, more = first[order], check[order]
    return order, _groups(name, more)


class _Ask:
    """Sorted distinct ranks of a round: 64 bits, and for a decision 64 more and the smallest document of each."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, check: np.ndarray | None = None):
        self.order, self.heads = _ordered(first, check)
        ids = ids[self.order]
        self.group = np.repeat(np.arange(len(self.heads)), np.diff(np.append(self.heads, len(ids))))
        self.keys = first[self.order[self.heads]]
        self.check = None if check is None else check[self.order[self.heads]]
        self.least = np.minimum.reduceat(ids, self.heads) if len(ids) else ids
        self.several = np.maximum.reduceat(ids, self.heads) != self.least if len(ids) else np.zeros(0, bool)

    def rows(self, bits: int) -> Iterator[tuple]:
        for b, lo, hi in X.split(self.keys, bits):
            more = H.pack_bits(self.several[lo:hi]) if self.check is None else self.check[lo:hi].tobytes() + self.least[lo:hi].tobytes()
            yield b, X.short(self.keys[lo:hi], bits), more

    def told(self, replies: dict[int, bytes], bits: int) -> np.ndarray:
        """The reply to each rank."""
        out = np.zeros(len(self.keys), bool)
        for b, lo, hi in X.split(self.keys, bits):
            out[lo:hi] = H.unpack_bits(replies[b], hi - lo)
        return out


class _Block:
    """The documents of a block as one buffer, and the anchors of their windows."""

    def __init__(self, texts: pa.Table, length: int):
        ids = texts.column("doc_id").to_pylist()
        raw = [(LAST_ID if i is None else i, i, t.encode()) for i, t in zip(ids, texts.column("text").to_pylist(), strict=True)]
        raw.sort(key=lambda r: (r[0], r[2]))
        self.length, self.docs = length, raw
        self.ends = np.cumsum(np.array([len(r[2]) for r in raw], dtype=np.int64))
        self.starts = self.ends - [len(r[2]) for r in raw]
        self.buf = np.frombuffer(b"".join(r[2] for r in raw), dtype=np.uint8)
        self.view = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.buf, np.zeros(8, np.uint8)]), 8)
        self.half = min(MIDDLE, (length + FIRST + 1) // 2)
        self._anchors()
        self.ids = np.array([r[0] for r in raw], dtype=np.int64)[np.searchsorted(self.ends, self.pos, side="right")]
        self.gone = [np.zeros((0, 2), np.int64)]  # first and last starts of removed windows

    def _anchors(self) -> None:
        """pos: positions with the least 16-byte rank of a window; low, high: the first and last of these windows."""
        length, n, edge, found = self.length, len(self.buf), 0, []
        width = length - FIRST + 1
        while edge < n:
            end = min(n, edge + CHUNK + length + width)
            last = end == n
            if end - edge >= length:
                word = np.ascontiguousarray(self.view[edge : end - 7]).view("<u8").ravel()
                rank = pair(word[:-8], word[8:], 0)
                top = (rank >> U(32)).astype(np.uint32) | np.uint32(1)
                least = H.sliding(top, width, np.minimum)
                # Windows that a document's end cuts don't count.
                a, z = np.searchsorted(self.ends, [edge, edge + len(least) - 1], side="right")
                for stop in self.ends[a : z + 1]:
                    least[max(0, stop - length + 1 - edge) : max(0, stop - edge)] = 0
                padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
                at = np.flatnonzero(H.sliding(padded, width, np.maximum) == top[: len(least) + width - 1])
                at = at[(at >= (width - 1 if edge else 0)) & (last | (at < CHUNK + width - 1))]  # each with all its windows
                start = at[:, None] + np.arange(1 - width, 1)[None, :]
                mine = (padded[start + width - 1] == top[at][:, None]) & (start < len(least))
                low, high = at - (width - 1) + mine.argmax(axis=1), at - mine[:, ::-1].argmax(axis=1)
                found.append(np.stack([at, low, high]) + edge)
            if last:
                break
            edge += CHUNK
        self.pos, self.low, self.high = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)

    def _keep(self, which: np.ndarray) -> None:
        self.pos, self.low, self.high, self.ids = (x[which] for x in (self.pos, self.low, self.high, self.ids))

    def rank(self, at: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
        """The rank of the n bytes at some positions: 8 bytes by value, more by pairs of halves."""
        if n == 8:
            return np.ascontiguousarray(self.view[at]).view("<u8").ravel()
        half = 8
        while 2 * half < n:
            half *= 2
        return pair(self.rank(at, half, lane), self.rank(at + (n - half), half, lane), lane)

    # The rounds: each takes the replies to the one before.

    def firsts(self) -> _Ask:
        return _Ask(self.ids, H.mix(self.rank(self.pos, FIRST) + H.GOLD))

    def contexts(self, ask: _Ask, repeated: np.ndarray) -> _Ask:
        self._keep(np.sort(ask.order[repeated[ask.group]]))
        place = (self.high - self.low).astype(U) * H.ODD[54] + (self.pos - self.low).astype(U) * H.ODD[55]
        names = [H.mix(pair(self.rank(self.low, self.length, k), self.rank(self.high, self.length, k), k) + place) for k in (0, 1)]
        return _Ask(self.ids, *names)

    def halves(self, ask: _Ask, smaller: np.ndarray) -> _Ask:
        later = np.zeros(len(self.pos), bool)
        later[ask.order] = smaller[ask.group] | (self.ids[ask.order] > ask.least[ask.group])
        self.gone.append(np.stack([self.low[later], self.high[later]], axis=1))
        self._keep(np.flatnonzero(~later))
        # Windows that start up to `reach` before the anchor hold the bytes after it, the others those around it.
        self.reach = self.length - self.half
        self.right, self.left = np.flatnonzero(self.pos - self.high <= self.reach), np.flatnonzero(self.pos - self.low > self.reach)
        names = [self.rank(self.pos[self.right], self.half), H.mix(self.rank(self.pos[self.left] - (self.half - FIRST), self.half) + U(1))]
        return _Ask(np.concatenate([self.ids[self.right], self.ids[self.left]]), np.concatenate(names))

    def windows(self, ask: _Ask, repeated: np.ndarray) -> _Ask:
        again = np.zeros(len(ask.order), bool)
        again[ask.order] = repeated[ask.group]
        r, k = self.right[again[: len(self.right)]], self.left[again[len(self.right) :]]
        first = np.concatenate([np.maximum(self.low[r], self.pos[r] - self.reach), self.low[k]])
        last = np.concatenate([self.high[r], np.minimum(self.high[k], self.pos[k] - self.reach - 1)])
        n = last - first + 1
        self.at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.at_ids = np.repeat(np.concatenate([self.ids[r], self.ids[k]]), n)
        return _Ask(self.at_ids, *(H.mix(self.rank(self.at, self.length, k) + U(2)) for k in (0, 1)))

    def removed(self, ask: _Ask, smaller: np.ndarray) -> np.ndarray:
        """Of each byte of the buffer, whether a window that a smaller document holds covers it."""
        later = ask.order[smaller[ask.group] | (self.at_ids[ask.order] > ask.least[ask.group])]
        every = np.concatenate([*self.gone, np.stack([self.at[later]] * 2, axis=1)])
        edge = np.zeros(len(self.buf) + 1, dtype=np.int32)
        np.add.at(edge, every[:, 0], 1)
        np.add.at(edge, every[:, 1] + self.length, -1)
        return np.cumsum(edge[:-1]) > 0

    def ask(self, rounds: int, replies: pa.Table, bits: int) -> tuple[_Ask, dict[int, bytes]]:
        """The ranks of the given round, from the replies to all before it, and the replies to them, if there are any yet."""
        got: dict[int, dict[int, bytes]] = {}
        for k, b, data in X.rows(replies, "round", "bucket", "bits"):
            got.setdefault(k, {})[b] = data
        ask = self.firsts()
        for k, step in enumerate((self.contexts, self.halves, self.windows)[:rounds]):
            ask = step(ask, ask.told(got.get(k, {}), bits))
        return ask, got.get(rounds, {})


def _judge_repeats(keys: list[np.ndarray], more: list[bytes]) -> np.ndarray:
    """Whether two documents hold each rank."""
    several = np.concatenate([H.unpack_bits(f, len(k)) for k, f in zip(keys, more, strict=True)])
    _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = count > 1
    again[back[several]] = True
    return again[back]


def _judge_owners(keys: list[np.ndarray], more: list[bytes]) -> np.ndarray:
    """Whether another block has a smaller document with each rank."""
    name = np.concatenate(keys)
    check = np.concatenate([np.frombuffer(m, U, len(k)) for k, m in zip(keys, more, strict=True)])
    owner = np.concatenate([np.frombuffer(m, np.int64, len(k), 8 * len(k)) for k, m in zip(keys, more, strict=True)])
    order, heads = _ordered(name, check)
    least = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(order))))
    out = np.zeros(len(name), bool)
    out[order] = least < owner[order]
    return out


def find_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 5 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document.

    spans lists the removed runs as start, end, start, end ... in bytes. length: 32 at least. Texts
    are UTF-8 bytes, whole; null is empty. Documents with one id never count against each other;
    null ids come after all others. An empty table gives an empty one. Other columns are ignored.
    """
    if length < MIDDLE:
        raise ValueError(f"length must be {MIDDLE} at least")
    n_blocks = block_count(text_bytes(docs, text), block_bytes)
    bits = X.bucket_bits(n_blocks)
    texts = blocked(docs, n_blocks, doc_id, text).repartition(n_blocks, "block")

    def asking(rounds: int):
        def run(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
            out = list(_Block(t, length).ask(rounds, replies, bits)[0].rows(bits)) if t.num_rows else []
            return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int32()), "keys": pa.array([o[1] for o in out], pa.binary()), "more": pa.array([o[2] for o in out], pa.binary())})

        return lean(run)

    def judging(rounds: int):
        judge = _judge_owners if rounds % 2 else _judge_repeats

        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            got = X.ordered(t, "block", "keys", "more")
            keys = [np.frombuffer(k, np.uint32) for _, k, _ in got]
            bits_of, lo, out = judge(keys, [m for *_, m in got]), 0, []
            for k in keys:
                out.append(H.pack_bits(bits_of[lo : lo + len(k)]))
                lo += len(k)
            return pa.table({"block": pa.array([g[0] for g in got], pa.int32()), "round": pa.array([rounds] * len(got), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(got), pa.int32()), "bits": pa.array(out, pa.binary())})

        return lean(run)

    def remove(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        out = []
        if t.num_rows:
            block = _Block(t, length)
            ask, last = block.ask(3, replies, bits)
            gone = block.removed(ask, ask.told(last, bits))
            for (_, i, raw), lo, hi in zip(block.docs, block.starts, block.ends, strict=True):
                g = gone[lo:hi]
                turns = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                kept = block.buf[lo:hi][~g].tobytes() if len(turns) else raw
                out.append((i, len(raw), int(g.sum()), len(turns) // 2, hashlib.sha256(kept).hexdigest(), turns.tolist()))
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    none = docs.sparkSession.createDataFrame([], "block int, round int, bucket int, bits binary").repartition(n_blocks, "block")
    told: list[DataFrame] = [none]
    for rounds in range(4):
        asked = texts.groupBy("block").cogroup(union_all(told).groupBy("block")).applyInArrow(asking(rounds), "bucket int, block int, keys binary, more binary")
        judged = asked.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(judging(rounds), "block int, round int, bucket int, bits binary")
        told.append(judged.repartition(n_blocks, "block"))
    return texts.groupBy("block").cogroup(union_all(told).groupBy("block")).applyInArrow(lean(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def op2(docs: DataFrame) -> DataFrame:
    """`find_repeats` of 50 bytes, without the spans; odd rows are as there."""
    return find_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same over documents, each with an id of its own.
OP2_SQL = """
WITH bodies AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 100]) AS rank FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS i FROM bodies)
), first AS (
    SELECT rank, min(doc_id) AS doc_id FROM windows GROUP BY rank
), gone AS (
    SELECT w.doc_id, w.i FROM windows w JOIN first f ON f.rank = w.rank WHERE f.doc_id < w.doc_id
), islands AS (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island
    FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone)
), spans AS (
    SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM islands GROUP BY doc_id, island
), pieces AS (
    SELECT s.doc_id, s.lo, h[2 * coalesce(lag(s.hi) OVER (PARTITION BY s.doc_id ORDER BY s.lo), 0) + 1:2 * s.lo] AS piece FROM spans s JOIN bodies b ON b.doc_id = s.doc_id
), kept AS (
    SELECT p.doc_id, string_agg(piece, '' ORDER BY lo) AS piece FROM pieces p GROUP BY p.doc_id
), removed AS (
    SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM spans GROUP BY doc_id
)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(piece, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256
FROM bodies b LEFT JOIN removed r ON r.doc_id = b.doc_id LEFT JOIN kept k ON k.doc_id = b.doc_id
"""
