"""Benchmark decontamination: the q-gram lemma over overlapping diagonal bands, then banded alignment.

A document is contaminated by a benchmark item of m bytes if a part of it is within
e = floor(RATE * m) edits of the item (UTF-8 bytes of the lowered text, runs of ASCII white space as one space).
Then at least m - q + 1 - q * e of the item's q-grams occur in that part on diagonals at most e apart,
all of them in one of the bands of 2 (e + 1) diagonals that start every e + 1. Bands with that many
shared q-grams are kept and aligned in the band; the rest of a document is never aligned. q is at
most LONGEST, and as long as an item's bound stays positive; items are grouped by q.

The distinct items are written to the shared folder in slices of about SLICE bytes. A task reads
each slice for each batch of its documents and keeps the last few of them: the driver holds no item,
texts are not shuffled and documents are read once. A larger benchmark takes more time, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import hashing as H
from larkspur.llm.common import file_system, release, scratch, text_bytes

U = np.uint64
RATE = 0.06
LONGEST = 12
SLICE = 1 << 20
BITS = 22


def normal(text: str) -> np.ndarray:
    """The bytes that are compared."""
    buf = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    gap = H.SPACE[buf]
    buf = np.where(gap, np.uint8(32), buf)
    drop = gap & np.append(True, gap[:-1]) if len(gap) else gap
    return buf[~drop]


def _trimmed(buf: np.ndarray) -> np.ndarray:
    return buf[:-1] if len(buf) and buf[-1] == 32 else buf


def gram_length(m: int, rate: float = RATE) -> int:
    """The longest q up to LONGEST that leaves the lemma a bound of a fifth of the grams, 1 at least."""
    e = int(rate * m)
    for q in range(min(LONGEST, m), 1, -1):
        if m - q + 1 - q * e >= max(1, (m - q + 1) // 5):
            return q
    return 1


def edits(item: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(least edits between the item and a part of the region, where the part ends), on diagonals low to high only."""
    m, far = len(item), len(item) + 1
    width = high - low + 1
    diag = np.arange(width)
    row = np.where((low + diag >= 0) & (low + diag <= len(region)), 0, far)
    padded = np.concatenate([np.full(max(0, -low) + 1, 256, np.int16), region.astype(np.int16), np.full(max(0, high + m - len(region)) + 2, 256, np.int16)])
    base = max(0, -low) + 1
    for i in range(1, m + 1):
        at = low + diag + i  # region bytes consumed
        same = padded[base + low + i - 1 : base + high + i] == item[i - 1]
        step = np.minimum(row + ~same, np.append(row[1:], far) + 1)
        step = np.where((at >= 0) & (at <= len(region)), step, far)
        row = np.minimum.accumulate(step - diag) + diag
        row = np.where((at >= 0) & (at <= len(region)), row, far)
    best = int(np.argmin(row))
    return int(row[best]), low + best + m


@dataclass
class Group:
    """Items that share a gram length."""

    q: int
    ids: np.ndarray
    items: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    edge: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


class Items:
    """The q-grams of the items, by hash."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE):
        made: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in rows:
            body = _trimmed(normal(text or ""))
            if len(body):
                made.setdefault(gram_length(len(body), rate), []).append((i, body))
        self.groups = []
        for q, some in sorted(made.items()):
            items = [b for _, b in some]
            budget = np.array([int(rate * len(b)) for b in items])
            size = np.array([len(b) for b in items])
            ranks = [H.string_ranks(b, q) for b in items]
            flat, owner = np.concatenate(ranks), np.repeat(np.arange(len(items)), [len(r) for r in ranks])
            place = np.concatenate([np.arange(len(r)) for r in ranks])
            order = np.argsort(flat, kind="stable")
            grams, first = np.unique(flat[order], return_index=True)
            seen = np.zeros(1 << BITS, dtype=bool)
            seen[(grams >> U(64 - BITS)).astype(np.int64)] = True
            self.groups.append(Group(q, np.array([i for i, _ in some]), items, budget, size - q + 1 - q * budget, grams, np.append(first, len(flat)), owner[order], place[order], seen))

    def found(self, texts: list[str]) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each text, (item, edits, start, end) of what it contains; positions in the compared bytes."""
        lo = 0
        while lo < len(texts):
            hi, total = lo + 1, len(texts[lo])
            while hi < len(texts) and total + len(texts[hi]) < 1 << 18:
                total += len(texts[hi])
                hi += 1
            yield from self._found([normal(t) for t in texts[lo:hi]])
            lo = hi

    def _found(self, bodies: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in bodies]
        buf = np.concatenate([np.append(b, np.uint8(10)) for b in bodies])
        ends = np.cumsum([len(b) + 1 for b in bodies])
        for g in self.groups:
            rank = H.string_ranks(buf, g.q)
            at = np.flatnonzero(g.seen[(rank >> U(64 - BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(g.grams, rank[at]), len(g.grams) - 1)
            ok = g.grams[k] == rank[at]
            at, k = at[ok], k[ok]
            if not len(at):
                continue
            # A region has at least the least bound of hits in the length of the longest one.
            span = int(max(len(b) for b in g.items) + 2 * g.budget.max())
            least = int(g.need.min())
            if least > 1:
                near = np.searchsorted(at, at + span, side="right") - np.searchsorted(at, at - span)
                dense = near >= least
                at, k = at[dense], k[dense]
            n = g.edge[k + 1] - g.edge[k]
            which = np.repeat(g.edge[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, item, place = np.repeat(at, n), g.item[which], g.place[which]
            doc = np.searchsorted(ends, at, side="right")
            diag = at - place
            step = g.budget[item] + 1
            band = diag // step
            key = np.concatenate([np.stack([doc, item, band], axis=1), np.stack([doc, item, band - 1], axis=1)])
            name = (key[:, 0] * len(g.items) + key[:, 1]) * (2 * len(buf) + 4) + key[:, 2] + len(buf) + 2
            name, count = np.unique(name, return_counts=True)
            band = name % (2 * len(buf) + 4) - len(buf) - 2
            pair = name // (2 * len(buf) + 4)
            doc, item = pair // len(g.items), pair % len(g.items)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for j in np.flatnonzero(count >= g.need[item]):
                d, i = int(doc[j]), int(item[j])
                if best.get((d, i), (1, 0))[0] == 0:
                    continue  # it can't get better
                e, body, lo = int(g.budget[i]), g.items[i], int(ends[d]) - len(bodies[d]) - 1
                low, high = int(band[j]) * (e + 1) - lo, (int(band[j]) + 2) * (e + 1) - 1 - lo
                if e:
                    cost, end = edits(body, bodies[d], low - e, high + e)
                else:
                    at = next((x for x in range(max(low, 0), high + 1) if np.array_equal(bodies[d][x : x + len(body)], body)), None)
                    cost, end = (1, 0) if at is None else (0, at + len(body))
                if cost <= e and cost < best.get((d, i), (e + 1, 0))[0]:
                    best[d, i] = cost, end
            for (d, i), (cost, end) in best.items():
                out[d].append((int(g.ids[i]), cost, max(0, end - len(g.items[i]) - int(g.budget[i])), end))
        return out


@dataclass(frozen=True)
class Slices:
    """The items in the shared folder: path/slice=0 to path/slice=(n - 1)."""

    path: str
    n: int
    rate: float

    def found(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """As Items.found, over all slices; an item is in one of them."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for k in range(self.n):
            for mine, more in zip(out, _items(self, k).found(texts), strict=True):
                mine += more
        return out


@lru_cache(maxsize=4)
def _items(slices: Slices, k: int) -> Items:
    """The items of a slice: a worker process keeps the last ones."""
    fs, at = file_system(f"{slices.path}/slice={k}")
    files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [r for f in sorted(files) for r in pq.read_table(fs.open_input_file(f)).select(["item", "body"]).to_pylist()]
    return Items([(r["item"], r["body"]) for r in rows], slices.rate)


def slices_of(benchmark: DataFrame, rate: float = RATE, item_id: str = "item_id", text: str = "text") -> Slices:
    """The distinct items with a text, written to the shared folder; drop its path when no result reads it any more."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("body")).filter("item is not null and trim(body) <> ''").distinct()
    n = -(-text_bytes(rows, "body") // SLICE)
    path = scratch(benchmark.sparkSession, "items")
    if n:
        cut = rows.withColumn("slice", F.pmod(F.xxhash64("item", "body"), F.lit(n)).cast("int"))
        cut.repartition(n, "slice").write.partitionBy("slice").parquet(path)
    return Slices(path, n, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits) of the documents that contain items, each item with its fewest edits.

    Items that are null, empty or blank, and rows with a null item id, are found in nothing. A null
    text contains nothing; a null doc_id is kept. Repeated rows, and rows with one id, count once. An
    empty table of either kind gives an empty one. Other columns are ignored, whatever their names.
    """
    slices = slices_of(benchmark, rate, item_id, item_text)

    def search(batches):
        for b in batches:
            hits = [(d, *h) for d, hs in zip(b.column("doc_id").to_pylist(), slices.found([x or "" for x in b.column("text").to_pylist()]), strict=True) for h in hs]
            yield pa.record_batch({"doc_id": pa.array([h[0] for h in hits], pa.int64()), "item_id": pa.array([h[1] for h in hits], pa.int64()), "edits": pa.array([h[2] for h in hits], pa.int32())})
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(search, "doc_id long, item_id long, edits int").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text contains a benchmark item; all columns are kept.

    Each row is judged by its own text, whatever its id. A null text stays; blank or null items and
    rows with a null item id remove nothing. An empty table of documents gives an empty one.
    """
    slices, place = slices_of(benchmark, rate, item_id, item_text), docs.columns.index(text)

    def search(batches):
        for b in batches:
            yield b.filter(pa.array([not h for h in slices.found([x or "" for x in b.column(place).to_pylist()])], pa.bool_()))
        release()

    return docs.mapInArrow(search, docs.schema)


def marked(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, contaminated, item_ids, least_edits) of every row, by its own text; item_ids ascend, comma-joined.

    Null ids and repeated rows are kept. What contains nothing, a null text too, has an empty
    item_ids and a null least_edits. Empty tables and odd items are as in `decontaminate`.
    """
    slices = slices_of(benchmark, rate, item_id, item_text)

    def search(batches):
        for b in batches:
            found = slices.found([x or "" for x in b.column("text").to_pylist()])
            ids = [",".join(map(str, sorted({h[0] for h in hs}))) for hs in found]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "contaminated": pa.array([bool(h) for h in found], pa.bool_()), "item_ids": pa.array(ids, pa.string()), "least_edits": pa.array([min((h[1] for h in hs), default=None) for hs in found], pa.int32())})
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(search, "doc_id long, contaminated boolean, item_ids string, least_edits int")


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`marked` at the default edit rate."""
    return marked(docs, benchmark)
